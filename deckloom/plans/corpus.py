"""Image-corpus queries: structure and colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import colour as K
from deckloom.operators import colours, structure
from deckloom.plans import views as V
from deckloom.plans.registry import query
from deckloom.session import fresh
from deckloom.sources import records

# On 8×8 test grids the published limits never trip, so the queries pass their own.
SIGMA, SHARE, BAND = 1.0, 0.25, 0.25


def measured(spark, sf):
    archetype = F.when(F.col("label") == 0, "panel").when(F.col("label") < 4, "portal")
    images = V.grids(spark, sf).withColumn("archetype", archetype)
    return structure.measure(images, ["image_id", "batch", "archetype"], SIGMA, SHARE, BAND, BAND)


GRAD_SQL = """SELECT * FROM (SELECT image_id, label, batch, y, x, abs(v - lead(v) OVER (PARTITION BY image_id, x ORDER BY y)) AS g FROM v_grid) WHERE g IS NOT NULL"""
LIMIT_SQL = f"""SELECT image_id, sum(g) / count(*) + {SIGMA} * (sqrt(CAST(count(*) * sum(g * g) - sum(g) * sum(g) AS DOUBLE)) / count(*)) AS lim
FROM ({GRAD_SQL}) GROUP BY image_id"""
MEASURE_SQL = f"""
SELECT a.image_id, b.batch, b.archetype, ruled_rows, widest_edge, band_structure, interior_energy FROM (
  SELECT image_id, count(*) FILTER (s > {SHARE}) AS ruled_rows, max(s) AS widest_edge FROM (
    SELECT image_id, y, count(*) FILTER (g > lim) / 8 AS s FROM ({GRAD_SQL}) JOIN ({LIMIT_SQL}) USING (image_id) GROUP BY image_id, y) GROUP BY image_id) a
JOIN (SELECT image_id, batch, CASE WHEN label = 0 THEN 'panel' WHEN label < 4 THEN 'portal' END AS archetype,
    least(sum(g) FILTER (y < 1) / count(*) FILTER (y < 1), sum(g) FILTER (y = 6) / count(*) FILTER (y = 6),
      sum(g) FILTER (x < 2) / count(*) FILTER (x < 2), sum(g) FILTER (x >= 6) / count(*) FILTER (x >= 6)) AS band_structure,
    sum(g) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 4) / count(*) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 4) AS interior_energy
  FROM ({GRAD_SQL}) GROUP BY ALL) b USING (image_id)"""


@query("w3_vertical_gradient", f"SELECT image_id, y, x, g FROM ({GRAD_SQL})", ("v_grid",))
def vertical_gradient(spark, sf):
    return structure.vertical_gradient(V.grids(spark, sf))


@query(
    "a7_mean_and_deviation",
    """SELECT image_id, sum(v) / count(*) AS mean, sqrt(CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE)) / count(*) AS deviation
FROM v_grid GROUP BY image_id""",
    ("v_grid",),
)
def mean_and_deviation(spark, sf):
    return structure.spread(V.grids(spark, sf))


@query("i1_structure_metrics", MEASURE_SQL, ("v_grid",))
def structure_metrics(spark, sf):
    return measured(spark, sf)


GRADED_SQL = f"""SELECT *, list_filter([CASE WHEN ruled_rows > CASE WHEN archetype = 'panel' THEN 12 ELSE 4 END THEN 'ruled' END,
  CASE WHEN widest_edge > CASE WHEN archetype = 'panel' THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.62 AS DOUBLE) END THEN 'wide_rim' END,
  CASE WHEN interior_energy > 9.5 THEN 'busy' END], lambda c: c IS NOT NULL) AS codes FROM ({MEASURE_SQL})"""


def graded(spark, sf):
    return measured(spark, sf).withColumn("problems", structure.grade(F.col("archetype")))


@query("g5_structure_gates", f"SELECT image_id, array_to_string(codes, ',') AS codes FROM ({GRADED_SQL})", ("v_grid",))
def structure_gates(spark, sf):
    codes = F.array_join(F.transform("problems", lambda p: p["code"]), ",")
    return graded(spark, sf).select("image_id", codes.alias("codes"))


@query(
    "flow_score",
    f"SELECT image_id, ruled_rows, widest_edge, band_structure, interior_energy, array_to_string(codes, ',') AS codes FROM ({GRADED_SQL})",
    ("v_grid",),
)
def score_flow(spark, sf):
    """Stored grey images, as the image source gives them, to metrics and problems."""
    digits = F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    image = F.struct("width", "height", F.lit(1).alias("nChannels"), F.unhex(digits).alias("data"))
    stored = V.grids(spark, sf).select("image_id", "label", image.alias("image"))
    archetype = F.when(F.col("label") == 0, "panel").when(F.col("label") < 4, "portal")
    found = structure.score_corpus(stored, "image", ["image_id"], archetype, sigma=SIGMA, share=SHARE, band=BAND, inset=BAND)
    codes = F.array_join(F.transform("problems", lambda p: p["code"]), ",")
    return found.select("image_id", *structure.METRICS, codes.alias("codes"))


@query(
    "a13_scoreboard",
    f"""SELECT batch, archetype, count(*) AS total, count(*) FILTER (len(codes) > 0) AS failures, count(*) FILTER (len(codes) = 0) AS inside
FROM ({GRADED_SQL}) GROUP BY batch, archetype""",
    ("v_grid",),
)
def scoreboard(spark, sf):
    return structure.scoreboard(graded(spark, sf), ["batch", "archetype"])


@query(
    "o1_corpus_listing",
    f"SELECT image_id, ruled_rows, widest_edge FROM ({MEASURE_SQL}) ORDER BY ruled_rows DESC, image_id",
    ("v_grid",),
)
def corpus_listing(spark, sf):
    return structure.listing(measured(spark, sf).select("image_id", "ruled_rows", "widest_edge"))


SUMMARY_SQL = f"""
SELECT batch, metric, CAST(sum(CAST(value AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean, min(value) AS min, max(value) AS max,
  max(value) FILTER (rn = n // 2 + 1) AS median
FROM (SELECT batch, metric, value, row_number() OVER (PARTITION BY batch, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY batch, metric) AS n
  FROM (SELECT batch, 'ruled_rows' AS metric, CAST(ruled_rows AS DOUBLE) AS value FROM ({MEASURE_SQL}) UNION ALL
        SELECT batch, 'widest_edge', widest_edge FROM ({MEASURE_SQL}) UNION ALL SELECT batch, 'band_structure', band_structure FROM ({MEASURE_SQL})
        UNION ALL SELECT batch, 'interior_energy', interior_energy FROM ({MEASURE_SQL})))
GROUP BY batch, metric"""


def summary(spark, sf):
    return structure.summarise(structure.tall_metrics(measured(spark, sf), ["batch"]), ["batch", "metric"])


@query("a1_corpus_summary", SUMMARY_SQL, ("v_grid",))
def corpus_summary(spark, sf):
    return summary(spark, sf)


@query(
    "j8_batch_against_baseline",
    f"""SELECT b.metric, b.mean AS theirs, o.mean AS ours, o.mean - b.mean AS delta, abs(o.mean - b.mean) > b.mean AS flagged
FROM ({SUMMARY_SQL}) b JOIN ({SUMMARY_SQL}) o ON b.metric = o.metric AND b.batch = 'baseline' AND o.batch = 'batch'""",
    ("v_grid",),
)
def batch_against_baseline(spark, sf):
    return structure.compare(summary(spark, sf))


@query(
    "s8_corpus_report",
    f"""SELECT 'card ' || image_id AS name, CAST(to_json({{'ruled_rows': ruled_rows, 'batch': batch}}) AS VARCHAR) AS metrics FROM ({MEASURE_SQL})""",
    ("v_grid",),
)
def corpus_report(spark, sf):
    """Written to the shared folder beside its summary, and read back."""
    rows = measured(spark, sf)
    cards = records.report_rows(rows, F.concat(F.lit("card "), F.col("image_id").cast("string")), ["ruled_rows", "batch"])
    path = fresh(spark, "report")
    records.write_report(rows.groupBy("batch").agg(F.sum("ruled_rows").alias("ruled_rows")), cards, path)
    return records.read_report(spark, path)[1]


HSV_SQL = """SELECT image_id, pos, r, g, b, span, CASE WHEN span > 0 THEN span / top ELSE 0 END AS sat, top AS val,
  CASE WHEN span > 0 THEN (six - floor(six)) * 360 ELSE 0.0 END AS hue FROM (
  SELECT *, CASE WHEN r / 255 = top THEN (top - b / 255) / span - (top - g / 255) / span
    WHEN g / 255 = top THEN 2.0 + (top - r / 255) / span - (top - b / 255) / span
    ELSE 4.0 + (top - g / 255) / span - (top - r / 255) / span END / 6 AS six
  FROM (SELECT *, greatest(r / 255, g / 255, b / 255) AS top, greatest(r / 255, g / 255, b / 255) - least(r / 255, g / 255, b / 255) AS span FROM {view}))"""
BUCKET_SQL = """CASE WHEN hue >= 345 OR hue < 25 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 170 THEN 'green'
  WHEN hue < 200 THEN 'cyan' WHEN hue < 255 THEN 'blue' WHEN hue < 300 THEN 'purple' ELSE 'magenta' END"""


def profile_sql(view: str, pos: str = "pos") -> str:
    hsv = HSV_SQL.replace("{view}", view).replace("image_id, pos,", f"image_id, {pos},")
    counts = ", ".join(f"count(*) FILTER (sat > CAST(0.3 AS DOUBLE) AND val > 0.25 AND {BUCKET_SQL} = '{b}') AS {b}" for b in colours.BUCKETS)
    return f"SELECT image_id, count(*) AS pixels, count(*) FILTER (sat > CAST(0.3 AS DOUBLE) AND val > 0.25) AS saturated, {counts} FROM ({hsv}) GROUP BY image_id"


@query(
    "f8_hue_buckets",
    f"SELECT image_id, pos, hue, {BUCKET_SQL} AS bucket FROM ({HSV_SQL.replace('{view}', 'v_rgb')})",
    ("v_rgb",),
)
def hue_buckets(spark, sf):
    pixels = V.triples(spark, sf).select("image_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pos", "p"))
    hue = K.hue_degrees(F.col("p.r"), F.col("p.g"), F.col("p.b"))
    return pixels.select("image_id", F.col("pos").cast("bigint"), hue.alias("hue"), K.hue_bucket(hue).alias("bucket"))


@query("a8_colour_profile", profile_sql("v_rgb"), ("v_rgb",))
def colour_profile(spark, sf):
    return colours.profile(V.triples(spark, sf))


MANA_SQL = """SELECT *, CASE WHEN saturated > 0 THEN red / saturated + orange / saturated ELSE 0 END AS sr,
  CASE WHEN saturated > 0 THEN green / saturated ELSE 0 END AS sg, CASE WHEN saturated > 0 THEN cyan / saturated + blue / saturated ELSE 0 END AS su,
  CASE WHEN saturated > 0 THEN purple / saturated + magenta / saturated ELSE 0 END AS sb FROM ({profile})"""


def mana_sql(view: str, pos: str = "pos") -> str:
    return MANA_SQL.replace("{profile}", profile_sql(view, pos))


LEADER_SQL = "CASE WHEN sr >= greatest(sg, su, sb) THEN 'R' WHEN sg >= greatest(su, sb) THEN 'G' WHEN su >= sb THEN 'U' ELSE 'B' END"


@query(
    "a9_leading_mana",
    f"SELECT image_id, {LEADER_SQL} AS mana, greatest(sr, sg, su, sb) AS share FROM ({mana_sql('v_rgb')})",
    ("v_rgb",),
)
def leading_mana(spark, sf):
    return colours.leading_mana(colours.tall_mana(colour_profile(spark, sf)))


@query(
    "a10_robust_spread",
    """
SELECT image_id, greatest(max(d) FILTER (c = 'r'), max(d) FILTER (c = 'g'), max(d) FILTER (c = 'b')) AS deviation FROM (
  SELECT image_id, c, median(abs(v - m)) AS d FROM (SELECT *, median(v) OVER (PARTITION BY image_id, c) AS m FROM (
    SELECT image_id, 'r' AS c, r AS v FROM v_rgb UNION ALL SELECT image_id, 'g', g FROM v_rgb UNION ALL SELECT image_id, 'b', b FROM v_rgb))
  GROUP BY image_id, c) GROUP BY image_id
""",
    ("v_rgb",),
)
def robust_spread(spark, sf):
    return colours.robust_spread(V.triples(spark, sf))


IDENTITY_SQL = """CASE image_id % 6 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['G'] WHEN 2 THEN ['R'] WHEN 3 THEN ['B'] WHEN 4 THEN ['W'] ELSE ['R', 'U'] END"""


def identity_for():
    k = F.col("image_id") % 6
    letters = {1: ["G"], 2: ["R"], 3: ["B"], 4: ["W"], 5: ["R", "U"]}
    out = F.array().cast("array<string>")
    for which, mana in letters.items():
        out = F.when(k == which, F.array(*[F.lit(m) for m in mana])).otherwise(out)
    return out


def identity_sql(view: str, pos: str = "pos") -> str:
    return f"""SELECT image_id, CASE WHEN NOT list_contains(ident, 'B') AND saturated / pixels >= CAST(0.15 AS DOUBLE) AND sb >= CAST(0.15 AS DOUBLE) THEN 'purple'
  WHEN saturated / pixels < CAST(0.15 AS DOUBLE) OR list_contains(ident, lead) THEN '' WHEN greatest(sr, sg, su, sb) >= CAST(0.6 AS DOUBLE) THEN 'reads'
  WHEN len(list_filter(ident, lambda m: m <> 'W')) > 0 AND CASE WHEN list_contains(ident, 'R') THEN sr ELSE 0 END + CASE WHEN list_contains(ident, 'G') THEN sg ELSE 0 END
    + CASE WHEN list_contains(ident, 'U') THEN su ELSE 0 END + CASE WHEN list_contains(ident, 'B') THEN sb ELSE 0 END < CAST(0.4 AS DOUBLE) THEN 'own' ELSE '' END AS verdict
FROM (SELECT *, {LEADER_SQL} AS lead, {IDENTITY_SQL} AS ident FROM ({mana_sql(view, pos)}))"""


@query("g6_colour_identity", identity_sql("v_rgb"), ("v_rgb",))
def colour_identity(spark, sf):
    found = colour_profile(spark, sf).select("image_id", colours.identity_problem(identity_for()).alias("p"))
    detail = F.get("p", F.lit(0))["detail"]
    verdict = F.coalesce(F.regexp_extract(detail, "^(purple|reads|own)", 1), F.lit(""))
    return found.select("image_id", verdict.alias("verdict"))


