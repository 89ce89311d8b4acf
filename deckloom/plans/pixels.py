"""Image-corpus queries: margins, light, ink."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import margins, scale, surfaces
from deckloom.plans import views as V
from deckloom.plans.registry import query

def depths_sql(match: str, limit: int, prefix: str, source: str = "v_sheet") -> str:
    sides = ", ".join(f"CAST(max(d) FILTER (side = '{s}') AS INTEGER) AS {prefix}_{s}" for s in margins.SIDES)
    return f"""SELECT image_id, {sides} FROM (
    SELECT image_id, side, COALESCE(min(o) FILTER (s < CAST(0.9 AS DOUBLE)), {limit}) AS d FROM (
      SELECT image_id, side, o, count(*) FILTER ({match}) / count(*) AS s FROM {source} WHERE use = 'band' AND o < {limit} GROUP BY image_id, side, o)
    GROUP BY image_id, side) GROUP BY image_id"""


BLACK_SQL = depths_sql("greatest(r, g, b) <= 32", 60, "black")
RING_SQL = "SELECT image_id, r, g, b FROM v_sheet WHERE use = 'ring'"
UPPER = "list_sort(list({c}))[len(list({c})) // 2 + 1]"


def upper(c: str) -> str:
    return UPPER.replace("{c}", c)


BASIS_SQL = f"""SELECT image_id, count(*) AS n, count(*) FILTER (least(r, g, b) > 185) AS n_light,
  count(*) FILTER (least(r, g, b) > 185) >= count(*) * CAST(0.55 AS DOUBLE) AS is_light FROM ({RING_SQL}) GROUP BY image_id"""
MAT_SQL = f"""SELECT image_id, {upper('r')} AS mr, {upper('g')} AS mg, {upper('b')} AS mb FROM ({RING_SQL}) JOIN ({BASIS_SQL}) USING (image_id)
  WHERE NOT is_light OR least(r, g, b) > 185 GROUP BY image_id"""
NEAR = "abs(r - mr) <= 26 AND abs(g - mg) <= 26 AND abs(b - mb) <= 26"
MATTED_SQL = f"""
SELECT image_id, mr, mg, mb, CASE WHEN is_light AND dev > 4 THEN 0.0 WHEN is_light OR (greatest(mr, mg, mb) > 32 AND share >= CAST(0.98 AS DOUBLE) AND dev <= 2) THEN share
  ELSE n_light / n END AS matted
FROM (SELECT image_id, count(*) FILTER ({NEAR}) / count(*) AS share FROM ({RING_SQL}) JOIN ({MAT_SQL}) USING (image_id) GROUP BY image_id)
JOIN ({BASIS_SQL}) USING (image_id) JOIN ({MAT_SQL}) USING (image_id)
LEFT JOIN (SELECT image_id, max(d) AS dev FROM (SELECT image_id, c, median(abs(v - m)) AS d FROM (SELECT image_id, c, v, median(v) OVER (PARTITION BY image_id, c) AS m FROM (
    SELECT image_id, unnest([{{'c': 'r', 'v': r}}, {{'c': 'g', 'v': g}}, {{'c': 'b', 'v': b}}], recursive := true)
    FROM ({RING_SQL}) JOIN ({MAT_SQL}) USING (image_id) JOIN ({BASIS_SQL}) USING (image_id)
    WHERE (is_light AND least(r, g, b) > 185) OR (NOT is_light AND {NEAR}))) GROUP BY image_id, c) GROUP BY image_id) USING (image_id)"""


def sheet_margins(spark, sf, *parts):
    return margins.measure_margins(V.sheets(spark, sf), "image", ["image_id"], parts)


@query("w5_edge_runs", BLACK_SQL, ("v_sheet",))
def edge_runs(spark, sf):
    return sheet_margins(spark, sf, "black").select("image_id", *margins.BLACKS)


@query(
    "i3_black_inset",
    f"SELECT image_id, least(black_top, black_bottom, black_left, black_right) / 200 AS inset FROM ({BLACK_SQL})",
    ("v_sheet",),
)
def black_inset(spark, sf):
    return sheet_margins(spark, sf, "black").select("image_id", margins.black_inset().alias("inset"))


@query("i2_flat_edge_share", f"SELECT image_id, matted FROM ({MATTED_SQL})", ("v_sheet",))
def flat_edge_share(spark, sf):
    return sheet_margins(spark, sf, "matted").select("image_id", "matted")


MAT_DEPTH_SQL = depths_sql(NEAR, 20, "mat", f"(SELECT * FROM v_sheet JOIN ({MAT_SQL}) USING (image_id))")
CORNER_SQL = """SELECT image_id, CASE WHEN paper = 4 AND deepest < 10 THEN deepest ELSE 0 END AS corner
FROM (SELECT image_id, count(*) FILTER (n > 32) AS paper FROM (
    SELECT image_id, side, count(*) FILTER (least(r, g, b) > 242) AS n FROM v_sheet WHERE use = 'box' GROUP BY image_id, side) GROUP BY image_id)
JOIN (SELECT image_id, list_sort(list(d))[CAST(floor(count(*) * CAST(0.98 AS DOUBLE)) AS INTEGER) + 1] AS deepest FROM (
    SELECT image_id, side, p, COALESCE(min(o) FILTER (least(r, g, b) <= 242), 10) AS d FROM v_sheet WHERE use = 'arc' GROUP BY image_id, side, p)
  GROUP BY image_id) USING (image_id)"""
ALL_BLACK, ALL_MAT = (", ".join(names) for names in (margins.BLACKS, margins.MATS))
TRIM_SQL = ", ".join(
    f"""CAST(CASE WHEN matted >= CAST(0.55 AS DOUBLE) THEN CASE WHEN least({ALL_MAT}) > 0 AND greatest({ALL_MAT}) < 20 THEN mat_{s} ELSE 0 END
    WHEN least({ALL_BLACK}) >= 2 AND greatest({ALL_BLACK}) < 20 THEN black_{s} ELSE corner END AS INTEGER) AS "{s}\""""
    for s in margins.SIDES
)


@query(
    "i4_trim_rectangle",
    f"""
SELECT image_id, top, bottom, "left", "right", greatest(top, bottom, "left", "right") / 200 AS depth FROM (
  SELECT image_id, {TRIM_SQL} FROM ({MATTED_SQL}) JOIN ({BLACK_SQL}) USING (image_id) JOIN ({MAT_DEPTH_SQL}) USING (image_id) JOIN ({CORNER_SQL}) USING (image_id))
""",
    ("v_sheet",),
)
def trim_rectangles(spark, sf):
    return margins.trim_rectangle(V.sheets(spark, sf), "image", ["image_id"])


MATTE_SQL = f"""SELECT image_id, CASE WHEN least({ALL_BLACK}) / 200 >= CAST(0.047 AS DOUBLE) OR matted >= CAST(0.55 AS DOUBLE) THEN 'matted' ELSE '' END AS codes
FROM ({MATTED_SQL}) JOIN ({BLACK_SQL}) USING (image_id)"""


@query("g8_matte_gate", MATTE_SQL, ("v_sheet",))
def matte_gate(spark, sf):
    ready = sheet_margins(spark, sf, "black", "matted")
    codes = F.array_join(F.transform(margins.matte_problem(), lambda p: p["code"]), ",")
    return ready.select("image_id", codes.alias("codes"))


# strips of a face over its canvas, in whole pixels
STRIP_SQL = """SELECT face_id AS image_id, j, CAST(floor(x0 * 40) AS INTEGER) AS px0, CAST(floor(y0 * 40) AS INTEGER) AS py0,
  least(CAST(floor(x1 * 40) AS INTEGER), 40) AS px1, least(CAST(floor(y1 * 40) AS INTEGER), 40) AS py1 FROM v_usable WHERE surface = 'rules'"""
GREY = "(r * 19595 + g * 38470 + b * 7471 + 32768) // 65536"
STRIP_MEAN_SQL = f"""SELECT image_id, j, sum({GREY}) / count(*) AS mean FROM ({STRIP_SQL}) JOIN v_canvas USING (image_id)
  WHERE x >= px0 AND x < px1 AND y >= py0 AND y < py1 GROUP BY image_id, j"""
INSET_SQL = f"""SELECT *, CAST(round_even((px1 - px0) * CAST(0.035 AS DOUBLE), 0) AS INTEGER) AS ix, CAST(round_even((py1 - py0) * CAST(0.035 AS DOUBLE), 0) AS INTEGER) AS iy,
  CAST(round_even((px1 - px0) * CAST(0.2 AS DOUBLE), 0) AS INTEGER) AS dx, CAST(round_even((py1 - py0) * CAST(0.2 AS DOUBLE), 0) AS INTEGER) AS dy FROM ({STRIP_SQL})"""
COVER_SQL = f"""
SELECT image_id, j, sum(m) / count(*) / 255 AS cover FROM (
  SELECT image_id, j, CASE WHEN v >= low THEN 0 ELSE CAST(least(255.0, round_even(255 * (low - v) / span, 0)) AS INTEGER) END AS m FROM (
    SELECT image_id, j, v, round_even(paper * (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE)), 0) AS low, greatest(1.0, round_even(paper * CAST(0.12 AS DOUBLE), 0)) AS span
    FROM (SELECT *, max(v) FILTER (rn = CAST(ceil(n * CAST(0.9 AS DOUBLE)) AS INTEGER)) OVER (PARTITION BY image_id, j) AS paper FROM (
      SELECT image_id, j, {GREY} AS v, row_number() OVER (PARTITION BY image_id, j ORDER BY {GREY}) AS rn, count(*) OVER (PARTITION BY image_id, j) AS n
      FROM ({INSET_SQL}) JOIN v_canvas USING (image_id)
      WHERE least(px1 - px0, py1 - py0) >= 2 AND least(px1 - px0 - 2 * ix, py1 - py0 - 2 * iy) >= 2
        AND x >= px0 + ix AND x < px1 - ix AND y >= py0 + iy AND y < py1 - iy))))
WHERE (image_id, j) NOT IN (SELECT (image_id, j) FROM (
  SELECT image_id, j, CAST(0.2126 AS DOUBLE) * (sum(r) / count(*)) + CAST(0.7152 AS DOUBLE) * (sum(g) / count(*)) + CAST(0.0722 AS DOUBLE) * (sum(b) / count(*)) AS luma
  FROM ({INSET_SQL}) JOIN v_canvas USING (image_id)
  WHERE x >= px0 + dx AND x < greatest(px0 + dx + 1, px1 - dx) AND y >= py0 + dy AND y < greatest(py0 + dy + 1, py1 - dy) GROUP BY image_id, j) WHERE luma < 128)
GROUP BY image_id, j"""
WORST_SQL = f"""SELECT vec_id AS image_id, worst_mean, worst_cover FROM v_scaled
  LEFT JOIN (SELECT image_id, min(mean) AS worst_mean FROM ({STRIP_MEAN_SQL}) GROUP BY image_id) m ON vec_id = m.image_id
  LEFT JOIN (SELECT image_id, max(cover) AS worst_cover FROM ({COVER_SQL}) GROUP BY image_id) c ON vec_id = c.image_id"""


def stripped(spark, sf):
    """Test strips are a few pixels high, so the smallest side is 2 here."""
    rows = V.canvas_strips(spark, sf).withColumn("rules", surfaces.strip_boxes(F.col("rules")))
    return surfaces.strips(rows, ["image_id"], min_side=2)


STRIP_VIEWS = ("v_canvas", "v_usable", "v_scaled")


@query("a12_worst_of_strips", WORST_SQL, STRIP_VIEWS)
def worst_of_strips(spark, sf):
    return stripped(spark, sf).select(
        "image_id", surfaces.worst_mean().alias("worst_mean"), surfaces.worst_cover().alias("worst_cover")
    )


def lum_sql(v: str) -> str:
    return f"CASE WHEN {v} / 255 <= CAST(0.03928 AS DOUBLE) THEN {v} / 255 / CAST(12.92 AS DOUBLE) ELSE pow(({v} / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) END"


@query(
    "f7_contrast",
    f"SELECT image_id, y, x, round(({lum_sql('v')} + CAST(0.05 AS DOUBLE)) / ({lum_sql('20')} + CAST(0.05 AS DOUBLE)), 6) AS contrast FROM v_grid",
    ("v_grid",),
)
def contrasts(spark, sf):
    from deckloom.functions import colour as K

    pixels = V.grids(spark, sf).select("image_id", F.posexplode("px").alias("at", "v"))
    return pixels.select(
        "image_id", F.floor(F.col("at") / 8).alias("y"), (F.col("at") % 8).cast("bigint").alias("x"),
        F.round(K.contrast(F.col("v"), F.lit(20)), 6).alias("contrast"),
    )


CONTRAST_SQL = f"""SELECT image_id, CASE WHEN ({lum_sql('worst_mean')} + CAST(0.05 AS DOUBLE)) / ({lum_sql('20')} + CAST(0.05 AS DOUBLE)) < 5 THEN 'panel_too_dark' ELSE '' END AS codes
FROM ({WORST_SQL})"""
OBSTRUCTED_SQL = f"SELECT image_id, CASE WHEN worst_cover > CAST(0.05 AS DOUBLE) THEN 'panel_obstructed' ELSE '' END AS codes FROM ({WORST_SQL})"


def codes_of(problems):
    return F.array_join(F.transform(problems, lambda p: p["code"]), ",").alias("codes")


@query("g7_contrast_gate", CONTRAST_SQL, STRIP_VIEWS)
def contrast_gate(spark, sf):
    return stripped(spark, sf).select("image_id", codes_of(surfaces.contrast_problem()))


@query("g9_obstruction_gate", OBSTRUCTED_SQL, STRIP_VIEWS)
def obstruction_gate(spark, sf):
    return stripped(spark, sf).select("image_id", codes_of(surfaces.obstruction_problem()))


@query(
    "a11_discrete_percentiles",
    """
SELECT 'paper' AS kind, CAST(image_id AS VARCHAR) AS grp, CAST(max(v) FILTER (rn = CAST(ceil(n * CAST(0.9 AS DOUBLE)) AS INTEGER)) AS DOUBLE) AS value FROM (
  SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM v_grid) GROUP BY image_id
UNION ALL
SELECT 'depth', l_returnflag, max(l_extendedprice) FILTER (rn = CAST(floor(n * CAST(0.98 AS DOUBLE)) AS BIGINT) + 1) FROM (
  SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag
""",
    ("v_grid",),
)
def discrete_percentiles(spark, sf):
    paper = V.grids(spark, sf).select(
        F.lit("paper").alias("kind"), F.col("image_id").cast("string").alias("grp"),
        surfaces.paper_level(F.col("px")).cast("double").alias("value"),
    )
    rank = F.floor(F.col("_total") * 0.98) + 1
    deep = scale.value_at_rank(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", rank, "value")
    return paper.unionAll(deep.select(F.lit("depth"), "l_returnflag", "value"))


MASK_SQL = """SELECT image_id, y, x FROM (SELECT *, max(d) FILTER (rd = 33) OVER (PARTITION BY image_id) AS spread FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d) AS rd FROM (SELECT *, abs(v - med) AS d FROM (
    SELECT *, max(v) FILTER (rv = 33) OVER (PARTITION BY image_id) AS med FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) AS rv FROM v_grid))))) WHERE d >= greatest(18, spread * 3)"""
ISLAND_SQL = f"""
WITH RECURSIVE ink AS (SELECT image_id, y, x, y * 8 + x AS id FROM ({MASK_SQL})),
reach AS (SELECT image_id, y, x, id AS seed FROM ink
  UNION SELECT i.image_id, i.y, i.x, r.seed FROM reach r JOIN ink i ON i.image_id = r.image_id AND abs(i.y - r.y) + abs(i.x - r.x) = 1)
SELECT image_id, CAST(count(*) AS INTEGER) AS mass, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0,
  CAST(max(x) + 1 AS INTEGER) AS x1, CAST(max(y) + 1 AS INTEGER) AS y1 FROM (
  SELECT image_id, y, x, min(seed) AS label FROM reach GROUP BY image_id, y, x) GROUP BY image_id, label"""


@query("i5_ink_components", ISLAND_SQL, ("v_grid",))
def ink_components(spark, sf):
    found = surfaces.components(V.grids(spark, sf), ["image_id"])
    return found.select("image_id", F.inline("islands"))


@query(
    "g10_end_badge",
    f"""{ISLAND_SQL.replace("SELECT image_id, CAST(count(*)", ", islands AS (SELECT image_id, CAST(count(*)")})
SELECT vec_id AS image_id, CASE WHEN EXISTS (SELECT 1 FROM islands i WHERE i.image_id = vec_id AND (x0 + x1) / 2 / 8 >= CAST(0.8 AS DOUBLE)
  AND (y1 - y0) / 8 >= CAST(0.55 AS DOUBLE) AND (x1 - x0) / (y1 - y0) BETWEEN CAST(0.4 AS DOUBLE) AND CAST(2.2 AS DOUBLE)
  AND mass / ((x1 - x0) * (y1 - y0)) >= CAST(0.12 AS DOUBLE) AND mass / 64 >= CAST(0.01 AS DOUBLE)) THEN 'painted_marks' ELSE '' END AS codes
FROM v_scaled""",
    ("v_grid", "v_scaled"),
)
def end_badge(spark, sf):
    """The grid stands for a type strip; its 8 pixels are allowed as a strip's smallest size here."""
    found = surfaces.components(V.grids(spark, sf), ["image_id"])
    return found.select("image_id", codes_of(surfaces.badge_problem(min_width=8, min_height=8)))


EDGE_SQL = """SELECT a.image_id, a.y - 1 AS y, greatest(0, least(255, 9 * a.v - sum(b.v))) AS e FROM v_grid a JOIN v_grid b
  ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
  WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY a.image_id, a.y, a.x, a.v"""


@query(
    "i6_band_energy",
    f"""SELECT image_id, substance, CASE WHEN whole > 0 THEN substance / whole ELSE 0.0 END AS liveliness FROM (
  SELECT image_id, sum(e) FILTER (y >= 4) / count(*) FILTER (y >= 4) AS substance, sum(e) / count(*) AS whole FROM ({EDGE_SQL}) GROUP BY image_id)""",
    ("v_grid",),
)
def band_energy(spark, sf):
    return surfaces.band_energy(V.grids(spark, sf), ["image_id"])


@query(
    "i7_light_direction",
    """SELECT image_id, CASE WHEN sum(v) FILTER (x < 4) >= sum(v) FILTER (x >= 4) THEN 1 ELSE -1 END AS light_x,
  CASE WHEN sum(v) FILTER (y < 4) >= sum(v) FILTER (y >= 4) THEN 1 ELSE -1 END AS light_y FROM v_grid GROUP BY image_id""",
    ("v_grid",),
)
def light_direction(spark, sf):
    return surfaces.light_direction(V.grids(spark, sf), ["image_id"])


