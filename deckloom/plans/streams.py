"""The streaming jobs run to the end of the tables, and the audit that draws on every rule set."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import functions as F

from deckloom.operators import audit, colours, geometry, margins, proof, surfaces
from deckloom.plans import corpus, layout, pixels, proofs
from deckloom.plans import views as V
from deckloom.plans.registry import ORACLES, query
from deckloom.session import fresh
from deckloom.sources import images, pictures
from deckloom.streaming import jobs as streams


def stream(spark, sf, name):
    """A table as a file stream."""
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def places(spark, name: str) -> tuple[str, str]:
    """A new output and checkpoint folder in the shared directory."""
    base = fresh(spark, name)
    return f"{base}/out", f"{base}/state"


def _finish(started) -> None:
    started.awaitTermination()


@query("t1_live_progress")
def live_progress(spark, sf):
    out, state = places(spark, "progress")
    _finish(streams.start_progress(V.results_of(stream(spark, sf, "lineitem")), out, state))
    return streams.read_progress(spark, out, V.jobs(spark, sf))


ORACLES["t1_live_progress"] = ORACLES["a5_job_progress"]


@query("t2_upsert_stream")
def upsert_stream(spark, sf):
    out, state = places(spark, "upserts")
    rows = stream(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    _finish(streams.start_upserts(rows, ["user_id"], ["ts", "event_id"], out, state))
    return streams.read_current(spark, out, ["user_id"], ["ts", "event_id"]).drop("ts")


ORACLES["t2_upsert_stream"] = ORACLES["s6_latest_write"]


@query("t3_first_seen_memo", "SELECT DISTINCT user_id, event_type FROM events")
def first_seen_memo(spark, sf):
    out, state = places(spark, "memo")
    keys = ["user_id", "event_type"]
    _finish(streams.start_memo(stream(spark, sf, "events"), keys, out, state))
    return streams.read_memo(spark, out, keys)


@query(
    "s4_decoded_images",
    """SELECT image_id, 8 AS width, 8 AS height, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b,
  CAST(sum(r * (pos + 1)) AS BIGINT) AS placed FROM v_rgb GROUP BY image_id""",
    ("v_rgb",),
)
def decoded_images(spark, sf):
    """PNG files made from the embeddings, written to the shared folder and read back as a folder of card images."""
    spark.dataSource.register(pictures.PictureFiles)
    path = fresh(spark, "pictures")
    named = V.triples(spark, sf).select(
        F.concat(F.lit("card-"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), pictures.encode("width", "r", "g", "b").alias("data")
    )
    named.write.format("picture_files").mode("append").option("batch", "1").save(path)
    read = images.read_images(spark, path).withColumn("image_id", F.regexp_extract("path", r"card-(\d+)\.png$", 1).cast("bigint"))

    def sum_of(c):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, v: acc + v).alias(c)

    placed = F.aggregate(F.transform("r", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return read.select(
        "image_id", "width", "height", sum_of("r"), sum_of("g"), sum_of("b"), placed.alias("placed")
    )


def _codes(sql: str, key: str) -> str:
    """A gate's own SQL as (face_id, codes)."""
    return f"(SELECT {key} AS face_id, codes FROM ({sql}))"


TITLE_CODES = f"""array_to_string(list_filter([CASE WHEN NOT has_title THEN 'missing_title' END, {proofs._field_sql('name', 'p_title')},
  CASE WHEN n_other > 0 THEN 'text_extra' END], lambda c: c IS NOT NULL), ',')"""
STAMPED_CODES = f"""array_to_string(list_filter([CASE WHEN NOT has_title THEN 'missing_title' END, {proofs._field_sql('name', 'p_title')},
  {proofs._field_sql('type_line', 'p_type')}, {proofs._field_sql('oracle_text', 'p_rules')}, {proofs._field_sql('tab', 'p_tab')},
  CASE WHEN n_loose + n_cost > 0 THEN 'text_extra' END], lambda c: c IS NOT NULL), ',')"""


@query(
    "g11_audit_by_mode",
    f"""
SELECT face_id, array_to_string(list_filter(CASE face_id % 4 WHEN 0 THEN [colour, matte] WHEN 1 THEN [layout, cover, contrast, colour, matte]
  WHEN 2 THEN [CASE WHEN face_id % 3 = 0 THEN stamped ELSE text END, CASE WHEN face_id % 3 = 0 THEN collision END, badge, contrast, colour, matte]
  ELSE [title, collision, layout, cover, contrast, colour, matte] END, lambda c: COALESCE(c, '') <> ''), ',') AS codes
FROM (SELECT f.vec_id AS face_id, g1.codes AS layout, CASE WHEN g4.face_id IS NOT NULL THEN 'cost_no_room' END AS collision,
  CASE WHEN g6.verdict <> '' THEN 'colour_identity' END AS colour, CASE WHEN f.vec_id % 7 <> 0 THEN g8.codes END AS matte,
  g7.codes AS contrast, g9.codes AS cover, g10.codes AS badge, t.text, t.title, t.stamped
FROM embeddings f
LEFT JOIN ({ORACLES["g1_layout_audit"]}) g1 ON g1.face_id = f.vec_id
LEFT JOIN ({ORACLES["g4_cost_collision"]}) g4 ON g4.face_id = f.vec_id
LEFT JOIN ({ORACLES["g6_colour_identity"]}) g6 ON g6.image_id = f.vec_id
LEFT JOIN ({ORACLES["g7_contrast_gate"]}) g7 ON g7.image_id = f.vec_id
LEFT JOIN ({ORACLES["g8_matte_gate"]}) g8 ON g8.image_id = f.vec_id
LEFT JOIN ({ORACLES["g9_obstruction_gate"]}) g9 ON g9.image_id = f.vec_id
LEFT JOIN ({ORACLES["g10_end_badge"]}) g10 ON g10.image_id = f.vec_id
LEFT JOIN (SELECT face_id, {TITLE_CODES} AS title, {STAMPED_CODES} AS stamped,
    array_to_string(list_filter({proofs.CODES_SQL}, lambda c: c IS NOT NULL), ',') AS text
  FROM (SELECT s.*, n_other FROM ({proofs.FACE_SQL}) s JOIN (SELECT e.face_id, count(p.ord) FILTER (surface NOT IN ('title_plate', 'artwork')) AS n_other
    FROM v_expected e LEFT JOIN v_patch p USING (face_id) GROUP BY e.face_id) USING (face_id))) t ON t.face_id = f.vec_id)
""",
    ("v_expected", "v_patch"),
)
def audit_by_mode(spark, sf):
    """Each rule set is worked out beside its own input, for the faces whose mode asks for it; only problem arrays meet, by face."""
    modes = F.array(*[F.lit(m) for m in (audit.ART_ONLY, audit.COMPOSITED, audit.LETTERED, audit.NAME_ONLY)])

    def kind(k):
        return F.get(modes, (k % 4).cast("int")), k % 7 != 0, k % 3 == 0  # mode, borderless, cost stamped

    def asked(df, **sets):
        """The rule sets that share an input, for the faces that any of them is asked for."""
        face = F.col(df.columns[0])
        wanted = {name: audit.needed(name, *kind(face)) for name in sets}
        kept = df.where(reduce(operator.or_, wanted.values()))
        return kept.select(face.alias("face_id"), *[F.when(wanted[name], problems).alias(name) for name, problems in sets.items()])

    both = V.expected(spark, sf).join(V.read_back(spark, sf), "face_id")
    patches, has_title = F.col("patches"), F.col("has_title")
    whole = proof.proofread(patches, has_title, cost_lettered=True, cost_printed=F.col("cost_printed"))
    found = [
        asked(
            layout.panels(spark, sf), layout=geometry.audit(F.col("power"), F.col("paragraphs"), F.col("overflowed")),
            collision=geometry.collision(F.col("tokens")),
        ),
        asked(corpus.colour_profile(spark, sf), colour=colours.identity_problem(corpus.identity_for())),
        asked(pixels.sheet_margins(spark, sf, "black", "matted"), matte=margins.matte_problem()),
        asked(pixels.stripped(spark, sf), contrast=surfaces.contrast_problem(), cover=surfaces.obstruction_problem()),
        asked(surfaces.components(V.grids(spark, sf), ["image_id"]), badge=surfaces.badge_problem(min_width=8, min_height=8)),
        asked(
            both, text=F.when(F.col("face_id") % 3 == 0, proof.proofread(patches, has_title)).otherwise(whole),
            title_text=proof.proofread(patches, has_title, only=["title_plate"]),
        ),
    ]
    joined = audit.gather(V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("face_id")), "face_id", found)
    sets = {name: F.col(name) for name in joined.columns if name != "face_id"}
    problems = audit.by_mode(*kind(F.col("face_id")), sets)
    return joined.select("face_id", F.array_join(F.transform(problems, lambda p: p["code"]), ",").alias("codes"))
