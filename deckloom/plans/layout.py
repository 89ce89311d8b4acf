"""Box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.functions import boxes as B
from deckloom.operators import geometry
from deckloom.plans import views as V
from deckloom.plans.registry import query

ABOUT = ["face_id", "power", "loyalty", "paragraphs", "overflowed", "tokens"]


def panels(spark, sf):
    return geometry.detected(V.raw_boxes(spark, sf), ABOUT)


def raw_lists(spark, sf):
    raw = V.raw_boxes(spark, sf)
    everything = F.concat(
        F.array("title", "type", "pt"), "rules", F.coalesce("spare", F.array().cast("array<array<int>>")), "marks"
    )
    return raw.select("face_id", everything.alias("raw"))


@query("f9_usable_boxes", "SELECT face_id, x0, y0, x1, y1 FROM v_usable", ("v_usable",))
def usable_boxes(spark, sf):
    return raw_lists(spark, sf).select("face_id", F.inline(B.parse_all(F.col("raw"))))


@query(
    "f10_box_arithmetic",
    """
SELECT face_id, x0, y0, (x1 - x0) * (y1 - y0) AS area,
  x0 - CAST(0.015 AS DOUBLE) AS grown_x0, y1 + CAST(0.015 AS DOUBLE) AS grown_y1,
  CAST(0.56 AS DOUBLE) + x0 * (CAST(1.0 AS DOUBLE) - CAST(0.56 AS DOUBLE)) AS card_x0,
  greatest(0.0, least(x1, CAST(0.9 AS DOUBLE)) - greatest(x0, CAST(0.1 AS DOUBLE)))
    * greatest(0.0, least(y1, CAST(0.8 AS DOUBLE)) - greatest(y0, 0.5)) / ((x1 - x0) * (y1 - y0)) AS inside
FROM v_usable
""",
    ("v_usable",),
)
def box_arithmetic(spark, sf):
    b = F.struct("x0", "y0", "x1", "y1")
    panel = B.box(F.lit(0.1), F.lit(0.5), F.lit(0.9), F.lit(0.8))
    return usable_boxes(spark, sf).select(
        "face_id", "x0", "y0", B.area(b).alias("area"), B.grown(b)["x0"].alias("grown_x0"),
        B.grown(b)["y1"].alias("grown_y1"), B.from_crop(b)["x0"].alias("card_x0"), B.share_inside(b, panel).alias("inside"),
    )


@query(
    "f11_marks_kept",
    "SELECT face_id, count(j) AS kept FROM (SELECT face_id FROM v_panels) LEFT JOIN v_mark USING (face_id) GROUP BY face_id",
    ("v_panels", "v_mark"),
)
def marks_kept(spark, sf):
    return panels(spark, sf).select("face_id", F.size("marks").cast("bigint").alias("kept"))


@query(
    "f12_one_or_many",
    """SELECT face_id, count(*) FILTER (face_id % 3 < 2) AS boxes, CAST(COALESCE(sum(ymax) FILTER (face_id % 3 < 2), 0) AS DOUBLE) AS far
FROM v_rawbox WHERE (face_id % 3 = 0 AND j = 3) OR (face_id % 3 > 0 AND j BETWEEN 3 AND 6) GROUP BY face_id""",
    ("v_rawbox",),
)
def one_or_many(spark, sf):
    k = F.col("face_id") % 3
    bare = F.to_json(F.get("rules", F.lit(0)))
    stored = F.when(k == 0, bare).when(k == 1, F.to_json("rules")).otherwise(F.lit("null"))
    listed = B.one_or_many(F.parse_json(stored))
    far = F.aggregate(listed, F.lit(0.0), lambda acc, b: acc + b["x1"])
    return V.raw_boxes(spark, sf).select("face_id", F.size(listed).cast("bigint").alias("boxes"), far.alias("far"))


OFFENDING_SQL = """SELECT m.face_id, m.j, m.x0, m.y0, m.x1, m.y1,
  (m.x1 - m.x0 >= CAST(0.35 AS DOUBLE) AND (m.x1 - m.x0) / (m.y1 - m.y0) >= 3) OR EXISTS (SELECT 1 FROM (
    SELECT face_id, x0, y0, x1, y1 FROM v_usable WHERE surface IN ('title', 'type', 'rules')
    UNION ALL SELECT face_id, px0, py0, px1, py1 FROM v_panels WHERE px0 IS NOT NULL) s
  WHERE s.face_id = m.face_id AND least(m.x1, s.x1 + CAST(0.015 AS DOUBLE)) - greatest(m.x0, s.x0 - CAST(0.015 AS DOUBLE)) > 0
    AND least(m.y1, s.y1 + CAST(0.015 AS DOUBLE)) - greatest(m.y0, s.y0 - CAST(0.015 AS DOUBLE)) > 0) AS offending FROM v_mark m"""


@query(
    "j9_offending_marks",
    f"SELECT face_id, x0, y0, x1, y1, offending, row_number() OVER (PARTITION BY face_id ORDER BY y0, x0, y1, x1) - 1 AS ord FROM ({OFFENDING_SQL})",
    ("v_mark", "v_usable", "v_panels"),
)
def offending(spark, sf):
    return geometry.offending_marks(panels(spark, sf), ["face_id"])


@query(
    "w8_strip_order",
    """SELECT face_id, row_number() OVER (PARTITION BY face_id ORDER BY y0, x0, y1, x1) - 1 AS place, x0, y0, x1, y1
FROM v_usable WHERE surface = 'rules'""",
    ("v_usable",),
)
def strip_order(spark, sf):
    return geometry.ordered(panels(spark, sf), "rules", ["face_id"])


@query(
    "g1_layout_audit",
    f"""
SELECT face_id, array_to_string(list_filter([CASE WHEN tx0 IS NULL THEN 'missing_title' END, CASE WHEN kx0 IS NULL THEN 'missing_type' END,
  CASE WHEN strips = 0 THEN 'missing_rules' END, CASE WHEN power IS NOT NULL AND px0 IS NULL THEN 'missing_pt' END,
  CASE WHEN ty0 > 0.25 THEN 'title_out_of_order' END, CASE WHEN ky0 < ty0 THEN 'type_above_title' END,
  CASE WHEN top_rule < ky0 THEN 'rules_above_type' END, CASE WHEN tx1 - tx0 < CAST(0.6 AS DOUBLE) THEN 'title_too_narrow' END,
  CASE WHEN kx1 - kx0 < CAST(0.45 AS DOUBLE) THEN 'type_too_narrow' END, CASE WHEN overflowed THEN 'text_too_small' END,
  CASE WHEN blank > 0 THEN 'blank_surface' END, CASE WHEN marks > 0 THEN 'painted_marks' END], lambda c: c IS NOT NULL), ',') AS codes, blank
FROM (SELECT p.*, COALESCE(r.strips, 0) AS strips, r.top_rule, COALESCE(o.marks, 0) AS marks,
    COALESCE(s.spare, 0) + CASE WHEN power IS NULL AND px0 IS NOT NULL THEN 1 ELSE 0 END
      + greatest(0, COALESCE(r.strips, 0) - greatest(1, paragraphs)) AS blank
  FROM v_panels p
  LEFT JOIN (SELECT face_id, count(*) AS strips, min(y0) AS top_rule FROM v_usable WHERE surface = 'rules' GROUP BY face_id) r USING (face_id)
  LEFT JOIN (SELECT face_id, count(*) AS spare FROM v_usable WHERE surface = 'spare' GROUP BY face_id) s USING (face_id)
  LEFT JOIN (SELECT face_id, count(*) FILTER (offending) AS marks FROM ({OFFENDING_SQL}) GROUP BY face_id) o USING (face_id))
""",
    ("v_panels", "v_usable", "v_mark"),
)
def layout_audit(spark, sf):
    problems = geometry.audit(F.col("power"), F.col("paragraphs"), F.col("overflowed"))
    found = panels(spark, sf).select("face_id", problems.alias("p"))
    told = F.get(F.filter("p", lambda p: p["code"] == "blank_surface"), F.lit(0))["detail"]
    blank = F.coalesce(F.regexp_extract(told, r"(\d+)$", 1).cast("bigint"), F.lit(0))
    return found.select("face_id", F.array_join(F.transform("p", lambda p: p["code"]), ",").alias("codes"), blank.alias("blank"))


PIP = 0.038 * 0.92


@query(
    "g4_cost_collision",
    f"""
SELECT face_id, nx1 + CAST(0.01 AS DOUBLE) - starts AS short FROM (
  SELECT *, tx1 - ((tokens + greatest(0, tokens - 1) * CAST(0.14 AS DOUBLE)) * (greatest(CAST(0.018 AS DOUBLE), least(CAST({PIP!r} AS DOUBLE),
    (ty1 - ty0) * CAST(0.72 AS DOUBLE))) * CAST(0.75 AS DOUBLE)) * CAST({2400 / 1792!r} AS DOUBLE) + CAST(0.045 AS DOUBLE)) AS starts
  FROM v_panels WHERE tx0 IS NOT NULL AND nx0 IS NOT NULL AND tokens > 0)
WHERE NOT starts >= nx1 + CAST(0.01 AS DOUBLE)
""",
    ("v_panels",),
)
def cost_collisions(spark, sf):
    short = geometry.cost_shortfall(F.col("tokens"))
    return panels(spark, sf).select("face_id", short.alias("short")).where(F.col("short").isNotNull())
