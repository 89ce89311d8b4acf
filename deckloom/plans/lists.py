"""Lists to plans: lines, entries, lookup, disposition, credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.functions import text as T
from deckloom.operators import catalogue, lists
from deckloom.plans import views as V
from deckloom.plans.registry import query

BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def entry_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lists.entries(V.requests(spark, sf), "raw")


@query(
    "s1_list_texts",
    f"""SELECT doc_id AS list_id, length(text) AS chars, len(string_split_regex(text, '{BREAKS}')) AS lines FROM documents""",
)
def list_texts(spark, sf):
    text = F.col("text")
    return V.documents(spark, sf).select(
        F.col("doc_id").alias("list_id"), F.length(text).cast("bigint").alias("chars"),
        F.size(T.lines(text)).cast("bigint").alias("lines"),
    )


@query(
    "p1_explode_lines",
    f"""
SELECT list_id, line_no - 1 AS line_no, trim(raw) AS line FROM (
  SELECT doc_id AS list_id, unnest(string_split_regex(text, '{BREAKS}')) AS raw,
    unnest(range(1, len(string_split_regex(text, '{BREAKS}')) + 1)) AS line_no FROM documents)
WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#') AND NOT starts_with(trim(raw), '//')
  AND rtrim(lower(trim(raw)), ':') NOT IN ('deck', 'sideboard', 'commander', 'companion', 'maybeboard', 'tokens')
""",
)
def explode_lines(spark, sf):
    texts = V.documents(spark, sf).withColumnRenamed("doc_id", "list_id")
    return lists.explode_lines(texts, "text", ["list_id"])


@query("p2_parse_entries", "SELECT list_id, line, part, supp, quantity, name FROM v_entry", ("v_entry",))
def parse_entries(spark, sf):
    return entry_lines(spark, sf)


@query(
    "p3_front_name",
    "SELECT card_id, trim(string_split(name, ' // ')[1]) AS front FROM v_card",
    ("v_card",),
)
def front_names(spark, sf):
    return V.cards(spark, sf).select("card_id", catalogue.front_name(F.col("name")).alias("front"))


@query(
    "p7_request_checks",
    r"""
SELECT request_id, reason FROM (
  SELECT doc_id AS request_id, unnest(list_filter([
    CASE WHEN lang = 'es' THEN 'mode' END,
    CASE WHEN trim(text) = '' THEN 'list_required' END,
    CASE WHEN trim(text) <> '' AND length(text) > 20000 THEN 'list_too_long' END,
    CASE WHEN length(source) > 500 THEN 'art_style_too_long' END,
    CASE WHEN n_chars % 3 = 0 AND length(text) > 500 THEN 'custom_art_notes_too_long' END], lambda v: v IS NOT NULL)) AS reason
  FROM documents)
UNION ALL
SELECT list_id, 'too_many_entries' FROM (
  SELECT doc_id AS list_id, trim(unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))) AS line
  FROM documents)
WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '//')
  AND rtrim(lower(line), ':') NOT IN ('deck', 'sideboard', 'commander', 'companion', 'maybeboard', 'tokens')
GROUP BY list_id HAVING count(*) > 20
""",
)
def request_checks(spark, sf):
    """The entry cap is lowered to 20 here so that the test texts reach it."""
    documents = V.documents(spark, sf)
    mode = F.when(F.col("lang") == "en", "CREATIVE_FULL").when(F.col("lang") == "de", "ART_ONLY").when(
        F.col("lang") == "es", "SKETCH"
    )
    notes = F.when(F.col("n_chars") % 3 == 0, F.col("text"))
    reasons = lists.request_violations(mode, F.col("text"), {"art_style": F.col("source"), "custom_art_notes": notes})
    one_by_one = documents.select(F.col("doc_id").alias("request_id"), F.explode(reasons).alias("reason"))
    lines = lists.explode_lines(documents, "text", ["doc_id"])
    capped = lists.over_cap(lines, "doc_id", cap=20)
    return one_by_one.unionByName(
        capped.select(F.col("doc_id").alias("request_id"), F.lit("too_many_entries").alias("reason"))
    )


@query(
    "flow_requests",
    r"""
SELECT request_id, accepted, CASE WHEN accepted THEN style END AS style FROM (
  SELECT d.doc_id AS request_id, lang <> 'es' AND trim(text) <> '' AND length(text) <= 20000 AND length(source) <= 500
      AND NOT (n_chars % 3 = 0 AND length(text) > 500) AND c.list_id IS NULL AS accepted,
    CASE WHEN n_chars % 4 = 0 AND text <> '' THEN trim(left(text, 500), chr(32) || chr(9) || chr(10) || chr(13)) ELSE nullif(trim(source), '') END AS style
  FROM documents d LEFT JOIN (
    SELECT list_id FROM (
      SELECT doc_id AS list_id, trim(unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))) AS line FROM documents)
    WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '//')
      AND rtrim(lower(line), ':') NOT IN ('deck', 'sideboard', 'commander', 'companion', 'maybeboard', 'tokens')
    GROUP BY list_id HAVING count(*) > 20) c ON c.list_id = d.doc_id)
""",
)
def taken_requests(spark, sf):
    """Every request, whether it is taken, and the style it then runs with: a custom one in place of the chosen one."""
    documents = V.documents(spark, sf)
    refused = request_checks(spark, sf).select("request_id").distinct().withColumn("refused", F.lit(True))
    custom = F.when(F.col("n_chars") % 4 == 0, F.col("text"))
    asked = documents.select(F.col("doc_id").alias("request_id"), lists.fold_custom_style(F.col("source"), custom).alias("style"))
    accepted = F.col("refused").isNull()
    return asked.join(refused, "request_id", "left").select("request_id", accepted.alias("accepted"), F.when(accepted, F.col("style")).alias("style"))


@query(
    "j1_resolve_names",
    """SELECT e.list_id, e.line, e.part, e.supp, e.quantity, e.name, a.card_id
FROM v_entry e LEFT JOIN v_alias a ON lower(e.name) = a.alias""",
    ("v_entry", "v_alias"),
)
def resolve_names(spark, sf):
    return catalogue.resolve(entry_lines(spark, sf), V.cards(spark, sf))


@query(
    "j2_unresolved_names",
    """
SELECT list_id, name, line, part, supp FROM (
  SELECT *, row_number() OVER (PARTITION BY list_id, name ORDER BY line, part, supp) AS rn FROM v_entry) e
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_alias a WHERE a.alias = lower(e.name))
""",
    ("v_entry", "v_alias"),
)
def unresolved_names(spark, sf):
    return catalogue.unresolved(entry_lines(spark, sf), V.cards(spark, sf), "list_id", V.LIST_ORDER)


@query(
    "j3_three_way_plan",
    "SELECT list_id, line, part, supp, quantity, name, card_id, reason, faces, disposition FROM v_plan",
    ("v_plan",),
)
def three_way_plan(spark, sf):
    return catalogue.plan_lines(entry_lines(spark, sf), V.cards(spark, sf))


@query(
    "j4_plan_faces",
    """SELECT p.list_id, p.line, p.part, p.supp, p.quantity, p.name, p.card_id, f.face_position, f.name AS face_name,
  f.mana_cost FROM v_plan p JOIN v_face f USING (card_id) WHERE p.disposition = 'entry'""",
    ("v_plan", "v_face"),
)
def plan_faces(spark, sf):
    return catalogue.plan_faces(entry_lines(spark, sf), V.cards(spark, sf))


@query(
    "a3_credits",
    """
SELECT list_id, count(*) AS lines, count(*) FILTER (disposition = 'entry') AS entries,
  count(*) FILTER (disposition = 'unsupported') AS unsupported, count(*) FILTER (disposition = 'unresolved') AS unresolved,
  CAST(COALESCE(sum(faces) FILTER (disposition = 'entry'), 0) AS BIGINT) AS faces,
  CAST(COALESCE(sum(faces * quantity) FILTER (disposition = 'entry'), 0) AS BIGINT) AS credits
FROM v_plan GROUP BY list_id
""",
    ("v_plan",),
)
def credit_counts(spark, sf):
    return catalogue.credits(three_way_plan(spark, sf), "list_id")


@query(
    "w1_ordered_distinct",
    """SELECT list_id, name, line, part, supp FROM (
  SELECT *, row_number() OVER (PARTITION BY list_id, name ORDER BY line, part, supp) AS rn FROM v_entry) WHERE rn = 1""",
    ("v_entry",),
)
def ordered_distinct(spark, sf):
    return lists.first_seen(entry_lines(spark, sf), ["list_id", "name"], V.LIST_ORDER)


@query(
    "w2_request_batches",
    """
SELECT list_id, name, line, part, supp, ordinal, (ordinal - 1) // 3 AS batch FROM (
  SELECT list_id, name, line, part, supp, row_number() OVER (PARTITION BY list_id ORDER BY line, part, supp, name) AS ordinal
  FROM (SELECT *, row_number() OVER (PARTITION BY list_id, name ORDER BY line, part, supp) AS rn FROM v_entry) e
  WHERE rn = 1)
""",
    ("v_entry",),
)
def request_batches(spark, sf):
    """Batches of 3 here, since the test lists are short. A bucket holds one line number's next 1,000 parts."""
    distinct = lists.first_seen(entry_lines(spark, sf), ["list_id", "name"], V.LIST_ORDER)
    bucket = F.struct("line", F.floor(F.col("part") / 1000).alias("block"))
    return lists.request_batches(distinct, ["list_id"], [*V.LIST_ORDER, "name"], bucket, size=3)


