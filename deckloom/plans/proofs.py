"""Text queries: normal forms, tokens, proofreading, held-out checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import text as T
from deckloom.operators import proof
from deckloom.plans import views as V
from deckloom.plans.registry import query

WHITE = T.WHITE
FOLD_TO = C.FOLD_TO.replace("'", "''")


def norm_sql(text: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(translate({text}, '{C.FOLD_FROM}', '{FOLD_TO}'), '[{{}}]', '', 'g'), "
        f"'{WHITE}+', ' ', 'g')))"
    )


def quotes_sql(text: str) -> str:
    single = f"replace(regexp_replace({text}, '([\\p{{L}}\\p{{N}}])''', '\\1’', 'g'), '''', '‘')"
    return f"replace(regexp_replace({single}, '([\\p{{L}}\\p{{N}}.,!?])\"', '\\1”', 'g'), '\"', '“')"


def key_sql(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("f1_normalised_texts", f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {norm_sql('text')} AS t FROM documents)")
def normalised_texts(spark, sf):
    text = T.normalise(F.col("text"))
    return V.documents(spark, sf).select(
        "doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest")
    )


@query("f5_smart_quotes", f"SELECT page_id, md5({quotes_sql('html')}) AS digest FROM pages")
def typographic_quotes(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.md5(T.smart_quotes(F.col("html"))).alias("digest"))


@query(
    "f6_shortened",
    "SELECT doc_id, CASE WHEN length(text) > 90 THEN left(text, 89) || '…' ELSE text END AS shown FROM documents",
)
def shortened(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.shorten(F.col("text")).alias("shown"))


@query(
    "f4_paragraph_facts",
    r"""
SELECT doc_id, no - 1 AS paragraph_no, regexp_matches(trim(p), '^[A-Z][A-Za-z ]*(?:,\s*[a-z][A-Za-z ]*)*$') AND length(p) < 60 AS keyword,
  regexp_extract(p, '^([A-Z][A-Za-z''’ ]{2,24}) — ', 1) AS ability,
  len(regexp_extract_all(p, '\(')) - len(regexp_extract_all(p, '\)')) AS depth
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)
""",
)
def paragraph_facts(spark, sf):
    paragraphs = V.documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_no", "p")
    )
    depth = F.regexp_count("p", F.lit(r"\(")) - F.regexp_count("p", F.lit(r"\)"))
    return paragraphs.select(
        "doc_id", F.col("paragraph_no").cast("bigint"), T.is_keyword_line(F.col("p")).alias("keyword"),
        T.ability_word(F.col("p")).alias("ability"), depth.cast("bigint").alias("depth"),
    )


@query(
    "w9_rules_tokens",
    f"""
SELECT doc_id, paragraph_no, count(*) AS pieces, CAST(sum(word_no * CAST(italic AS INTEGER)) AS BIGINT) AS italic_places,
  count(*) FILTER (symbol) AS symbols, count(*) FILTER (keyword) AS keywords, count(*) FILTER (flavour) AS flavours, CAST(sum(length(text)) AS BIGINT) AS chars
FROM (
  SELECT doc_id, paragraph_no, word_no, piece[1] AS text, piece[2] = 's' AS symbol, piece[2] <> 's' AND (italic OR flav) AS italic,
    piece[2] <> 's' AND keyword AS keyword, piece[2] <> 's' AND flav AS flavour
  FROM (SELECT *, unnest(list_filter(flatten(list_transform(list_zip(string_split_regex(word, '\\{{([^}}]{{1,6}})\\}}'),
          regexp_extract_all(word, '\\{{([^}}]{{1,6}})\\}}')), lambda z: [[z[1], 't'], [z[2], 's']])), lambda r: COALESCE(r[1], '') <> '')) AS piece
    FROM (SELECT *, word_no < n_open OR COALESCE(lag(depth) OVER w, 0) > 0 OR turn > 0 AS italic
      FROM (SELECT *, s - least(0, min(s) OVER w) AS depth
        FROM (SELECT *, sum(turn) OVER w AS s
          FROM (SELECT *, len(regexp_extract_all(word, '\\(')) - len(regexp_extract_all(word, '\\)')) AS turn
            FROM (SELECT doc_id, paragraph_no, flav, keyword, n_open, unnest(words) AS word, unnest(range(0, len(words))) AS word_no
              FROM (SELECT doc_id, paragraph_no, flav, regexp_matches(trim(p), '{C.KEYWORD_LINE}') AND length(p) < 60 AND NOT flav AS keyword,
                  len(list_filter(string_split_regex(regexp_extract(p, '^([A-Z][A-Za-z''’ ]{{2,24}}) — ', 1), '{WHITE}+'), lambda v: v <> '')) AS n_open,
                  list_filter(string_split_regex(p, '{WHITE}+'), lambda v: v <> '') AS words
                FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS p, unnest(range(0, len(string_split(t, chr(10))))) AS paragraph_no, false AS flav
                      FROM (SELECT doc_id, {quotes_sql('text')} AS t FROM documents)
                      UNION ALL SELECT doc_id, source, len(string_split(text, chr(10))), true FROM documents WHERE doc_id % 10 = 0))))
          WINDOW w AS (PARTITION BY doc_id, paragraph_no ORDER BY word_no ROWS UNBOUNDED PRECEDING))
        WINDOW w AS (PARTITION BY doc_id, paragraph_no ORDER BY word_no ROWS UNBOUNDED PRECEDING))
      WINDOW w AS (PARTITION BY doc_id, paragraph_no ORDER BY word_no))))
GROUP BY doc_id, paragraph_no
""",
)
def rules_token_counts(spark, sf):
    texts = V.documents(spark, sf).withColumn("flavour", F.when(F.col("doc_id") % 10 == 0, F.col("source")))
    tokens = proof.rules_tokens(texts, ["doc_id"], "text", "flavour")
    return tokens.groupBy("doc_id", "paragraph_no").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.sum(F.when(F.col("italic"), F.col("word_no")).otherwise(F.lit(0))).alias("italic_places"),
        F.count_if("symbol").alias("symbols"), F.count_if("keyword").alias("keywords"),
        F.count_if("flavour").alias("flavours"), F.sum(F.length("text")).alias("chars"),
    )


EXPECTED_SQL = """SELECT face_id, surface, expected FROM (
  SELECT face_id, 'title_plate' AS surface, name AS expected FROM v_expected UNION ALL SELECT face_id, 'cost', mana_cost FROM v_expected
  UNION ALL SELECT face_id, 'type_strip', type_line FROM v_expected UNION ALL SELECT face_id, 'rules_panel', oracle_text FROM v_expected
  UNION ALL SELECT face_id, 'tab', tab FROM v_expected)"""
PRINTED_SQL = """SELECT face_id, surface, string_agg(text, ' ' ORDER BY ord) AS printed, count(*) AS patches
FROM v_patch GROUP BY face_id, surface"""


@query("f13_expected_fields", EXPECTED_SQL, ("v_expected",))
def expected_fields(spark, sf):
    return proof.expected_tall(V.expected(spark, sf), "face_id", cost_lettered=True)


@query(
    "f14_cleaned_patches",
    "SELECT face_id, row_number() OVER (PARTITION BY face_id ORDER BY ord) - 1 AS ord, surface, text FROM v_patch",
    ("v_patch",),
)
def cleaned_patches(spark, sf):
    return proof.patch_rows(V.read_back(spark, sf), "face_id")


@query("a6_printed_surfaces", PRINTED_SQL, ("v_patch",))
def printed_surfaces(spark, sf):
    return proof.printed_surfaces(cleaned_patches(spark, sf), "face_id")


@query(
    "j7_expected_and_read",
    f"SELECT face_id, surface, expected, printed, patches FROM ({EXPECTED_SQL}) FULL JOIN ({PRINTED_SQL}) USING (face_id, surface)",
    ("v_expected", "v_patch"),
)
def expected_and_read(spark, sf):
    return proof.expected_and_read(expected_fields(spark, sf), printed_surfaces(spark, sf), "face_id")


def canon_sql(text: str) -> str:
    """The test costs hold one split symbol only, spelt G/W or W/G."""
    return f"replace({text}, '{{W/G}}', '{{G/W}}')"


# what each rule needs about one face, in one row
FACE_SQL = f"""
SELECT e.face_id, e.c % 9 <> 0 AS has_title, e.name, e.type_line, e.oracle_text, e.tab, e.mana_cost,
  CASE WHEN e.c % 17 = 0 THEN '{{?}}' WHEN e.c % 6 = 0 THEN '' ELSE CASE e.turn % 4 WHEN 0 THEN '{{2}}{{G}}' WHEN 1 THEN '{{W/G}}{{U}}'
    WHEN 2 THEN '' ELSE '{{11}}' END END AS blind,
  COALESCE(string_agg(text, ' ' ORDER BY ord) FILTER (surface = 'title_plate'), '') AS p_title,
  COALESCE(string_agg(text, ' ' ORDER BY ord) FILTER (surface = 'type_strip'), '') AS p_type,
  COALESCE(string_agg(text, ' ' ORDER BY ord) FILTER (surface = 'rules_panel'), '') AS p_rules,
  COALESCE(string_agg(text, ' ' ORDER BY ord) FILTER (surface = 'tab'), '') AS p_tab,
  COALESCE(string_agg(text, ' ' ORDER BY ord) FILTER (surface = 'cost'), '') AS p_cost,
  count(*) FILTER (surface = 'cost') AS n_cost,
  count(*) FILTER (surface NOT IN ('title_plate', 'cost', 'type_strip', 'rules_panel', 'tab', 'artwork')) AS n_loose,
  string_agg(text, '; ' ORDER BY ord) FILTER (surface NOT IN ('title_plate', 'cost', 'type_strip', 'rules_panel', 'tab', 'artwork')) AS loose
FROM v_expected e LEFT JOIN v_patch p USING (face_id) GROUP BY ALL"""
DISAGREE_SQL = f"""blind NOT LIKE '%{{?}}%' AND p_cost NOT LIKE '%{{?}}%' AND trim(blind) <> '' AND trim(p_cost) <> ''
  AND {canon_sql('blind')} <> {canon_sql('p_cost')}"""


def _field_sql(wanted: str, printed: str) -> str:
    return f"""CASE WHEN {wanted} = '' AND trim({printed}) <> '' THEN 'text_extra' WHEN {wanted} = '' THEN NULL
      WHEN trim({printed}) = '' THEN 'text_missing' WHEN {norm_sql(printed)} <> {norm_sql(wanted)} THEN 'text_wrong' END"""


CODES_SQL = f"""[CASE WHEN NOT has_title THEN 'missing_title' END, {_field_sql('name', 'p_title')},
  CASE WHEN mana_cost <> '' AND n_cost > 1 THEN 'cost_wrong' WHEN mana_cost <> '' AND {DISAGREE_SQL} THEN 'cost_wrong'
    WHEN mana_cost = '' AND trim(blind) <> '' THEN 'text_extra' WHEN mana_cost = '' THEN NULL WHEN trim(blind) = '' THEN 'text_missing'
    WHEN blind LIKE '%{{?}}%' OR {canon_sql('blind')} <> {canon_sql('mana_cost')} THEN 'cost_wrong' END,
  {_field_sql('type_line', 'p_type')}, {_field_sql('oracle_text', 'p_rules')}, {_field_sql('tab', 'p_tab')},
  CASE WHEN n_loose > 0 THEN 'text_extra' END]"""


def proofed(spark, sf, **how):
    both = V.expected(spark, sf).join(V.read_back(spark, sf), "face_id")
    problems = proof.proofread(F.col("patches"), F.col("has_title"), **how)
    return both.select("face_id", problems.alias("problems"))


@query(
    "g2_text_proof",
    f"SELECT face_id, array_to_string(list_filter({CODES_SQL}, lambda c: c IS NOT NULL), ',') AS codes FROM ({FACE_SQL})",
    ("v_expected", "v_patch"),
)
def text_proof(spark, sf):
    found = proofed(spark, sf, cost_lettered=True, cost_printed=F.col("cost_printed"))
    return found.select("face_id", F.array_join(F.transform("problems", lambda p: p["code"]), ",").alias("codes"))


@query(
    "o2_problem_rank",
    f"""SELECT face_id, rank, code, CASE WHEN last THEN n_loose || ' loose: ' || loose END AS loose FROM (
  SELECT *, unnest(codes) AS code, unnest(range(0, len(codes))) AS rank, unnest(range(0, len(codes))) = len(codes) - 1 AND n_loose > 0 AS last
  FROM (SELECT *, list_filter({CODES_SQL}, lambda c: c IS NOT NULL) AS codes FROM ({FACE_SQL})))""",
    ("v_expected", "v_patch"),
)
def problem_rank(spark, sf):
    found = proofed(spark, sf, cost_lettered=True, cost_printed=F.col("cost_printed"))
    detail = F.when(F.col("p.detail").rlike(r"^\d+ loose: "), F.col("p.detail"))
    return found.select("face_id", F.posexplode("problems").alias("rank", "p")).select(
        "face_id", F.col("rank").cast("bigint"), F.col("p.code").alias("code"), detail.alias("loose")
    )


@query(
    "g3_reader_agreement",
    f"SELECT face_id, {DISAGREE_SQL} AS differ FROM ({FACE_SQL})",
    ("v_expected", "v_patch"),
)
def reader_agreement(spark, sf):
    sighted = F.array_join(proof.texts_on(proof.clean_patches(F.col("patches")), "cost"), " ")
    return V.read_back(spark, sf).select("face_id", proof.cost_disagreement(F.col("cost_printed"), sighted).alias("differ"))


@query(
    "j10_held_out",
    f"""
WITH reference AS (SELECT doc_id, no, key FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS no,
    {key_sql('unnest(string_split(text, chr(10)))')} AS key FROM documents)),
evaluation AS (SELECT DISTINCT key FROM (SELECT {key_sql('unnest(string_split(text, chr(10)))')} AS key FROM benchmark) WHERE key <> '')
SELECT doc_id, count(*) AS lines, count(*) FILTER (key IN (SELECT key FROM evaluation)) AS leaked FROM reference GROUP BY doc_id
""",
)
def held_out(spark, sf):
    def rows(name, key):
        return V.table(spark, sf, name).select(key, F.explode(F.split("text", "\n")).alias("line"))

    reference, evaluation = rows("documents", "doc_id"), rows("benchmark", "item_id")
    return proof.held_out_flags(reference, evaluation, "line").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("leak").cast("bigint").alias("leaked")
    )
