"""Registered queries of the operators over whole tables, and the DuckDB SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm import binslack, codes, embeddings, fingerprint, html, langid, maxent, mixing, neardup, packing, pii, quality, stripes
from deckloom.llm.common import fold, table

TARGET_ENTROPY, MOST_REPEATS = 0.95, 4.0
#: For the test tables. In production the key is the caller's secret.
TEST_KEY = b"key of the test tables"


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), TARGET_ENTROPY, MOST_REPEATS)
    return rows.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_components(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality.score(docs, model, [F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held_out")])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.dictionaries(docs.where(fold("doc_id", 4) != 2))
    return langid.classify(docs, learned, keep=[F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held_out")])


def op6_score_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)
    return found.select("doc_id", "text", F.size("pii_spans").alias("n_found"), F.col("pii_spans.kind").alias("kinds"))


def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.collocations(table(spark, sf_dir, "documents"))


def op12_fullest_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binslack.pack(table(spark, sf_dir, "documents"), tokenizer_path(binslack.TOKENIZER), keep_ids=False)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_main_text, op3_jaccard_join, op4_quality, op5_language, op6_score_lm, op7_near_vectors, op8_pack, op9_pseudonyms, op10_phrase_fingerprints, op11_collocations, op12_fullest_bins, op13_vector_codes)
}

#: Sources by temperature: the power by bisection over the list of source sizes, then block permutations.
_OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, doc_id // 64 - CASE WHEN doc_id % 64 < 0 THEN 1 ELSE 0 END AS block,
         CAST(CASE WHEN coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '') = '' THEN 0
              ELSE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) - length(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ', '')) + 1 END AS BIGINT) AS n_tokens
  FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM d GROUP BY source),
p AS (SELECT list(t / (SELECT sum(t) FROM s) ORDER BY t) AS ps, (SELECT sum(t) FROM s) AS total FROM s WHERE t > 0),
bent(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT i, low, high, mid,
               ln(list_sum(list_transform(ps, lambda x: pow(x, mid)))) - mid * list_sum(list_transform(ps, lambda x: pow(x, mid) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, mid)))
                 < 0.95 * ln(len(ps)) AS ok
        FROM (SELECT i, low, high, (low + high) / 2 AS mid FROM bent WHERE i < 50), p)),
rep(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT i, low, high, mid, pow(list_max(ps) / list_min(ps), 1 - mid) <= 4.0 AS ok
        FROM (SELECT i, low, high, (low + high) / 2 AS mid FROM rep WHERE i < 50), p)),
h AS (SELECT -list_sum(list_transform(ps, lambda x: x * ln(x))) AS h1, ln(len(ps)) AS h0 FROM p),
a AS (SELECT greatest(
        CASE WHEN h1 >= 0.95 * h0 THEN 1.0 WHEN h0 <= 0.95 * h0 THEN 0.0 ELSE (SELECT high FROM bent WHERE i = 50) END,
        CASE WHEN list_max(ps) / list_min(ps) <= 4.0 THEN 0.0 ELSE (SELECT high FROM rep WHERE i = 50) END) AS a FROM h, p),
w AS (SELECT source, t, pow(t / total, a) / list_sum(list_transform(ps, lambda x: pow(x, a))) AS weight,
             total * list_sum(list_transform(ps, lambda x: pow(x, a))) * pow(list_max(ps), 1 - a) AS budget FROM s, p, a WHERE t > 0),
q AS (SELECT source, t, weight, CAST(floor(weight * budget + 1e-6) AS BIGINT) AS quota FROM w),
b AS (SELECT source, block, sum(n_tokens)::BIGINT AS bt, md5('mix|' || coalesce(source, chr(0)) || '|' || coalesce(block::VARCHAR, '-')) AS place FROM d GROUP BY source, block),
c AS (SELECT b.source, block, bt, sum(bt) OVER (PARTITION BY b.source ORDER BY place) AS upto FROM b),
k AS (SELECT c.source, c.block, coalesce(q.weight, 0.0) AS weight,
             CASE WHEN q.source IS NULL AND q.t IS NULL THEN 1 ELSE quota // t + CASE WHEN bt > 0 AND upto <= quota - (quota // t) * t THEN 1 ELSE 0 END END AS copies
      FROM c LEFT JOIN q ON c.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, d.source AS source, n_tokens, round(weight, 9) AS weight, CAST(copies AS INTEGER) AS copies
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.block IS NOT DISTINCT FROM k.block
"""

#: Phrases of one to four words counted as text; a part of a candidate is looked up among them.
_OP11 = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 5) AS t(k) WHERE len(ws) >= k),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS MATERIALIZED (SELECT lang, a, i, j, k, array_to_string(ws[i:j], ' ') AS part FROM c, range(1, 5) AS t(i), range(1, 5) AS u(j) WHERE i < j AND j <= k AND j - i < k - 1),
h AS (SELECT lang, part, max(a) AS held FROM s GROUP BY ALL),
e AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS rest FROM c, range(1, 4) AS t(cut) WHERE cut < k),
x AS (SELECT e.lang, e.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
      FROM e JOIN f l ON l.lang = e.lang AND l.phrase = e.head JOIN f r ON r.lang = e.lang AND r.phrase = e.rest),
m AS (SELECT lang, phrase, a, l, r, score FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
      FROM m LEFT JOIN h ON h.lang = m.lang AND h.part = m.phrase WHERE held IS NULL OR 100 * held::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6, length: int = 8) -> str:
    """Lloyd rounds as a chain of common tables, for vectors of ``parts * length`` components."""
    at = range(1, length + 1)
    gap = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in at)
    floors = ", ".join(f"(sum(p.x{i}) - (sum(p.x{i}) % count(*) + count(*)) % count(*)) // count(*) AS x{i}" for i in at)
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT p.row, p.part, min(d * {entries} + e) AS de FROM "
            f"(SELECT p.row, p.part, c.e, {gap} AS d FROM p JOIN c{r} c ON p.part = c.part) p GROUP BY p.row, p.part)"
        )
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p.part, a.de % {entries} AS e, {floors} FROM p JOIN a{r} a ON p.row = a.row AND p.part = a.part GROUP BY p.part, a.de % {entries})")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, " + ", ".join(f"coalesce(s.x{i}, c.x{i})::BIGINT AS x{i}" for i in at) + f" FROM c{r} c LEFT JOIN s{r} s ON c.part = s.part AND c.e = s.e)")
    listed = "[" + ", ".join(f"x{i}" for i in at) + "]"
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, {", ".join(f"v[part * {length} + {i}] AS x{i}" for i in at)} FROM k, range({parts}) AS t(part)),
c0 AS (SELECT part, row - 1 AS e, {", ".join(f"x{i}" for i in at)} FROM p WHERE row <= {entries}),
{", ".join(steps)},
o AS (SELECT row, string_agg(lpad(printf('%x', de % {entries}), 2, '0'), '' ORDER BY part) AS code, sum(de // {entries})::BIGINT AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string({listed}, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (row), h
"""


#: Small tables only: every pair of documents that share a shingle is compared there.
ORACLES: dict[str, str] = {"op1_mix_sources": _OP1, "op11_collocations": _OP11, "op13_vector_codes": _op13()}
