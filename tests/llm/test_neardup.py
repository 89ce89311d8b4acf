"""The Jaccard join against every pair."""

import random
import re

import pytest
from pyspark.sql import types as T

from deckloom.llm import neardup
from deckloom.llm.common import components, table

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("g", T.StringType())])


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n, component) by joining every pair."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def families(seed, words=80, size=12):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for f in range(6):
        base = [word() for _ in range(words)]
        for k in range(size):
            w = list(base)
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = word()
            rows.append(" ".join(w))
    for k in range(20):  # one passage in many texts that are no copies of each other
        rows.append(" ".join(passage + [word() for _ in range(draw.choice([5, 12, 40]))]))
    return rows


def found(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], schema)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.jaccard_components(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_and_passages(far, monkeypatch, seed):
    monkeypatch.setattr(neardup, "COMMON_FROM", 4)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)  # groups of several blocks
    rows = list(enumerate(families(seed)))
    assert found(far, rows) == brute(rows)


def test_odd_rows(far):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (None, "a b"), (9, "one two three four five six"),
            (9, "one two three four five six"), (10, "É b c d e f"), (11, "é b c d e f"), (12, "x y")]
    assert found(far, rows) == brute(rows)


def test_empty_table(far):
    assert found(far, []) == []


def test_given_documents(far, sf):
    docs = table(far, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.jaccard_components(docs).collect()), key=repr)
    assert got == brute(rows)


def test_one_of_each_stays(far):
    rows = [(3, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (None, "p q"), (None, "p q"), (5, None)]
    df = far.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    kept = neardup.keep_one(df, neardup.jaccard_components(df))
    assert sorted(map(repr, [r["doc_id"] for r in kept.collect()])) == ["1", "2", "5", "None"]


def test_one_of_each_stays_without_ids(far):
    one = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "p q"), (None, "p q"), (None, "r s"), (None, None), (4, one), (4, "other text"), (6, one + " end"), (None, "OTHER text"), (4, one)]
    df = far.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    assert found(far, rows) == brute(rows)
    kept = neardup.keep_one(df, neardup.jaccard_components(df, keyed=True)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(None, "p q"), (None, "r s"), (None, None), (4, one), (4, "other text")], key=repr)
    import corpus_pipeline

    assert corpus_pipeline.near_duplicate_stage(far, df, "").count() == 5


def test_components_of_chains_and_stars(far):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(50, 50), (None, 3)]
    got = {r["node"]: r["root"] for r in components(far.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in range(7, 30)}}
