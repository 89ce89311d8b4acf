"""The shapes for hot groups, against brute force, with a third of the rows under one key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deckloom.operators import scale


def skewed(n=6000, seed=7):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(50)}", i, round(rng.gauss(0, 9) ** 3, 3)) for i in range(n)]


def test_numbers_are_dense_and_in_order(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = scale.number_in_group(df, ["k"], [F.col("i")], F.floor(F.col("i") / 100)).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r.k].append((r.i, r.ordinal))
    assert sum(map(len, seen.values())) == len(rows)
    for pairs in seen.values():
        assert [o for _, o in sorted(pairs)] == list(range(1, len(pairs) + 1))


@pytest.mark.parametrize("cells, recuts", [(2, 1), (7, 2), (8192, 3)])
def test_value_at_rank_is_exact(spark, monkeypatch, cells, recuts):
    monkeypatch.setattr(scale, "CELLS", cells)
    monkeypatch.setattr(scale, "RECUTS", recuts)
    rows = skewed() + [("one", 0, 5.0), ("same", 0, 2.0), ("same", 1, 2.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {r.k: r.m for r in scale.value_at_rank(df, ["k"], "v", F.floor(F.col("_total") / 2) + 1, "m").collect()}
    groups = defaultdict(list)
    for k, _, v in rows:
        if v is not None:
            groups[k].append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}


def test_ranks_of_extreme_values(spark):
    inf = float("inf")
    values = [-inf, -1e308, -1e300, -5e-324, -0.0, 0.0, 5e-324, 2.0**52, 2.0**52 + 1, 1.0, 1.0 + 2.0**-52, 1.7e308, 1e308, inf, inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for at, want in enumerate(sorted(values), 1):
        row = scale.values_at_ranks(df, [], "v", {"a": F.lit(at), "last": F.col("_total"), "past": F.col("_total") + 1}).first()
        assert (row.a, row.last, row.past) == (want, inf, None)
    whole = spark.createDataFrame([(2**63 - 1 - i,) for i in range(50)] + [(-(2**63),)], "v long")
    assert scale.value_at_rank(whole, [], "v", F.lit(3), "m").first().m == 2**63 - 1 - 48
    assert scale.value_at_rank(df.limit(0), [], "v", F.lit(1), "m").collect()[0:1] in ([], [(None,)])


def test_an_outlier_does_not_gather_the_rest(spark):
    """A million values near one another and one far away: at most a few thousand are left to order."""
    df = spark.range(1_000_000).select((F.lit(1.0) + F.col("id") * 1e-9).alias("v")).union(spark.range(1).select(F.lit(1e300)))
    middle = F.floor(F.col("_total") / 2) + 1
    assert scale._narrowed(df, [], "v", {"m": middle}).count() <= scale.CELLS
    assert scale.value_at_rank(df, [], "v", middle, "m").first().m == 1.0 + 500_000 * 1e-9


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_a_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(scale, "HOT_PARTS", 10)
    rows = [(k if i % 97 else None, i) for k, i, _ in skewed()]
    facts = spark.createDataFrame(rows, "k string, i long")
    dim = spark.createDataFrame([("hot", "h"), ("k1", "x"), ("k2", "y"), ("zz", "z")], "k string, d string")
    hot = scale.hot_keys(facts, ["k"])
    assert [r.k for r in hot.collect()] == ["hot"]
    salted = sorted(map(tuple, scale.lookup(facts, dim, ["k"], how, hot=hot).select("k", "i", "d").collect()), key=repr)
    plain = sorted(map(tuple, facts.join(dim, ["k"], how).select("k", "i", "d").collect()), key=repr)
    assert salted == plain


def test_a_side_that_cannot_be_broadcast_is_salted(spark):
    from test_lists import cards

    from deckloom.operators import catalogue

    lines = spark.createDataFrame([("fire",)] * 5 + [("Day",), ("Nobody",)], "name string")
    plain = sorted(map(tuple, catalogue.resolve(lines, cards(spark)).collect()), key=repr)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        salted = sorted(map(tuple, catalogue.resolve(lines, cards(spark)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert salted == plain
