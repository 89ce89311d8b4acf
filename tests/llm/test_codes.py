import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from deckloom.llm import codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in plain loops over Python's numbers."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 1e15 else math.floor(x) * 4096 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for _, v, _ in kept] for p in range(parts)]
    books = [part[:entries] for part in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for x in cut[p]:
                taken.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(taken[i]) for c in zip(*taken[i])] if i in taken else e for i, e in enumerate(books[p])]
    found = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    errors = [sum(f[i][0] for f in found) for i in range(len(kept))]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0], "".join(f"{f[i][1]:02x}" for f in found), fits(errors[i]), fits(labels[r[2]]), sha) for i, r in enumerate(kept)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in codes.compress(df)[0].collect()), key=str)


@pytest.mark.parametrize("seed,n,spread", [(1, 400, 0.2), (2, 40, 5.0), (3, 9, 0.1)])
def test_codes_equal_plain_loops(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, 32))
    rows = [(int(i), (centres[i % 5] + rng.normal(0, spread, 32)).tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0] * 31 + [None], 1), (n + 3, [math.inf] * 32, 2), (n + 4, [math.nan] * 32, 2)]
    assert got(spark, rows) == plain(rows)


def test_ties_repeats_and_null_ids(spark):
    rng = np.random.default_rng(4)
    grid = [[float(x) for x in row] for row in rng.integers(0, 2, (60, 16))]  # many equal distances
    rows = [(i // 3, v, 0) for i, v in enumerate(grid)] + [(5, grid[0], 1)] * 200 + [(None, grid[1], None)] * 3
    assert got(spark, rows) == plain(rows)


def test_one_vector_makes_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 16).tolist(), i % 2) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e200])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 16) * (size if i % 2 else 1)).tolist(), i % 2) for i in range(60)]
    assert got(spark, rows) == plain(rows)


def test_other_lengths_and_empty_tables(spark):
    rows = [(i, [float(i)] * 16, 0) for i in range(5)]
    odd = [(10, [1.0] * 8, 0), (11, [], 0), (12, [1.0] * 9, None)]
    found = got(spark, rows + odd)
    assert [r for r in found if r[0] < 10] == plain(rows)
    assert [r[:3] for r in found if r[0] >= 10] == [(10, None, None), (11, None, None), (12, None, None)]
    assert got(spark, []) == []
    assert [r[:3] for r in got(spark, odd[1:])] == [(11, None, None), (12, None, None)]


def test_whole_nodes_take_their_cached_sums():
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.integers(-4, 5, (300, 3)) + c for c in ((0, 0, 0), (500, 0, 0), (0, 500, 0))]).astype(np.int64)
    order, levels = codes.grow(points, 1, codes.LEAF)
    entries = np.array([[0, 0, 0], [500, 0, 0], [0, 500, 0], [900, 900, 900]], np.int64)
    found = codes.walk(points[order], levels, entries, 1)
    assigned = sum(int((levels[d].stop - levels[d].start)[q].sum()) for d, q, _ in found.level)
    assert assigned > 0.9 * len(points) and assigned + len(found.points) == len(points)
    total = np.zeros((4, 3), np.int64)
    for d, q, ids in found.level:
        np.add.at(total, ids, levels[d].total[q])
    np.add.at(total, found.entries, points[order][found.points])
    nearest = ((points[:, None] - entries) ** 2).sum(-1).argmin(1)
    assert all((total[e] == points[nearest == e].sum(0)).all() for e in range(4))
