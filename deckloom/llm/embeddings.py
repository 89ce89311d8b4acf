"""Near-duplicate vectors: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, exact cosines.

A hash rotates a vector by three rounds of random signs and a Walsh-Hadamard transform and takes the axis and
sign of its largest coordinate. Two hashes make a bucket of a table. A vector enters its best buckets of every table, and
vectors that meet in a bucket are compared exactly. A pair is counted in the first bucket in which it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import components, settled

LIMIT = 0.9
#: Tables, hashes that make a bucket, and buckets of a table that a vector enters.
TABLES, PROBES, AXES = 8, 4, 3
#: Vectors of a bucket compared at once; larger buckets are split into blocks.
BLOCK = 1_024


def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng(17).choice(np.array([-1.0, 1.0]), (TABLES, 2, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray) -> np.ndarray:
    """TABLES x PROBES bucket numbers of each row, best first; rows need not be of length one."""
    dim = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((len(x), TABLES * PROBES), np.int64)
    axes = min(AXES, dim)
    for t, pair in enumerate(_signs(dim)):
        best = []
        for signs in pair:
            y = padded
            for s in signs:
                y = hadamard(y * s) / np.sqrt(dim)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :axes]
            value = np.take_along_axis(y, top, axis=1)
            best.append((2 * top + (value > 0), np.abs(value[:, :1]) - np.abs(value)))
        (a, loss_a), (b, loss_b) = best
        loss = (loss_a[:, :, None] ** 2 + loss_b[:, None, :] ** 2).reshape(len(x), -1)
        bucket = (a[:, :, None] * 2 * dim + b[:, None, :]).reshape(len(x), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        # tables, lengths and buckets never share a number
        found = np.take_along_axis(bucket, order, axis=1) + (np.int64(t) << 56) + (np.int64(x.shape[1]) << 36)
        out[:, t * PROBES : t * PROBES + found.shape[1]] = found
        out[:, t * PROBES + found.shape[1] : (t + 1) * PROBES] = found[:, :1]
    return out


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.float64) for v in column.to_pylist()]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("embedding").to_pylist()
        lengths = np.array([len(v) for v in values])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                x = np.array([values[k] for k in some], np.float64)
                found = codes(x)
                row, column = np.nonzero(np.ones(found.shape, bool))
                keep = np.ones(len(row), bool)
                keep[(column % PROBES > 0) & (found[row, column] == found[row, column - column % PROBES])] = False
                row, column = row[keep], column[keep]
                node = batch.column("node").to_numpy()[some]
                copies = batch.column("copies").to_numpy()[some]
                raw = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([pa.array(found[row, column]), pa.array(node[row]), pa.array(copies[row]), pa.array([raw[k] for k in row], pa.binary())], names=["code", "node", "copies", "x"])


def _joined(linked: np.ndarray) -> np.ndarray:
    """Smallest position reached from each through ``linked``."""
    now = np.arange(len(linked))
    while True:
        low = np.minimum(np.where(linked, now[None, :], len(now)).min(axis=1), now)
        low = low[low]
        if (low == now).all():
            return now
        now = low


def _compare(code: int, first: int, second: int, block: np.ndarray, node: np.ndarray, copies: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links of it, node it is joined with) for the pairs whose first common bucket is this one."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= LIMIT
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(linked))
    if len(i):
        found = codes(x)
        earlier = np.zeros(len(i), bool)
        for t in range(code >> 56):
            mine = slice(t * PROBES, (t + 1) * PROBES)
            for p in range(PROBES):
                earlier |= (found[i, t * PROBES + p][:, None] == found[j, mine]).any(axis=1)
        t = code >> 56
        for p in range(PROBES):  # in the same table, the smaller number comes first
            c = found[i, t * PROBES + p]
            earlier |= (c < code) & (c[:, None] == found[j, t * PROBES : (t + 1) * PROBES]).any(axis=1)
        i, j = i[~earlier], j[~earlier]
    links = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
    mine = np.zeros_like(linked)
    mine[i, j] = mine[j, i] = True
    to = _joined(mine)
    some = links > 0
    return node[some], links[some].astype(np.int64), node[to[some]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, []

    def finish() -> tuple | None:
        if len(held) < 2:
            return None
        block, node, copies, x = zip(*held)
        return _compare(*key, np.array(block), np.array(node), np.array(copies, np.float64), np.array([np.frombuffer(v, np.float64) for v in x]))

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["node", "links", "to"])

    for batch in batches:
        found = []
        for code, first, second, block, node, copies, x in zip(*(batch.column(c).to_pylist() for c in ("code", "first", "second", "block", "node", "copies", "x"))):
            if (code, first, second) != key:
                if (r := finish()) is not None:
                    found.append(r)
                key, held = (code, first, second), []
            held.append((block, node, copies, x))
        if found:
            yield out(found)
    if (r := finish()) is not None:
        yield out([r])


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; pairs of cosine >= ``LIMIT`` in double precision link.

    Null and zero vectors, and those with null or non-finite components, link with nothing; vectors of different
    lengths do not link. Equal vectors are one node with a count, so their pairs are counted and not made. Rows of
    null id link and count like others and have no id to give. Large buckets are compared in pairs of
    blocks; only counts and joining edges leave a comparison.
    """
    plain = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = plain.withColumn("node", F.when(good, F.xxhash64("embedding")))
    classes = rows.where(F.col("node").isNotNull()).groupBy("node", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = settled(classes, "vectors")
    buckets = classes.select("node", "embedding", "copies").mapInArrow(_buckets, "code long, node long, copies long, x binary")
    sizes = settled(buckets.groupBy("code").count().where("count > 1").withColumn("nb", F.ceil(F.col("count") / BLOCK).cast("int")).select("code", "nb"), "buckets")
    dealt = buckets.join(sizes, "code").withColumn("block", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("code", F.least("block", "o").alias("first"), F.greatest("block", "o").alias("second"), "block", "node", "copies", "x")
    key = ["code", "first", "second"]
    found = settled(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared, "node long, links long, to long"), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left")
    told = settled(told.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "told")
    named = told.join(told.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
