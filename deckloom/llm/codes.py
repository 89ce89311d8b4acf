"""Vector code compression by dual-tree Lloyd rounds in whole numbers.

Vectors are cut into equal parts, and each part position has a codebook of its own. Kept vectors are dealt
once into blocks. A block holds, for every part position, a tree over its parts (median cuts along the
widest component) whose nodes carry bounding boxes, counts and componentwise sums; blocks are written to the shared
folder, so a lost executor reads them again. A round walks each block's trees against small trees over the
codebook entries: pairs of nodes start at the roots, a pair goes when another entry node is surely nearer to all
of the part node (box distances), and a part node with one entry left is assigned whole by its cached sums.
Only leaves that keep several entries compare their parts, in whole numbers. A task sends one partial sum per entry,
component and 30-bit limb; Spark adds them, and what reaches the driver has the size of the codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckloom.llm.common import settled

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Parts in a leaf, at most, and bytes of components in a block.
LEAF, BLOCK_BYTES = 16, 4 << 20
_LIMB = 30


class Level(NamedTuple):
    """Nodes of one depth: places of their points, boxes, sums. Children of node i are 2i and 2i + 1."""

    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def safe(dims: int) -> int:
    """Components up to this size keep every sum of ``dims`` squared differences within 63 bits."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def whole(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite doubles: 64-bit numbers where distances stay exact in them, else Python's."""
    scaled = values * SCALE if not values.size or np.abs(values).max() < 1e300 else values.astype(object)
    if scaled.dtype != object and (not scaled.size or np.abs(scaled).max() < safe(values.shape[-1])):
        return np.floor(scaled).astype(np.int64)
    flat = [math.floor(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def _halves(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (start + stop) // 2
    return np.stack([start, middle], 1).ravel(), np.stack([middle, stop], 1).ravel()


def _level(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Level:
    full = np.flatnonzero(stop > start)
    low, high, total = (np.zeros((len(start), points.shape[1]), points.dtype) for _ in range(3))
    if len(full):
        at = start[full]  # full nodes of a level follow one another without gaps
        low[full], high[full], total[full] = (f.reduceat(points, at, axis=0) for f in (np.minimum, np.maximum, np.add))
    return Level(start, stop, low, high, total)


def grow(points: np.ndarray, trees: int, leaf: int) -> tuple[np.ndarray, list[Level]]:
    """Trees over ``trees`` equal stretches of ``points``: the order of points, and the levels from the roots down."""
    size = len(points) // trees
    order = np.arange(len(points))
    start = np.arange(trees) * size
    levels = [_level(points, start, start + size)]
    while size > leaf:
        here = levels[-1]
        widest = (here.high - here.low).argmax(axis=1)
        node = np.repeat(np.arange(len(here.start)), here.stop - here.start)
        by = points[order, widest[node]]
        order = order[_sorted(by, node)]
        levels.append(_level(points[order], *_halves(here.start, here.stop)))
        size = int((levels[-1].stop - levels[-1].start).max())
    return order, levels


def _sorted(by: np.ndarray, node: np.ndarray) -> np.ndarray:
    if by.dtype == object:
        return np.array(sorted(range(len(by)), key=lambda i: (node[i], by[i])), np.int64)
    return np.lexsort((by, node))


def _gaps(a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest squared distance between points of the boxes a[i] and b[j]."""
    below, above = b.low[j] - a.high[i], a.low[i] - b.high[j]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(a.high[i] - b.low[j], b.high[j] - a.low[i])
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def _least(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Of each run of equal ``groups`` its least value, given back to every member."""
    at = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.repeat(np.minimum.reduceat(values, at), np.diff(np.r_[at, len(groups)]))


def _pruned(q: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray, single: bool) -> np.ndarray:
    """Pairs that can still hold a nearest entry. Pairs of a node follow one another, entries ascending.

    With single entries an equal distance goes to the lower index: an entry whose least distance reaches the
    largest distance of an earlier one is never taken.
    """
    best = _least(high, q)
    keep = low <= best
    if single:
        first = _least(np.where(high == best, e, np.iinfo(np.int64).max), q)
        keep &= (low < best) | (e <= first)
    return keep


class Walk(NamedTuple):
    """What a walk found: assigned stretches of points (whole nodes) with their entries, and single points with theirs."""

    level: list[tuple[int, np.ndarray, np.ndarray]]
    points: np.ndarray
    entries: np.ndarray


def walk(points: np.ndarray, levels: list[Level], entries: np.ndarray, trees: int) -> Walk:
    """Nearest entry of every point. ``points`` are in tree order; entry ids count on from tree to tree."""
    upper = grow(entries, trees, 1)
    order = upper[0]
    whole_nodes: list[tuple[int, np.ndarray, np.ndarray]] = []
    q = e = np.arange(trees)
    depth = 0
    for depth, level in enumerate(levels):
        if not len(q):
            break
        # entry nodes descend with the part nodes, and to single entries before a part node may be assigned
        at = min(depth, len(upper[1]) - 1)
        low, high = _gaps(level, q, upper[1][at], e)
        keep = _pruned(q, e, low, high, False)
        q, e = q[keep], e[keep]
        alone = np.r_[True, q[1:] != q[:-1]] & np.r_[q[1:] != q[:-1], True]
        last = at == len(upper[1]) - 1
        if last:
            ids = order[upper[1][at].start[e]]
            back = np.lexsort((ids, q))
            q, e, ids = q[back], e[back], ids[back]
            low, high = _gaps(level, q, upper[1][at], e)
            keep = _pruned(q, ids, low, high, True)
            q, e, ids = q[keep], e[keep], ids[keep]
            alone = np.r_[True, q[1:] != q[:-1]] & np.r_[q[1:] != q[:-1], True]
            whole_nodes.append((depth, q[alone], ids[alone]))
            q, e = q[~alone], e[~alone]
        if depth == len(levels) - 1:
            break
        # children of the part node with the children of the entry node
        q = np.stack([2 * q, 2 * q + 1], 1)
        if not last:
            e = np.stack([2 * e, 2 * e + 1], 1)
            q, e = np.repeat(q, 2, axis=1).ravel(), np.tile(e, (1, 2)).ravel()
            nodes = upper[1][at + 1]
        else:
            q, e = q.ravel(), np.repeat(e, 2)
            nodes = upper[1][at]
        full = (levels[depth + 1].stop[q] > levels[depth + 1].start[q]) & (nodes.stop[e] > nodes.start[e])
        q, e = q[full], e[full]
        back = np.lexsort((e, q))
        q, e = q[back], e[back]
    # leaves that keep several entries: every part against each of them
    at = min(depth, len(upper[1]) - 1)
    q, ids = _singles(q, e, upper, at, order) if len(q) else (q, e)
    level = levels[depth]
    sizes = (level.stop - level.start)[q]
    pair = np.repeat(np.arange(len(q)), sizes)
    row = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + level.start[q][pair]
    gap = points[row] - entries[ids[pair]]
    distance = (gap * gap).sum(axis=1)
    # least distance of each part, ties to the lower entry
    back = np.lexsort((ids[pair], row)) if distance.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], ids[pair[i]])), np.int64)
    row, mine, distance = row[back], ids[pair][back], distance[back]
    if len(row):
        best = _least(distance, row)
        hit = np.flatnonzero(distance == best)
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        row, mine = row[hit], mine[hit]
    return Walk(whole_nodes, row, mine)


def _singles(q: np.ndarray, e: np.ndarray, upper: tuple, at: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry nodes of pairs opened to their single entries."""
    level = upper[1][at]
    sizes = (level.stop - level.start)[e]
    pair = np.repeat(np.arange(len(e)), sizes)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + level.start[e][pair]
    return q[pair], order[place]


def _blocks(parts: int, label_type: pa.DataType) -> object:
    """Kept rows in blocks with their trees: ids, labels, components in tree order, places, boxes and sums."""

    def emit(ids: pa.Array, labels: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        dims = values.shape[1]
        numbers = whole(values)
        wide = numbers.dtype == object
        ok = dims > 0 and dims % parts == 0
        made = [b""] * 3
        if ok:
            points = np.concatenate(np.split(numbers, parts, axis=1))
            order, levels = grow(points, parts, LEAF)
            if wide:  # large numbers are stored as the doubles they come from, and their boxes are made again
                exact = np.concatenate(np.split(values, parts, axis=1))[order]
                made = [exact.tobytes(), order.astype(np.int64).tobytes(), b""]
            else:
                cached = np.concatenate([np.concatenate([v.low, v.high, v.total]) for v in levels])
                made = [points[order].tobytes(), order.astype(np.int64).tobytes(), cached.tobytes()]
        one = np.array([0, len(ids)], np.int32)
        columns = [
            pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([wide], pa.bool_()),
            pa.ListArray.from_arrays(pa.array(one), ids), pa.ListArray.from_arrays(pa.array(one), labels),
            *[pa.array([m], pa.binary()) for m in made],
        ]
        return pa.RecordBatch.from_arrays(columns, names=["dims", "n", "wide", "ids", "labels", "points", "places", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            sizes = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, np.int64)
            flat, begin = np.asarray(vectors.values.slice(vectors.offsets[0].as_py())), np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                values = flat[begin[rows][:, None] + np.arange(dims)].astype(np.float64).reshape(len(rows), dims)
                take = pa.array(rows)
                held.setdefault(dims, []).append((batch.column(0).take(take), batch.column(2).take(take).cast(label_type), values))
                most = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
                while sum(len(x[0]) for x in held[dims]) >= most:
                    ids, labels, values = (pa.concat_arrays([x[0] for x in held[dims]]), pa.concat_arrays([x[1] for x in held[dims]]), np.concatenate([x[2] for x in held[dims]]))
                    yield emit(ids[:most], labels[:most], values[:most])
                    held[dims] = [(ids[most:], labels[most:], values[most:])] if len(ids) > most else []
        for some in held.values():
            if some:
                yield emit(pa.concat_arrays([x[0] for x in some]), pa.concat_arrays([x[1] for x in some]), np.concatenate([x[2] for x in some]))

    return run


def _opened(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray, list[Level]]:
    """A stored block: components and places in tree order, and the trees' levels with their cached sums."""
    d, n = row["dims"] // parts, row["n"]
    places = np.frombuffer(row["places"], np.int64)
    if row["wide"]:
        points = whole(np.frombuffer(row["points"], np.float64).reshape(-1, row["dims"] // parts))
        points = points.astype(object)
    else:
        points = np.frombuffer(row["points"], np.int64).reshape(-1, d)
        cached = np.frombuffer(row["nodes"], np.int64).reshape(-1, d)
    start = np.arange(parts) * n
    stop = start + n
    levels, at = [], 0
    while True:
        k = len(start)
        if row["wide"]:
            levels.append(_level(points, start, stop))
        else:
            levels.append(Level(start, stop, *(cached[at + i * k : at + (i + 1) * k] for i in range(3))))
            at += 3 * k
        if (stop - start).max() <= LEAF:
            return points, places, levels
        start, stop = _halves(start, stop)


def _same_kind(points: np.ndarray, levels: list[Level], entries: np.ndarray) -> tuple[np.ndarray, list[Level], np.ndarray]:
    """All in 64-bit numbers, or all in Python's."""
    if points.dtype == entries.dtype:
        return points, levels, entries
    return points.astype(object), [Level(v.start, v.stop, *(x.astype(object) for x in v[2:])) for v in levels], entries.astype(object)


def _entries(books: list[list[list[int]]]) -> np.ndarray:
    """Codebooks as rows of numbers, 64-bit where distances stay exact in them."""
    flat = [entry for book in books for entry in book]
    d = len(flat[0])
    if max((abs(x) for entry in flat for x in entry), default=0) < safe(d * len(books)):
        return np.array(flat, np.int64).reshape(len(flat), d)
    out = np.empty((len(flat), d), object)
    out[:] = flat
    return out


def _sums(books: list[list[list[int]]], dims: int, parts: int) -> object:
    """A task's partial sums: (entry, component or -1 for the count, limb, value)."""
    entries = _entries(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = dims // parts
        # sums of 64-bit components fit Python's numbers and are split into limbs at the end
        total = np.zeros((len(entries), d), object)
        count = np.zeros(len(entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                points, _, levels = _opened(row, parts)
                points, levels, mine = _same_kind(points, levels, entries)
                found = walk(points, levels, mine, parts)
                added = np.zeros((len(entries), d), points.dtype)
                for depth, nodes, ids in found.level:
                    np.add.at(added, ids, levels[depth].total[nodes])
                    np.add.at(count, ids, (levels[depth].stop - levels[depth].start)[nodes])
                np.add.at(added, found.entries, points[found.points])
                np.add.at(count, found.entries, 1)
                total += added.astype(object)
        out = []
        for entry in np.flatnonzero(count).tolist():
            out.append((entry, -1, 0, int(count[entry])))
            for c, x in enumerate(total[entry].tolist()):
                sign, x, limb = (-1 if x < 0 else 1), abs(x), 0
                while x:
                    out.append((entry, c, limb, sign * (x & ((1 << _LIMB) - 1))))
                    x, limb = x >> _LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["entry", "c", "limb", "value"])

    return run


def _coded(books: list[list[list[int]]], dims: int, parts: int, id_type: pa.DataType, label_type: pa.DataType) -> object:
    """Rows (vec_id, label, code, error); vectors of another length have neither code nor error."""
    entries = _entries(books) if books and books[0] else None
    k = len(books[0]) if books else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("dims", "n", "wide", "points", "places", "nodes")}
                n = row["n"]
                codes, errors = [None] * n, [None] * n
                if row["dims"] == dims and entries is not None:
                    points, places, levels = _opened(row, parts)
                    points, levels, mine = _same_kind(points, levels, entries)
                    found = walk(points, levels, mine, parts)
                    which = np.zeros(len(points), np.int64)
                    for depth, nodes, ids in found.level:
                        size = (levels[depth].stop - levels[depth].start)[nodes]
                        at = np.repeat(levels[depth].start[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        which[at] = np.repeat(ids, size)
                    which[found.points] = found.entries
                    gap = points - mine[which]
                    cost = (gap * gap).sum(axis=1)
                    back = np.empty(len(places), np.int64)
                    back[places] = np.arange(len(places))
                    index = (which[back].reshape(parts, n) - np.arange(parts)[:, None] * k).astype(np.uint8)
                    codes = [bytes(x).hex() for x in np.ascontiguousarray(index.T)]
                    errors = [e if e < 1 << 63 else None for e in cost[back].reshape(parts, n).sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values.cast(id_type), batch.column("labels")[i].values.cast(label_type), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def _digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes and errors of all kept vectors, and the codebooks (part, entry, components).

    A vector is dropped if it is null or holds a null or non-finite component. Components are floor(4096 * x), exact for
    every finite double. Codebooks start as the parts of the ``entries`` smallest ids (null ids last, then by
    components); with fewer kept rows they have as many entries. Repeated rows count as often as they stand.
    The length of vectors is the one most kept rows have (the shorter at ties, multiples of ``parts`` only);
    vectors of another length stay as rows with null code and error and have no say in the codebooks.
    Equal distances go to the lower entry, unused entries stay. An error beyond 63 bits is null; the sum over
    equal labels leaves null errors out and is null beyond 63 bits. An empty table gives no rows and empty codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("one byte per part holds 1 to 256 entries")
    label = F.col(f"`{label_column}`")
    given = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"), label.alias("label"))
    # comparisons instead of isnan: a null component makes the test null, so the row goes as well
    kept = given.where(F.coalesce(F.forall("v", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))), F.lit(False)))
    label_type = _arrow(kept.schema["label"].dataType)
    block_type = T.StructType([
        T.StructField("dims", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BooleanType()),
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)),
        T.StructField("points", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("nodes", T.BinaryType()),
    ])
    blocks = settled(kept.mapInArrow(_blocks(parts, label_type), block_type), "codes")
    sizes = blocks.where(f"dims > 0 and dims % {parts} = 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").head(1)
    dims = sizes[0]["dims"] if sizes else 0
    first = kept.where(F.size("v") == dims).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect() if dims else []
    d = dims // parts
    numbers = [whole(np.array([r["v"]], np.float64))[0].tolist() for r in first]
    books = [[row[p * d : (p + 1) * d] for row in numbers] for p in range(parts)]
    used = blocks.where(F.col("dims") == dims).select("dims", "n", "wide", "points", "places", "nodes")
    for _ in range(rounds if dims else 0):
        sums = used.mapInArrow(_sums(books, dims, parts), "entry int, c int, limb int, value long").groupBy("entry", "c", "limb").agg(F.sum("value").alias("value"))
        k = len(books[0])
        count, total = {}, {}
        for r in sums.collect():  # one row per entry, component and limb
            if r["c"] < 0:
                count[r["entry"]] = r["value"]
            else:
                total[r["entry"], r["c"]] = total.get((r["entry"], r["c"]), 0) + (r["value"] << _LIMB * r["limb"])
        books = [
            [[total.get((p * k + i, c), 0) // count[p * k + i] for c in range(d)] if p * k + i in count else entry for i, entry in enumerate(book)]
            for p, book in enumerate(books)
        ]
    coded_type = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = settled(blocks.mapInArrow(_coded(books, dims, parts, pa.int64(), label_type), coded_type), "coded")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256")), books


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
