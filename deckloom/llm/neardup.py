"""N-gram Jaccard join by a token-group matrix, distributed by token.

Documents are sets of shingles; equal sets are one node. Similar nodes fall into groups (by their smallest shingle
and size), and the matrix holds, for every shingle, the groups whose members may have it as one of the
shingles that a linked document must share (its prefix). A query group looks its own shingles up in the matrix: only groups it
meets there, with sizes that fit, qualify. Qualified groups are opened: members whose overlap with the other side's token
union is too small are left out, and the rest are compared exactly. Every pair over the limit meets in
the matrix, so no link is lost; the order of shingles and the grouping only decide how much work is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import components, private, settled, slices
from deckloom.llm.words import mixed, shingle_sets

SHINGLE = 5
#: Shingles known as common, at most: they come last in the order, the rest need no list.
COMMON, COMMON_FROM = 1 << 18, 16
#: A prefix is longer by one shingle for so many of the set, and so many more must meet.
MET_STEP = 25
#: Shingles held while a task looks for repeated ones; postings and shingles of one comparison, which bound its memory.
HELD, BLOCK_SHINGLES = 3_000_000, 120_000


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares at least with any set it links to: 0.8 n, rounded up."""
    return (4 * n + 4) // 5


def met(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles of its prefix that a set of n meets at least in the prefix of any set of its size or more that it links to."""
    return 1 + n // MET_STEP


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a stretch of documents has more than once, with their counts."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        more = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[more].view(np.int64)), pa.array(counts[more].astype(np.int64))], names=["token", "n"])

    for part in slices(batches, "text"):
        for s in shingle_sets(part.column("text"), SHINGLE):
            held.append(s)
            n += len(s)
        if n > HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles (sorted) and their counts as seen; at most ``COMMON`` of them."""
    seen = texts.select("text").mapInArrow(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = seen.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens, counts = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _fingerprint(s: np.ndarray) -> int:
    """Of a set: equal sets have equal ones."""
    total = np.add.reduce(s, keepdims=True) * np.uint64(3) + np.bitwise_xor.reduce(mixed(s), keepdims=True) + np.uint64(len(s))
    return int(mixed(total).view(np.int64)[0])


class Order:
    """The order of shingles: uncommon ones by hash, then common ones from rare to frequent; and the groups made by it."""

    def __init__(self, common: tuple[np.ndarray, np.ndarray]):
        self.tokens, counts = common
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))

    def places(self, s: np.ndarray) -> np.ndarray:
        """Rank among the common shingles, or -1."""
        if not len(self.tokens):
            return np.full(len(s), -1)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.rank[at], -1)

    def prefix(self, s: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first n - needed + met shingles: as many as ``met`` of the smaller set are common to the prefixes of two linked sets.

        (Of ``needed`` common shingles in order, the k-th has needed - k after it in either set.)
        """
        n = min(len(s), len(s) - int(needed(len(s))) + int(met(len(s))))
        plain = s[places < 0]
        if len(plain) >= n:
            return plain[:n]
        shared = np.flatnonzero(places >= 0)
        return np.concatenate([plain, s[shared[np.argsort(places[shared])][: n - len(plain)]]])

    @staticmethod
    def group(s: np.ndarray, places: np.ndarray) -> int:
        """By the smallest shingle (of the common ones if they are half of the set) and the size to a factor of 1.5."""
        shared = s[places >= 0]
        first = shared[:1] if 2 * len(shared) >= len(s) else s[:1]
        band = int(np.log(len(s)) / np.log(1.5))
        return int(mixed(first + np.uint64(band * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)[0])


def _nodes(order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), SHINGLE)
            n = np.array([len(s) for s in sets], np.int64)
            fps = [_fingerprint(s) if len(s) else None for s in sets]
            groups = [order.group(s, order.places(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(n), pa.array(fps, pa.int64()), pa.array(groups, pa.int64())], names=["doc_id", "rid", "n", "fp", "g"])

    return run


def _postings(order: Order):
    """Matrix rows (token, group, smallest and largest size); a task gives one row per token and group of a stretch."""

    def out(held: list) -> pa.RecordBatch:
        token, group, n = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((group, token))
        token, group, n = token[by], group[by], n[by]
        heads = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
        arrays = (token[heads].view(np.int64), group[heads], np.minimum.reduceat(n, heads), np.maximum.reduceat(n, heads))
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["token", "g", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in slices(batches, "text"):
            for s in shingle_sets(part.column("text"), SHINGLE):
                if len(s):
                    places = order.places(s)
                    prefix = order.prefix(s, places)
                    held.append((prefix, np.full(len(prefix), order.group(s, places), np.int64), np.full(len(prefix), len(s), np.int32)))
                    rows += len(prefix)
            if rows > 1_000_000:
                yield out(held)
                held, rows = [], 0
        if rows:
            yield out(held)

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups of fitting sizes that share rows of the matrix, with how many and the smallest size. Rows come sorted by token and group."""
    carry = None

    def pairs(token: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
        sizes = np.diff(np.r_[heads, len(token)])
        a_all, b_all, n_all = [], [], []
        for h, k in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            group, first = np.unique(g[h : h + k], return_index=True)
            if len(group) < 2:
                continue
            small, large = np.minimum.reduceat(low[h : h + k], first), np.maximum.reduceat(high[h : h + k], first)
            for i in range(len(group) - 1):
                fit = (5 * large[i + 1 :] >= 4 * small[i]) & (5 * large[i] >= 4 * small[i + 1 :])
                b = group[i + 1 :][fit]
                a_all.append(np.full(len(b), group[i]))
                b_all.append(b)
                n_all.append(np.minimum(small[i], small[i + 1 :][fit]))
        if a_all and (a := np.concatenate(a_all)).size:
            b, n = np.concatenate(b_all), np.concatenate(n_all)
            by = np.lexsort((b, a))
            a, b, n = a[by], b[by], n[by]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.r_[first, len(a)])), pa.array(np.minimum.reduceat(n, first).astype(np.int64))], names=["g1", "g2", "shared", "low"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if carry is not None:
            columns = [np.concatenate(x) for x in zip(carry, columns)]
        last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        carry = [c[last:] for c in columns]  # the last token may go on in the next batch
        yield from pairs(*(c[:last] for c in columns))
    if carry is not None:
        yield from pairs(*carry)


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label of each set after joining all linked ones: the smallest position reached. Exact.

    Sets whose overlap with the union of the other side (a side is its own other side) cannot reach 0.8 stay out.
    """
    n = np.array([len(s) for s in sets])
    labels = np.arange(len(sets))
    token, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(labels, n)
    on = [np.bincount(where[side[owner]], minlength=len(token)) for side in (left, right)]
    # how many sets of the other side hold each shingle, the set itself not counted
    other = np.where(left[owner], on[1][where] - right[owner], on[0][where])
    opened = np.bincount(owner, weights=other > 0, minlength=len(sets)) >= needed(n)
    if opened.sum() < 2:
        return labels
    use = opened[owner]
    token, column = np.unique(where[use], return_inverse=True)
    kept = np.flatnonzero(opened)
    row = np.searchsorted(kept, owner[use])
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    inter = np.zeros((len(kept), len(kept)), np.float32)
    width = max(1, 8_000_000 // len(kept))
    for start in range(0, int(shared.sum()), width):
        here = (column >= start) & (column < start + width)
        m = np.zeros((len(kept), min(width, int(shared.sum()) - start)), np.float32)
        m[row[here], column[here] - start] = 1
        inter += m @ m.T
    size = n[kept].astype(np.float64)
    linked = 100.0 * inter >= 80.0 * (size[:, None] + size[None, :] - inter)
    now = np.arange(len(kept))
    while True:
        low = np.where(linked, now[None, :], len(kept)).min(axis=1)
        low = np.minimum(low, now)[np.minimum(low, now)]
        if (low == now).all():
            break
        now = low
    labels[kept] = kept[now]
    return labels


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one comparison come together; out go edges that join its linked nodes."""
    key, held = None, {}

    def finish() -> list[tuple[int, int]]:
        fps = list(held)
        if len(fps) < 2:
            return []
        sets = shingle_sets(pa.array([held[f][0] for f in fps], pa.large_string()), SHINGLE)
        good = [i for i, (f, s) in enumerate(zip(fps, sets)) if len(s) and _fingerprint(s) == f]  # another text under the same id is not meant
        if len(good) < 2:
            return []
        fps, sets = [fps[i] for i in good], [sets[i] for i in good]
        left, right = (np.array([held[f][k] for f in fps]) for k in (1, 2))
        labels = _links(sets, left, right)
        return [(fps[i], fps[j]) for i, j in enumerate(labels.tolist()) if i != j]

    for part in slices(batches, "text", 8 << 20):
        edges: list[tuple[int, int]] = []
        for g1, b1, g2, b2, side, fp, text in zip(*(part.column(c).to_pylist() for c in ("g1", "b1", "g2", "b2", "side", "fp", "text"))):
            if (g1, b1, g2, b2) != key:
                edges += finish()
                key, held = (g1, b1, g2, b2), {}
            same = (g1, b1) == (g2, b2)
            was = held.get(fp, (text, False, False))
            held[fp] = (text, was[1] or side == 1 or same, was[2] or side == 2 or same)
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])
    if edges := finish():
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])


def _row_key(id_column: str, text: str) -> Column:
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text).cast("string"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: sets of distinct ``SHINGLE``-word shingles, linked from 0.8 on.

    A text of fewer words is one shingle; a null or blank text has none and is its own component. ``component_id``
    is the smallest id reachable (rows of null id link like others, and give no id of their own). Equal sets link, so
    repeated rows share a component. ``keyed`` adds row_key (of id and text) and component (null without shingles), which
    tells components apart that have no id, or the same one.
    """
    rid = _row_key(id_column, text)  # an id may stand with several texts
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), rid.alias("rid"), F.col(text).cast("string").alias("text"))
    order = Order(common_shingles(rows))
    made = settled(rows.mapInArrow(_nodes(order), "doc_id long, rid long, n long, fp long, g long"), "sets")
    nodes = made.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.min("g").alias("g"), F.min("doc_id").alias("least"))
    nodes = settled(nodes, "nodes")
    groups = nodes.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    groups = groups.withColumn("nb", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"))
    postings = rows.select("text").mapInArrow(_postings(order), "token long, g long, low int, high int")
    meetings = postings.repartition("token").sortWithinPartitions("token", "g").mapInArrow(_meetings, "g1 long, g2 long, shared long, low long")
    meetings = meetings.groupBy("g1", "g2").agg(F.sum("shared").alias("shared"), F.min("low").alias("low"))
    qualified = meetings.where(F.expr(f"shared >= 1 + low div {MET_STEP}")).select("g1", "g2")
    alone = groups.where("m > 1").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    pairs = settled(qualified.union(alone), "groups-met")
    block = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    members = nodes.select("fp", "rid", "g").join(groups.select("g", "nb"), "g").withColumn("block", block)
    size = groups.select(F.col("g").alias("og"), F.col("nb").alias("onb"))
    cross, own = pairs.where("g1 <> g2"), pairs.where("g1 = g2")
    every = F.explode(F.sequence(F.lit(0), F.col("onb") - 1))
    one = cross.join(size, F.col("g2") == F.col("og")).join(members, F.col("g1") == F.col("g")).select("g1", F.col("block").alias("b1"), "g2", every.alias("b2"), F.lit(1).alias("side"), "fp", "rid")
    two = cross.join(size, F.col("g1") == F.col("og")).join(members, F.col("g2") == F.col("g")).select("g1", every.alias("b1"), "g2", F.col("block").alias("b2"), F.lit(2).alias("side"), "fp", "rid")
    within = own.join(members, F.col("g1") == F.col("g")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    within = within.select("g1", F.least("block", "o").alias("b1"), "g2", F.greatest("block", "o").alias("b2"), F.when(F.col("block") <= F.col("o"), 1).otherwise(2).alias("side"), "fp", "rid")
    items = one.unionByName(two).unionByName(within)
    work = items.join(rows.select("rid", "text"), "rid").drop("rid")
    key = ["g1", "b1", "g2", "b2"]
    edges = work.repartition(*key).sortWithinPartitions(*key).mapInArrow(_opened, "a long, b long")
    roots = components(edges)
    least = nodes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = settled(least, "roots")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    out = made.join(named, "fp", "left")
    more = [F.col("rid").alias("row_key"), F.col("root").alias("component")] if keyed else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)


def keep_one(docs: DataFrame, components_of: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text) per component: of the smallest id, and of its texts the one of the smallest key.

    Rows of null id in a component with an id go; a component of null ids alone keeps one row. Texts without shingles are
    each a component; of equal ones with equal ids one stays. Components need to be ``keyed`` where null ids stand with
    several texts, or an id does; without keys one row per id stays.
    """
    if "row_key" not in components_of.columns:
        named = components_of.select(F.col("doc_id").alias("__id"), "component_id").distinct()
        kept = named.where(F.expr("__id <=> component_id"))
        return docs.join(kept, F.expr("doc_id <=> __id"), "left_semi").dropDuplicates(["doc_id"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("row_key"))).alias("first")
    linked = components_of.where("component is not null").groupBy("component").agg(first).select(F.col("first.row_key").alias("__kept"))
    kept = linked.union(components_of.where("component is null").select("row_key"))
    row = private("__row", [*docs.columns, "__kept"])
    rows = docs.withColumn(row, _row_key("doc_id", "text"))
    return rows.join(kept, rows[row] == kept["__kept"], "left_semi").dropDuplicates([row]).drop(row)
