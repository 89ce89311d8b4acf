"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class given the words before it, times its share of the class. Classes are the
most frequent tokens, one each, and the shapes of the others (first and last byte). The class is
predicted in two steps (sixteen groups, then eight classes of the group) by a maximum-entropy model over hashed features:
the word before, the pair before, two skipped words and the last classes. Its weights start from nothing, where the
model equals the class frequencies, and are trained by rounds of gradient updates: every task walks the training
texts of its partition from the current weights, and the changes are averaged by the number of tokens.

Counts of tokens are a table. Scoring carries the counts of a bounded number of frequent tokens; the others meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import settled, slices
from deckloom.llm.words import words

GROUPS, MEMBERS = 16, 8
CLASSES = GROUPS * MEMBERS
#: Tokens with a class of their own, frequent tokens whose counts travel with a task, rows of the weight table.
OWN, FREQUENT, ROWS = 32, 1 << 19, 1 << 13
#: Rounds over the training texts; of their positions one in STRIDE gives a gradient, the others in the other rounds: every position in one round.
ROUNDS, BATCH, RATE = 2, 8_192, 0.6
STRIDE = ROUNDS
HELD = 1_500_000
BLOCK = 512
END = np.uint64(0x5851F42D4C957F2D)
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _shape_table() -> tuple[np.ndarray, np.ndarray]:
    """Kind of a first byte (12) and of a last byte (8)."""
    first, last = np.full(256, 10, np.int64), np.full(256, 6, np.int64)
    letters = np.arange(97, 123)
    first[letters], last[letters] = (letters - 97) % 9, (letters - 97) % 4
    first[48:58], last[48:58] = 9, 6
    first[128:], last[128:] = 11, 7
    last[ord(".")], last[ord(",")] = 4, 5
    return first, last


_FIRST, _LAST = _shape_table()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shape class, end of each text): words in lower case, each text closed by the end token."""
    h, at, first, last, _ = words(texts)
    n = len(at) - 1
    place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))
    out, shape = np.full(len(h) + n, END, np.uint64), np.zeros(len(h) + n, np.int64)
    out[place] = h
    shape[place] = OWN + (_FIRST[first] * 8 + _LAST[last])
    shape[at[1:] + np.arange(n)] = CLASSES - 1
    return out, shape, at[1:] + np.arange(n) + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        token, shape = (np.concatenate(x) for x in zip(*held))
        token, at, counts = np.unique(token, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(shape[at].astype(np.int32)), pa.array(counts)], names=["token", "shape", "c"])

    for part in slices(batches, "text"):
        h, shape, _ = tokens(part.column("text"))
        held.append((h, shape))
        n += len(h)
        if n > HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


@dataclass
class Model:
    """What a task needs: frequent tokens (sorted) with counts, own classes, class sizes, weights of features."""

    frequent: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    own_class: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    total: int
    types: int
    group_bias: np.ndarray
    member_bias: np.ndarray
    group_weights: np.ndarray
    member_weights: np.ndarray

    def classes(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, self.own_class[at], shape)

    def log_share(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a token's part of its class: its count and a half, of the class's tokens and a half per type and for an unseen one."""
        out = np.log10(c + 0.5) - self.log_class(cls)
        return np.where(cls < len(self.own), 0.0, out)

    def log_class(self, cls: np.ndarray) -> np.ndarray:
        return np.log10(self.class_tokens[cls] + 0.5 * (self.class_types[cls] + 1))


def features(h: np.ndarray, cls: np.ndarray, ends: np.ndarray, at: slice = slice(None)) -> np.ndarray:
    """Rows of the weight table for the positions ``at``: pair of last classes, word before, pair before, two skips."""
    n = len(h)
    start = np.zeros(n, np.int64)
    heads = np.r_[0, ends[:-1]]
    start[heads[heads < n]] = heads[heads < n]
    start = np.maximum.accumulate(start)
    back = []
    for k in (1, 2, 3):
        x = np.zeros(n, np.uint64)
        x[k:] = h[:-k] if n > k else x[k:]
        x[np.arange(n) - start < k] = np.uint64(k)
        back.append(x)
    pair = np.zeros(n, np.uint64)
    if n > 2:
        pair[2:] = (cls[1:-1] * CLASSES + cls[:-2] + 7).astype(np.uint64)
    pair[np.arange(n) - start < 2] = np.uint64(3)
    pair, back = pair[at], [x[at] for x in back]
    mixed = (pair * _MIX[0], back[0] * _MIX[1], back[0] * _MIX[2] + back[1] * _MIX[3], back[1] * _MIX[4], back[2] * _MIX[3])
    shift = np.uint64(64 - ROWS.bit_length() + 1)
    return np.stack([((m ^ (m >> np.uint64(31))) * _MIX[0]) >> shift for m in mixed], axis=1).astype(np.int64)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", z)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= _row_sums(z)[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at the column ``at``; ``z`` is used up."""
    z -= z.max(axis=1, keepdims=True)
    out = z[np.arange(len(at)), at]
    np.exp(z, out=z)
    return out - np.log(_row_sums(z))


def _predict(rows: np.ndarray, group: np.ndarray, gw: np.ndarray, mw: np.ndarray, gb: np.ndarray, mb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the groups, and of the members of the true group, before they are made probabilities."""
    members, cells = mw.reshape(-1, MEMBERS), rows * GROUPS + group[:, None]
    zg, zm = gb + gw.take(rows[:, 0], axis=0), mb.take(group, axis=0) + members.take(cells[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        zg += gw.take(rows[:, k], axis=0)
        zm += members.take(cells[:, k], axis=0)
    return zg, zm


def class_log10(m: Model, h: np.ndarray, cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 P(class | words before) of each position."""
    out = np.empty(len(h))
    rows = features(h, cls, ends)
    for a in range(0, len(h), BATCH * 2):
        some = slice(a, a + BATCH * 2)
        group, member = np.divmod(cls[some], MEMBERS)
        zg, zm = _predict(rows[some], group, m.group_weights, m.member_weights, m.group_bias, m.member_bias)
        out[some] = (_log_softmax_at(zg, group) + _log_softmax_at(zm, member)) / np.log(10)
    return out


def _sums(values: np.ndarray, order: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order`` of ``values``, in stretches of ``n`` rows from ``heads`` on. A stretch of one row is only copied."""
    out = values.take(order.take(heads), axis=0)
    many = np.flatnonzero(n > 1)
    if len(many):
        sizes = n[many]
        out[many] = np.add.reduceat(values.take(order[np.repeat(n > 1, n)], axis=0), np.cumsum(sizes) - sizes, axis=0)
    return out


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values`` to the row of ``table`` that ``rows`` names, also where it is named again.

    Two floats go as one complex number: numpy 2.3 adds these by index over ten times faster than single floats.
    """
    width = table.shape[1] // 2
    at = (rows * width)[:, None] + np.arange(width)
    np.add.at(table.view(np.complex64).reshape(-1), at.reshape(-1), values.view(np.complex64).reshape(-1))


def _step(rows: np.ndarray, cls: np.ndarray, gw: np.ndarray, mw: np.ndarray, gb: np.ndarray, mb: np.ndarray, seen: np.ndarray) -> None:
    """One batch: gradients are taken per row of the table at a rate that falls with how often the row was seen, now and before."""
    group, member = np.divmod(cls, MEMBERS)
    dg, dm = _predict(rows, group, gw, mw, gb, mb)
    np.negative(_softmax(dg), out=dg)
    np.negative(_softmax(dm), out=dm)
    i = np.arange(len(cls))
    dg[i, group] += 1
    dm[i, member] += 1
    members = mw.reshape(-1, MEMBERS)
    for k in range(rows.shape[1]):
        r = rows[:, k]
        cell = r * GROUPS + group
        count = np.bincount(r, minlength=ROWS)
        seen += count
        rate = RATE / np.sqrt(20 + seen)
        per_cell = (rate[r] / np.sqrt(np.bincount(cell, minlength=ROWS * GROUPS)[cell])).astype(np.float32)
        per_row = (rate / np.sqrt(np.maximum(count, 1))).astype(np.float32)[r]
        _add_rows(members, cell, dm * per_cell[:, None])
        _add_rows(gw, r, dg * per_row[:, None])


def _trained(m: Model, turn: int):
    """A task's change of the weights, times its tokens, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gw, mw, seen, n = m.group_weights.copy(), m.member_weights.copy(), np.zeros(ROWS), 0
        held, size = [], 0
        draw = np.random.default_rng(turn)

        def walk() -> None:
            rows, cls = (np.concatenate(x) for x in zip(*held))
            order = draw.permutation(len(cls))
            for a in range(0, len(order), BATCH):
                i = order[a : a + BATCH]
                _step(rows[i], cls[i], gw, mw, m.group_bias, m.member_bias, seen)

        for part in slices(batches, "text"):
            h, shape, ends = tokens(part.column("text"))
            cls = m.classes(h, shape)
            at = slice(turn % STRIDE, None, STRIDE)
            held.append((features(h, cls, ends, at), cls[at]))
            size += len(held[-1][1])
            n += len(h)
            if size > 16 * BATCH:
                walk()
                held, size = [], 0
        if size:
            walk()
        if n:
            change = np.concatenate([(gw - m.group_weights), (mw - m.member_weights).reshape(ROWS, -1)], axis=1)
            for b in range(0, ROWS, BLOCK):
                part = change[b : b + BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "salt": pa.array([n % 16], pa.int32()), "n": pa.array([float(n)]), "change": [(part * np.float32(n)).astype(np.float32).tobytes()]})
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "salt": pa.array([n % 16], pa.int32()), "n": pa.array([float(n)]), "change": [b""]})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for block, n, change in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "change"))):
            change = np.frombuffer(change, np.float32)
            held[block] = [held[block][0] + n, held[block][1] + change] if block in held else [n, change]
    for block, (n, change) in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([0], pa.int32()), "n": [n], "change": [change.tobytes()]})


def _vocabulary(texts: DataFrame) -> DataFrame:
    """token, shape, c over all ``texts``; counted per stretch of a task before the shuffle."""
    rows = texts.select("text").mapInArrow(_counts, "token long, shape int, c long")
    return settled(rows.groupBy("token", "shape").agg(F.sum("c").alias("c")), "tokens")


def train(texts: DataFrame) -> tuple[Model, DataFrame] | None:
    """The model and the table of token counts from ``texts`` (null: empty). None if there is no row."""
    texts = texts.select(F.col("text").cast("string").alias("text"))
    vocabulary = _vocabulary(texts)
    top = vocabulary.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    if not top.num_rows:
        return None
    token, counts = top["token"].to_numpy().view(np.uint64), top["c"].to_numpy()
    own, own_counts = token[:OWN], counts[:OWN]
    n_t, n_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocabulary.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        n_t[r["shape"]], n_v[r["shape"]] = r["c"], r["v"]
    total, types = int(n_t.sum()), int(n_v.sum())
    own_shape = top["shape"].to_numpy()[:OWN]
    np.subtract.at(n_t, own_shape, own_counts)
    np.subtract.at(n_v, own_shape, 1)
    n_t[: len(own)], n_v[: len(own)] = own_counts, 1
    prior = n_t + 0.5 * (n_v + 1)
    groups = prior.reshape(GROUPS, MEMBERS)
    by = np.argsort(own)
    order = np.argsort(token)
    m = Model(token[order], counts[order], own[by], by.astype(np.int64), n_t, n_v, total, types,
              np.log(groups.sum(axis=1) / groups.sum()).astype(np.float32), np.log(groups / groups.sum(axis=1, keepdims=True)).astype(np.float32),
              np.zeros((ROWS, GROUPS), np.float32), np.zeros((ROWS, GROUPS, MEMBERS), np.float32))
    schema = "block int, salt int, n double, change binary"
    for turn in range(ROUNDS):
        light = Model(m.frequent[:0], m.counts[:0], *list(vars(m).values())[2:])
        changes = texts.mapInArrow(_trained(light, turn), schema)
        for _ in range(2):  # sums of sixteen parts, then of those
            changes = changes.repartition("block", "salt").mapInArrow(_summed, schema)
        found = changes.collect()
        n = sum(r["n"] for r in found if r["block"] == -1)
        for r in found:
            if r["block"] >= 0:
                part = np.frombuffer(r["change"], np.float32).reshape(-1, GROUPS + CLASSES) / np.float32(n)
                some = slice(r["block"], r["block"] + BLOCK)
                m.group_weights[some] += part[:, :GROUPS]
                m.member_weights[some] += part[:, GROUPS:].reshape(-1, GROUPS, MEMBERS)
    return m, vocabulary


def _scored(shared) -> object:
    """For each row one sum of what is known here, and a row per further token with how often it stands in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for part in slices(batches, "text"):
            h, shape, ends = tokens(part.column("text"))
            cls = m.classes(h, shape)
            at = np.minimum(np.searchsorted(m.frequent, h), len(m.frequent) - 1)
            c = np.where(m.frequent[at] == h, m.counts[at], -1)
            frequent = c >= 0
            value = class_log10(m, h, cls, ends) + np.where(cls < len(m.own), 0.0, -m.log_class(cls))
            logs = np.where(frequent, np.log10(np.maximum(c, 0) + 0.5), 0.0)
            value += np.where(cls < len(m.own), 0.0, logs)
            starts = np.r_[0, ends[:-1]]
            n = ends - starts
            doc = np.repeat(np.arange(len(ends)), n)
            rare = np.flatnonzero(~frequent)
            row, other = doc[rare], h[rare]
            order = np.lexsort((other, row))
            row, other = row[order], other[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1])]) if len(row) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(row)])
            row, other, rest = row[first], other[first], len(first)
            ids, keys = part.column("doc_id"), part.column("key")
            take = pa.array(np.r_[np.arange(len(ends)), row])
            zeros = np.zeros(rest)
            # a row's own sum joins nothing: its token is made from its key
            token = np.r_[keys.to_numpy(zero_copy_only=False), other.view(np.int64)]
            columns = {
                "doc_id": ids.take(take), "key": keys.take(take), "held_out": part.column("held_out").take(take), "own": pa.array(np.r_[np.ones(len(ends), bool), np.zeros(rest, bool)]),
                "token": pa.array(token), "times": pa.array(np.r_[n, times]),
                "known": pa.array(np.r_[np.add.reduceat(frequent.astype(np.int64), starts), zeros.astype(np.int64)]),
                "logs": pa.array(np.r_[np.add.reduceat(logs, starts), zeros]), "value": pa.array(np.r_[np.add.reduceat(value, starts), zeros]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learned where ``held_out`` is false.

    Scores are log10 probabilities of whole texts, end token included. ``base_score`` is that of smoothed token
    frequencies, ``score`` that of the model. Null texts are empty: the end token alone. Repeated rows come back as often
    as they stand. If nothing is learned from (every row held out, or no row), both scores are those of a vocabulary with no counts: 0.

    Rows of frequent tokens need no join. The rest are dealt by token to the table of counts (Spark splits a
    hot one), and sums per row are merged before the last shuffle.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    got = train(rows.where(~F.col("held_out")).select("text"))
    if got is None:
        return rows.select("doc_id", "held_out", (F.size(F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")) + 1).cast("long").alias("n_tokens"), *[F.lit(0).cast("long").alias(c) for c in ("n_known", "train_tokens")], F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    model, vocabulary = got
    schema = "doc_id long, key long, held_out boolean, own boolean, token long, times long, known long, logs double, value double"
    keyed = rows.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("key"), "text")
    parts = keyed.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), schema)
    table = vocabulary.select(F.col("token").alias("t"), F.col("c"))
    joined = parts.join(table, (F.col("token") == F.col("t")) & ~F.col("own"), "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")
    one = lambda mine, other: F.sum(F.when(F.col("own"), mine).otherwise(other))
    sums = joined.groupBy("doc_id", "key", "held_out").agg(
        F.sum(F.col("own").cast("long")).alias("rows"), one(F.col("times"), F.lit(0)).alias("n_tokens"), one(F.col("known"), F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        one(F.col("logs"), log).alias("logs"), one(F.col("value"), log).alias("value"),
    )
    each = lambda c: (F.col(c) / F.col("rows"))
    norm = float(np.log10(model.total + 0.5 * (model.types + 1)))
    out = sums.select(
        "doc_id", "held_out", each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (each("logs") - each("n_tokens") * norm).alias("base_score"), each("value").alias("score"), F.col("rows").cast("int").alias("rows"),
    )
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows", "again")
