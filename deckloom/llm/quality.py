"""Quality classifier: random-indexing word vectors, pooled per document, under a small calibrated network.

Every unit (word, number, run of symbols) has a fixed sparse random vector; its word vector adds the vectors of
its neighbours over the training texts. A document is the mean of its units' vectors. Two layers of weights
turn that into a probability, whose temperature is fitted on training rows that the weights did not see.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import slices

#: Bound of the labelled sample, buckets of units, size of a vector, non-zero places in a random vector.
TRAIN_ROWS, BUCKETS, WIDTH, PLACES = 20_000, 1 << 15, 64, 6
WINDOW, HIDDEN, EPOCHS, RATE, HELD = 2, 32, 60, 0.01, 5
THRESHOLD = 0.7
REMEMBERED = 200_000
#: Rows of the vector table that travel together; units of a text whose vectors are laid out at a time.
BLOCK, STRETCH = 2_048, 8_192

_UNITS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
#: The first buckets are marks; numbers share one.
NUMBER, MARKS, CAPITALS = 0, 8, 1 << 20


class Units:
    """Bucket of each unit of a text. What stands between blanks repeats, so a bounded number of it is remembered."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    @staticmethod
    def bucket(unit: str) -> int:
        """The bucket, with ``CAPITALS`` added for a word in capitals."""
        if unit[0].isdecimal():
            return NUMBER
        if unit[0].isalpha():
            return MARKS + zlib.crc32(unit.lower().encode()) % (BUCKETS - MARKS) + (CAPITALS if len(unit) > 1 and unit.isupper() else 0)
        return MARKS + zlib.crc32(unit[:4].encode()) % (BUCKETS - MARKS)

    def __call__(self, text: str) -> tuple[np.ndarray, int, int]:
        """Buckets in order, how many units repeat the one before, how many are in capitals."""
        pieces, known = text.split(), self.known
        try:
            raw = b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > REMEMBERED:
                self.known = known = dict(itertools.islice(known.items(), REMEMBERED // 4))
            for p in set(pieces):
                if p not in known:
                    known[p] = np.array([self.bucket(u) for u in _UNITS.findall(p)], np.int32).tobytes()
            raw = b"".join(map(known.__getitem__, pieces))
        codes = np.frombuffer(raw, np.int32)
        plain = codes & (CAPITALS - 1)
        return plain, int((plain[1:] == plain[:-1]).sum()), int((codes >= CAPITALS).sum())


def index_vectors() -> np.ndarray:
    """The fixed sparse random vectors: ``PLACES`` entries of plus or minus one each."""
    draw = np.random.default_rng(7)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    rows = np.arange(BUCKETS)
    for _ in range(PLACES):
        out[rows, draw.integers(0, WIDTH, BUCKETS)] += draw.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of neighbours' vectors by bucket, and counts, in blocks of the table."""
    index, units = index_vectors(), Units()
    sums, counts = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS, np.float64)
    for part in slices(batches, "text"):
        for text in part.column("text").to_pylist():
            ids, _, _ = units(text or "")
            for start in range(0, len(ids), STRETCH):
                stop = min(len(ids), start + STRETCH)
                low = max(0, start - WINDOW)
                vectors = index[ids[low : stop + WINDOW]]
                near = np.zeros_like(vectors)
                for k in range(1, WINDOW + 1):
                    near[k:] += vectors[:-k]
                    near[:-k] += vectors[k:]
                mine = ids[start:stop]
                order = np.argsort(mine, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(mine[order]) != 0])
                sums[mine[order][heads]] += np.add.reduceat(near[order + (start - low)], heads, axis=0)
                counts[mine[order][heads]] += np.diff(np.r_[heads, len(mine)])
    for b in range(0, BUCKETS, BLOCK):
        if counts[b : b + BLOCK].any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "sums": [sums[b : b + BLOCK].tobytes()], "counts": [counts[b : b + BLOCK].tobytes()]})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for b, s, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            s, c = np.frombuffer(s, np.float32), np.frombuffer(c, np.float64)
            held[b] = [held[b][0] + s, held[b][1] + c] if b in held else [s, c]
    for b, (s, c) in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "sums": [s.tobytes()], "counts": [c.tobytes()]})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """BUCKETS x WIDTH. Sums are added up on the way, per task and per block of the table; the table is of fixed size."""
    schema = "block int, sums binary, counts binary"
    parts = texts.select("text").mapInArrow(_contexts, schema).repartition(BUCKETS // BLOCK, "block").mapInArrow(_summed, schema)
    sums, counts = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS)
    for row in parts.collect():
        b = row["block"]
        sums[b : b + BLOCK] = np.frombuffer(row["sums"], np.float32).reshape(-1, WIDTH)
        counts[b : b + BLOCK] = np.frombuffer(row["counts"], np.float64)
    total = max(1.0, counts.sum())
    sums -= np.outer(counts, sums.sum(axis=0) / total).astype(np.float32)  # what all units have in common says nothing
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = index_vectors() / np.sqrt(PLACES) + np.where(norms > 0, sums / np.maximum(norms, 1e-9), 0)
    vectors[counts < 2] = 0  # a unit hardly seen has no vector
    weight = 1e-3 / (1e-3 + counts / total)
    vectors *= weight[:, None]
    marks = index_vectors()[:MARKS]
    vectors[:MARKS] = marks / np.linalg.norm(marks, axis=1, keepdims=True)
    return vectors.astype(np.float32)


def pooled(text: str, units: Units, vectors: np.ndarray) -> np.ndarray:
    """Mean vector; shares of repeats, capitals, different units, numbers and lines; log length."""
    ids, same, capitals = units(text)
    out = np.zeros(WIDTH + 6, np.float32)
    n = len(ids)
    if n:
        counts = np.bincount(ids, minlength=1)
        used = np.flatnonzero(counts)
        out[:WIDTH] = counts[used].astype(np.float32) @ vectors[used] / n
        out[WIDTH:] = same / n, capitals / n, len(used) / n, (ids < MARKS).mean(), text.count("\n") / n, np.log1p(n) / 10
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, vectors: np.ndarray) -> Model:
    """Adam on the log loss, then the temperature with the least log loss on the held rows."""
    draw = np.random.default_rng(11)
    learn, rest = np.flatnonzero(~held), np.flatnonzero(held)
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-4
    m = Model(vectors, mean, scale, draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, HIDDEN), 0.0, 1.0)
    z = (x - mean) / scale
    p = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for epoch in range(EPOCHS):
        draw.shuffle(learn)
        for at in range(0, len(learn), 128):
            i = learn[at : at + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40)))
            d = (out - y[i]) / len(i)
            back = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(rest):
        logits = m.logits(x[rest])
        loss = lambda t: np.log1p(np.exp(-np.clip(np.where(y[rest] > 0, logits, -logits) / t, -40, 40))).mean()
        m.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return m


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, rows: int = TRAIN_ROWS) -> Model | None:
    """Model from at most ``rows`` labelled documents (``labels.quality`` 0 or 1), those of the lowest hash of their id.

    ``learn_from`` filters ids. Null labels and ids teach nothing; one label is kept of repeated ones. None if
    there is no labelled row. Only the pooled vectors of the sample (70 numbers a row) reach the driver.
    """
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    if learn_from is not None:
        named = named.where(learn_from)
    named = named.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    vectors = word_vectors(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for part in slices(batches, "text"):
            got = [pooled(t or "", units, vectors).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "quality": part.column("quality"), "x": got})

    seen = {}
    for r in sample.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(features, "doc_id long, quality int, x binary").toLocalIterator():
        if len(seen) < rows:
            seen[r["doc_id"], bytes(r["x"])] = r["quality"]
    if not seen:
        return None
    order = sorted(seen)
    x = np.array([np.frombuffer(k[1], np.float32) for k in order], np.float64)
    y = np.array([seen[k] for k in order], np.float64)
    held = np.array([zlib.crc32(f"held{k[0]}".encode()) % HELD == 0 for k in order])
    return _fit(x, y, held, vectors)


def score(docs: DataFrame, model: Model | None, keep: list[Column] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on), no shuffle.

    Null and empty texts have the score of an empty text. With no model every score is 0.5.
    The model is of fixed size and travels with the task.
    """
    kept = list(keep or [])
    rows = docs.select(*kept, F.col("text").cast("string").alias("__text"))
    schema = rows.select(*rows.columns[: len(kept)], F.lit(0.5).alias("score"), F.lit(0).alias("predicted")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, m = Units(), shared.value
        for part in slices(batches, "__text"):
            texts = part.column("__text").to_pylist()
            s = m.scores(np.array([pooled(t or "", units, m.vectors) for t in texts], np.float64)) if m else np.full(len(texts), 0.5)
            arrays = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)
