"""Best-fit packing by minimum bin slack over the histogram of lengths.

Lengths are at most the capacity, so a corpus of any size is a histogram of at most ``capacity`` counters.
Bins are planned on it: a bin takes the longest length left, and a bitset subset-sum dynamic program over the
lengths left (each as often as it is there) finds the fullest filling of the rest. The combination is removed as often
as its lengths last, which is one pattern repeated, so the plan has a few patterns per length however many
documents there are. Each piece has a number among the pieces of its length, counted per task and summed over
tasks, and a pattern owns a stretch of those numbers; so pieces find bin and place without meeting in one task.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckloom.llm.common import settled, slices

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks whose ids a worker remembers in a task, at most, and between tasks.
REMEMBERED, IDLE = 600_000, 200_000
#: Python's split takes these for white space, the tokenizer does not.
_MARKS = re.compile("[\x1c-\x1f]")
#: Runs of letters that stay letters in lower case: ASCII, Latin-1 and Latin Extended-A.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+")
#: Marks that stay together behind them; an apostrophe may begin an ending, and < a special token.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:;=-@\[-`{-~]+)")
_CHUNKS = re.compile("[^\t-\r ]+")


class Ids:
    """Little-endian 32-bit ids of texts, as the tokenizer gives them.

    The tokenizer drops white space, and no token, composed letter or special token spans it. So a text is its
    chunks between white space one after another, and the ids of repeated chunks are remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, new: list[str]) -> list[bytes]:
        """Words of letters make one token group each, so many are encoded as one text."""
        out = []
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            edges = (4 * np.searchsorted(owner, np.arange(len(some) + 1))).tolist()
            out += map(ids.__getitem__, map(slice, edges, edges[1:]))
        return out

    def _learn(self, new: set[str]) -> None:
        """A run of letters and the marks after it are token groups of their own."""
        letters = set(filter(_LETTERS.fullmatch, new))
        others = new.difference(letters)
        marked = {m[0]: m.groups() for m in map(_MARKED.fullmatch, others) if m}
        rest = list(others.difference(marked))
        words = letters.union(w for w, _ in marked.values()).difference(self.chunks)
        self.chunks.update(zip(words, self._encode(list(words))))
        known = self.chunks
        for mark in {mark for _, mark in marked.values()}.difference(known):
            known[mark] = self.whole(mark)
        known.update((c, known[w] + known[mark]) for c, (w, mark) in marked.items())
        known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)))

    def forget(self, most: int, stay: int) -> None:
        """Of more than ``most`` the first ``stay`` are kept, which are the frequent ones."""
        if len(self.chunks) > most:
            self.chunks = dict(itertools.islice(self.chunks.items(), stay))

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.forget(REMEMBERED, REMEMBERED // 3)
        taken = [_CHUNKS.findall(t) if _MARKS.search(t) else (t.lower() if t.isascii() and "<|" not in t else t).split() for t in texts]
        if new := set().union(*taken).difference(self.chunks):
            self._learn(new)
        known = self.chunks.__getitem__
        return [b"".join(map(known, cs)) for cs in taken]


_READY: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's tokenizer, loaded once."""
    if path not in _READY:
        _READY[path] = Ids(path)
    return _READY[path]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination (length, copies) of most tokens within ``room``; among equals long lengths are preferred.

    Bit t of ``reach`` says that t tokens can be made up. Copies of a length come in once as 1, 2, 4 ... together.
    """
    reach, mask = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0:
            some = min(some, left)
            steps.append((length, some, reach))
            reach |= reach << length * some & mask
            left, some = left - some, some * 2
        if reach >> room:
            break
    target, taken = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> target & 1:
            taken[length] = taken.get(length, 0) + some
            target -= length * some
    return sorted(taken.items(), reverse=True)


class Pattern(NamedTuple):
    bins: int
    parts: list[tuple[int, int]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (bins, combination) that use up every length of the histogram."""
    left = {length: n for length, n in counts.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        parts = dict(fullest(rest, capacity - longest))
        parts[longest] = parts.get(longest, 0) + 1
        bins = min(left[length] // copies for length, copies in parts.items())
        for length, copies in parts.items():
            left[length] -= bins * copies
            if not left[length]:
                del left[length]
        patterns.append(Pattern(bins, sorted(parts.items(), reverse=True)))
    return patterns


#: A length and a number in it as one number that sorts alike.
_SHIFT = 48


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (key of length and first number, first number, first bin, copies, place in the bin), sorted."""
    rows, used, first = [], {}, 0
    for bins, parts in patterns:
        at = 0
        for length, copies in parts:
            number = used.get(length, 0)
            rows.append(((length << _SHIFT) + number, number, first, copies, at))
            used[length], at = number + bins * copies, at + length * copies
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PIECE = [
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
]
_IDS = T.StructField("ids", T.BinaryType())


def _cutter(path: str, capacity: int, keep_ids: bool) -> Callable:
    """Pieces of documents, each with its task and its number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = ids_of(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "seq"] + ["ids"] * keep_ids
        for part in slices(batches, "text"):
            rows = []
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc, mine in zip(part.column("doc_id").to_pylist(), ids(texts)):
                mine += end
                for k, at in enumerate(range(0, len(mine), 4 * capacity)):
                    piece = mine[at : at + 4 * capacity] if len(mine) > 4 * capacity else mine
                    n = len(piece) // 4
                    number = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc, k, at // 4, n, zlib.crc32(piece), task, number) + ((piece,) if keep_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        ids.forget(IDLE, IDLE)

    return run


def _placer(known: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = known.value
        for batch in batches:
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            own = rows[np.searchsorted(rows[:, 0], (length << _SHIFT) + number, side="right") - 1]
            bins, place = np.divmod(number - own[:, 1], own[:, 3])
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(own[:, 2] + bins), pa.array(own[:, 4] + place * length)], names=[*kept, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: document, place in it, sequence, place in that, and (``keep_ids``) the ids themselves.

    A document is its ids and the end id; null and empty texts are the end id alone. Documents of more than
    ``capacity`` ids are cut into pieces of ``capacity`` and a rest, others stay whole. A null document id stays null;
    repeated rows are packed as often as they stand; an empty table gives no rows. Other columns are ignored.
    Sequences are numbered from 0 and hold at most ``capacity`` tokens.
    """
    if not 1 <= capacity < 1 << 14:
        raise ValueError("the capacity must be between 1 and 16,383")
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    extra = [_IDS] if keep_ids else []
    piece_type = T.StructType([*_PIECE, T.StructField("task", T.LongType()), T.StructField("seq", T.LongType()), *extra])
    # written once: numbers in a task are then the same for everything that follows
    pieces = settled(plain.mapInArrow(_cutter(tokenizer_path, capacity, keep_ids), piece_type), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    per_task = settled(per_task.select("task", "length", "n"), "lengths")
    # at most one row per length
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    known = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["task", "length"]).select(*[f.name for f in _PIECE], (F.col("first") + F.col("seq")).alias("number"), *[f.name for f in extra])
    placed_type = T.StructType([*_PIECE, *extra, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(_placer(known), placed_type)
