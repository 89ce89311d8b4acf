"""Harmonic packing: lengths in the classes (C/(k+1), C/k], and k documents of class k to a sequence.

Every worker fills the sequences of each class on its own, whatever the others do, so there is no shuffle. The k
documents of a full sequence leave less than C/(k+1) tokens free; the documents that come next fill them, and
the last of these is cut there. So a sequence costs one cut at most, and all of them are full. What a worker holds at
its end is laid out one after another and cut at the capacity; the last stretch goes to sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from deckloom.llm.common import slices

CAPACITY = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids a worker remembers in a task, at most, and between tasks, when its memory belongs to others.
REMEMBERED, IDLE = 600_000, 300_000

#: Characters on which the tokenizer's word pattern and Python's agree: ASCII without the separators 1C-1F,
#: and the letters of Latin-1 and Latin Extended-A. Other texts go through the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ſ]*")
#: White space before a space: there the space would not begin a word.
_RUN = re.compile(r"\s ")
#: With these, or with a line break at an end, breaks of a text are not taken apart.
_ODD_BREAKS = ("\n\n", " \n", "\n ", "\t", "\r")
#: Stands for a line break before a piece; no plain text has it.
_BREAK = "\x01"
#: Runs of letters, and marks that stay together behind them; an apostrophe may begin an ending.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+")
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]+)")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def _plain_breaks(text: str) -> bool:
    return "\n" in text and text[0] != "\n" != text[-1] and not any(b in text for b in _ODD_BREAKS)


class Ids:
    """Little-endian 32-bit ids of texts, as the tokenizer gives them.

    Texts are taken apart at spaces and line breaks, where the tokenizer's words always begin, and what stands between
    repeats, so its ids are remembered. Texts for which that does not hold go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}  # what stands after a space
        self.heads: dict[str, bytes] = {}  # what a text begins with
        self.marks: dict[str, bytes] = {}
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, words: list[str], between: str, step: int) -> list[bytes]:
        """Ids of runs of letters behind ``between``: one token group each (every ``step``-th), so many are encoded as one text."""
        out = []
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            e = self.tokenizer.encode(between + between.join(some), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            first = np.arange(len(some)) * step + step - 1
            begin, end = (4 * np.searchsorted(owner, first + k) for k in (0, 1))
            out += map(ids.__getitem__, map(slice, begin.tolist(), end.tolist()))
        return out

    def _learn(self, new: set[str], known: dict[str, bytes], before: str) -> None:
        """Ids of new pieces after ``before``, a space or nothing. A run of letters and the marks after it are token groups of their own."""
        letters = set(filter(_LETTERS.fullmatch, new))
        others = new.difference(letters)
        marked = {m[0]: m.groups() for m in map(_MARKED.fullmatch, others) if m}
        words = list(letters.union(w for w, _ in marked.values()).difference(known))
        known.update(zip(words, self._joined(words, " ", 1) if before else self._joined(words, "\n", 2)))
        for mark in {mark for _, mark in marked.values()}.difference(self.marks):
            self.marks[mark] = self.whole(mark)
        known.update((c, known[w] + self.marks[mark]) for c, (w, mark) in marked.items())
        for c in others.difference(marked):
            known[c] = self.whole(before + c)

    def forget(self, most: int, stay: int) -> None:
        """Of more than ``most`` pieces the first ``stay`` ones are kept, which are the frequent ones."""
        for name in ("pieces", "heads", "marks"):
            if len(had := getattr(self, name)) > most:
                setattr(self, name, dict(itertools.islice(had.items(), stay)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.forget(REMEMBERED, IDLE)
        plain = [bool(t and _PLAIN.fullmatch(t) and not _RUN.search(t) and not any(s in t for s in self.special)) for t in texts]
        taken = [(t.replace("\n", " " + _BREAK) if _plain_breaks(t) else t).split(" ") for t, ok in zip(texts, plain) if ok]
        firsts = [ps.pop(0) for ps in taken]
        if new := set().union(*taken).difference(self.pieces):
            begun = [p for p in new if p[:1] == _BREAK]
            self._learn(new.difference(begun), self.pieces, " ")
            self._learn({p[1:] for p in begun}.difference(self.heads), self.heads, "")
            self.pieces.update((p, self.line + self.heads[p[1:]]) for p in begun)
        if new := set(firsts).difference(self.heads):
            self._learn(new, self.heads, "")
        known = self.pieces.__getitem__
        done = (self.heads[f] + b"".join(map(known, ps)) for f, ps in zip(firsts, taken))
        return [next(done) if ok else self.whole(t) for t, ok in zip(texts, plain)]


_READY: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's tokenizer, loaded once."""
    if path not in _READY:
        _READY[path] = Ids(path)
    return _READY[path]


class Bins:
    """One worker's sequences: an open one per class, and one whose documents are together and that is being filled up.

    Pieces are (document, start, length, ...); ``cut(piece, n)`` gives its first n tokens and the rest.
    """

    def __init__(self, first: int, capacity: int, cut: Callable[[tuple, int], tuple[tuple, tuple]]):
        self.open: dict[int, list[tuple]] = {}
        self.filling: list[tuple] = []
        self.free = 0
        self.next, self.capacity, self.cut = first, capacity, cut

    def _leave(self, pieces: list[tuple]) -> Iterator[tuple]:
        number, self.next, at = self.next, self.next + 1, 0
        for piece in pieces:
            yield (*piece, number, at)
            at += piece[2]

    def _fill(self, piece: tuple) -> tuple | None:
        """Puts the piece, or as much of it as fits, in the sequence that is being filled; what is left of it."""
        left = None
        if piece[2] > self.free:
            piece, left = self.cut(piece, self.free)
        self.filling.append(piece)
        self.free -= piece[2]
        return left

    def add(self, piece: tuple) -> Iterator[tuple]:
        while piece:
            if self.free:
                piece = self._fill(piece)
                if not self.free:
                    yield from self._leave(self.filling)
                    self.filling = []
            elif piece[2] >= self.capacity:
                self.free = self.capacity
            else:
                k = self.capacity // piece[2]
                pieces = self.open.setdefault(k, [])
                pieces.append(piece)
                piece = None
                if len(pieces) == k:
                    del self.open[k]
                    self.free = self.capacity - sum(p[2] for p in pieces)
                    self.filling = pieces
                    if not self.free:
                        yield from self._leave(pieces)
                        self.filling = []

    def close(self) -> Iterator[tuple]:
        """What is left, one after another; the last stretch in sequences of powers of two."""
        rest = self.filling + [p for _, pieces in sorted(self.open.items()) for p in pieces]
        self.open, self.filling, total = {}, [], sum(p[2] for p in rest)
        rest.reverse()
        while total:
            self.free = min(self.capacity, 1 << total.bit_length() - 1)
            total -= self.free
            while self.free:
                if left := self._fill(rest.pop()):
                    rest.append(left)
            yield from self._leave(self.filling)
            self.filling = []


def _packer(path: str, capacity: int, id_column: str, text_column: str, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        end = np.array([END_ID], "<u4").tobytes()

        def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
            doc, start, length, tokens, ids_here = piece
            rest = ids_here[4 * n :]
            if length - n < capacity:  # may wait for its class: without the rest of a long document
                rest = memoryview(bytes(rest))
            return (doc, start, n, tokens, ids_here[: 4 * n]), (doc, start + n, length - n, tokens, rest)

        bins = Bins(TaskContext.get().partitionId() << 40, capacity, cut)
        schema = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in SCHEMA if keep_ids or f.name != "ids"])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, length, tokens, held, number, offset = list(zip(*rows)) or [[]] * 7
            columns = [doc, start, length, list(map(zlib.crc32, held)), tokens, number, offset] + [list(map(bytes, held))] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for part in slices(batches, text_column):
            rows: list[tuple] = []
            texts = [t or "" for t in part.column(text_column).to_pylist()]
            for doc, mine in zip(part.column(id_column).to_pylist(), ids(texts)):
                mine += end
                rows += bins.add((doc, 0, len(mine) // 4, len(mine) // 4, memoryview(mine)))
            if rows:
                yield out(rows)
        if rows := list(bins.close()):
            yield out(rows)
        ids.forget(IDLE, IDLE)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: document, place in it, sequence, place in that, and (``keep_ids``) the ids themselves.

    ``capacity`` is a power of two. Documents stay whole but for one cut a sequence and those longer than the capacity.
    A document is its ids and the end id; null and empty texts are the end id alone. A null document id stays null; repeated rows are packed as often as they stand. Sequence numbers
    hold the number of the task's partition, so they are unique without a count over all. Every sequence has
    either ``capacity`` tokens or a smaller power of two. A lost task is packed again from the same rows.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    schema = SCHEMA if keep_ids else T.StructType([f for f in SCHEMA if f.name != "ids"])
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return plain.mapInArrow(_packer(tokenizer_path, capacity, "doc_id", "text", keep_ids), schema)
