"""Phrase collocation mining with stripes: every prefix keys a counter of the words that come next.

A stripe of a prefix has one cell per next word and one cell for the prefix itself, its total. Tasks count
the stripes of a block of words in arrays and send its cells; Spark adds equal cells elementwise, so a prefix that a
third of all words belong to is as many groups as it has next words, and never one map in one task.
From the merged stripes come the counts of phrases (cells), of their first and last parts (totals) and the
largest extension of a phrase (maxima over cells).

Before that, cells that cannot reach the least count are ruled out, level by level: a phrase can only be frequent if
the phrases without its first and without its last word are, and if its 40-bit key is met often enough. Keys travel
as sorted differences, dealt by their first bits, three bytes each instead of a row. What may be frequent becomes a bitmap of
bounded size. Keys and bits may say yes too often, which costs cells and changes no count.

Texts are cut into words once. A block of one language keeps its distinct words with their counts and the rest as numbers
in this list, in the shared folder; every level reads these blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm import words as hashed
from deckloom.llm.common import settled, slices

LONGEST, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Words of a block, and bytes cut at a time.
BLOCK_WORDS, STRETCH = 1 << 19, 2 << 20
#: Bits per frequent phrase in a bitmap, and bits of a bitmap at least and at most (16 MB).
SPREAD, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27
#: Bits of a key. Parts number 2^LEAST_PARTS or more, so that one has PART_WORDS places or fewer; keys added up at a time.
KEY_BITS, LEAST_PARTS, PART_WORDS, ADDED = 40, 8, 1 << 22, 1 << 20
#: The next word of a stripe's total.
TOTAL = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: byte of a word, 1: blank between words, 2: end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of the phrases with one more word."""
    return hashed.mixed(prefix * _NEXT + word)


def _lang_seed(lang: str) -> np.uint64:
    seed = np.zeros(1, np.uint64)
    for b in lang.encode():
        seed = hashed.mixed(seed * _NEXT + np.uint64(b + 1))
    return seed[0]


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """Word hashes of ``texts`` one after another, whether each begins a piece, and the words at given places.

    A very long text is cut in stretches that end between words, so arrays have a bounded size.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    begin, stop = int(ends[0]), int(ends[-1])
    raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[begin:stop]] if stop > begin else np.zeros(0, np.uint8)
    ends = ends - begin
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text begins here
    edge[ends[:-1]] = True
    points = np.flatnonzero(edge), np.flatnonzero(kind == 2)
    found = []
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > STRETCH:
            outside = np.flatnonzero(kind[at + STRETCH :])
            end = at + STRETCH + int(outside[0]) if len(outside) else end
        found.append(_cut(raw[at:end], kind[at:end], edge[at : end + 1], at))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.astype(bool), lambda places: []
    h, firsts, lasts = (np.concatenate([f[i] for f in found]) for i in range(3))
    place = sum(np.searchsorted(x, firsts, side="right") for x in points)  # the piece by its number
    starts = np.ones(len(h), bool)
    starts[1:] = place[1:] != place[:-1]
    data = raw.tobytes()
    return h, starts, lambda places: [data[a : b + 1].decode("utf-8", "replace") for a, b in zip(firsts[places].tolist(), lasts[places].tolist())]


def _cut(raw: np.ndarray, kind: np.ndarray, edge: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    firsts, lasts = np.flatnonzero(first), np.flatnonzero(last)
    powers, inverse = hashed._powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(hashed._BYTES[raw] * powers[: len(raw)], out=sums[1:])
    h = hashed.mixed((sums[lasts + 1] - sums[firsts]) * inverse[firsts] + (lasts - firsts).astype(np.uint64))
    return h, firsts + at, lasts + at


class _Block:
    """Words of one language that a task has met and not yet sent."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, _lang_seed(lang)
        self.hashes: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.known, self.words, self.n = np.zeros(0, np.uint64), [], 0

    def add(self, texts: pa.Array) -> None:
        h, starts, named = cut(texts)
        h = hashed.mixed(h ^ self.seed)
        h[h == TOTAL] = 1
        own, at = np.unique(h, return_index=True)
        new = ~np.isin(own, self.known)
        self.words += named(at[new])
        self.known = np.concatenate([self.known, own[new]])
        self.hashes.append(h)
        self.starts.append(starts)
        self.n += len(h)

    def row(self) -> pa.RecordBatch:
        order = self.known.argsort()
        known = self.known[order]
        codes = np.searchsorted(known, np.concatenate(self.hashes)).astype(np.int32)
        counts = np.bincount(codes, minlength=len(known)).astype(np.int64)
        listed = pa.array(np.array([0, len(known)], np.int32))
        columns = [
            pa.array([self.lang], pa.string()), pa.array([self.n], pa.int64()),
            pa.ListArray.from_arrays(listed, pa.array(self.words, pa.string()).take(pa.array(order))),
            pa.ListArray.from_arrays(listed, pa.array(known.view(np.int64))), pa.ListArray.from_arrays(listed, pa.array(counts)),
            pa.array([codes.tobytes()], pa.binary()), pa.array([np.packbits(np.concatenate(self.starts)).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "n", "words", "hashes", "counts", "codes", "starts"])


_BLOCK_TYPE = "lang string, n long, words array<string>, hashes array<long>, counts array<long>, codes binary, starts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[str, _Block] = {}
    for part in slices(batches, "text"):
        for lang in pc.unique(part.column("lang")).to_pylist():
            block = open_blocks.get(lang) or open_blocks.setdefault(lang, _Block(lang))
            block.add(part.column("text").filter(pc.equal(part.column("lang"), lang)))
            if block.n >= BLOCK_WORDS:
                yield block.row()
                del open_blocks[lang]
        if sum(b.n for b in open_blocks.values()) >= 2 * BLOCK_WORDS:  # many languages in one task
            lang = max(open_blocks, key=lambda x: open_blocks[x].n)
            yield open_blocks.pop(lang).row()
    for block in open_blocks.values():
        if block.n:
            yield block.row()


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key one place and its count."""
    order = keys.argsort()
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order[at], np.diff(np.r_[at, len(keys)])


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _begun(batches: Iterator[pa.RecordBatch], first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each block the places and hashes of its frequent words, and its word numbers, starts of pieces and hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            known = np.asarray(batch.column("hashes")[i].values).view(np.uint64)
            codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int32)
            starts = np.unpackbits(np.frombuffer(batch.column("starts")[i].as_py(), np.uint8), count=len(codes)).astype(bool)
            places = np.flatnonzero(_passes(first, known)[codes])
            yield places, known[codes[places]], codes, starts, known


def _keys(bitmaps: list, size: int, part_bits: int) -> Callable:
    """Keys of the phrases one word longer than ``size`` whose two shorter phrases may be frequent, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(b.value, np.uint64) for b in bitmaps]
        inner = np.uint64(KEY_BITS - part_bits)
        for places, prefix, codes, starts, known in _begun(batches, maps[0]):
            for k in range(1, size + 1):
                places, _, prefix = _extended(places, prefix, codes, starts, known, k)
                if k < size:
                    good = _passes(maps[k], prefix)
                    places, prefix = places[good], prefix[good]
            keys = np.sort(prefix & np.uint64((1 << KEY_BITS) - 1))
            if not len(keys):
                continue
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            n, keys = np.diff(np.r_[at, len(keys)]), keys[at]
            parts = keys >> inner
            edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True])
            gaps = keys - (parts << inner)
            gaps[1:] -= np.where(parts[1:] == parts[:-1], gaps[:-1], np.uint64(0))
            cut_at = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[edges[:-1]].astype(np.int64)), pa.array([_planes(gaps[a:b]) for a, b in cut_at], pa.binary()), pa.array([_planes(n[a:b].astype(np.uint64)) for a, b in cut_at], pa.binary())],
                names=["part", "gaps", "n"],
            )

    return run


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as all their first bytes, all their second bytes ..., so that Spark's compression finds the empty ones."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _frequent(least: int, part_bits: int) -> Callable:
    """Keys that are met ``least`` times or more. Rows come sorted by part; a part's keys are added up as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, held, most = None, [], [], 0, ADDED

        def added() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.concatenate(keys), np.concatenate(counts)
            order = own.argsort()
            own, n = own[order], n[order]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            return own[at], np.minimum(np.add.reduceat(n, at), least)

        def enough() -> pa.RecordBatch:
            own, n = added()
            return pa.RecordBatch.from_arrays([pa.array(own[n >= least].astype(np.int64))], names=["phrase"])

        for batch in batches:
            for one, gaps, n in zip(batch.column("part").to_pylist(), batch.column("gaps"), batch.column("n")):
                if one != part and part is not None:
                    yield enough()
                    keys, counts, held, most = [], [], 0, ADDED
                part = one
                keys.append(np.cumsum(_numbers(gaps.as_py())) + np.uint64(one << KEY_BITS - part_bits))
                counts.append(np.minimum(_numbers(n.as_py()), np.uint64(least)).astype(np.int64))
                held += len(keys[-1])
                if held > most:
                    own, total = added()
                    keys, counts, held, most = [own], [total], len(own), max(most, 2 * len(own))
        if part is not None:
            yield enough()

    return run


def _cells(bitmaps: list) -> Callable:
    """Cells (size, prefix, next, n) of the stripes of all prefixes, and their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(b.value, np.uint64) for b in bitmaps]
        for places, prefix, codes, starts, known in _begun(batches, maps[0]):
            for size in range(1, len(maps)):
                at, n = _counted(prefix)
                yield _cell_batch(size, prefix[at], np.full(len(at), TOTAL, np.uint64), n)
                places, prefix, h = _extended(places, prefix, codes, starts, known, size)
                good = _passes(maps[size], h)
                places, prefix, h = places[good], prefix[good], h[good]
                at, n = _counted(h)
                yield _cell_batch(size, prefix[at], known[codes[places[at] + size]], n)
                prefix = h

    return run


def _extended(places: np.ndarray, prefix: np.ndarray, codes: np.ndarray, starts: np.ndarray, known: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``places`` with phrases of ``size`` words those whose next place has one too, in the same piece; and the longer phrases."""
    if not len(places):
        return places, prefix, prefix
    follows = np.r_[places[1:] == places[:-1] + 1, False]
    follows[:-1] &= ~starts[places[:-1] + 1]
    places, prefix = places[follows], prefix[follows]
    return places, prefix, longer(prefix, known[codes[places + size]])


def _cell_batch(size: int, prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(prefix), size, np.int32)), pa.array(prefix.view(np.int64)), pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["size", "prefix", "next", "n"])


def _with_phrase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix, word = (np.asarray(batch.column(c)).view(np.uint64) for c in ("prefix", "next"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(longer(prefix, word).view(np.int64))], names=["size", "prefix", "next", "n", "phrase"])


def _bitmap(phrases: DataFrame) -> object:
    """The frequent phrases' hashes as bits, 16 MB at most, for the tasks."""
    n = phrases.count()
    bits = LEAST_BITS
    while bits < min(SPREAD * n, MOST_BITS):
        bits *= 2
    place = F.col("phrase").bitwiseAND(F.lit(bits - 1))
    cells = phrases.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(phrase & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(cells.column("at"))] = np.asarray(cells.column("bits"))
    return phrases.sparkSession.sparkContext.broadcast(out.tobytes())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every cut of every phrase: the hashes of its first and its last part."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hs = batch.column("hs")
        sizes = np.diff(np.asarray(hs.offsets))
        flat, begin = np.asarray(hs.values).view(np.uint64), np.asarray(hs.offsets)[:-1]
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            own = flat[begin[rows][:, None] + np.arange(size)]
            kept = batch.take(pa.array(rows))
            for k in range(1, size):
                sides = []
                for some in (own[:, :k], own[:, k:]):
                    h = some[:, 0]
                    for c in range(1, some.shape[1]):
                        h = longer(h, some[:, c])
                    sides.append(pa.array(np.ascontiguousarray(h).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("phrase"), kept.column("lang"), kept.column("text"), kept.column("n"), pa.array(np.full(len(rows), k, np.int32)), pa.array(np.full(len(rows), size, np.int32)), *sides],
                    names=["phrase", "lang", "text", "a", "k", "size", "first", "rest"],
                )


def collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, longest: int = LONGEST,
) -> DataFrame:
    """The ``top`` phrases of every language by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to ``longest`` words that occur ``least`` times are candidates; one that lies in a longer
    candidate with at least ``subsumed`` percent of its count goes. Ties go by count, then by the phrase's bytes, so ranks are total.
    Null texts and texts without words add nothing; a null language is ``und``; repeated rows count as often as they
    stand; an empty table gives no rows; other columns are ignored. Phrases are told apart by 64-bit hashes of their words and language:
    two of m phrases share one with probability m^2 / 2^65.
    """
    plain = docs.select(F.coalesce(docs[lang_column].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_column].cast("string").alias("text"))
    blocks = settled(plain.mapInArrow(_blocks, _BLOCK_TYPE), "words")
    # the stripe of the empty prefix of each language
    met = blocks.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w"))
    known = met.groupBy("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("phrase")).agg(F.sum("w.counts").alias("n"))
    vocabulary = settled(known.where(F.col("n") >= least), "vocabulary")
    found = vocabulary.select("phrase", "lang", F.col("word").alias("text"), F.array("phrase").alias("hs"))
    last = vocabulary.select(F.col("phrase").alias("next"), "word")
    bitmaps = [_bitmap(vocabulary)]
    words = blocks.agg(F.sum("n")).head()[0] or 0
    part_bits = min(max(LEAST_PARTS, (words // PART_WORDS).bit_length()), KEY_BITS - 1)
    places = blocks.select("hashes", "codes", "starts")
    for size in range(1, longest):
        keys = places.mapInArrow(_keys(bitmaps, size, part_bits), "part long, gaps binary, n binary")
        often = keys.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent(least, part_bits), "phrase long")
        bitmaps.append(_bitmap(settled(often, f"keys{size}")))
    merged = places.mapInArrow(_cells(bitmaps), "size int, prefix long, next long, n long").groupBy("size", "prefix", "next").agg(F.sum("n").alias("n"))
    merged = settled(merged.where(F.col("n") >= least).mapInArrow(_with_phrase, "size int, prefix long, next long, n long, phrase long"), "stripes")
    totals = merged.where(F.col("next") == TOTAL).select(F.col("prefix").alias("part"), F.col("n").alias("f"))
    candidates = None
    for size in range(1, longest):
        stripe = merged.where((F.col("next") != TOTAL) & (F.col("size") == size)).drop("size")
        named = stripe.join(found.select(F.col("phrase").alias("prefix"), "lang", "text", "hs"), "prefix").join(last, "next")
        named = settled(named.select("phrase", "lang", F.concat_ws(" ", "text", "word").alias("text"), F.concat("hs", F.array("next")).alias("hs"), "n"), f"phrases{size}")
        found = named.drop("n")
        candidates = named if candidates is None else candidates.union(named)
    cuts = settled(candidates.mapInArrow(_parts, "phrase long, lang string, text string, a long, k int, size int, first long, rest long"), "cuts")
    # what is one word longer and holds a phrase: a cell of its stripe, or a phrase whose rest it is
    holding = cuts.where(F.col("k") == F.col("size") - 1).select(F.col("first").alias("phrase"), "a").union(cuts.where(F.col("k") == 1).select(F.col("rest").alias("phrase"), "a"))
    largest = holding.groupBy("phrase").agg(F.max("a").alias("held"))
    scored = cuts.join(totals.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(totals.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(19,0)) * 2000000BD) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    weakest = scored.groupBy("phrase", "lang", "text", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = weakest.join(largest, "phrase", "left").where(f"held is null or cast(held as decimal(19,0)) * 100BD < cast(a as decimal(19,0)) * {int(subsumed)}BD")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = kept.select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    per_lang = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
