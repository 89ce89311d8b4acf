"""Lempel-Ziv phrase fingerprint: a document's dictionary phrases, hashed and reduced to a minimum-hash signature.

A text is parsed as LZ78 does: each phrase is the shortest run of code points not met before. The set of
phrases is what a compressor would have learned, so the overlap of two sets tells how well one text would help to
compress the other. Signatures are one-permutation minimum hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckloom.llm.common import slices

BINS = 128
MASK = (1 << 61) - 1
BASE = 1_099_511_628_211
_ROTATE = np.uint64(0x9E3779B97F4A7C15)


def parse(points: list[int], seen: set[int], carry: int = 0) -> int:
    """Add the phrases of ``points`` to ``seen``; the hash of the unfinished phrase is carried in and out."""
    h, add, mask, base = carry, seen.add, MASK, BASE
    for c in points:
        h = (h * base + c + 1) & mask
        if h not in seen:
            add(h)
            h = 0
    return h


def signature(phrases: set[int]) -> np.ndarray:
    """16 bits of the smallest hash in each bin; empty bins take the next full bin's value, shifted by the distance.

    No phrases: all zero.
    """
    if not phrases:
        return np.zeros(BINS, np.uint16)
    h = np.fromiter(phrases, np.uint64, len(phrases))
    h ^= h >> np.uint64(31)
    h *= _ROTATE
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    bins = (h & np.uint64(BINS - 1)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, h >> np.uint64(7))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    at = np.searchsorted(full, np.arange(BINS)) % len(full)
    distance = (full[at] - np.arange(BINS)) % BINS
    value = (least[full[at]] + distance.astype(np.uint64) * _ROTATE) >> np.uint64(17)
    return (value & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)


def hexed(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins; two empty texts are alike, an empty and another text are not."""
    return float((a == b).mean())


def code_points(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").tolist()


def fingerprints(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of the whole text (null and empty: all zero), with no shuffle."""
    kept = list(keep or [])
    rows = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = rows.select(*rows.columns[: len(kept)], F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            signs = []
            for value in part.column("__text").to_pylist():
                seen: set[int] = set()
                parse(code_points(value or ""), seen)
                signs.append(hexed(signature(seen)))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns - 1)] + [pa.array(signs, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place: each is finished when the next of its range arrives."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    last = None
    for part in slices(batches, "text"):
        rows = []
        for span, doc, text, guard in zip(*(part.column(c).to_pylist() for c in ("span", "doc_id", "text", "guard"))):
            points = code_points(text)
            half = len(points) // 2
            seen: set[int] = set()
            carry = parse(points[: len(points) - half], seen)
            first = set() if guard else set(seen)
            parse(points[len(points) - half :], seen, carry)
            sign = signature(seen)
            if last and last[0] == span:
                _, l_doc, l_text, l_points, l_half, l_first, l_carry, l_sign = last
                parse(points[:l_half], l_first, l_carry)
                edited = signature(l_first)
                whole = l_text[: len(l_points) - l_half] + text[:l_half]
                rows.append((l_doc, len(l_points), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), hexed(l_sign), hexed(edited), likeness(l_sign, edited), likeness(l_sign, sign)))
            last = None if guard else (span, doc, text, points, half, first, carry, sign)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def edited_likeness(docs: DataFrame, spans: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (its later half taken from the start of the next document).

    The next document is that of the next lower ``doc_id``; after the last comes the first. Rows of one id follow each
    other by text; null ids come after all others; null texts are empty. A table of one row is its own next.
    An empty table gives no rows.

    Ids are cut into ``spans`` ranges at approximate quantiles, so texts are shuffled once, to their range; each
    range also gets the first row of the following one. The cut points and the ranges' first ids (two numbers
    a range) are all that reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = spans or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000).alias("q")).head()["q"] or []
    cut = sorted(set(cut))
    # ranges in descending order of ids; the last one is of null ids
    marks = F.array(*[F.lit(c) for c in cut]).cast("array<bigint>")
    span = F.when(F.col("doc_id").isNull(), F.lit(len(cut) + 1)).otherwise(F.size(F.filter(marks, lambda c: c >= F.col("doc_id"))) if len(cut) < 2 else _rank(cut))
    rows = rows.withColumn("span", span.cast("int"))
    tops = {r["span"]: r["top"] for r in rows.groupBy("span").agg(F.max("doc_id").alias("top")).collect()}
    if not tops:
        return spark.createDataFrame([], EDITED)
    order = sorted(tops)
    before = {s: order[i - 1] for i, s in enumerate(order)}
    ids = [t for t in tops.values() if t is not None]
    heads = rows.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) if None in tops.values() else rows.where(F.col("doc_id").isin(ids))
    heads = heads.groupBy("span").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    back = F.create_map(*[x for s in order for x in (F.lit(s), F.lit(before[s]))])
    heads = heads.select("doc_id", "text", back[F.col("span")].cast("int").alias("span"), F.lit(True).alias("guard"))
    all_rows = rows.select("doc_id", "text", "span", F.lit(False).alias("guard")).unionByName(heads)
    dealt = all_rows.repartition("span").sortWithinPartitions("span", "guard", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_pairs, EDITED)


def _rank(cut: list[int]) -> Column:
    """Number of cut points at or above the id, by halving: a nested ``when`` of logarithmic depth."""
    def of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(len(cut) - low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") <= F.lit(cut[mid]), of(low, mid)).otherwise(of(mid + 1, high))

    return of(0, len(cut))
