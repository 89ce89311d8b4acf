"""Language by compression: the dictionary that shortens a text most names its language.

Each language's raw-content zstandard dictionary is a bounded sample of its labelled texts. A text is reduced
to lower-case letters, cut into blocks so that the dictionary counts along the whole of it, and every block is
compressed with every dictionary. The smallest total wins; a narrow margin is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import slices

#: Bounds of the sample a dictionary is made of: texts of a language, characters of each, bytes of the dictionary,
#: and languages (the most frequent ones).
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES, LANGUAGES = 200, 2_000, 96 << 10, 200
BLOCK_BYTES, LEVEL, NARROW = 8_000, 6, 0.01
#: Shorter texts are repeated to this length: else a block costs as much stored as compressed, whatever the dictionary.
LEAST_BYTES = 300
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Runs of letters in lower case, one space between them. Empty if there is no letter."""
    return _OTHER.sub(" ", text or "").strip().lower()


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, from labelled rows. Null, blank and letterless rows teach nothing.

    Texts fall into ``SAMPLE_TEXTS`` slots by a hash of their content, and a language's sample is the text of lowest
    hash in each slot: a grouped minimum of numbers, merged before the shuffle, so copies count once and a
    language with a third of all rows costs no more than another. The picks are bounded, so they may be broadcast.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    common = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    picks = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("slot")).agg(F.min("h").alias("h"))
    picks = picks.join(F.broadcast(common.select("lang")), "lang", "left_semi").select("lang", "h")
    sample = rows.join(F.broadcast(picks), ["lang", "h"]).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropDuplicates(["lang", "h"])
    found: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        if words := letters(row["text"]):
            found.setdefault(row["lang"], []).append(words)
    return {k: " ".join(v).encode()[-DICTIONARY_BYTES:] for k, v in sorted(found.items())}


def blocks(data: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    """Blocks of nearly equal length, so that no short last block weighs like a whole one. ``data`` is not empty."""
    if len(data) < LEAST_BYTES:
        data = (data + b" ") * -(-LEAST_BYTES // (len(data) + 1))
    n = max(1, -(-len(data) // size))
    edges = [len(data) * i // n for i in range(n + 1)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    """Matches from three bytes on, and nothing in the frame but the text."""
    how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=len(dictionary), min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstd.ZstdCompressor(compression_params=how, dict_data=zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT))


def classify(docs: DataFrame, learned: dict[str, bytes], text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (0 to 1), ``rejected``.

    ``und`` and score 0 where the text is null or has no letter, or nothing was learned; ``score`` is the lead of the best over
    the second dictionary (1 where there is but one); ``rejected`` marks leads below ``NARROW``, whose language
    is still given. Equal sizes go to the first language in alphabetic order. Whole texts are compressed.
    """
    names = list(learned)
    kept = list(keep or [])
    rows = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = rows.select(*rows.columns[: len(kept)], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [compressor(d) for d in learned.values()]
        for part in slices(batches, "__text"):
            best, score = [], []
            for value in part.column("__text").to_pylist():
                data = letters(value).encode()
                if not data or not made:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                parts = blocks(data)
                sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in made])
                first = int(sizes.argmin())
                second = np.delete(sizes, first).min() if len(sizes) > 1 else np.inf
                lead = 1.0 if np.isinf(second) else (second - sizes[first]) / second
                best.append(names[first])
                score.append(float(1 - np.exp(-lead / (2 * NARROW))) if np.isfinite(second) else 1.0)
            narrow = pa.array([s < 1 - np.exp(-0.5) for s in score])
            arrays = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(best, pa.string()), pa.array(score, pa.float64()), narrow]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)
