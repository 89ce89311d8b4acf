import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deckloom.llm import stripes

LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(docs, least=30, subsumed=80, top=2000):
    """The contract by counting all phrases in dictionaries."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in candidates.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}:
                held[sub] = max(held[sub], a)
        rows = []
        for p, a in candidates.items():
            if held[p] and 100 * held[p] >= subsumed * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(spark, docs, parts=5, **limits):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in docs], "lang string, text string, n long, phrase string").repartition(parts)
    return sorted(tuple(r) for r in stripes.collocations(df, **limits).collect())


def prose(seed, rows, words):
    rng = random.Random(seed)
    gaps = [" "] * 12 + ["  ", "\t", ". ", ", ", ";", "\n", " \x0b", "! ? "]
    return [
        (rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 60, 300]))))
        for _ in range(rows)
    ]


WORDS = ["the", "The", "of", "new", "York", "city", "é", "ÉTÉ", "strasse", "12", "-", "a\x1cb", "\xa0"]


@pytest.mark.parametrize("seed,least,top", [(1, 30, 2000), (2, 5, 7), (3, 2, 2000)])
def test_equal_to_counting_everything(spark, seed, least, top):
    docs = prose(seed, 120, WORDS) + [("en", "new york city " * 40), ("en", None), ("fr", ""), (None, " .,; ")]
    assert got(spark, docs, least=least, top=top) == plain(docs, least=least, top=top)


def test_one_phrase_makes_a_third_of_all_words(spark):
    docs = prose(4, 60, WORDS) + [("en", "of the old town " * 30)] * 50 + [("de", "x " * 2000)]
    assert got(spark, docs, 11) == plain(docs)


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [(None, None)]) == []


def test_long_text_in_stretches(monkeypatch):
    monkeypatch.setattr(stripes, "STRETCH", 64)
    texts = [t for _, t in prose(5, 40, WORDS)] + ["w" * 500 + " end", None, "", "last"]
    h, starts, named = stripes.cut(pa.array(texts, pa.string()))
    want = [(w, i == 0) for t in texts for ws in pieces(t) for i, w in enumerate(ws)]
    assert named(np.arange(len(h))) == [w for w, _ in want]
    assert starts.tolist() == [s for _, s in want]
    assert len({w for w, _ in want}) == len(set(h.tolist()))


def test_small_blocks_and_full_bitmaps_change_no_count(spark, monkeypatch):
    docs = prose(6, 100, WORDS)
    whole = plain(docs, least=4)
    # tasks take these values with their functions
    monkeypatch.setattr(stripes, "MOST_BITS", 64)
    monkeypatch.setattr(stripes, "LEAST_BITS", 64)
    assert got(spark, docs, 3, least=4) == whole


def test_totals_are_the_counts_of_the_prefixes():
    words = np.arange(1, 5, dtype=np.uint64)
    codes = np.array([0, 1, 2, 0, 1, 3, 0, 1], np.int32)
    starts = np.array([1, 0, 0, 0, 0, 0, 1, 0], bool)

    class Full:
        value = np.full(1, -1, np.int64).tobytes()

    row = pa.RecordBatch.from_arrays(
        [pa.array([words.view(np.int64).tolist()]), pa.array([codes.tobytes()]), pa.array([np.packbits(starts).tobytes()])], names=["hashes", "codes", "starts"]
    )
    cells = {}
    for batch in stripes._cells([Full, Full])(iter([row])):
        cells |= {(r["prefix"], r["next"]): r["n"] for r in batch.to_pylist()}
    assert cells == {(1, 0): 3, (2, 0): 3, (3, 0): 1, (4, 0): 1, (1, 2): 3, (2, 3): 1, (3, 1): 1, (2, 4): 1}


def test_keys_add_up_over_blocks():
    rng = np.random.default_rng(1)
    parts, least = 5, 3
    rows, want = [], {}
    for _ in range(20):
        keys = np.unique(rng.integers(0, 1 << stripes.KEY_BITS, 50, dtype=np.uint64) >> np.uint64(34) << np.uint64(34))
        for k in keys.tolist():
            want[k] = want.get(k, 0) + 1
        part = keys >> np.uint64(stripes.KEY_BITS - parts)
        for p in np.unique(part).tolist():
            own = keys[part == p] - np.uint64(p << stripes.KEY_BITS - parts)
            rows.append((p, stripes._planes(np.diff(own, prepend=np.uint64(0))), stripes._planes(np.ones(len(own), np.uint64))))
    rows.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "gaps", "n"])
    found = [k for b in stripes._frequent(least, parts)(iter([batch])) for k in b.column(0).to_pylist()]
    assert sorted(found) == sorted(k for k, n in want.items() if n >= least) and found
