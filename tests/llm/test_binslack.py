import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deckloom.llm import binslack

PATH = public_tokenizers.path(binslack.TOKENIZER)
PLAIN = Tokenizer.from_file(PATH)


def direct(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


ODD = [
    "", " ", "Don't STOP; we'll go... 3,14 and 2024!", "a\x1cb \x1d c\x1f", "café é İstanbul ΣΣ ß", "one two three four\x85five",
    "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>.", "你好, 世界! \U0001f600\U0001f600", "́lead\ńmark", "__init__ a_b-c", "A\tB\rC\nD\x0bE\x0cF", "l’eau", "Å ﬁ ẞ", "it's. it's, we're.", "Ḱ.", "한국어 한",
]


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    pool = list("abzAZ019#%$*.,'!?-_ \t\n\x1c é́İΣ你 <|>\U0001f600") + ["'s", "'LL", "<|endoftext|>", "word"]
    texts = ODD + ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(3000)]
    ids = binslack.Ids(PATH)
    for _ in range(2):  # learnt, then remembered
        assert [x + b"\x01\0\0\0" for x in ids(texts)] == [direct(t) for t in texts]


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        room = rng.randint(0, 60)
        taken = binslack.fullest(counts, room)
        assert all(1 <= n <= counts[x] for x, n in taken)
        best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
        assert sum(x * n for x, n in taken) == best


def test_plan_uses_every_length_once():
    rng = random.Random(2)
    counts = {x: rng.randint(1, 10**9) for x in rng.sample(range(1, 4097), 1500)}
    patterns = binslack.plan(counts)
    used = {}
    for bins, parts in patterns:
        assert bins > 0 and sum(x * n for x, n in parts) <= 4096
        for x, n in parts:
            used[x] = used.get(x, 0) + bins * n
    assert used == counts
    assert len(patterns) < 4 * len(counts)
    total, bins = sum(x * n for x, n in counts.items()), sum(p.bins for p in patterns)
    least = sum(n for x, n in counts.items() if x > 2048)  # longer ones never share a bin
    assert bins <= 1.01 * max(least, -(-total // 4096)) or bins <= 1.05 * -(-total // 4096)


def check(rows, docs, capacity):
    """Every id in exactly one piece, pieces as agreed, places gapless; returns the sizes of sequences."""
    want = {i: direct(t) for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == [capacity * k for k in range(len(pieces))]
        assert all(r["length"] == capacity for r in pieces[:-1]) and 0 < pieces[-1]["length"] <= capacity
        assert b"".join(r["ids"] for r in pieces) == want[doc]
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in pieces)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("capacity", [16, 64])
def test_round_trip_and_few_sequences(spark, capacity):
    rng = random.Random(capacity)
    words = ["alpha", "Beta,", "gamma.", "delta!", "café", "12"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 7, 9, 40, 200])))) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, length int").repartition(5)
    sizes = check(binslack.pack(df, PATH, capacity).collect(), docs, capacity)
    assert len(sizes) <= -(-sum(sizes) // capacity) + 2


def test_third_of_rows_alike_null_ids_and_empty(spark):
    docs = [(None, "same words here")] * 100 + [(i, "word " * (i % 11)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = binslack.pack(df, PATH, 16).collect()
    assert sum(r["doc_id"] is None for r in rows) == 100 and len(rows) == 300
    places = [(r["sequence_id"], r["offset"] + k) for r in rows for k in range(r["length"])]
    assert len(places) == len(set(places))
    assert binslack.pack(df.limit(0), PATH, 16).collect() == []
