import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from deckloom.llm import packing, queries



def CUT(p, n):
    return ((p[0], p[1], n), (p[0], p[1] + n, p[2] - n))


def packed(lengths, capacity):
    bins = packing.Bins(0, capacity, CUT)
    out = []
    for doc, n in enumerate(lengths):
        out += bins.add((doc, 0, n))
    at_end = bins.next
    out += bins.close()
    sequences = {}
    for doc, start, n, number, offset in out:
        sequences.setdefault(number, []).append((offset, doc, start, n))
    return sequences, at_end


@pytest.mark.parametrize("capacity", [1, 8, 64, 2048])
@pytest.mark.parametrize("seed", range(3))
def test_sequences_hold_k_documents_of_class_k(capacity, seed):
    rng = random.Random(seed)
    lengths = [max(1, int(rng.lognormvariate(np.log(capacity / 5 + 1), 1.3))) for _ in range(rng.choice([0, 1, 30, 3000]))]
    sequences, at_end = packed(lengths, capacity)
    seen = {}
    for number, pieces in sequences.items():
        pieces.sort()
        at = 0
        for offset, doc, start, n in pieces:
            assert offset == at and n > 0
            at += n
            seen.setdefault(doc, []).append((start, n))
        assert at == capacity or at & (at - 1) == 0 and number >= at_end
        if number < at_end:
            k = capacity // pieces[0][3]
            inside = [p for p in pieces[:k]]
            assert k == 1 or all(capacity // (k + 1) < p[3] <= capacity // k for p in inside) and len(inside) == k
    for doc, n in enumerate(lengths):
        parts = sorted(seen[doc])
        assert parts[0][0] == 0 and sum(p[1] for p in parts) == n and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert sum(map(len, sequences.values())) <= len(lengths) + len(sequences)


def test_ids_are_the_tokenizers():
    path = queries.tokenizer_path()
    plain, ids = Tokenizer.from_file(path), packing.Ids(path)
    rng = random.Random(4)
    pool = list("abzAZ019.,'!?-_#$%* \t\n\x1c éİΣ你ĸŉſ<|>") + ["'s", "'LL", "<|endoftext|>", "word", " and", "  ", " don't", "end.\nNew", "\n\n", "a\nb", "x \ny", "\n x"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(4000)]
    for _ in range(2):  # learnt, then remembered
        assert ids(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_few_pieces_a_document(spark, sf):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), queries.tokenizer_path(), keep_ids=False).collect()
    docs = len({r["doc_id"] for r in rows})
    sequences = len({r["sequence_id"] for r in rows})
    assert len(rows) <= docs + sequences
