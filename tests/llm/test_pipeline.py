"""Every stage of the pipeline beside plain Python, on a table with odd rows and with columns named like the operators' own."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from deckloom.llm import mixing, pii, quality, queries
from deckloom.llm.common import fold, table

CLASHES = ["predicted", "score", "copies", "copy", "pii_spans", "row", "component_id", "n_tokens", "__row", "__id", "__spans", "__copies", "__0", "weight", "component"]


@pytest.fixture(scope="module")
def docs(far, sf):
    given = table(far, sf, "documents").where("doc_id < 120").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in given]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], "en", "web", 1)]  # repeated rows, one id with two texts
    rows += [(1001, None, None, None, None), (1002, "", "en", None, 0), (1003, " \n", None, "s", 2), (None, rows[7][1], "en", "web", 3), (None, None, None, None, None), (None, rows[9][1] + " 4111 1111 1111 1111", "x", "web", 5)]
    rows += [(1004, "x" * 200_000, "en", "web", 200_000), (1005, "word " * 30_000, "en", "web", 150_000), (1006, "mail " + "a" * 150 + ".b@x.org key " + "0a" * 5000, "en", "web", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return far.createDataFrame([(*r, *["kept"] * len(CLASHES)) for r in rows], schema).repartition(3)


def counted(df, columns=("doc_id", "text", "source")):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def clean(out, docs):
    assert out.columns == docs.columns
    assert all(set(r[c] for r in out.select(*[f"`{x}`" for x in CLASHES]).collect()) <= {"kept"} for c in CLASHES)


def test_quality_keeps_what_the_model_predicts(far, sf, docs):
    out = corpus_pipeline.quality_stage(far, docs, sf)
    clean(out, docs)
    model = quality.train(docs, table(far, sf, "labels"), fold("doc_id", 4) != 2)
    units, want = quality.Units(), collections.Counter()
    for r in docs.collect():
        good = model.scores(np.array([quality.pooled(r["text"] or "", units, model.vectors)], np.float64))[0] >= quality.THRESHOLD
        want.update([(r["doc_id"], r["text"], r["source"])] * int(good))
    assert counted(out) == want and 0 < sum(want.values()) < docs.count()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_one_document_of_each_group_stays(far, sf, docs):
    out = corpus_pipeline.near_duplicate_stage(far, docs, sf)
    clean(out, docs)
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=str)
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            group[root(j)] = root(i)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len(set(kept)) == len(groups)
    where = {root(i): rows[i] for i in range(len(rows))}
    for members in groups.values():
        mine = [rows[i] for i in members if rows[i] in set(kept)]
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
    assert where


def test_private_values_change_as_in_the_driver(far, sf, docs):
    out = corpus_pipeline.private_data_stage(far, docs, sf)
    clean(out, docs)
    change = pii.Pseudonyms(queries.TEST_KEY, checked=True)
    want = collections.Counter((r["doc_id"], None if r["text"] is None else change(r["text"])[0], r["source"]) for r in docs.collect())
    assert counted(out) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert counted(out) != counted(docs)


def test_mixing_repeats_rows_as_the_mixture_says(far, sf, docs):
    out = corpus_pipeline.mixing_stage(far, docs, sf)
    clean(out, docs)
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(docs, corpus_pipeline.TARGET_ENTROPY, corpus_pipeline.REPEATS).collect()}
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"], r["text"], r["source"]] += copies[r["doc_id"], r["source"]]
    assert counted(out) == want and min(copies.values()) >= 1


def test_packing_gives_back_the_ids(far, sf, docs):
    plain = Tokenizer.from_file(queries.tokenizer_path())
    small = docs.where("doc_id not in (1004, 1005) and doc_id is not null").dropDuplicates(["doc_id"]).cache()
    rows = corpus_pipeline.packing_stage(far, small, sf).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for r in small.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        assert b"".join(b for _, b in sorted(pieces[r["doc_id"]])) == np.array([*ids, 1], "<u4").tobytes()


def test_all_stages_in_a_row_and_an_empty_table(far, sf, docs):
    for given in (docs, docs.limit(0)):
        now = given
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(far, now, sf)
            if k < 4:
                assert out.columns == docs.columns, name
                now = far.createDataFrame(out.collect(), docs.schema)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert now.count() == 0
