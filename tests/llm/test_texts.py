"""Packing, language, fingerprints, pseudonyms, quality, language model and main text on small and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deckloom.llm import fingerprint, html, langid, maxent, mixing, packing, pii, quality, queries
from deckloom.llm.common import fold, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, token string"
ODD = [None, "", " \n\t ", "one", "same text here", "same text here", "it's  double  spaced\n\n and \n more", "… weird ² ½ é ŝ", "x" * 5000, "word " * 4000]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "k", "t") for i, t in enumerate(rows)] + [(None, "no id", "en", "s", 1, "k", "t")], DOCS)


def test_packing_is_a_round_trip(far):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    plain = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(odd(far), path, capacity=256).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc, text in [*enumerate(ODD), (None, "no id")]:
        whole = b"".join(b for _, b in sorted(pieces[doc]))
        ids = [int.from_bytes(whole[i : i + 4], "little") for i in range(0, len(whole), 4)]
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 1]
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(odd(far).limit(0), path).count() == 0


def test_language(far, sf):
    docs = table(far, sf, "documents")
    learned = langid.dictionaries(docs.where(fold("doc_id", 4) != 2))
    got = langid.classify(docs, learned, keep=[F.col("doc_id"), F.col("lang"), (fold("doc_id", 4) == 2).alias("held")]).where("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    for r in langid.classify(odd(far), learned, keep=[F.col("doc_id")]).collect():
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2)) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid.classify(odd(far), {}).collect()} == {"und"}


def test_fingerprints(far):
    rows = sorted(((i, t or "") for i, t in enumerate(ODD)), reverse=True) + [(None, "no id")]
    got = {r["doc_id"]: r for r in fingerprint.edited_likeness(odd(far), spans=5).collect()}
    assert len(got) == len(rows)
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(odd(far), keep=[F.col("doc_id")]).collect()}
    for k, (d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)], len(t) // 2
        edited = t[: len(t) - half] + after[1][:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        seen = set()
        fingerprint.parse(fingerprint.code_points(edited), seen)
        assert r["edited_fingerprint"] == fingerprint.hexed(fingerprint.signature(seen)) and r["fingerprint"] == alone[d]
        assert (r["near_next"] == 1) == (alone[d] == alone[after[0]])
    assert alone[4] == alone[5]
    assert fingerprint.edited_likeness(odd(far).limit(0)).count() == 0
    assert fingerprint.edited_likeness(odd(far).where("doc_id = 4")).count() == 1


@pytest.mark.parametrize("size", [2, 7, 100, 1000])
def test_permutation(size):
    assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


@pytest.mark.parametrize("n", [1, 2, 64, 160, 255, 256, 257, 600, 5000, 100_000])
def test_values_of_any_length_keep_their_form(n):
    value = ("a0Z-" * n)[:n]
    new = pii.written(value, b"key", "t")
    assert [pii._alphabet(c) or c for c in new] == [pii._alphabet(c) or c for c in value]
    assert new == pii.written(value, b"key", "t") and (n < 64 or new != value)
    if n > 600:  # the end depends on the beginning and the beginning on the end
        other = pii.written("b" + value[1:], b"key", "t")
        assert other[-30:] != new[-30:] and pii.written(value[:-3] + "b" + value[-2:], b"key", "t")[:30] != new[:30]
    if n == 600:
        assert len({pii.written(f"{i:04}" + value[4:], b"key", "t") for i in range(1000)}) == 1000


def test_long_secrets_and_addresses(far):
    texts = ["0a" * 80, "0a" * 50_000, "a" * 120 + "@example.org", "sk-" + "aB3" * 3000]
    rows = pii.pseudonymise(far.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, pii_spans int"), b"key").orderBy("doc_id").collect()
    assert [len(r["text"]) for r in rows] == list(map(len, texts)) and all(r["text"] != t and len(r["pii_spans"]) == 1 for r, t in zip(rows, texts))
    assert pii.pseudonymise(odd(far).limit(0), b"key").collect() == []


def test_pseudonyms(far):
    change = pii.Pseudonyms(b"key")
    text = "mail a.b@x.org 4111 1111 1111 1111 and 1234567890123456, born 1980-02-29 or 31/12/1999; 10.0.0.255 +1 (206) 555-0101 123-45-6789 DE89370400440532013000"
    new, spans = change(text)
    assert [k for *_, k in spans] == ["email", "number", "number", "date", "date", "ip", "phone", "ssn", "iban"]
    assert len(re.findall(r"\d", new)) >= 60 and not any(text[a:b] in new for a, b, _ in spans)
    assert [k for *_, k in change(new)[1]] == [k for *_, k in spans]  # each new value is valid in its format
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert pii.luhn(card) == 0
    assert change("2023-02-30 999.1.1.1 Version 2.0 in 1999")[1] == []
    assert change("x 10.0.0.255 y")[0].split()[1] in new  # the same value, the same pseudonym
    rows = pii.pseudonymise(odd(far, [*ODD, "10.0.0.255"]), b"key").collect()
    assert [r["text"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 10] == ODD and rows[-2]["text"] != "10.0.0.255"


def test_decoys_stay(far):
    decoys = ["1234567890123456", "1234 5678 9012 3456", "4111-1111-1111-1112", "371449635398432", "123456789", "123456789012", "1234 5678 9012", "order 98079157628044901 of"]
    rows = [r["text"] for r in pii.pseudonymise(far.createDataFrame([(i, t) for i, t in enumerate(decoys)], "doc_id long, text string"), b"key").orderBy("doc_id").collect()]
    assert rows == decoys
    change = pii.Pseudonyms(b"key", checked=True)
    new, spans = change("in 2024 4111 1111 1111 1111 and 371449635398431, not 4111111111111112")
    assert [k for *_, k in spans] == ["number", "number"] and new.startswith("in 2024 ") and new.endswith(", not 4111111111111112")
    assert "4111 1111 1111 1111" not in new and "371449635398431" not in new
    assert all(pii.luhn(re.sub(" ", "", n)) == 0 for n in re.findall(r"(?:\d{4} ){3}\d{4}|(?<!\d)\d{15}(?!\d)", new[8:]))


def test_quality(far, sf):
    docs, labels = table(far, sf, "documents"), table(far, sf, "labels")
    model = quality.train(docs, labels, fold("doc_id", 4) != 2)
    got = quality.score(docs, model, [F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held")]).where("held").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.85 * len(got)
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd(far), model).collect())
    assert quality.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(odd(far), None).collect()} == {0.5}


def test_language_model(far):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["the cat sat", "A dog ran.", "un chat noir"]) for _ in range(30)) for _ in range(40)] + ODD
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "The cat")]
    docs = far.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, c string")
    held = fold("doc_id", 5) == 1
    got = collections.defaultdict(list)
    for r in maxent.score(docs, held).collect():
        got[r["doc_id"]].append(r)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = collections.Counter(w for d, t in rows if not out(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert sum(map(len, got.values())) == len(rows)
    for d, t in rows:
        r = got[d][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(d), len(words(t)), sum(w in counts for w in words(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))
    some = [r for d in range(40) for r in got[d] if r["held_out"]]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)
    assert maxent.score(docs.limit(0), held).count() == 0
    assert maxent.score(docs, F.lit(True)).agg(F.max("train_tokens")).head()[0] == 0


def test_every_position_gives_a_gradient(monkeypatch):
    taken = collections.Counter()
    monkeypatch.setattr(maxent, "_step", lambda rows, cls, *_: taken.update(zip(map(tuple, rows.tolist()), cls.tolist())))
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate([0, 1, 2, 3, 50, 700])])
    n, cells = maxent.CLASSES, np.ones(maxent.CLASSES)
    zeros = np.zeros((maxent.ROWS, maxent.GROUPS), np.float32), np.zeros((maxent.ROWS, maxent.GROUPS, maxent.MEMBERS), np.float32)
    none = np.zeros(1, np.uint64)
    model = maxent.Model(none, np.zeros(1), none, np.zeros(1, np.int64), cells, cells, n, n, cells[: maxent.GROUPS], cells.reshape(maxent.GROUPS, -1), *zeros)
    for turn in range(maxent.ROUNDS):
        list(maxent._trained(model, turn)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    h, shape, ends = maxent.tokens(texts)
    cls = model.classes(h, shape)
    assert taken == collections.Counter(zip(map(tuple, maxent.features(h, cls, ends).tolist()), cls.tolist()))


def test_rows_named_again_add_up():
    draw = np.random.default_rng(3)
    weights, rows, values = draw.random((50, 8), np.float32), draw.integers(0, 20, 400), draw.random((400, 8), np.float32)
    want = weights.astype(float)
    for r, v in zip(rows, values):
        want[r] += v
    maxent._add_rows(weights, rows, values)
    assert np.allclose(weights, want, atol=1e-4)


def test_a_step_against_single_positions():
    draw = np.random.default_rng(4)
    rows, cls = draw.integers(0, 12, (300, 5)), draw.integers(0, maxent.CLASSES, 300)
    gw, mw = draw.normal(0, 0.1, (maxent.ROWS, maxent.GROUPS)).astype(np.float32), draw.normal(0, 0.1, (maxent.ROWS, maxent.GROUPS, maxent.MEMBERS)).astype(np.float32)
    gb, mb, seen = draw.normal(0, 1, maxent.GROUPS).astype(np.float32), draw.normal(0, 1, (maxent.GROUPS, maxent.MEMBERS)).astype(np.float32), draw.integers(0, 9, maxent.ROWS).astype(float)
    g, m, n = gw.astype(float), mw.astype(float), seen.copy()
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    slopes = [(np.eye(maxent.GROUPS)[c // maxent.MEMBERS] - soft(gb + sum(g[r] for r in some)), np.eye(maxent.MEMBERS)[c % maxent.MEMBERS] - soft(mb[c // maxent.MEMBERS] + sum(m[r, c // maxent.MEMBERS] for r in some))) for some, c in zip(rows, cls)]
    for k in range(5):
        count, cells = collections.Counter(rows[:, k].tolist()), collections.Counter(zip(rows[:, k].tolist(), (cls // maxent.MEMBERS).tolist()))
        for r, c in count.items():
            n[r] += c
        for r, c, (dg, dm) in zip(rows[:, k].tolist(), cls.tolist(), slopes):
            rate = maxent.RATE / math.sqrt(20 + n[r])
            g[r] += rate / math.sqrt(count[r]) * dg
            m[r, c // maxent.MEMBERS] += rate / math.sqrt(cells[r, c // maxent.MEMBERS]) * dm
    maxent._step(rows, cls, gw, mw, gb, mb, seen)
    assert np.allclose(gw, g, atol=1e-4) and np.allclose(mw, m, atol=1e-4) and np.array_equal(seen, n)


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><nav><ul><li>Home</li></ul></nav><div id="cookie-notice">We use cookies</div>
<article><header>By A</header><h1>Head &amp; line</h1><p>One <b>bold
 text<br>two &lt;3</p><aside>see also</aside><p>Three<script>var a="</p>";</script><form>mail</form></article>
<section class="comments"><article class="comment"><p>nice</p></article></section><footer>&copy; x</footer></body></html>"""


def test_main_text(far):
    loose = lambda body: f"<div><p>menu one two three four five six seven eight nine</p><p>{body}</p></div>"
    rows = [(1, "http://h.example/a", PAGE), (2, None, None), (3, "http://h.example/b", ""), (4, "http://k.example/1", loose("alpha beta")), (5, "http://k.example/2", loose("gamma delta")),
            (5, "http://k.example/2", loose("gamma delta")), (6, "http://l.example/1", loose("alone")), (7, "::bad[", "plain & text <b"), (None, "http://h.example", "<main>kept</main><p>not</p>")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(far.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, row int")).collect()]
    want = {1: "Head & line\nOne bold text\ntwo <3\nThree", 2: "", 3: "", 4: "alpha beta", 5: "gamma delta", 6: "menu one two three four five six seven eight nine\nalone", 7: "plain & text", None: "kept"}
    assert len(got) == len(rows)
    assert all(t == want[i] and n == len(t) for i, t, n in got), got


def test_runs_that_few_pages_share_stay(far):
    menu = "menu one two three four five six seven eight nine"
    own = lambda i, n=20: " ".join(f"w{i}x{k}" for k in range(n))
    passage = "a passage of ten words that three articles have shared"
    texts = {i: own(i) for i in range(10)}
    texts[1] = texts[0].replace("w0x19", "changed")  # a near copy
    for i in (2, 3, 4):
        texts[i] += " " + passage
    rows = [(i, f"http://h.example/{i}", f"<div><p>{menu}</p><p>{t}</p></div>") for i, t in texts.items()]
    got = {r["page_id"]: r["text"] for r in html.main_text(far.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == texts


def brute_runs(rows):
    """Text of each page: every sequence of 8 to 31 tokens of a host compared with every page of the host."""
    want, hosts = [], collections.defaultdict(dict)
    for i, url, page in rows:
        found = html.blocks(page)
        streams = [[t for _, ts in html._streams(found, inside) for t in ts] for inside in (False, True)]
        hosts[html.host(url)]["\n".join(t for t, _ in found)] = streams
    grams = lambda ts: {(k, n): tuple(ts[k : k + n]) for n in range(html.RUN, html.RUN + html.DEPTH) for k in range(len(ts) - n + 1)}
    gone = {}
    for name, pages in hosts.items():
        on, within = collections.Counter(), collections.Counter()
        for out, inside in pages.values():
            a, b = set(grams(out).values()), set(grams(inside).values())
            on.update(a | b)
            within.update(b)
        gone[name] = {g for g, n in on.items() if n >= max(2, html.SHARE * len(pages)) and 2 * within[g] <= n}
    for i, url, page in rows:
        found = html.blocks(page)
        streams = html._streams(found)
        covered = [at for at, g in grams([t for _, ts in streams for t in ts]).items() if g in gone[html.host(url)]]
        kept = [t for t, mark in found if mark == html.KEPT]
        out, place = [], 0
        for i_block, ts in streams:
            left = [w for k, w in enumerate(found[i_block][0].split(" ")) if not any(p <= place + k < p + n for p, n in covered)] if i_block >= 0 else []
            out += [" ".join(left)] if left else []
            place += len(ts)
        want.append((i, "\n".join(kept or out)))
    return want


def test_runs_against_brute_force(far):
    draw = random.Random(5)
    words = lambda n, kinds=30: " ".join(f"t{draw.randrange(kinds)}" for _ in range(n))
    menus = [words(n) for n in (8, 11, 30, 45)]
    rows = []
    for i in range(70):
        name = "h" if i < 40 else f"k{i % 6}"
        own = [words(draw.randrange(3, 25)), *[m if draw.random() < 0.6 else m[: len(m) // 2] for m in menus if draw.random() < 0.75], words(9, 2)]
        draw.shuffle(own)
        parts = [f"<{tag}><p>{t}</p></{tag}>" for t in own for tag in [draw.choice(["div", "div", "nav", "div", "article" if i % 3 == 0 else "section"])]]
        rows.append((i, f"http://{name}.example/{i}", "".join(parts)))
    rows.append((70, rows[0][1], rows[0][2]))
    want = dict(brute_runs(rows))
    got = {r["page_id"]: r["text"] for r in html.main_text(far.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    whole = {i: html.unique_runs(html.blocks(p), []) for i, _, p in rows}
    assert sum(want[i] != whole[i] for i in want if "<article" not in rows[i][2]) > 20  # the runs had something to do


def test_runs_count_in_articles_too(far):
    teaser, quote = "our newsletter comes on every friday with ten good stories", "a sentence that five articles and three other pages quote"
    rows = []
    for i in range(10):
        own = " ".join(f"w{i}x{k}" for k in range(12))
        if i < 3:
            page = f"<div><p>{teaser}</p><p>{quote}</p><p>{own}</p></div>"
        else:
            page = f"<article><p>{own}</p>{f'<p>{teaser}</p>' if i < 5 else ''}{f'<p>{quote}</p>' if i > 4 else ''}</article>"
        rows.append((i, f"http://h.example/{i}", page))
    got = {r["page_id"]: r["text"].split("\n") for r in html.main_text(far.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # on five of ten pages, and on three of these outside articles: boilerplate; on eight, but on five in the article: text
    assert all(len(got[i]) == 2 and got[i][0] == quote for i in range(3))
    assert all(got[i][1] == (teaser if i < 5 else quote) for i in range(3, 10))


def test_sorted_suffixes_give_maximal_runs():
    key = lambda *ks: html.suffix_bytes(np.array(ks, np.uint64) << np.uint64(32))[0]
    found = sorted([(key(1, 2, 3), 2), (key(1, 2, 4), 1), (key(1, 2), 1), (key(1, 5), 1), (key(6), 1)])
    batch = pa.RecordBatch.from_pydict({"host": ["h"] * 5, "suffix": [s for s, _ in found], "n": [n for _, n in found], "pages": [5] * 5})
    got = {r for b in html._maximal(iter([batch.slice(k, 1) for k in range(5)])) for r in b.column("run").to_pylist()}
    assert got == {key(1, 2), key(1)}
    batch = batch.set_column(3, "pages", pa.array([4] * 5))
    assert {r for b in html._maximal(iter([batch])) for r in b.column("run").to_pylist()} == {key(1, 2, 3), key(1, 2), key(1)}


def test_main_text_of_no_pages(far):
    assert html.main_text(far.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_mixing_odd_rows(far):
    got = {r["doc_id"]: r for r in mixing.mix(odd(far), 0.95, 4.0).collect()}
    assert len(got) == len(ODD) + 1 and all(r["copies"] >= 1 for r in got.values())
    assert mixing.mix(odd(far).limit(0), 0.95, 4.0).count() == 0
    big = far.range(3000).selectExpr("id AS doc_id", "'a b c d' AS text", "CASE WHEN id < 2000 THEN 'big' ELSE concat('s', id % 5) END AS source")
    rows = mixing.mix(big, 0.95, 2.0).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("quota").alias("q"), F.max("copies").alias("c")).collect()
    assert all(r["used"] <= r["q"] and r["q"] - r["used"] < 4 * 64 and r["q"] <= 2.0 * r["t"] + 1 for r in rows)
    half = mixing.mix(big, 1.0, 4.0, budget_tokens=3000).agg(F.sum(F.col("n_tokens") * F.col("copies"))).head()[0]
    assert 1500 < half <= 3000
    assert mixing.apply(big, mixing.mix(big, 0.95, 2.0)).columns == big.columns


def test_large_sources_are_used_whole(far, monkeypatch):
    monkeypatch.setattr(mixing, "tokens", lambda text: F.col(text).cast("long"))  # the texts name their sizes
    draw = random.Random(3)
    for _ in range(4):
        rows = [(i * mixing.BLOCK_IDS, str(draw.randrange(10**10, 10**11)), f"s{i % 40}") for i in range(120)]
        docs = far.createDataFrame(rows, "doc_id long, text string, source string")
        assert mixing.mix(docs, 0.0, 4.0).where("copies < 1").count() == 0


def test_mixing_against_sql(far, duck, sf):
    from oracle import compare

    assert compare(far, duck, queries.QUERIES["op1_mix_sources"], queries.ORACLES["op1_mix_sources"], sf) == ""


def test_sums_over_stretches_are_those_of_the_ordered_rows():
    import numpy as np

    from deckloom.llm.maxent import _sums

    draw = np.random.default_rng(3)
    cell = np.sort(draw.integers(0, 700, 1000))
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    n = np.diff(np.r_[heads, len(cell)])
    values, order = draw.normal(size=(1000, 24)).astype(np.float32), draw.permutation(1000)
    for some in (values, values[:, :16]):
        assert np.array_equal(_sums(some, order, heads, n), np.add.reduceat(some.take(order, axis=0), heads, axis=0))
    alone = np.arange(1000)
    assert np.array_equal(_sums(values, order, alone, np.ones(1000, int)), values[order])
