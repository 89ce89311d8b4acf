"""Vector links against all cosines."""

import numpy as np

from deckloom.llm import embeddings
from deckloom.llm.common import table


def brute(rows):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and any(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([rows[i][1] for i in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = {i: 0 for i in range(len(rows))} | dict(zip(good, near.sum(axis=1).tolist()))
    label = {i: rows[i][0] for i in range(len(rows))}
    while True:
        new = dict(label)
        for a, i in enumerate(good):
            new[i] = min([label[i], *(label[good[b]] for b in np.flatnonzero(near[a]))])
        if new == label:
            break
        label = new
    return {rows[i][0]: (links[i], label[i], label[i] == rows[i][0]) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}


def test_odd_vectors(far):
    rows = [(1, [1.0, 0, 0]), (2, [2.0, 0, 0]), (3, [0.99, 0.1, 0]), (4, None), (5, [0.0, 0, 0]), (6, [1.0, None, 0]), (7, [float("nan"), 1, 0]), (8, [float("inf"), 1, 0]), (9, [1.0, 0, 0]), (10, [0.0, 1, 0]), (11, [-1.0, 0, 0])]
    got = result(far.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<double>, node int"))
    assert got == brute(rows)


def test_hot_group_in_blocks(far, monkeypatch):
    draw = np.random.default_rng(3)
    base = draw.normal(size=64)
    x = np.concatenate([base + 0.25 * draw.normal(size=(150, 64)), np.repeat(base[None], 40, axis=0), draw.normal(size=(100, 64))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = result(far.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert set(got) == set(want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert [g[1] for g in got.values()].count(0) >= 0.97 * [w[1] for w in want.values()].count(0)


def test_recall_on_given_vectors(far, sf):
    df = table(far, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert result(df) == brute(rows)


def test_recall_near_the_limit():
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c, d = embeddings.codes(a), embeddings.codes(0.905 * a + np.sqrt(1 - 0.905**2) * b)
    assert np.mean([len(set(p) & set(q)) > 0 for p, q in zip(c.tolist(), d.tolist())]) >= 0.97


def test_empty(far):
    assert result(far.createDataFrame([], "vec_id long, embedding array<float>")) == {}
