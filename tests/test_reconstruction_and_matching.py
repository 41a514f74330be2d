"""Softmax over blocks against one over all, token matching against all pairs."""

import math
import random

import numpy as np
import pytest

from judgeloom.operators import matching as M
from judgeloom.operators import reconstruct as R


def dense(h, w, e, cosine, t):
    n = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    z = (n(h) @ n(w).T if cosine else h @ w.T) / t
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True) @ e


@pytest.mark.parametrize(("rows", "cosine", "t", "block", "bytes_"), [(40, False, 1.0, 4096, 1 << 27), (40, True, 0.05, 7, 1 << 27), (40, False, 0.01, 7, 1), (1, False, 1.0, 1, 4000)])
def test_reconstruction(spark, rows, cosine, t, block, bytes_):
    rng = np.random.default_rng(rows + block)
    h, w, e = rng.normal(size=(rows, 6)) * 30, rng.normal(size=(50, 6)) * 30, rng.normal(size=(50, 4))
    states = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)], "id long, h array<double>").repartition(5)
    words = spark.createDataFrame([(f"w{k}", a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(w, e, strict=True))], "word string, w array<double>, e array<double>")
    out = R.reconstructed(states, words, cosine, t, block, bytes_)
    got = {r["id"]: r["v"] for r in out.collect()}
    assert np.allclose([got[k] for k in range(rows)], dense(h, w, e, cosine, t), atol=1e-9)


def test_reconstruction_of_odd_inputs(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0], [5.0])], "word string, w array<double>, e array<double>")
    states = spark.createDataFrame([(1, [1e6, 2.0]), (2, None), (1, [0.0, 0.0])], "id long, h array<double>")
    assert sorted((r["id"], r["v"]) for r in R.reconstructed(states, words).collect() if r["v"]) == [(1, [5.0]), (1, [5.0])]
    assert [r["v"] for r in R.reconstructed(states, words.limit(0)).collect()] == [None] * 3
    assert R.reconstructed(states.limit(0), words).collect() == []
    with pytest.raises(Exception, match="lengths"):
        R.reconstructed(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, h array<double>").coalesce(1), words).collect()


def test_blocks_merge_in_any_order():
    rng = np.random.default_rng(1)
    z, e = rng.normal(size=(3, 12)) * 200, rng.normal(size=(12, 2))
    whole = np.exp(z - z.max(axis=1, keepdims=True))
    for order in (range(12), reversed(range(12)), rng.permutation(12)):
        state = np.full(3, -np.inf), np.zeros(3), np.zeros((3, 2))
        for k in order:
            state = R.merged(*state, z[:, [k]], e[[k]])
        assert np.allclose(state[2] / state[1][:, None], whole / whole.sum(axis=1, keepdims=True) @ e)


def by_pairs(rows, vectors, idf, unseen):
    def cos(a, b):
        if a == b:
            return 1.0
        x, y = vectors.get(a), vectors.get(b)
        if not x or not y:
            return 0.0
        nx, ny = (math.sqrt(sum(v * v for v in u)) for u in (x, y))
        return sum(p * q for p, q in zip(x, y, strict=True)) / nx / ny if nx and ny else 0.0

    out = {}
    for k, a, b in rows:
        a, b = ([t for t in s or [] if t is not None] for s in (a, b))
        if not a or not b:
            out[k] = (float(a == b),) * 3
            continue
        side = lambda x, y: (sum(idf.get(t, unseen) * max(cos(t, u) for u in y) for t in x), sum(idf.get(t, unseen) for t in x))
        (p, wp), (r, wr) = side(a, b), side(b, a)
        p, r = p / wp if wp > 0 else 0.0, r / wr if wr > 0 else 0.0
        out[k] = (p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0)
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_matching(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(block)
    tokens = [f"t{k}" for k in range(30)]
    vectors = {t: [rng.gauss(0, 1) for _ in range(5)] for t in tokens[:25]} | {"t3": [0.0] * 5}
    rows = [(k, rng.choices(tokens, k=rng.randrange(0, 12)), rng.choices(tokens, k=rng.randrange(0, 12))) for k in range(60)] + [(100, None, ["t1"]), (101, None, None), (102, [], []), (103, ["t28"], ["t28"]), (104, [None, "t1"], ["t1", None]), (105, ["t28"], ["t29"])]
    n = len(rows)
    df = {t: sum(t in (b or []) for _, _, b in rows) for t in tokens}
    idf = {t: math.log((n + 1) / (c + 1)) for t, c in df.items() if c}
    data = spark.createDataFrame(rows, "id long, candidate array<string>, reference array<string>").repartition(3)
    known = spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")
    want = by_pairs(rows, vectors, idf, math.log(n + 1.0))
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in M.matched(data, known).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_matching_of_nothing(spark):
    known = spark.createDataFrame([], "token string, vector array<double>")
    assert M.matched(spark.createDataFrame([], "id long, candidate array<string>, reference array<string>"), known).collect() == []
    same = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["c"], ["d"])], "id long, candidate array<string>, reference array<string>")
    assert {r["id"]: round(r["f1"], 6) for r in M.matched(same, known).collect()} == {1: 1.0, 2: 0.0}
