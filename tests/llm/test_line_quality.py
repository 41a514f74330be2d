"""The chain of lines against enumeration of all labellings, and on held-out labels."""

import math
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgeloom.llm import line_quality as Q

SCHEMA = "doc_id long, text string, quality int, score double, good int, _id int, _shard int"
WORDS = ["alpha", "beta", "Gamma", "delta,", "epsilon.", "zeta", "ΕΤΑ", "thêta"]


def line(rng, good):
    words = rng.choices(WORDS, k=rng.randrange(1, 12))
    return " ".join(words if good else [w + rng.choice(["###", "$$", " |"]) for w in words])


def text(rng, good, lines=None):
    n = lines or rng.randrange(1, 9)
    odd = rng.randrange(n) if n > 3 else n  # a line of the other kind, in a text of four or more
    return "\n".join(line(rng, good != (k == odd)) for k in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5, 1, 2, 3) for i, t in rows], SCHEMA)


def step_weight(w, before, after):
    return w[-4 + 2 * before + after]


def enumerated(w, one):
    """(log-likelihood of a labelling, P(good) by line) of one text."""
    lines = Q.described([one])
    speaks = Q._scores(w, lines)
    of = lambda ys: sum(s for s, y in zip(speaks, ys, strict=True) if y) + sum(step_weight(w, a, b) for a, b in zip(ys, ys[1:]))
    every = {ys: math.exp(of(ys)) for ys in product((0, 1), repeat=len(speaks))}
    total = sum(every.values())
    return (lambda ys: math.log(every[tuple(ys)] / total)), [sum(v for ys, v in every.items() if ys[k]) / total for k in range(len(speaks))]


@pytest.fixture(scope="module")
def weights():
    return np.random.default_rng(2).normal(0, 0.4, Q.SIZE)


def test_probabilities_by_enumeration(weights):
    rng = random.Random(1)
    texts = [text(rng, k % 2 == 0, 1 + k % 8).encode() for k in range(40)] + [b"", b"\n", b"\n\n\n"]
    p, lines = Q.line_probabilities(weights, texts)
    want = [v for t in texts for v in enumerated(weights, t)[1]]
    assert np.allclose(p, want, atol=1e-12)
    scores = Q.document_scores(weights, texts)
    ends = [*lines.first[1:], len(p)]
    for k, t in enumerate(texts):
        sizes = [max(1, len(x)) for x in t.split(b"\n")]
        assert math.isclose(scores[k], np.average(p[lines.first[k] : ends[k]], weights=sizes), abs_tol=1e-12)


def test_texts_don_t_touch(weights):
    rng = random.Random(4)
    texts = [text(rng, k % 3 > 0).encode() for k in range(300)]
    assert np.allclose(Q.document_scores(weights, texts), [Q.document_scores(weights, [t])[0] for t in texts], atol=1e-12)


def test_gradient_by_differences(weights):
    rng = random.Random(3)
    texts, good = [text(rng, k % 2 == 0, 1 + k).encode() for k in range(5)], np.array([1.0, 0, 1, 0, 1])
    lines = Q.described(texts)
    n = [t.count(b"\n") + 1 for t in texts]
    value = lambda w: sum(enumerated(w, t)[0]([int(g)] * k) / math.sqrt(k) for t, g, k in zip(texts, good, n, strict=True))
    got = Q.gradient(weights, lines, good)
    for k in [*np.flatnonzero(got)[::9], *range(Q.SIZE - 5, Q.SIZE)]:
        step = np.zeros(Q.SIZE)
        step[k] = 1e-5
        assert math.isclose(got[k], (value(weights + step) - value(weights - step)) / 2e-5, abs_tol=1e-6), k


def test_features():
    lines = Q.described(["Ab cd ab.\n###\n\nAb cd ab.".encode(), b"x"])
    names = list(Q.FEATURES)
    value = lambda i, name: lines.codes[i, names.index(name)]
    assert lines.sizes.tolist() == [9, 3, 0, 9, 1] and lines.first.tolist() == [0, 4]
    assert value(0, "copies") == value(3, "copies") == 1 and value(1, "copies") == 0
    assert value(1, "symbols") == 8 and value(0, "symbols") == 0 and value(2, "words") == 0 and value(0, "words") == 2
    assert [value(i, "place") for i in range(5)] == [1, 3, 3, 2, 0]


def labelled_texts(n, seed):
    rng = random.Random(seed)
    rows = [(k, text(rng, k % 4 > 0), int(k % 4 > 0)) for k in range(n)]
    return [(i, t) for i, t, _ in rows], [(i, q) for i, _, q in rows]


def test_held_out_accuracy(spark):
    docs, labels = labelled_texts(800, 5)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    w = Q.learn(table(spark, docs).repartition(6), known)
    assert np.array_equal(w, Q.learn(table(spark, docs).repartition(2), known))
    got = {r["doc_id"]: r["score"] for r in Q.score(table(spark, docs), w).collect()}
    out = [(got[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    bad, good = [s for s, q in out if not q], [s for s, q in out if q]
    assert len(bad) > 20 and sum(s >= 0.3 for s in good) >= 0.99 * len(good) and sum(s < 0.3 for s in bad) >= 0.85 * len(bad)
    assert sum(a > b for a in good for b in bad) > 0.98 * len(good) * len(bad)
    held = {r["doc_id"]: r["h"] for r in table(spark, docs).select("doc_id", Q.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}


def test_held_out_labels_don_t_count(spark):
    docs, labels = labelled_texts(200, 6)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    one, other = (Q.learn(table(spark, docs), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert np.array_equal(one, other)


def test_odd_inputs(spark):
    docs, labels = labelled_texts(120, 7)
    odd = [(None, "a line"), (1000, None), (1000, ""), (1001, "\n"), (1002, "x " * 50_000), (1003, "y\n" * 20_000), (1, docs[1][1]), (2, "other text of a known id")]
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (3, 0), (5000, 1)], "doc_id long, quality int")
    w = Q.learn(table(spark, docs + odd), known)
    out = Q.score(table(spark, docs + odd), w).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in docs + odd) and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] == 1000}
    assert len(empty) == 1
    assert Q.score(table(spark, []), w).count() == 0
    none = Q.learn(table(spark, docs), known.where("quality = 1"))
    assert not none.any() and {r["score"] for r in Q.score(table(spark, docs), none).collect()} == {0.5}
    assert not Q.learn(table(spark, []), known).any()
    few = Q.learn(table(spark, docs), known, max_training=40)
    assert few.any() and not np.array_equal(few, w)
