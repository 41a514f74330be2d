"""Whitening against plain integer sums and a dense decomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from judgeloom.llm import whitening as W


def plain(vectors):
    """(n, S, n·XᵀX - SSᵀ) of x = floor(1024 c) + 100000, entry by entry."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return x, n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [1, 1000, 1 << 25, 1 << 50])
def test_scatter_is_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-size * 1024, size * 1024, (W.BLOCK_ROWS + 300, 4))
    total, products = W.scatter(x)
    exact = x.astype(object)
    assert (total == exact.sum(axis=0)).all() and (products == exact.T.dot(exact)).all()
    assert sum(limb.astype(object) << W.LIMB_BITS * k for k, limb in enumerate(W._limbs(products))).tolist() == products.tolist()


@pytest.mark.parametrize(("n", "size"), [(3000, 600), (2**30, 600), (2**40, 1 << 30)])
def test_deviations_are_exact(n, size):
    rng = np.random.default_rng(n)
    x, s = rng.integers(-size, size, (50, 6)), [int(v) * n // 7 for v in rng.integers(-size, size, 6)]
    assert W._deviations(x, n, s)[1] == [sum((n * int(v) - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]


def check(out, vectors, ids, d, shown):
    x, n, s, m = plain(vectors)
    values, directions = np.linalg.eigh(np.array([[m[i][j] / (n * n) for j in range(d)] for i in range(d)], float))
    values, directions = values[::-1][:shown], directions[:, ::-1][:, :shown]
    assert len(out) == n * shown and {r["n"] for r in out} == {n}
    by = {(r["vec_id"], r["component"]): r for r in out}
    signs = {}
    for k, row in zip(ids, x, strict=True):
        y = [n * v - t for v, t in zip(row, s, strict=True)]
        for c in range(shown):
            r = by[k, c + 1]
            assert int(r["deviation"]) == sum(v * v for v in y)
            assert math.isclose(r["explained"], values[c] / (sum(m[i][i] for i in range(d)) / n**2), rel_tol=1e-9)
            want = float(np.dot([v / n for v in y], directions[:, c])) / math.sqrt(values[c])
            if abs(want) > 1e-3:
                assert signs.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
            assert math.isclose(abs(r["whitened"]), abs(want), rel_tol=1e-7, abs_tol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in out)


SCHEMA = "vec_id long, embedding array<float>, deviation string, n int, component int, whitened int, i int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, 2, 3, 4) for k, v in rows], SCHEMA)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_whiten_against_plain(spark, scale):
    rng = random.Random(5)
    vectors = [[float(np.float32(rng.gauss(0, scale * (j + 1)))) for j in range(10)] for _ in range(400)]
    out = W.whiten(table(spark, list(enumerate(vectors))).repartition(7)).collect()
    check(out, vectors, range(400), 10, 8)


def test_fewer_dimensions_than_components(spark):
    vectors = [[1.0, 2.0], [2.0, 1.5], [0.5, -3.0]]
    check(W.whiten(table(spark, list(enumerate(vectors)))).collect(), vectors, range(3), 2, 2)


def test_rows_that_go(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (None, [3.0, 1.0])]
    bad = [(5, None), (6, [1.0, None]), (7, [float("nan"), 0.0]), (8, [float("inf"), 0.0]), (9, [1e30, 0.0]), (10, []), (11, [1.0, 2.0, 3.0])]
    out = W.whiten(table(spark, bad[:4] + good + bad[4:])).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "2", "2", "2", "2", "None", "None"]
    _, n, _, m = plain([v for _, v in good])
    assert n == 4 and math.isclose(sum({r["component"]: r["explained"] for r in out}.values()), 1) and m


def test_no_variance_and_no_rows(spark):
    out = W.whiten(table(spark, [(k, [0.5, 0.25]) for k in range(5)])).collect()
    assert len(out) == 10 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == "0" for r in out)
    flat = W.whiten(table(spark, [(k, [float(k), 0.25]) for k in range(5)])).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: (r["vec_id"], r["component"]))] == [False, True] * 5
    for rows in ([], [(1, None)], [(1, [])]):
        assert W.whiten(table(spark, rows)).collect() == []


def test_parts_don_t_matter(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for k in range(200)]
    one, many = (W.fit(table(spark, rows).repartition(n)) for n in (1, 9))
    assert one.sums == many.sums and (one.values == many.values).all() and (one.vectors == many.vectors).all()
