"""Whitening of embeddings by exact integer scatter.

An entry c becomes the integer x = floor(SCALE * c) + SHIFT.  Tasks subtract the
shift and sum the integers and their products to any size: rows are cut into
limbs of 20 bits, products of limbs are summed by a matrix product of doubles in
blocks so short that no sum passes 2^53, and what the blocks give is added up as
Python integers.  Sums leave a task as limbs of 40 bits, which Spark adds.  From
them n·XᵀX - SSᵀ is formed exactly; only then it becomes floating point, is
divided by n² and decomposed by ``eigh``.  So the components depend neither on
the order of rows nor on the number of tasks.

Scale: vectors are read once to find the dimension, once to fit and once to
project; a task sends d(d + 1)/2 + d + 1 rows, d columns being bounded by
``MAX_DIMENSION``, and the driver gets as many in all.

Results for odd inputs: rows go whose vector is null or holds an entry that is
null, not finite, or so large (2^52 and more) that x isn't a long; so do empty
vectors and those of another length than most (of equally frequent lengths, the
greater one stays).  A component without variance has a null whitened value, and
explained is null if there is no variance at all.  The sum of squared deviations
is given in digits, however long.  Repeated rows and ids, null ids too, give
rows of their own; an empty table, or one without any usable vector, gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packs as P

SCALE, SHIFT = 1024, 100_000
MAX_DIMENSION = 2048
#: Entries are smaller than this.
LARGEST = float(1 << 52)
#: Bits of a factor; so many products of two of them add up to 2^53.
FACTOR_BITS, BLOCK_ROWS = 20, 1 << 13
#: Bits of a limb of a sum, and limbs: sums of 2^180 fit, of 2^23 tasks at least.
LIMB_BITS, LIMBS = 40, 5
_SUMS = [f"l{k}" for k in range(LIMBS)]


def integers(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that stay, their floor(SCALE * c), a row each)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dimension)
    values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    fine = (np.abs(values) < LARGEST).all(axis=1)  # false for NaN, which nulls are too
    return at[fine], np.floor(SCALE * values[fine]).astype(np.int64)


def _factors(x: np.ndarray) -> list[np.ndarray]:
    """x as digits of FACTOR_BITS bits, the last one signed."""
    out = []
    while x.size and int(np.abs(x).max()) >> FACTOR_BITS:
        out.append((x & ((1 << FACTOR_BITS) - 1)).astype(np.float64))
        x = x >> FACTOR_BITS
    return [*out, x.astype(np.float64)]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column sums, cross-products) of integers, as Python integers."""
    d = x.shape[1]
    total, products = np.zeros(d, object), np.zeros((d, d), object)
    for k in range(0, len(x), BLOCK_ROWS):
        digits = _factors(x[k : k + BLOCK_ROWS])
        for a, left in enumerate(digits):
            total += left.sum(axis=0).astype(np.int64).astype(object) << FACTOR_BITS * a
            for b, right in enumerate(digits):
                products += (left.T @ right).astype(np.int64).astype(object) << FACTOR_BITS * (a + b)
    return total, products


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    low = (1 << LIMB_BITS) - 1
    return [((values >> LIMB_BITS * k) & low if k < LIMBS - 1 else values >> LIMB_BITS * k).astype(np.int64) for k in range(LIMBS)]


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S of x - SHIFT, the trace of the covariance, and its
    first components: ``vectors`` (a column each) and eigenvalues, falling."""

    dimension: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def fit(rows: DataFrame, components: int = 8, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    sizes = vectors.select(F.size("v").alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).head()
    if sizes is None:
        return None
    d = sizes["d"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors have {d} entries, at most {MAX_DIMENSION} are supported")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            _, x = integers(batch.column(0), d)
            s, p = scatter(x)
            n, total, products = n + len(x), total + s, products + p
        if n:
            i, j = np.triu_indices(d)
            keys = np.concatenate([i, np.arange(d), [-1]]), np.concatenate([j, np.full(d, -1), [-1]])
            limbs = _limbs(np.concatenate([products[i, j], total, np.array([n], object)]))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in keys] + [pa.array(a) for a in limbs], names=["i", "j", *_SUMS])

    sums = vectors.mapInArrow(summed, f"i int, j int, {', '.join(f'{c} long' for c in _SUMS)}").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in _SUMS)).toArrow()
    if not sums.num_rows:
        return None
    i, j = (sums.column(c).to_numpy() for c in ("i", "j"))
    whole = sum(sums.column(c).to_numpy().astype(object) << LIMB_BITS * k for k, c in enumerate(_SUMS))
    n, total, products = int(whole[i < 0][0]), np.zeros(d, object), np.zeros((d, d), object)
    total[i[(i >= 0) & (j < 0)]] = whole[(i >= 0) & (j < 0)]
    products[i[j >= 0], j[j >= 0]] = products[j[j >= 0], i[j >= 0]] = whole[j >= 0]
    exact = n * products - np.multiply.outer(total, total)
    covariance = (exact / (n * n)).astype(np.float64)  # of integers: each quotient is rounded once
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(d, n, [int(s) for s in total], int(np.trace(exact)) / (n * n), values[order], directions[:, order])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(n * x - S as doubles, the exact sum of its squares in each row)."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if largest >= 1 << 53:
        exact = n * x.astype(object) - np.array(sums, object)
        return exact.astype(np.float64), [sum(v * v for v in row) for row in exact.tolist()]
    exact = n * x - np.array(sums, np.int64)
    high, low = exact >> 26, exact & ((1 << 26) - 1)
    squares = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return exact.astype(np.float64), [(a << 52) + (b << 27) + c for a, b, c in zip(*(s.tolist() for s in squares), strict=True)]


def whitened(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation in digits, whitened: one value a component)."""
    schema = "vec_id long, deviation string, whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    spread = model.values > model.trace * 1e-14
    axes = np.where(spread, model.vectors, 0) / (np.sqrt(np.where(spread, model.values, 1)) * model.n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), model.dimension)
            centred, squares = _deviations(x, model.n, model.sums)
            values = centred @ axes
            flat = pa.array(values.ravel(), mask=np.tile(~spread, len(values)))
            places = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(spread))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([str(s) for s in squares], pa.string()), pa.ListArray.from_arrays(places, flat)], names=["vec_id", "deviation", "whitened"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(project, schema)


def identity_error(rows: DataFrame, components: int) -> float | None:
    """Largest entry by which the covariance of ``whitened`` differs from the
    identity; components without variance don't count."""
    value = lambda k: F.col("whitened")[k]
    entries = [F.abs(F.covar_pop(value(i), value(j)) - (1 if i == j else 0)) for i in range(components) for j in range(i, components)]
    return rows.agg(reduce(lambda a, b: F.greatest(a, b), entries, F.lit(None).cast("double")).alias("e")).head()["e"]


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n,
    deviation (digits), whitened, explained, identity_error."""
    model = fit(rows, components, vector_col)
    done = P.checkpointed(whitened(rows, model, id_col, vector_col))
    shown = 0 if model is None else len(model.values)
    shares = [max(0.0, float(v)) / model.trace if model.trace else None for v in model.values] if model else []
    error = identity_error(done, shown) if shown else None
    share = F.array(*(F.lit(s).cast("double") for s in shares)) if shares else F.array().cast("array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
