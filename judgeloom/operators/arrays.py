"""Array kernels as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def head_tail(tokens: Column, most: int) -> Column:
    """Cut to ``most``: the first half (the longer one), and the last."""
    head, tail = -(-most // 2), most // 2
    end = F.slice(tokens, -tail, tail) if tail else F.slice(tokens, 1, 0)
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, head), end))


def balanced_sizes(length: Column, count: Column) -> Column:
    """Sizes that differ by one at most; borders are rounded half to even."""
    edge = lambda i: F.bround(i * length / count, 0).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda i: edge(i) - edge(i - 1))


def running(sizes: Column) -> Column:
    """Ends of consecutive chunks."""
    step = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    return F.aggregate(sizes, F.array().cast("array<int>"), step)


def quantile_frontier(count: Column, view: Column, views: int) -> Column:
    return F.greatest(F.lit(1), F.least(count, F.ceil(count * (view + 1) / views).cast("int")))


def top_k(vector: Column, k: int) -> Column:
    """(value, index) of the k largest, ties by index."""
    entries = F.transform(vector, lambda v, i: F.struct((-v).alias("neg"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct((-e["neg"]).alias("value"), e["index"].alias("index")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, not once for each element
    of a lambda in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(values: Column) -> Column:
    weights = lambda vs: let(F.array_max(vs), lambda top: F.transform(vs, lambda v: F.exp(v - top)))
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, w: a + w)
    return let(let(values, weights), lambda ws: let(total(ws), lambda t: F.transform(ws, lambda w: w / t)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def pad_right(tokens: Column, length: Column, fill: Column) -> Column:
    return F.concat(tokens, F.array_repeat(fill, (length - F.size(tokens)).cast("int")))


def differences(ends: Column) -> Column:
    """Sizes of chunks from their ends."""
    return F.transform(ends, lambda e, i: e - F.when(i == 0, 0).otherwise(F.get(ends, i - 1)))


def increasing(ends: Column) -> Column:
    """Whether chunk ends rise from above zero, with one at least."""
    return (F.size(ends) > 0) & F.forall(differences(ends), lambda n: n > 0)


def probability_checks(p: Column) -> list[Column]:
    finite = F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return [finite.alias("finite"), F.forall(p, lambda x: x >= 0).alias("non_negative"), (F.aggregate(p, F.lit(0.0), lambda a, x: a + x) > 0).alias("has_mass")]


def resample(values: Column, slots: int) -> Column:
    """Entries at even distances from first to last, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.get(values, F.bround(i * (F.size(values) - 1) / F.lit(max(slots - 1, 1)), 0).cast("int")))


SOFT_MODES = ("weighted", "top1", "uniform", "temperature")


def soft_mode(p: Column, mode: str, temperature: float = 1.0) -> Column:
    """A row of probabilities as it is, all on its first largest entry, even,
    or flattened by a temperature; sums to one."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: let(a, lambda xs: let(F.greatest(total(xs), F.lit(1e-12)), lambda t: F.transform(xs, lambda x: x / t)))
    if mode == "top1":
        best = F.array_position(p, F.array_max(p)) - 1
        return F.transform(p, lambda x, i: F.when(i == best, 1.0).otherwise(0.0))
    if mode == "uniform":
        return F.transform(p, lambda x: F.lit(1.0) / F.size(p))
    if mode == "temperature":
        return norm(F.transform(norm(p), lambda x: F.pow(F.greatest(x, F.lit(1e-12)), F.lit(1 / temperature))))
    if mode != "weighted":
        raise ValueError(mode)
    return norm(p)


def perturbed(p: Column, unit: Callable[[Column], Column], scale: float, temperature: float) -> Column:
    """(ln(p + 1e-10) + scale * g) / temperature, g Gumbel noise from a number
    between 0 and 1 for each place."""
    return F.transform(p, lambda x, k: (F.ln(x + 1e-10) - scale * F.ln(-F.ln(unit(k)))) / temperature)


def normalised(row: Column) -> Column:
    """A row that sums to one; a sum near zero counts as 1e-12."""
    total = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
    return let(F.greatest(total, F.lit(1e-12)), lambda t: F.transform(row, lambda x: x / t))


def interleaved(tokens: Column, ends: Column, marker: Column) -> Column:
    """Every chunk with a marker after it."""
    return F.flatten(F.transform(ends, lambda e, i: let(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), lambda start: F.concat(F.slice(tokens, start + 1, e - start), F.array(marker)))))
