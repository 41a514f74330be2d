"""Hidden states against a vocabulary, and losses between distributions.

The vocabulary is a table (word, w, e): its projection and its basis, arrays of
double.  It is cut into blocks of a bounded number of rows; a block is broadcast
only where it is the only one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .nearest import BLOCK_ROWS, with_blocks

EPSILON = 1e-12


def unit(v: Column) -> Column:
    return A.let(F.greatest(F.sqrt(A.dot(v, v)), F.lit(EPSILON)), lambda n: F.transform(v, lambda x: x / n))


def logits(states: DataFrame, vocabulary: DataFrame, cosine: bool = False, temperature: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, block, z) of states(id, h): for each block of words the array of
    (word, z), z = w . h / temperature, of unit vectors if cosine."""
    blocks = max(1, -(-vocabulary.count() // block_rows))
    w = unit(F.col("w")) if cosine else F.col("w")
    packed = vocabulary.select(F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("block"), F.struct("word", w.alias("w")).alias("entry"))
    packed = packed.groupBy("block").agg(F.collect_list("entry").alias("entries"))
    h = unit(F.col("h")) if cosine else F.col("h")
    joined = with_blocks(states.select("id", h.alias("h")), packed, blocks)
    return joined.select("id", "block", F.transform("entries", lambda x: F.struct(x["word"].alias("word"), (A.dot(F.col("h"), x["w"]) / temperature).alias("z"))).alias("z"))


def projected(states: DataFrame, vocabulary: DataFrame, top_k: int | None = None, **options) -> DataFrame:
    """(id, rank, word, p): softmax(W h) over the whole vocabulary, or over the
    ``top_k`` likeliest words alone; ties by word.  Of each block no more than
    top_k words leave."""
    z = logits(states, vocabulary, **options)
    order = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct((-x["z"]).alias("neg"), x["word"].alias("word"))))
    best = order(F.col("z"))
    best = best if top_k is None else F.slice(best, 1, top_k)
    every = z.select("id", best.alias("best")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    kept = F.col("best") if top_k is None else F.slice("best", 1, top_k)
    rows = every.select("id", kept.alias("best"))
    p = A.softmax(F.transform("best", lambda x: -x["neg"]))
    return rows.select("id", F.posexplode(F.arrays_zip(F.col("best.word").alias("word"), p.alias("p"))).alias("rank", "x")).select("id", "rank", "x.word", "x.p")


def weighted(weights: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, dim, v): the sums of p * e[word] by id, from weights(id, word, p)."""
    rows = weights.join(vocabulary.select("word", F.posexplode("e").alias("dim", "x")), "word")
    return rows.groupBy("id", "dim").agg(F.sum(F.col("p") * F.col("x")).alias("v"))


def log_softmax(z: Column) -> Column:
    return A.let(z, lambda zs: A.let(F.array_max(zs), lambda top: A.let(top + F.ln(F.aggregate(zs, F.lit(0.0), lambda a, x: a + F.exp(x - top))), lambda total: F.transform(zs, lambda x: x - total))))


def divergence(z: Column, q: Column, indices: Column | None = None, temperature: float = 1.0) -> Column:
    """KL(q || softmax(z / T)) of a row, q being given for all of z or for the
    entries at ``indices``; q is scaled to one.  T squared is left to the mean."""
    logp = log_softmax(F.transform(z, lambda x: x / temperature))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) + EPSILON
    scaled = A.let(total(q), lambda t: F.transform(q, lambda x: x / t))
    taken = logp if indices is None else A.let(logp, lambda lp: F.transform(indices, lambda i: F.get(lp, i)))
    terms = F.zip_with(scaled, taken, lambda a, b: a * (F.ln(F.greatest(a, F.lit(EPSILON))) - b))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def mean_divergence(rows: DataFrame, key: str, kl: Column, mask: Column | None = None, temperature: float = 1.0) -> DataFrame:
    """(key, loss): the mean over a key's rows (those with a mask) times T
    squared; zero where none has one."""
    counted = F.when(mask, 1).otherwise(0) if mask is not None else F.lit(1)
    return rows.groupBy(key).agg((F.sum(F.when(counted == 1, kl).otherwise(0.0)) / F.greatest(F.sum(counted), F.lit(1)) * temperature**2).alias("loss"))


def combined_loss(tokens: DataFrame, batch: str, example: str, ce: Column, kl: Column, ce_weight: float, kl_weight: float) -> DataFrame:
    """(batch, loss_ce, loss_kl, loss) of one row a token: the mean cross entropy
    of all tokens that have one, and the mean over examples of their mean
    divergences; both weighted."""
    by = tokens.groupBy(batch, example).agg(F.sum(ce).alias("_ce"), F.count(ce).alias("_n"), F.avg(kl).alias("_kl"))
    out = by.groupBy(batch).agg((F.sum("_ce") / F.greatest(F.sum("_n"), F.lit(1))).alias("loss_ce"), F.avg(F.coalesce("_kl", F.lit(0.0))).alias("loss_kl"))
    return out.withColumn("loss", ce_weight * F.col("loss_ce") + kl_weight * F.col("loss_kl"))
