"""Vectors against a vocabulary of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Vocabulary vectors in one block; a block is one row.
BLOCK_ROWS = 1024


def with_blocks(rows: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Each row with each of n blocks(block, entries).  A sole block is broadcast;
    of several, copies are dealt over the shuffle's partitions, so that the work
    isn't bound to as many tasks as there are blocks."""
    if n == 1:
        return rows.withColumn("block", F.lit(0)).join(F.broadcast(blocks), "block")
    copies = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n)
    dealt = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asking = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int").alias("copy"))
    return asking.join(dealt, ["block", "copy"]).drop("copy")


def cosine_top_k(vectors: DataFrame, vocabulary: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, rank, word, cosine): the k most similar entries, ties by word.

    ``vectors`` has (id, v), ``vocabulary`` (word, v), arrays of double.  The
    vocabulary is cut into blocks; each vector keeps k entries of a block, and
    k of all blocks.  Words are distinct, so hashed blocks hold about
    ``block_rows`` each; a sole block, which has no more, is broadcast.
    """
    n = vocabulary.count()
    blocks = max(1, -(-n // block_rows))
    norm = lambda v: F.sqrt(A.dot(v, v))
    entry = F.struct("word", "v", norm(F.col("v")).alias("norm"))
    block = F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")
    packed = vocabulary.select(block.alias("block"), entry.alias("entry")).groupBy("block").agg(F.collect_list("entry").alias("entries"))
    joined = with_blocks(vectors.select("id", "v", norm(F.col("v")).alias("norm")), packed, blocks)
    likeness = lambda e: A.dot(F.col("v"), e["v"]) / F.greatest(F.col("norm") * e["norm"], F.lit(1e-12))
    found = F.slice(F.array_sort(F.transform("entries", lambda e: F.struct((-likeness(e)).alias("neg"), e["word"].alias("word")))), 1, k)
    top = joined.select("id", found.alias("top"))
    if blocks > 1:
        # k of each block: bounded by k times the number of blocks
        top = top.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return top.select("id", F.posexplode("top").alias("rank", "e")).select("id", "rank", F.col("e.word").alias("word"), (-F.col("e.neg")).alias("cosine"))

