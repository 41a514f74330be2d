"""How filters overlap: what each order of filters removes, and in which step.

1. One pass over the texts gives each row the letters of the filters it fails
   and what the refinement needs: its length and hashes of successive blocks.
2. Repeated texts by partition refinement: rows are split by length in code
   points, then by the hash of one block after another; a row that is alone in
   its class leaves at once.  Full texts are read again for the classes that are
   left and compared as they are; rows with a larger id than the smallest of
   their text fail the filter too.
3. Rows are counted by (part, letters failed); every order and step is worked
   out from these counts alone.

Scale: texts are read twice and only those of repeated texts are shuffled, one
copy a task (and then one a salt) of each; a bitmap of at most ``MAX_BITS``
tells them.  Beyond that more texts pass it, which costs time and changes no
result.  Counts per order have 2^filters rows a part.

Results for odd inputs: null texts count as empty; a null id isn't smaller than
any other and none is smaller than it, and it has no labels; rows of one id and
text don't make each other repeated; labels that repeat count once (1 if any row
says so), null labels as 0; null parts count as the empty string; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packs as P

#: Where the blocks of the refinement start, in code points; the last goes on
#: to the end of the text.
BLOCKS = (0, 256, 4096)
#: Bits of the map of repeated classes: 16 a class, at most 32 MB.
BITS_A_CLASS, MAX_BITS = 16, 1 << 28
#: Tasks' copies of one text meet in so many groups before they meet in one.
SALTS = 64
#: Orders are all listed, so there are few filters.
MAX_FILTERS = 6
#: (columns to be computed first, conditions on them by letter) of a text.
Filters = Callable[[Column], tuple[dict[str, Column], dict[str, Column]]]
_BITMAP = 1 << 15  # bits of one row of bitmap_construct_agg
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """A few words, B few
    different words, C many capitals, D signs of markup."""
    first = {"_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")}
    n = F.size("_words")
    return first, {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct("_words")) < 80 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, _UPPER, ""))) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _keys(blocks: tuple[int, ...]) -> list[str]:
    return ["_length", *(f"_block{k}" for k in range(len(blocks)))]


def _keyed(rows: DataFrame, blocks: tuple[int, ...], block_hash: Callable[[Column], Column]) -> DataFrame:
    """rows(_text, ...) with length and block hashes."""
    ends = [*blocks[1:], 1 << 30]
    return rows.withColumns({"_length": F.length("_text")} | {f"_block{k}": block_hash(F.substring("_text", start + 1, end - start)) for k, (start, end) in enumerate(zip(blocks, ends, strict=True))})


def refined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that share all of keys with another one.  Classes are split by
    one key after the other; singletons leave after each."""
    for k in range(1, len(keys) + 1):
        # stored apart, so that the join has an exchange on either side and Spark can split a common length
        shared = P.checkpointed(rows.groupBy(*keys[:k]).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
        rows = P.checkpointed(rows.join(shared, keys[:k], "left_semi"))
    return rows


def _maybe_in(classes: DataFrame, keys: list[str], max_bits: int):
    """A condition that holds for all rows of the classes, and few others."""
    most = max_bits // _BITMAP * _BITMAP
    bits = min(most, -(-max(1, classes.count()) * BITS_A_CLASS // _BITMAP) * _BITMAP)
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    maps = classes.select((place + 1).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_m"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # bits / 32,768 rows of 4 KB
        at = (r["_b"] - 1) * (_BITMAP // 8)
        whole[at : at + _BITMAP // 8] = np.frombuffer(bytes(r["_m"]), np.uint8)
    shared = classes.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        x = p.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    return there(place)


def repeated(rows: DataFrame, texts: DataFrame, blocks: tuple[int, ...] = BLOCKS, max_bits: int = MAX_BITS) -> DataFrame:
    """Of rows(_id, keys, ...), those whose text a smaller id has too.  texts
    has their keys too, and _text."""
    keys = _keys(blocks)
    rows = refined(rows, keys)
    classes = P.checkpointed(rows.select(*keys).distinct())
    if classes.isEmpty():
        return rows.limit(0)
    found = texts.where(_maybe_in(classes, keys, max_bits)).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    found = found.groupBy(*keys, "_salt", "_text").agg(F.min("_id").alias("_low"))
    found = found.repartition(*keys).groupBy(*keys, "_text").agg(F.min("_low").alias("_low"))
    lows = P.checkpointed(found.groupBy(*keys).agg(F.count("*").alias("_texts"), F.min("_low").alias("_low")))
    marked = rows.join(lows.where("_texts = 1").drop("_texts"), keys).where(F.col("_id") > F.col("_low")).drop("_low")
    mixed = lows.where("_texts > 1").select(*keys)
    if mixed.isEmpty():
        return marked
    # different texts of one class: their rows meet by the text itself
    own = texts.join(mixed, keys, "left_semi")
    smallest = own.groupBy(*keys, "_text").agg(F.min("_id").alias("_low"))
    return marked.unionByName(own.join(smallest, [*keys, "_text"]).where(F.col("_id") > F.col("_low")).select(*rows.columns))


def _with_labels(rows: DataFrame, labels: DataFrame, id_col: str, names: tuple[str, ...]) -> DataFrame:
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(f"_{c}")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(*map(flag, names))
    none = rows.where("_id is null").select("*", *(F.lit(0).cast("long").alias(f"_{c}") for c in names))  # else all in one task
    there = rows.where("_id is not null").join(known, "_id", "left").fillna(0, [f"_{c}" for c in names])
    return there.unionByName(none)


def failed_counts(docs: DataFrame, labels: DataFrame, filters: Filters = text_filters, repeats: str = "E", label_cols: tuple[str, ...] = ("quality", "toxic"), part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", blocks: tuple[int, ...] = BLOCKS, max_bits: int = MAX_BITS, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(part, failed, n, and a count for each label): rows by the letters of the
    filters they fail, in no order; ``repeats`` is the letter of repeated texts."""
    first, conditions = filters(F.col("_text"))
    letters = [*conditions, repeats]
    if len(letters) > MAX_FILTERS or any(len(x) != 1 for x in letters) or len(set(letters)) < len(letters):
        raise ValueError(f"at most {MAX_FILTERS} filters of one letter each: {letters}")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumns(first)
    failed = F.concat(*(F.when(c, F.lit(n)).otherwise(F.lit("")) for n, c in conditions.items()))
    texts = _keyed(base.select("_id", "part", "_text", failed.alias("failed")), blocks, block_hash)
    rows = P.checkpointed(texts.drop("_text"))
    again = P.checkpointed(repeated(rows, texts, blocks, max_bits).select("_id", "part", "failed"))
    # a repeated row is taken from its count and added to that of one letter more
    signed = rows.select("_id", "part", "failed", F.lit(1).alias("_sign")).unionByName(again.withColumn("_sign", F.lit(-1))).unionByName(again.withColumn("failed", F.concat("failed", F.lit(repeats))).withColumn("_sign", F.lit(1)))
    counted = _with_labels(signed, labels, id_col, label_cols).groupBy("part", "failed")
    return counted.agg(F.sum("_sign").cast("long").alias("n"), *(F.sum(F.col("_sign") * F.col(f"_{c}")).alias(c) for c in label_cols))


def interactions(counts: DataFrame, letters: str, label_cols: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """For every part, order of filters and step: rows kept after it, removed in
    it, failing it but removed before, failing it alone; of the removed, those
    with each label; and what it removes in all orders together."""
    orders = ",".join("".join(p) for p in permutations(letters))
    grid = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    failed = F.col("failed")
    here = F.expr("substring(filter_order, step, 1)")
    without = lambda n: F.expr(f"translate(failed, substring(filter_order, 1, {n}), '')")
    fails, before = F.contains(failed, here), without("step - 1") != failed
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0))).cast("long")
    share = F.when(fails, F.expr(f"n * {math.factorial(len(letters))} div greatest(length(failed), 1)")).otherwise(F.lit(0))
    return grid.groupBy("part", "filter_order", "step").agg(
        total(without("step") == failed).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(failed == here).alias("unique_fails"),
        *(total(fails & ~before, c).alias(f"{c}_lost") for c in label_cols),
        F.sum(share).cast("long").alias("shapley"),
    )
