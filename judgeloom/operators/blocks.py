"""Windows over few large groups, cut into blocks of ids.

A window by a key of few values sends a large part of all rows to one task.
Here the rows of a group are cut by ranges of their id; only one row a block
passes through the window of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000


def _same(group: str, left: str, right: str) -> Column:
    return F.col(f"{left}.{group}").eqNullSafe(F.col(f"{right}.{group}")) & F.col(f"{left}._block").eqNullSafe(F.col(f"{right}._block"))


def running(rows: DataFrame, group: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the sum of value over the group's rows before each, by order."""
    cut = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(group, "_block").agg(F.sum("_value").alias("_sum")).select(group, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("_within", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    joined = within.alias("l").join(starts.alias("r"), _same(group, "l", "r"))
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("r._start") + F.col("l._within")).alias(name))


def successor(rows: DataFrame, group: str, key: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the next key of their group, the first one after the last."""
    cut = rows.withColumn("_block", F.floor(F.col(key) / block))
    w = Window.partitionBy(group).orderBy("_block")
    heads = cut.groupBy(group, "_block").agg(F.min(key).alias("_head"))
    heads = heads.select(group, "_block", F.coalesce(F.lead("_head").over(w), F.first("_head").over(w)).alias("_next"))
    within = cut.withColumn("_within", F.lead(key).over(Window.partitionBy(group, "_block").orderBy(key)))
    joined = within.alias("l").join(heads.alias("r"), _same(group, "l", "r"))
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], F.coalesce("l._within", "r._next").alias(name))
