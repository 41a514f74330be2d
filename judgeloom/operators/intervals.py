"""Points among ordered intervals, by one sort instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(key: str, is_header: Column, header_id: Column, *order: str) -> Column:
    """The id of the last header at or before a row; null before the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(is_header, header_id), ignorenulls=True).over(w)


def spans_over_tokens(tokens: DataFrame, spans: DataFrame, key: str, span_id: str) -> DataFrame:
    """(key, span_id, lo, hi): the tokens lo..hi-1 (by rank) that each span
    overlaps, tok.end > span.start and tok.start < span.end.

    Both take (key, start, end); the tokens of a key are ordered and don't
    overlap, so the two ends of a span are counts of token edges before them:
    one exchange by key and one sort, whatever the lengths.
    """
    edge = lambda df, col, rank, sid: df.select(key, F.col(col).alias("x"), F.lit(rank).alias("rank"), sid.alias(span_id))
    none, sid = F.lit(None).cast("long"), F.col(span_id).cast("long")
    # at one place: tokens end, spans start, spans end, tokens start
    edges = edge(tokens, "end", 0, none).unionAll(edge(spans, "start", 1, sid)).unionAll(edge(spans, "end", 2, sid)).unionAll(edge(tokens, "start", 3, none))
    w = Window.partitionBy(key).orderBy("x", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = edges.select("*", F.count_if(F.col("rank") == 0).over(w).alias("ended"), F.count_if(F.col("rank") == 3).over(w).alias("begun"))
    at = counted.where(F.col("rank").isin(1, 2)).groupBy(key, span_id)
    return at.agg(F.max(F.when(F.col("rank") == 1, F.col("ended"))).alias("lo"), F.max(F.when(F.col("rank") == 2, F.col("begun"))).alias("hi"))


def forbidden_cuts(overlaps: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, cut): edges between tokens inside a span of 2 to ``most`` tokens."""
    wide = (F.col("hi") - F.col("lo")).between(2, most)
    return overlaps.where(wide).select(key, F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("cut")).distinct()


def located(points: DataFrame, starts: DataFrame, key: str, name: str, block: int = 10_000) -> DataFrame:
    """points with the greatest start at or before each; null before the first.

    The axis is cut into blocks; within a block it is one sort, and only the
    last start of each block passes through one task."""
    of = lambda df, own: df.select(F.col(key).alias("x"), F.lit(own).alias("own"), F.floor(F.col(key) / block).alias("block"))
    rows = of(points, 1).unionAll(of(starts, 0))
    last = of(starts, 0).groupBy("block").agg(F.max("x").alias("last"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select("block").distinct().join(last, "block", "left").select("block", F.last("last", ignorenulls=True).over(w).alias("carry"))
    before = Window.partitionBy("block").orderBy("x", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("found", F.last(F.when(F.col("own") == 0, F.col("x")), ignorenulls=True).over(before))
    return found.where("own = 1").join(carried, "block").select(F.col("x").alias(key), F.coalesce("found", "carry").alias(name))
