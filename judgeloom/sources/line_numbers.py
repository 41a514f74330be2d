"""Lines of text files with their exact numbers, though files are read in splits.

A split doesn't know how many lines stand before it.  So each split counts its
lines; a running sum of these counts over the splits of a file, which are few,
gives every split the number of its first line.  Lines are then numbered within
their split and moved by that.  Compressed files have one split.

Counting reads the files once and numbering once more; no line is shuffled.
Splits are told by file and start, lines of a split by the order they are read
in, which Spark keeps within a partition as long as nothing is dealt out anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line) of all lines, in the order of each split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, before): how many lines of a file stand before a split."""
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split from 1; a partition may hold several."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = np.empty(batch.num_rows, np.int64)
        for i, key in enumerate(zip(files, blocks, strict=True)):
            out[i] = at[key] = at.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["file", "block", "line", "n"])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, line), numbers from 1."""
    lines = split_lines(spark, path)
    starts = block_starts(lines)
    within = lines.mapInArrow(_within, "file string, block long, line string, n long")
    joined = within.join(F.broadcast(starts), ["file", "block"])  # a row for each split
    return joined.select("file", (F.col("before") + F.col("n")).alias("number"), "line")
