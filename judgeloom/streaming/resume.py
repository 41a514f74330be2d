"""A result log that grows as files arrive, and goes on after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, signature: str | None = None, files_at_once: int | None = None) -> int:
    """Appends the rows of JSON-lines files that haven't been read yet to a
    Parquet log, and gives how many batches that took.

    Each batch is a folder of its own, so a batch that is run again after a
    failure replaces itself.  Rows of another run (``evaluation_id`` other than
    the signature) are an error.
    """
    stream = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)

    def append(batch: DataFrame, number: int) -> None:
        if signature is not None:
            other = ~F.col("evaluation_id").eqNullSafe(F.lit(signature))
            batch = batch.where(F.when(other, F.raise_error(F.lit("row of another run")).cast("boolean")).otherwise(True))
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    started = stream.json(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in started.recentProgress)


def completed(rows: DataFrame, key: str) -> DataFrame:
    """One row a key.  Rows that say the same collapse; rows that differ are an
    error.  Only digests are compared, so copies shuffle as one row a task."""
    values = [c for c in rows.columns if c != key]
    digest = F.xxhash64(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))
    groups = rows.groupBy(key).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high"), F.any_value(F.struct(*values)).alias("_row"))
    conflict = F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string"))).cast("boolean")
    return groups.where(F.when(F.col("_low") != F.col("_high"), conflict).otherwise(True)).select(key, "_row.*")


def pending(requests: DataFrame, done: DataFrame, key: str, rank: int = 0, world: int = 1) -> DataFrame:
    """What one of several workers has still to do."""
    return requests.where(F.pmod(F.col(key), F.lit(world)) == rank).join(done.select(key), key, "left_anti")


def windowed_latency(rows: DataFrame, ts: str = "ts", value: str = "value", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and means by time window; a stream drops what is later than
    ``late`` and keeps state for that long only."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select("w.start", "w.end", "n", "mean")


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in an order that tells all rows apart."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
