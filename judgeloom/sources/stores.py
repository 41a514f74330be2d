"""Two stores of the same records, read side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays as A

# What the manifests of both stores have to agree on.
AGREE = ("num_records", "compression_rate", "use")


def check_manifests(left: dict, right: dict, keys: tuple[str, ...] = AGREE) -> None:
    for key in keys:
        if left.get(key) != right.get(key):
            raise ValueError(f"Stores disagree on {key}: {left.get(key)!r} and {right.get(key)!r}")


def paired(cache: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_index, length, frontier_ends, probs, token_ids, fault): one row
    for each index of either store, ``fault`` null where the record is sound.

    ``cache`` has (record_index, explicit_ids, frontier_ends), ``labels``
    (record_index, probs, token_ids), arrays of arrays.
    """
    n_left, n_right = F.size("frontier_ends"), F.size("probs")
    aligned = (n_left == n_right) & (n_right == F.size("token_ids")) & F.forall(F.arrays_zip("probs", "token_ids"), lambda r: F.size(r["probs"]) == F.size(r["token_ids"]))
    whole = A.increasing(F.col("frontier_ends")) & (F.try_element_at("frontier_ends", F.lit(-1)) == F.size("explicit_ids"))
    sane = lambda k: F.forall("probs", lambda p: F.coalesce(k(p), F.lit(False)))
    finite = sane(lambda p: F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))
    mass = sane(lambda p: F.forall(p, lambda x: x >= 0) & (F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double")) > 0))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    left = cache.select("record_index", "explicit_ids", "frontier_ends", F.lit(True).alias("in_cache"))
    right = labels.select("record_index", "probs", "token_ids", F.lit(True).alias("in_labels"))
    fault = F.when(F.col("in_cache").isNull() | F.col("in_labels").isNull(), "missing").when(bad(aligned), "shapes").when(bad(whole), "frontiers").when(bad(finite), "not_finite").when(bad(mass), "no_mass")
    return left.join(right, "record_index", "full").select("record_index", F.size("explicit_ids").alias("length"), "frontier_ends", "probs", "token_ids", fault.alias("fault"))


def read_pair(spark: SparkSession, cache_path: str, labels_path: str, cache_manifest: dict, labels_manifest: dict) -> DataFrame:
    """The sound records of two sharded stores; any other is an error."""
    check_manifests(cache_manifest, labels_manifest)
    rows = paired(spark.read.parquet(cache_path), spark.read.parquet(labels_path))
    fail = F.raise_error(F.concat(F.lit("Record "), F.col("record_index").cast("string"), F.lit(": "), F.col("fault")))
    return rows.where(F.when(F.col("fault").isNotNull(), fail.cast("boolean")).otherwise(True)).drop("fault")


def complete_shards(rows: DataFrame, index: str, n_records: int, size: int) -> DataFrame:
    """(shard, rows, complete) of the shards that are there, against what the
    manifest says."""
    shard = F.floor(F.col(index) / size).alias("shard")
    return rows.groupBy(shard).agg(F.count("*").alias("rows")).withColumn("complete", F.col("rows") == F.least(F.lit(size), F.lit(n_records) - F.col("shard") * size))


def overlaid(base: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """base(key, length, latents, frontier_ends), latents and frontiers replaced
    where a trace(key, latents) is there; its frontiers are at even distances,
    rounded up.  Overlaid says which."""
    over = traces.select(key, F.col("latents").alias("_latents"))
    both = base.join(over, key, "left")
    n = F.size("_latents")
    even = F.transform("_latents", lambda _, i: F.when(i + 1 == n, F.col("length")).otherwise(F.ceil(F.col("length") * (i + 1) / n).cast("int")))
    there = F.col("_latents").isNotNull()
    return both.select(key, "length", F.when(there, F.col("_latents")).otherwise(F.col("latents")).alias("latents"), F.when(there, even).otherwise(F.col("frontier_ends")).alias("frontier_ends"), there.alias("overlaid"))


def shapes(rows: DataFrame, matrix: str, vector: str) -> DataFrame:
    """(matrix, agree, width): whether a matrix's rows are all as wide."""
    return rows.groupBy(matrix).agg((F.min(F.size(vector)) == F.max(F.size(vector))).alias("agree"), F.max(F.size(vector)).alias("width"))
