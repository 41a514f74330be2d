"""JSON files as DataFrames, at four levels of strictness, and their sinks.

Lines are read as text (gzip too) and parsed once as variants, so that a line
that isn't JSON can be told from one that is JSON but no object.  Files are
never changed by reading them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .folders import remove
from .line_numbers import numbered_lines


def _state(line: str = "line") -> F.Column:
    """ok, blank, malformed or not_object, of a line and its column json."""
    return F.when(F.col(line).rlike(r"(?U)^\s*$"), "blank").when(F.col("json").isNull(), "malformed").when(~F.schema_of_variant("json").startswith("OBJECT"), "not_object").otherwise("ok")


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, at, line, state, row): every line, state being ok, blank,
    malformed or not_object; ``at`` orders the lines of a file."""
    # by block start, then by order within the split that begins there
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("line"))
    return lines.withColumn("json", F.try_parse_json("line")).select("file", "at", "line", _state().alias("state"), F.from_json("line", schema).alias("row"))


def line_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, line, state) of every line, numbered from 1."""
    lines = numbered_lines(spark, path).withColumn("json", F.try_parse_json("line"))
    return lines.select("file", "number", "line", _state().alias("state"))


def _or_fail(bad: F.Column, what: str, wanted: F.Column) -> F.Column:
    """wanted, but an error where bad; one condition, as Spark may move parts of
    a filter past each other."""
    place = F.concat(F.col("file"), F.lit(", line "), F.col("number").cast("string"))
    fail = F.raise_error(F.concat(F.lit(f"{what} in "), place, F.lit(": "), F.substring("line", 1, 200)))
    return F.when(bad, fail.cast("boolean")).otherwise(wanted)


def read_strict(spark: SparkSession, path: str | list[str], schema: str, skip_blank: bool = True) -> DataFrame:
    """Any line that is no JSON object is an error that names the file and the
    line; so is a blank one unless those are skipped.  For the numbers the
    lines are counted first."""
    lines = line_states(spark, path)
    good = F.col("state").isin("ok", "blank") if skip_blank else F.col("state") == "ok"
    return lines.where(_or_fail(~good, "Not a JSON object", F.col("state") == "ok")).select(F.from_json("line", schema).alias("row")).select("row.*")


def read_counted(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, Observation]:
    """The rows of lenient reading, and what it counts on the way: lines read,
    skipped (malformed) and blank.  The counts are there once the rows have been
    computed, in the same pass; where a task runs twice they count once."""
    seen = Observation(f"lines of {uuid.uuid4().hex}")
    counts = [F.count_if(F.col("state").isin("ok", "not_object")).alias("read"), F.count_if(F.col("state") == "malformed").alias("skipped"), F.count_if(F.col("state") == "blank").alias("blank")]
    lines = json_lines(spark, path, schema).observe(seen, *counts)
    return lines.where("state in ('ok', 'not_object')").select("row.*"), seen


def read_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows, and (file, line) of what was skipped because it isn't JSON."""
    lines = json_lines(spark, path, schema)
    return lines.where("state in ('ok', 'not_object')").select("row.*"), lines.where("state = 'malformed'").select("file", "line")


def read_recovering(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log whose writer may have died: a malformed last line of a file is
    left out; an earlier one, or a line that is no object, is an error."""
    lines = json_lines(spark, path, schema).where("state <> 'blank'")
    last = lines.groupBy("file").agg(F.max("at").alias("last"), F.min(F.when(F.col("state") == "malformed", F.col("at"))).alias("broken"), F.count_if(F.col("state") == "not_object").alias("odd"))
    for row in last.where("odd > 0 or broken <> last").select("file", "odd").limit(1).collect():
        raise ValueError(f"{'Non-object' if row['odd'] else 'Malformed non-tail'} result in {row['file']}")
    return lines.where("state = 'ok'").select("row.*")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls written out; seen only when all are there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_shards(rows: DataFrame, path: str, index: str = "record_index", size: int = 1000) -> None:
    """Parquet by ranges of the index; a shard that is there is an error."""
    shard = F.floor(F.col(index) / size)
    rows.withColumn("shard", shard).repartition("shard").write.partitionBy("shard").mode("errorifexists").parquet(path)


def read_record(spark: SparkSession, path: str, at: int, n_records: int, index: str = "record_index", size: int = 1000) -> DataFrame:
    """One record by its index, from its shard alone; negative ones count from
    the end."""
    at = at + n_records if at < 0 else at
    if not 0 <= at < n_records:
        raise IndexError(at)
    return spark.read.parquet(path).where((F.col("shard") == at // size) & (F.col(index) == at)).drop("shard")


def missing_ranges(spark: SparkSession, existing: DataFrame, n_records: int, size: int = 1000) -> DataFrame:
    """(start, end) of the ranges that ``existing`` (start, end) lacks."""
    start = F.col("id").alias("start")
    wanted = spark.range(0, n_records, size).select(start, F.least(F.col("id") + size, F.lit(n_records)).alias("end"))
    return wanted.join(existing.select("start", "end"), ["start", "end"], "left_anti")


def read_split(spark: SparkSession, path: str, name: str, column: str = "split") -> DataFrame:
    """One named split of a dataset folder; a name that isn't there is an error."""
    rows = spark.read.parquet(path)
    if rows.where(F.col(column) == name).isEmpty():
        raise KeyError(f"No split {name} in {path}")
    return rows.where(F.col(column) == name).drop(column)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON object, as one row; more or other is an error."""
    rows = read_array(spark, path, schema)
    if rows.limit(2).count() != 1:
        raise ValueError(f"Not one JSON object: {path}")
    return rows


def write_report(row: DataFrame, path: str) -> None:
    """One row as a file of one JSON object, nulls written out."""
    if row.limit(2).count() != 1:
        raise ValueError("A report has one row")
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """JSON lines beside those that are there."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def merge_parts(spark: SparkSession, parts: list[str], schema: str, target: str) -> DataFrame:
    """The rows of several writers' parts as one folder of lines; the parts go
    once all are there."""
    write_lines(read_strict(spark, parts, schema), target)
    remove(spark, *parts)
    return read_strict(spark, target, schema)


def manifest(spark: SparkSession, settings: dict) -> DataFrame:
    """(setting, value) of all settings that a store is known by, values as JSON
    with sorted keys."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(settings.items())], "setting string, value string")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(setting, left, right) where two manifests don't agree."""
    both = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), "setting", "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
