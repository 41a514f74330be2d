"""A store of records by index: a Python data source of Spark's.

``df.write.format("shards").option("path", p).mode("append").save()`` puts records
into one Parquet file a range of ``shardsize`` indices, ``batch_<start>_<end>``,
and commits in two phases: tasks write their shards below ``_writing-<run>``,
each under a name of its own attempt; the driver then checks that every range of
0 to n - 1 came once and whole, moves them to their names, and last of all
writes ``manifest.json``.  So a store is finished if it has a manifest, and a
task that runs twice leaves one shard.  An aborted write leaves nothing.

``spark.read.format("shards")`` has a partition for each shard.  The options
``low``, ``high`` (not included) and ``indices`` bound the records, so that only
their shards are opened; of the columns only those of the schema that is asked
for.  With the option ``pushdown``, which asks for Spark's setting
``spark.sql.python.filterPushdown.enabled``, filters on ``record_index`` (=, <,
<=, >, >=, in) do the same.  Spark 4.1 then keeps for a loaded frame the shards
of the first plan that was made of it, whatever the next one's filter: such a
frame serves for one filter.  So ``read_store`` and ``read_at`` use the bounds.

A folder without a manifest is an error, as is a shard whose rows aren't its
range.

Paths are local or on any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

INDEX, MANIFEST = "record_index", "manifest.json"
#: Records of a shard.
SHARD_SIZE = 1000
# Fixed format: how a shard is named by its range.
_SHARD = re.compile(r"batch_(\d+)_(\d+)\.parquet$")


def shard_name(start: int, end: int) -> str:
    return f"batch_{start}_{end}.parquet"


def shard_range(name: str) -> tuple[int, int] | None:
    """(start, end) that a file's name says; None if it isn't a shard's."""
    m = _SHARD.search(name)
    return (int(m[1]), int(m[2])) if m else None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def read_manifest(path: str) -> dict:
    """What a finished store says of itself; an unfinished one is an error."""
    files, root = _opened(path)
    if not _there(files, f"{root}/{MANIFEST}"):
        raise RuntimeError(f"Incomplete store: {path}" if _there(files, root) else f"No store: {path}")
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Shard(InputPartition):
    start: int
    end: int
    name: str


@dataclass
class Written(WriterCommitMessage):
    """(start, end, rows, name within the run's folder) of a task's shards."""

    shards: list[tuple[int, int, int, str]]


class ShardReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, low: int = 0, high: int | None = None, wanted: set[int] | None = None) -> None:
        self.path, self.schema = path, schema
        self.low, self.high, self.wanted = low, high, wanted

    def partitions(self) -> Sequence[InputPartition]:
        told = read_manifest(self.path)
        high = told["num_records"] if self.high is None else self.high
        of = None if self.wanted is None else {v // told["shard_size"] for v in self.wanted if self.low <= v < high}
        shards = [Shard(s["start"], s["end"], s["file"]) for s in told["shards"] if s["start"] < high and s["end"] > self.low and (of is None or s["start"] // told["shard_size"] in of)]
        return shards or [Shard(0, 0, "")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = _opened(self.path)
        want = to_arrow_schema(self.schema)
        with files.open_input_file(f"{root}/{partition.name}") as f:
            shard = pq.ParquetFile(f)
            if shard.metadata.num_rows != partition.end - partition.start:
                raise RuntimeError(f"{partition.name} has {shard.metadata.num_rows} records")
            for batch in shard.iter_batches(columns=want.names):
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(want.names, want.types, strict=True)], schema=want)


class FilteredShardReader(ShardReader):
    """One that takes filters; Spark asks for its setting then."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes what bounds the index; Spark checks all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == (INDEX,):
                match f:
                    case EqualTo(value=v):
                        self.within(v, v + 1)
                    case GreaterThan(value=v):
                        self.within(v + 1, None)
                    case GreaterThanOrEqual(value=v):
                        self.within(v, None)
                    case LessThan(value=v):
                        self.within(0, v)
                    case LessThanOrEqual(value=v):
                        self.within(0, v + 1)
                    case In(value=values):
                        own = {v for v in values if v is not None}
                        self.wanted = own if self.wanted is None else self.wanted & own
            yield f

    def within(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, size: int, settings: dict) -> None:
        self.path, self.schema, self.size, self.settings = path, schema, size, settings
        self.run = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A task has whole shards, sorted by index."""
        files, root = _opened(self.path)
        files.create_dir(f"{root}/{self.run}", recursive=True)
        done: list[tuple[int, int, int, str]] = []
        held: list[pa.RecordBatch] = []

        def close() -> None:
            table = pa.Table.from_batches(held)
            index = table.column(INDEX)
            low, high = pc.min_max(index).values()
            name = f"{uuid.uuid4().hex}.parquet"
            with files.open_output_stream(f"{root}/{self.run}/{name}") as f:
                pq.write_table(table, f, compression="zstd")
            if pc.count_distinct(index).as_py() != len(index):
                raise ValueError(f"An index is there twice, between {low} and {high}")
            done.append((low.as_py(), high.as_py() + 1, len(index), name))
            held.clear()

        shard = None
        for batch in batches:
            index = batch.column(batch.schema.get_field_index(INDEX))
            if index.null_count or (len(index) and pc.min(index).as_py() < 0):
                raise ValueError(f"{INDEX} must not be null or negative")
            of = pc.divide(index.cast(pa.int64()), self.size).to_pylist()
            begin = 0
            for k, s in enumerate(of):
                if s != shard:
                    if k > begin:
                        held.append(batch.slice(begin, k - begin))
                    if held:
                        close()
                    begin, shard = k, s
            if begin < len(of):
                held.append(batch.slice(begin))
        if held:
            close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Second phase: every range once and whole, or nothing is kept."""
        files, root = _opened(self.path)
        shards = sorted(s for m in messages if m for s in m.shards)
        n = shards[-1][1] if shards else 0
        faults = range_faults([(s, e) for s, e, _, _ in shards], n, self.size)
        faults += [(s, e, "incomplete") for s, e, rows, _ in shards if rows != e - s]
        if faults:
            self.abort(messages)
            raise ValueError(f"Not a whole store: {faults[:5]}")
        for s, e, _, name in shards:
            files.move(f"{root}/{self.run}/{name}", f"{root}/{shard_name(s, e)}")
        if shards:
            files.delete_dir(f"{root}/{self.run}")
        files.create_dir(root, recursive=True)
        told = self.settings | {"num_records": n, "shard_size": self.size, "schema": json.loads(self.schema.json()), "shards": [{"file": shard_name(s, e), "start": s, "end": e} for s, e, _, _ in shards]}
        with files.open_output_stream(f"{root}/{MANIFEST}.tmp") as f:
            f.write(json.dumps(told, sort_keys=True).encode())
        files.move(f"{root}/{MANIFEST}.tmp", f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.path)
        if _there(files, f"{root}/{self.run}"):
            files.delete_dir(f"{root}/{self.run}")
        if _there(files, root) and not files.get_file_info(fs.FileSelector(root)):
            files.delete_dir(root)


def range_faults(ranges: list[tuple[int, int]], n: int, size: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, gap | overlap | empty | misplaced) of sorted ranges that
    should follow one another from 0 to n, each beginning at a multiple of size."""
    out, at = [], 0
    for start, end in ranges:
        if end <= start:
            out.append((start, end, "empty"))
            continue
        if start > at:
            out.append((at, start, "gap"))
        if start < at:
            out.append((start, min(at, end), "overlap"))
        if size and start % size:
            out.append((start, end, "misplaced"))
        at = max(at, end)
    return [*out, (at, n, "gap")] if at < n else out


def shard_faults(files: DataFrame, records: DataFrame, store: str = "store", name: str = "file", n: str = "n") -> DataFrame:
    """(store, start, end, fault) of stores' files(store, file) against their
    records(store, n), from the names alone: gap, overlap, empty, or a name that
    is no shard's."""
    part = lambda k: F.regexp_extract(name, _SHARD.pattern, k).try_cast("long")
    named = files.select(store, name, part(1).alias("start"), part(2).alias("end"))
    known = named.where("start is not null and end is not null")
    before = Window.partitionBy(store).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    full = known.where("end > start").withColumn("_at", F.coalesce(F.max("end").over(before), F.lit(0)))
    gaps = full.where("start > _at").select(store, F.col("_at").alias("start"), F.col("start").alias("end"), F.lit("gap").alias("fault"))
    overlaps = full.where("start < _at").select(store, "start", F.least("_at", "end").alias("end"), F.lit("overlap").alias("fault"))
    last = records.join(full.groupBy(store).agg(F.max("end").alias("_last")), store, "left").select(store, F.coalesce("_last", F.lit(0)).alias("start"), F.col(n).alias("end"))
    tail = last.where("start < end").withColumn("fault", F.lit("gap"))
    beyond = last.where("start > end").select(store, F.col("end").alias("start"), F.col("start").alias("end"), F.lit("beyond").alias("fault"))
    empty = known.where("end <= start").select(store, "start", "end", F.lit("empty").alias("fault"))
    odd = named.where("start is null or end is null").select(store, "start", "end", F.concat(F.lit("name "), name).alias("fault"))
    return reduce(DataFrame.unionByName, [gaps, overlaps, tail, beyond, empty, odd])


class ShardSource(DataSource):
    """Format ``shards``; options to write: path, shardsize, settings (JSON, kept
    in the manifest); to read: path, low, high, indices,
    pushdown."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType:
        return StructType.fromJson(read_manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        wanted = {int(k) for k in o["indices"].split(",") if k} if "indices" in o else None
        kind = FilteredShardReader if o.get("pushdown", "false") == "true" else ShardReader
        return kind(o["path"], schema, int(o.get("low", 0)), int(o["high"]) if "high" in o else None, wanted)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        path, size = self.options["path"], int(self.options.get("shardsize", SHARD_SIZE))
        files, root = _opened(path)
        if INDEX not in schema.names or size < 1:
            raise ValueError(f"A store needs {INDEX} and a shard size of 1 at least")
        if _there(files, root):
            raise RuntimeError(f"{'There is a' if _there(files, f'{root}/{MANIFEST}') else 'Incomplete'} store: {path}")
        return ShardWriter(path, schema, size, json.loads(self.options.get("settings", "{}")))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ShardSource)
    return spark


def write_store(rows: DataFrame, path: str, size: int = SHARD_SIZE, settings: dict | None = None) -> dict:
    """A finished store of rows(record_index, ...), which must be 0 to n - 1.  One
    that is there is used again if its settings, size and schema are the same;
    another one, or an unfinished one, is an error."""
    spark = registered(rows.sparkSession)
    files, root = _opened(path)
    if _there(files, root):
        told = read_manifest(path)
        wanted = (settings or {}) | {"shard_size": size, "schema": json.loads(rows.schema.json())}
        other = sorted(k for k, v in wanted.items() if told.get(k) != v)
        if other:
            raise RuntimeError(f"The store at {path} differs in {', '.join(other)}")
        return told
    shard = F.floor(F.col(INDEX) / size)
    # shards lie whole in a task, side by side
    dealt = rows.repartitionByRange(shard).sortWithinPartitions(INDEX)
    dealt.write.format("shards").option("path", path).option("shardsize", size).option("settings", json.dumps(settings or {})).mode("append").save()
    return read_manifest(path)


def _load(spark: SparkSession, path: str, columns: tuple[str, ...] = (), **options) -> DataFrame:
    reader = registered(spark).read.format("shards").option("path", path).options(**options)
    if columns:
        whole = StructType.fromJson(read_manifest(path)["schema"])
        reader = reader.schema(StructType([whole[c] for c in columns]))
    return reader.load()


def read_store(spark: SparkSession, path: str, *columns: str, low: int = 0, high: int | None = None) -> DataFrame:
    """The records from low up to high (not included), or some of their columns."""
    if columns and INDEX not in columns:
        return read_store(spark, path, INDEX, *columns, low=low, high=high).drop(INDEX)
    bounds = {"low": low} | ({} if high is None else {"high": high})
    within = F.col(INDEX) >= low
    return _load(spark, path, columns, **bounds).where(within if high is None else within & (F.col(INDEX) < high))


def read_at(spark: SparkSession, path: str, *at: int) -> DataFrame:
    """Records by their index, negative ones from the end; one beyond the store
    is an error.  Only their shards are read."""
    n = read_manifest(path)["num_records"]
    for k in at:
        if not -n <= k < n:
            raise IndexError(k)
    wanted = sorted({k % n for k in at})
    return _load(spark, path, indices=",".join(map(str, wanted))).where(F.col(INDEX).isin(wanted))
