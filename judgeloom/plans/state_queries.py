"""Stores read by shard, streams with state, shards checked by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import json_files, shard_store
from ..sources.folders import new_folder
from ..sources.tables import table
from ..streaming import keyed
from .registry import query

_SLICE = "record_index BETWEEN 120 AND 333 OR record_index >= (SELECT max(doc_id) - 9 FROM documents)"


@query(f"SELECT doc_id AS record_index, lang, n_chars FROM (SELECT *, doc_id AS record_index FROM documents) WHERE {_SLICE}")
def store_slice(spark: SparkSession, d: str) -> DataFrame:
    """Two ranges of a store, each read from its own shards; the second write
    finds the store finished."""
    path = new_folder(spark, "slices")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("record_index"), "lang", "n_chars")
    for _ in range(2):
        told = shard_store.write_store(rows, path, size=100, settings={"use": "slices"})
    return shard_store.read_store(spark, path, low=120, high=334).unionByName(shard_store.read_store(spark, path, low=max(334, told["num_records"] - 10)))


_SHARDS = "SELECT o_orderpriority AS store, o_orderkey // 500 AS k, CASE WHEN o_orderkey // 500 % 7 = 3 THEN 20 ELSE 0 END AS early, o_orderkey // 500 % 11 = 5 AS gone FROM orders GROUP BY ALL"


@query(f"""
WITH s AS ({_SHARDS}), f AS (SELECT store, k * 500 - CASE WHEN k > 0 THEN early ELSE 0 END AS a, (k + 1) * 500 AS b FROM s WHERE NOT gone UNION ALL SELECT store, k * 500, k * 500 FROM s WHERE k % 13 = 1),
n AS (SELECT store, max(k + 1) * 500 + 7 AS n FROM s GROUP BY store), x AS (SELECT *, coalesce(max(b) OVER (PARTITION BY store ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM f WHERE b > a)
SELECT store, CAST(at_ AS BIGINT) AS start, CAST(a AS BIGINT) AS end_, 'gap' AS fault FROM x WHERE a > at_ UNION ALL SELECT store, CAST(a AS BIGINT), CAST(least(at_, b) AS BIGINT), 'overlap' FROM x WHERE a < at_
UNION ALL SELECT store, CAST(a AS BIGINT), CAST(b AS BIGINT), 'empty' FROM f WHERE b <= a UNION ALL SELECT store, CAST(max(b) AS BIGINT), CAST(any_value(n) AS BIGINT), 'gap' FROM x JOIN n USING (store) GROUP BY store
""")
def shard_faults(spark: SparkSession, d: str) -> DataFrame:
    """Stores by their shards' names, some of them missing, some beginning too
    early, some empty, all ending too early."""
    k = F.floor(F.col("o_orderkey") / 500)
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("store"), k.alias("k")).distinct()
    early = F.when((F.col("k") % 7 == 3) & (F.col("k") > 0), 20).otherwise(0)
    name = lambda a, b: F.format_string("batch_%d_%d.parquet", a, b).alias("file")
    files = s.where("k % 11 <> 5").select("store", name(F.col("k") * 500 - early, (F.col("k") + 1) * 500)).unionByName(s.where("k % 13 = 1").select("store", name(F.col("k") * 500, F.col("k") * 500)))
    records = s.groupBy("store").agg((F.max(F.col("k") + 1) * 500 + 7).alias("n"))
    return shard_store.shard_faults(files, records).withColumnRenamed("end", "end_")


@query("SELECT item_id, text FROM benchmark")
def keyed_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that takes a key's row once, by state that outlives a restart: the
    second run brings a third of the rows again."""
    folder, rows = new_folder(spark, "keyed"), table(spark, d, "benchmark").select("item_id", "text")
    for name, part in (("a", rows.where("item_id % 3 < 2")), ("b", rows.where("item_id % 3 > 0"))):
        part.write.option("ignoreNullFields", "false").json(f"{folder}/in/{name}")
        keyed.ingest_agreed(spark, f"{folder}/in/*", "item_id long, text string", f"{folder}/log", f"{folder}/state", "item_id")
    return spark.read.parquet(f"{folder}/log")


@query("""
WITH g AS (SELECT user_id, ts, event_type, sum(CASE WHEN ts - prev <= INTERVAL 24 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)),
s AS (SELECT user_id, session, epoch_us(min(ts)) AS queued_us, epoch_us(min(ts) FILTER (event_type = 'click')) AS first_us, epoch_us(max(ts)) AS finish_us, CAST(count(*) AS BIGINT) AS events FROM g GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS request, queued_us, first_us, finish_us, events, first_us - queued_us AS ttft_us, finish_us - first_us AS decode_us, finish_us - queued_us AS e2e_us FROM s
""")
def session_latency(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions from a stream that is started for each of three parts and
    once more to close it; each session is given when its timer fires."""
    folder, events = new_folder(spark, "sessions"), table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    placed = events.join(F.broadcast(span)).withColumn("part", F.least(F.lit(2), F.floor(3 * (F.unix_micros("ts") - F.unix_micros("low")) / (F.unix_micros("high") - F.unix_micros("low") + 1))))
    closing = span.select(F.lit(-1).cast("long").alias("user_id"), (F.col("high") + F.expr("INTERVAL 48 HOURS")).alias("ts"), F.lit("close").alias("event_type"))
    for k in range(4):
        (placed.where(F.col("part") == k).select("user_id", "ts", "event_type") if k < 3 else closing).write.parquet(f"{folder}/in/{k}")
        keyed.run_latencies(spark, f"{folder}/in/*", "user_id long, ts timestamp, event_type string", f"{folder}/log", f"{folder}/state", "user_id", "ts", F.col("event_type") == "click", 24 * 3_600_000, "1 hour")
    return spark.read.parquet(f"{folder}/log")


_LINES = "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS number, CASE WHEN doc_id % 50 = 7 THEN 'malformed' WHEN doc_id % 50 = 11 THEN 'blank' WHEN doc_id % 50 = 19 THEN 'not_object' ELSE 'ok' END AS state FROM documents"


def _spoilt_log(spark: SparkSession, d: str, name: str, **options) -> str:
    """Documents as JSON lines, a file a language, with faults."""
    path, k = new_folder(spark, name), F.col("doc_id") % 50
    whole = F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})
    line = F.when(k == 7, F.substring(whole, 1, 12)).when(k == 11, " ").when(k == 19, "[1]").otherwise(whole)
    rows = table(spark, d, "documents").select("doc_id", "lang", line.alias("value")).repartition("lang").sortWithinPartitions("lang", "doc_id")
    rows.select("lang", "value").write.options(**options).partitionBy("lang").text(path)
    return path


@query(f"SELECT lang, number, state FROM ({_LINES}) WHERE state <> 'ok'")
def line_faults(spark: SparkSession, d: str) -> DataFrame:
    """Where the faults of a log are, by language and line; its files are read in
    splits of many sizes, or as one where they are compressed."""
    lang = F.regexp_extract("file", "lang=([^/]*)", 1).alias("lang")
    states = json_files.line_states(spark, _spoilt_log(spark, d, "faults"))
    zipped = json_files.line_states(spark, _spoilt_log(spark, d, "faults", compression="gzip"))
    both = states.where("state <> 'ok'").select(lang, "number", "state").intersect(zipped.where("state <> 'ok'").select(lang, "number", "state"))
    return both


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(*) FROM ({_LINES}) WHERE state = 'malformed') AS BIGINT) AS skipped, CAST((SELECT count(*) FROM ({_LINES}) WHERE state = 'blank') AS BIGINT) AS blank FROM documents WHERE doc_id % 50 NOT IN (7, 11, 19) GROUP BY lang")
def counted_on_the_way(spark: SparkSession, d: str) -> DataFrame:
    """A log read leniently; what is skipped is counted in the pass that reads."""
    rows, seen = json_files.read_counted(spark, _spoilt_log(spark, d, "counted"), "doc_id long, text string")
    folder = new_folder(spark, "read")
    rows.write.parquet(folder)
    read = spark.read.parquet(folder).where("doc_id is not null").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return read.groupBy("lang").agg(F.count("*").alias("rows")).withColumns({n: F.lit(seen.get[n]).cast("long") for n in ("skipped", "blank")})
