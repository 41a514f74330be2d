"""Files, shards and stores: written from the tables, read back, compared."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import intervals
from ..operators import layout as L
from ..sources import assets, json_files, shard_store, stores
from ..sources.folders import new_folder
from ..sources.tables import table
from ..streaming import resume
from .measure_queries import _EDGES_SQL, _edges
from .registry import query

_ITEM = "item_id long, text string"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", "text")


def _as_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


@query("SELECT item_id, text FROM benchmark")
def scan_strict(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, blank ones between them."""
    path, lines = new_folder(spark, "strict"), _as_lines(_items(spark, d))
    lines.unionByName(lines.select(F.lit(" ").alias("value"))).write.text(path)
    return json_files.read_strict(spark, path, _ITEM)


@query("SELECT CASE WHEN item_id % 7 = 0 THEN 'skipped' ELSE 'read' END AS state, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN item_id % 7 <> 0 THEN item_id END) AS BIGINT) AS ids FROM benchmark GROUP BY 1")
def scan_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh line is cut off; it is left out, and counted."""
    path = new_folder(spark, "lenient")
    lines = _as_lines(_items(spark, d).where("item_id % 7 <> 0")).unionByName(_items(spark, d).where("item_id % 7 = 0").select(F.format_string('{"item_id": %d, "te', "item_id").alias("value")))
    lines.write.text(path)
    good, bad = json_files.read_lenient(spark, path, _ITEM)
    return good.select(F.lit("read").alias("state"), "item_id").unionByName(bad.select(F.lit("skipped").alias("state"), F.lit(None).cast("long").alias("item_id"))).groupBy("state").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


@query("SELECT item_id, text FROM benchmark WHERE item_id < (SELECT max(item_id) FROM benchmark)")
def scan_recovering(spark: SparkSession, d: str) -> DataFrame:
    """A log of one file whose last line was being written."""
    path = new_folder(spark, "log")
    last = _items(spark, d).agg(F.max("item_id").alias("last"))
    rows = _items(spark, d).join(F.broadcast(last)).coalesce(1).sortWithinPartitions("item_id")
    whole = F.to_json(F.struct("item_id", "text"))
    rows.select(F.when(F.col("item_id") == F.col("last"), F.substring(whole, 1, 9)).otherwise(whole).alias("value")).write.text(path)
    return json_files.read_recovering(spark, path, _ITEM)


@query("SELECT n_nationkey, n_name FROM nation")
def scan_array(spark: SparkSession, d: str) -> DataFrame:
    """A file that is one array; such a file is one row to begin with."""
    path = new_folder(spark, "array")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    return json_files.read_array(spark, path, "n_nationkey int, n_name string")


@query("SELECT conv_id, turn, role, text FROM conversations")
def scan_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "gzip")
    table(spark, d, "conversations").write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    return json_files.read_strict(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_regionkey", "r_name")


_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, lang FROM documents WHERE {_SPLIT} = 'validation'")
def scan_split(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "splits")
    table(spark, d, "documents").select("doc_id", "lang", F.expr(_SPLIT).alias("split")).write.partitionBy("split").parquet(path)
    return json_files.read_split(spark, path, "validation")


@query("SELECT count(*) AS records, min(n_name) AS first_name, ['a', 'b'] [2] AS use FROM nation")
def scan_config(spark: SparkSession, d: str) -> DataFrame:
    """A configuration object, nested, as one row."""
    path = new_folder(spark, "config")
    json_files.write_report(table(spark, d, "nation").agg(F.count("*").alias("records"), F.struct(F.min("n_name").alias("first")).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("uses")), path)
    return json_files.read_config(spark, path, "records long, name struct<first: string>, uses array<string>").select("records", F.col("name.first").alias("first_name"), F.get("uses", F.lit(1)).alias("use"))


@query("SELECT r_name AS name, 'org/' || lower(r_name) AS repo, 'main' AS revision, CASE WHEN r_regionkey = 0 THEN 'dataset' ELSE 'model' END AS type, 'assets/' || r_regionkey AS path, min(n_nationkey) AS position FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def asset_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Regions as assets, asked for once a nation."""
    manifest = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("org/"), F.lower("r_name")).alias("repo"), F.lit("main").alias("revision"), F.when(F.col("r_regionkey") == 0, "dataset").otherwise("model").alias("type"), F.concat(F.lit("assets/"), F.col("r_regionkey").cast("string")).alias("path"))
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("position"), F.col("r_name").alias("name"))
    return assets.asset_table(manifest, names)


@query("SELECT 'parser/' || r_regionkey || '.txt' AS file, r_name AS text FROM region")
def safe_unpack(spark: SparkSession, d: str) -> DataFrame:
    """An archive packed and unpacked on the driver, files beside the prefix
    left out."""
    rows = table(spark, d, "region").select("r_regionkey", "r_name").collect()  # a lookup table
    with tempfile.TemporaryDirectory() as folder:
        with zipfile.ZipFile(f"{folder}/a.zip", "w") as z:
            for key, name in rows:
                z.writestr(f"top/parser/{key}.txt", name)
                z.writestr(f"other/{key}.txt", name)
        found = assets.unpack(f"{folder}/a.zip", f"{folder}/out", "top/")
        out = []
        for path in found:
            with open(path, encoding="utf-8") as f:
                out.append((os.path.relpath(path, os.path.realpath(f"{folder}/out")), f.read()))
    return spark.createDataFrame(out, "file string, text string")


@query("SELECT item_id, text FROM benchmark UNION ALL SELECT -1, NULL")
def sink_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with nulls written out."""
    path = new_folder(spark, "lines")
    rows = _items(spark, d).unionByName(spark.createDataFrame([(-1, None)], _ITEM))
    json_files.write_lines(rows, path)
    whole = spark.read.text(path).where(F.col("value").contains('"text":'))
    return whole.select(F.from_json("value", _ITEM).alias("r")).select("r.*")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM documents) AS BIGINT) AS total FROM documents GROUP BY lang")
def sink_report(spark: SparkSession, d: str) -> DataFrame:
    """A report as one JSON object, read again."""
    path = new_folder(spark, "report")
    by = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    json_files.write_report(by.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("languages")), path)
    report = json_files.read_config(spark, path, "total long, languages map<string, long>")
    return report.select("total", F.explode("languages").alias("lang", "n"))


@query("SELECT item_id, text FROM benchmark")
def merged_parts(spark: SparkSession, d: str) -> DataFrame:
    """Three writers' parts, merged, then removed."""
    parts = [new_folder(spark, f"part{k}") for k in range(3)]
    for k, path in enumerate(parts):
        json_files.write_lines(_items(spark, d).where(F.pmod("item_id", F.lit(3)) == k), path)
    return json_files.merge_parts(spark, parts, _ITEM, new_folder(spark, "merged"))


@query("SELECT doc_id AS record_index, lang FROM documents WHERE doc_id IN (0, 7, (SELECT max(doc_id) FROM documents))")
def record_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Records from their own shards; a negative index counts from the end."""
    path, docs = new_folder(spark, "shards"), table(spark, d, "documents").select(F.col("doc_id").alias("record_index"), "lang")
    shard_store.write_store(docs, path, size=100)
    return shard_store.read_at(spark, path, 0, 7, -1)


_LENGTHS = "list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))"


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n, CAST(list_sum(t) AS BIGINT) AS total, sha256(array_to_string(t, ',')) AS ids_sha256 FROM (SELECT doc_id, {_LENGTHS} AS t FROM documents)")
def packed_decode(spark: SparkSession, d: str) -> DataFrame:
    """Sequences packed by shards of eight records, values and offsets, and cut
    out of them again."""
    rows = table(spark, d, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("t"))
    packed = L.packed(rows, "doc_id", "t", 8)
    out = L.unpacked(packed).select(F.col("record_index").alias("doc_id"), "t")
    return out.select("doc_id", F.size("t").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.sha2(F.array_join(F.col("t").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))


@query("SELECT CAST(start AS BIGINT) AS start, CAST(least(start + 50, n) AS BIGINT) AS end_ FROM (SELECT max(doc_id) + 1 AS n FROM documents), LATERAL (SELECT unnest(generate_series(0, n - 1, 50)) AS start) WHERE (start // 50) % 3 = 1")
def missing_shards(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of a store of which every third is missing."""
    n = table(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0]
    there = spark.range(0, n, 50).select(F.col("id").alias("start"), F.least(F.col("id") + 50, F.lit(n)).alias("end")).where("floor(start / 50) % 3 <> 1")
    return json_files.missing_ranges(spark, there, n, 50).withColumnRenamed("end", "end_")


@query("SELECT shard, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) = least(64, (SELECT max(doc_id) + 1 FROM documents) - shard * 64) AS complete FROM (SELECT doc_id // 64 AS shard FROM documents WHERE doc_id % 200 <> 7) GROUP BY shard")
def shard_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Shards of a store against its manifest's number of records and size."""
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.agg(F.max("doc_id") + 1).first()[0]
    return stores.complete_shards(docs.where("doc_id % 200 <> 7"), "doc_id", n, 64)


@query("SELECT l_orderkey AS step, round(avg(l_discount), 6) AS loss FROM lineitem GROUP BY l_orderkey")
def loss_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of losses, appended in two goes."""
    path = new_folder(spark, "losses")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(F.round(F.avg("l_discount"), 6).alias("loss"))
    for k in range(2):
        json_files.append_lines(rows.where(F.pmod("step", F.lit(2)) == k), path)
    return json_files.read_strict(spark, path, "step long, loss double")


@query("SELECT 'shard_size' AS setting, '1000' AS \"left\", '100' AS \"right\" UNION ALL SELECT 'use', '\"semantic\"', NULL UNION ALL SELECT 'num_records', CAST((SELECT count(*) FROM documents) AS VARCHAR), CAST((SELECT count(*) FROM labels) AS VARCHAR)")
def cache_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Two stores' manifests, and where they differ."""
    counts = [table(spark, d, name).count() for name in ("documents", "labels")]
    left = json_files.manifest(spark, {"version": 5, "num_records": counts[0], "compression_rate": 8, "use": "semantic", "shard_size": 1000})
    right = json_files.manifest(spark, {"version": 5, "num_records": counts[1], "compression_rate": 8, "shard_size": 100})
    return json_files.differing(left, right)


@query("SELECT d.doc_id, max(l.doc_id) AS start FROM documents d LEFT JOIN labels l ON l.doc_id <= d.doc_id GROUP BY d.doc_id")
def shard_locate(spark: SparkSession, d: str) -> DataFrame:
    """The shard of each record, shards beginning at labelled ones."""
    return intervals.located(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id", "start")


_FAULT = "CASE doc_id % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'shapes' WHEN 3 THEN 'no_mass' WHEN 4 THEN 'not_finite' WHEN 5 THEN 'frontiers' END"


@query(f"SELECT doc_id AS record_index, CAST(n AS INT) AS length, CAST(len(ends) AS INT) AS chunks, {_FAULT} AS fault FROM ({_EDGES_SQL})")
def two_store_pair(spark: SparkSession, d: str) -> DataFrame:
    """A cache beside its labels, both made from documents, some records of
    which are spoilt in one way each."""
    k = F.col("doc_id") % 7
    rows = _edges(spark, d)
    ids = F.transform("t", lambda w: F.length(w))
    cache = rows.select(F.col("doc_id").alias("record_index"), F.when(k == 5, F.concat(ids, F.array(F.lit(0)))).otherwise(ids).alias("explicit_ids"), F.col("ends").alias("frontier_ends"))
    p = F.when(k == 3, F.array(F.lit(0.0), F.lit(0.0))).when(k == 4, F.array(F.lit(float("inf")), F.lit(0.5))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    latents = F.when(k == 2, F.size("ends") + 1).otherwise(F.size("ends"))
    labels = rows.where(k != 1).select(F.col("doc_id").alias("record_index"), F.array_repeat(p, latents).alias("probs"), F.array_repeat(F.array(F.lit(1), F.lit(2)), latents).alias("token_ids"))
    found = stores.paired(cache, labels)
    length = F.when(F.col("fault") == "frontiers", F.col("length") - 1).otherwise(F.col("length"))
    return found.select("record_index", length.alias("length"), F.size("frontier_ends").alias("chunks"), "fault")


@query(f"""
SELECT e.doc_id, l.doc_id IS NOT NULL AS overlaid, CAST(CASE WHEN l.doc_id IS NULL THEN len(ends) ELSE quality + 2 END AS INT) AS latents,
  array_to_string(CASE WHEN l.doc_id IS NULL THEN ends ELSE list_transform(generate_series(1, quality + 2), lambda i: CAST(ceil(n * i / (quality + 2)) AS INT)) END, ',') AS frontiers FROM ({_EDGES_SQL}) e LEFT JOIN labels l USING (doc_id)
""")
def overlay_store(spark: SparkSession, d: str) -> DataFrame:
    """Records whose latents a trace replaces, at even frontiers; the others
    stay as they are."""
    base = _edges(spark, d).select("doc_id", F.col("n").alias("length"), F.transform("ends", lambda e: e.cast("double")).alias("latents"), F.col("ends").alias("frontier_ends"))
    traces = table(spark, d, "labels").select("doc_id", F.array_repeat(F.lit(0.5), F.col("quality") + 2).alias("latents"))
    out = stores.overlaid(base, traces, "doc_id")
    return out.select("doc_id", "overlaid", F.size("latents").alias("latents"), F.array_join(F.col("frontier_ends").cast("array<string>"), ",").alias("frontiers"))


@query("SELECT item_id FROM benchmark WHERE item_id % 2 = 1 AND item_id % 4 <> 1")
def strided_pending(spark: SparkSession, d: str) -> DataFrame:
    """What the second of two workers has still to do."""
    requests = _items(spark, d).select("item_id")
    return resume.pending(requests, requests.where("item_id % 4 = 1"), "item_id", rank=1, world=2)


@query("SELECT item_id, 'run' AS evaluation_id FROM benchmark")
def run_identity(spark: SparkSession, d: str) -> DataFrame:
    """A log that takes rows of one run only; twice the same rows collapse."""
    folder, rows = new_folder(spark, "run"), _items(spark, d).select("item_id", F.lit("run").alias("evaluation_id"))
    for k in range(2):
        json_files.write_lines(rows, f"{folder}/in/{k}")
    resume.ingest(spark, f"{folder}/in/*", "item_id long, evaluation_id string", f"{folder}/log", f"{folder}/state", signature="run")
    return resume.completed(spark.read.parquet(f"{folder}/log").drop("batch"), "item_id")


@query("SELECT CAST(o_custkey % 8 AS BIGINT) AS batch, o_orderkey AS record_index, o_orderstatus AS status, CAST(row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1 AS INT) AS place FROM orders")
def batches_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Results that came back by batch, put in order and taken apart."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("batch"), F.floor(F.col("o_orderkey") / 64).alias("part"), F.struct("o_orderkey", "o_orderstatus").alias("r"))
    parts = rows.groupBy("batch", "part").agg(F.array_sort(F.collect_list("r")).alias("results"), F.count("*").alias("n"))
    return L.flattened(parts, "batch", "part", "results").select("batch", F.col("r.o_orderkey").alias("record_index"), F.col("r.o_orderstatus").alias("status"), "place")


@query("SELECT seq, count(DISTINCT n) = 1 AS agree, CAST(max(n) AS INT) AS width FROM (SELECT vec_id % 16 AS seq, CASE WHEN vec_id % 160 = 3 THEN len(embedding) - 1 ELSE len(embedding) END AS n FROM embeddings) GROUP BY seq")
def vector_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rows of a matrix agree on their width; one matrix has rows
    that are short."""
    v = F.when(F.col("vec_id") % 160 == 3, F.slice("embedding", F.lit(1), F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return stores.shapes(table(spark, d, "embeddings").select((F.col("vec_id") % 16).alias("seq"), v.alias("v")), "seq", "v")
