"""Array kernels over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import blocks, kernels
from ..operators.traces import spread
from ..sources.tables import table
from .registry import query


@query("SELECT doc_id, array_to_string(CASE WHEN len(t) <= 16 THEN t ELSE t[1:8] || t[-8:] END, ' ') AS kept FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)")
def head_tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(A.head_tail(F.split(F.col("text"), " "), 16), " ").alias("kept"))


@query("SELECT doc_id, CAST(i AS INT) AS part, CAST(round_even(i * n / c, 0) - round_even((i - 1) * n / c, 0) AS INT) AS size FROM (SELECT doc_id, length(text) AS n, doc_id % 7 + 2 AS c FROM documents), LATERAL (SELECT unnest(generate_series(1, c)) AS i)")
def balanced_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(A.balanced_sizes(F.length("text"), (F.col("doc_id") % 7 + 2).cast("int"))).alias("part", "size"))
    return rows.withColumn("part", F.col("part") + 1)


@query("SELECT doc_id, CAST(ceil(n / 8) AS INT) AS budget, CAST(ceil(n / 16) AS INT) AS least, CAST(greatest(1, n // 4) AS INT) AS most FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def latent_budget(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.split(F.col("text"), " "))
    return table(spark, d, "documents").select("doc_id", F.ceil(n / 8).cast("int").alias("budget"), F.ceil(n / 16).cast("int").alias("least"), F.greatest(F.lit(1), F.floor(n / 4).cast("int")).alias("most"))


@query("SELECT doc_id, CAST(v AS INT) AS view, CAST(greatest(1, least(c, ceil(c * (v + 1) / 4.0))) AS INT) AS frontier FROM (SELECT doc_id, CAST(doc_id % 11 + 1 AS INT) AS c FROM documents), range(4) t(v)")
def quantile_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 11 + 1).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("view"))
    return rows.select("doc_id", "view", A.quantile_frontier(F.col("c"), F.col("view"), 4).alias("frontier"))


@query("""WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i)), r AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e)
SELECT vec_id, CAST(k - 1 AS INT) AS rank, CAST(i - 1 AS INT) AS index, round(exp(v - max(v) OVER w) / sum(exp(v - m)) OVER w, 6) AS p FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM r WHERE k <= 5) WINDOW w AS (PARTITION BY vec_id)""")
def topk_softmax(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "embeddings").select("vec_id", A.top_k(F.col("embedding").cast("array<double>"), 5).alias("top"))
    rows = top.select("vec_id", F.posexplode(F.arrays_zip(F.col("top.index").alias("index"), A.softmax(F.col("top.value")).alias("p"))).alias("rank", "x"))
    return rows.select("vec_id", "rank", F.col("x.index").alias("index"), F.round("x.p", 6).alias("p"))


@query("SELECT source, doc_id, CAST(n AS BIGINT) AS size, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM (SELECT source, doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def pack_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.size(F.split(F.col("text"), " ")).cast("long").alias("size"))
    return blocks.running(rows, "source", "doc_id", F.col("size"), "offset_")


_PADDED = 8


@query(f"""
WITH t AS (SELECT doc_id, doc_id // {_PADDED} AS batch, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS t FROM documents), m AS (SELECT batch, CAST(ceil(max(len(t)) / 8.0) * 8 AS INT) AS width FROM t GROUP BY batch)
SELECT doc_id, width, sha256(array_to_string(t || list_transform(range(width - len(t)), lambda i: 0), ',')) AS ids_sha256, sha256(array_to_string(list_transform(range(width), lambda i: CASE WHEN i < len(t) THEN 1 ELSE 0 END), ',')) AS mask_sha256,
  sha256(array_to_string(list_transform(range(width), lambda i: CASE WHEN i < len(t) THEN i ELSE 0 END), ',')) AS positions_sha256 FROM t JOIN m USING (batch)
""")
def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight ids, each padded to a multiple of eight: ids, attention
    mask and positions."""
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / _PADDED).alias("batch"), F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("t"))
    widest = rows.groupBy("batch").agg((F.ceil(F.max(F.size("t")) / 8) * 8).cast("int").alias("width"))
    rows = rows.join(widest, "batch")
    zero, n = F.lit(0), F.size("t")
    mask = A.pad_right(F.array_repeat(F.lit(1), n), F.col("width"), zero)
    places = A.pad_right(F.transform("t", lambda x, i: i), F.col("width"), zero)
    digest = lambda a: F.sha2(F.array_join(a.cast("array<string>"), ",").cast("binary"), 256)
    return rows.select("doc_id", "width", digest(A.pad_right(F.col("t"), F.col("width"), zero)).alias("ids_sha256"), digest(mask).alias("mask_sha256"), digest(places).alias("positions_sha256"))


@query("SELECT doc_id, array_to_string([x for x, i in t if i % 3 <> 0], ' ') AS kept FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)")
def compact_slots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(F.split(F.col("text"), " "), lambda x, i: (i + 1) % 3 != 0), " ").alias("kept"))


@query()
def allocated_budget(spark: SparkSession, d: str) -> DataFrame:
    """Chunk counts of a document's thirds; null where one has under four words."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    third = F.floor(n / 3).cast("int")
    rows = table(spark, d, "documents").select("doc_id", F.array(third, third, n - 2 * third).alias("lengths"))
    return spread(rows).mapInPandas(kernels.allocate_rows, "doc_id long, counts array<int>")


@query()
def lcs_rouge(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequence of a document's first and second half."""
    t = F.split("text", " ")
    half = F.greatest(F.lit(1), F.floor(F.size(t) / 2).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.slice(t, F.lit(1), half).alias("a"), F.slice(t, half + 1, F.size(t)).alias("b"))
    return spread(rows).mapInPandas(kernels.lcs_rows, "doc_id long, lcs int, rouge double")
