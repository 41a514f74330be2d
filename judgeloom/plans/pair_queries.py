"""Pairs from chosen and rejected responses, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks
from ..sources.tables import table
from .registry import query


@query("SELECT doc_id, quality, false AS exchange, CASE WHEN quality = 1 THEN 'response_a' ELSE 'response_b' END AS label FROM labels UNION ALL SELECT doc_id, quality, true, CASE WHEN quality = 1 THEN 'response_b' ELSE 'response_a' END FROM labels")
def bidirectional_union(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, then all with their responses exchanged; one scan."""
    rows = table(spark, d, "labels").select("doc_id", "quality", F.explode(F.array(F.lit(False), F.lit(True))).alias("exchange"))
    return rows.select("doc_id", "quality", "exchange", F.when((F.col("quality") == 1) != F.col("exchange"), "response_a").otherwise("response_b").alias("label"))


#: Documents of one record: those of a range of sixteen ids.
_RECORD = 16


@query(f"""WITH g AS (SELECT doc_id // {_RECORD} AS record, list(doc_id ORDER BY doc_id) FILTER (quality = 1) AS c, list(doc_id ORDER BY doc_id) FILTER (quality = 0) AS r FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT record, CAST(i - 1 AS INT) AS chosen_index, CAST(j - 1 AS INT) AS rejected_index, c[i] AS chosen, r[j] AS rejected FROM g, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS j)""")
def pair_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen with every rejected response of a record, which has few."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").withColumn("record", F.floor(F.col("doc_id") / _RECORD))
    of = lambda q: F.array_sort(F.collect_list(F.when(F.col("quality") == q, F.col("doc_id"))))
    by = rows.groupBy("record").agg(of(1).alias("c"), of(0).alias("r"))
    pairs = by.select("record", "r", F.posexplode("c").alias("chosen_index", "chosen"))
    return pairs.select("record", "chosen_index", "chosen", F.posexplode("r").alias("rejected_index", "rejected"))


@query("SELECT p_partkey, CAST(i AS INT) AS chosen_style, CAST(j AS INT) AS rejected_style, CASE WHEN i < j THEN 'hard' WHEN i = j THEN 'normal' ELSE 'easy' END AS difficulty FROM part, range(3) a(i), range(3) b(j)")
def style_grid(spark: SparkSession, d: str) -> DataFrame:
    styles = F.sequence(F.lit(0), F.lit(2))
    rows = table(spark, d, "part").select("p_partkey", F.explode(styles).alias("chosen_style")).select("*", F.explode(styles).alias("rejected_style"))
    return rows.withColumn("difficulty", T.difficulty_by_styles(F.col("chosen_style"), F.col("rejected_style")))


@query("SELECT vec_id, l AS left_index, r AS right_index, round(CAST(embedding[l + 1] AS DOUBLE), 6) AS a, round(CAST(embedding[r + 1] AS DOUBLE), 6) AS b FROM (SELECT vec_id, embedding, CAST(label % 8 AS INT) AS l, CAST(label % 5 + 8 AS INT) AS r FROM embeddings) WHERE embedding[l + 1] <> embedding[r + 1]")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.inline(F.array(F.struct((F.col("label") % 8).cast("int").alias("left_index"), (F.col("label") % 5 + 8).cast("int").alias("right_index")))))
    a, b = F.get("embedding", F.col("left_index")), F.get("embedding", F.col("right_index"))
    return rows.where(a != b).select("vec_id", "left_index", "right_index", F.round(a.cast("double"), 6).alias("a"), F.round(b.cast("double"), 6).alias("b"))


@query("SELECT CAST(count(*) FILTER (quality = 1) AS BIGINT) AS wins, CAST(count(*) FILTER (quality = toxic) AS BIGINT) AS ties FROM labels")
def tie_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("wins"), F.count_if(F.col("quality") == F.col("toxic")).alias("ties"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS source_index FROM documents WHERE length(text) > 200")
def valid_dense_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.length("text") > 200).select("source", "doc_id")
    return blocks.running(rows, "source", "doc_id", F.lit(1), "source_index").select("doc_id", F.col("source_index").cast("int").alias("source_index"))


@query("SELECT lang, CAST(count(*) FILTER (length(trim(text)) > 0) AS BIGINT) AS valid, CAST(count(*) FILTER (NOT coalesce(length(trim(text)) > 0, false)) AS BIGINT) AS skipped FROM documents GROUP BY lang")
def valid_records(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.length(T.strip(F.col("text"))) > 0, F.lit(False))
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"))


@query("SELECT item_id, b.text AS instruction, CAST(n AS BIGINT) AS pairs FROM (SELECT doc_id % 20 AS item_id, count(*) AS n FROM documents GROUP BY 1) JOIN benchmark b USING (item_id)")
def rubric_join(spark: SparkSession, d: str) -> DataFrame:
    """One rubric a request.  The rubric table isn't broadcast by hand: its
    size decides."""
    pairs = table(spark, d, "documents").groupBy((F.col("doc_id") % 20).alias("item_id")).agg(F.count("*").alias("pairs"))
    return pairs.join(table(spark, d, "benchmark").withColumnRenamed("text", "instruction"), "item_id").select("item_id", "instruction", "pairs")


@query("SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def render_context(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    shown = F.transform(turns, lambda t: F.concat(F.initcap(t["role"]), F.lit(":\n"), t["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(shown, "\n\n").alias("context"))


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS present, count(*) = count(DISTINCT doc_id) AS distinct_cells FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def grid_completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("present"), (F.count("*") == F.count_distinct("doc_id")).alias("distinct_cells"))
