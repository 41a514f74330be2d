"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .registry import query

_W = "CASE doc_id % 6 WHEN 0 THEN ' Model-A ' WHEN 1 THEN 'Response_B' WHEN 2 THEN 'x: a' WHEN 3 THEN 'tie' WHEN 4 THEN 'response b over response a' ELSE 'b' END"


@query(f"SELECT doc_id, CASE WHEN w IN ('a', 'model a', 'response a') THEN 'response_a' WHEN w IN ('b', 'model b', 'response b') THEN 'response_b' WHEN contains(w, 'response a') OR ends_with(w, ': a') THEN 'response_a' WHEN contains(w, 'response b') OR ends_with(w, ': b') THEN 'response_b' END AS winner FROM (SELECT doc_id, trim(replace(replace(lower({_W}), '-', ' '), '_', ' ')) AS w FROM documents)")
def normalize_winner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalise_winner(F.expr(_W)).alias("winner"))


@query("SELECT event_id, CASE trim(l) WHEN 'Response A' THEN 'Response A' WHEN 'Response B' THEN 'Response B' END AS label FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ' Response A ' WHEN 'view' THEN 'Response B' ELSE event_type END AS l FROM events)")
def parse_label(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_type") == "click", " Response A ").when(F.col("event_type") == "view", "Response B").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.parse_label(text).alias("label"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source) AS value FROM documents")
def coalesce_truthy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truthy(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("value"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'code' WHEN 2 THEN 'safety' END AS domain FROM documents")
def normalize_domain(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("Chat-easy"), F.lit("CODE"), F.lit("safety-refuse"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.normalise_domain(raw).alias("domain"))


@query("SELECT event_id, CASE WHEN k = 1 THEN 'hard' WHEN k = 2 THEN 'normal' WHEN k >= 3 THEN 'simple' END AS difficulty FROM (SELECT event_id, user_id % 5 AS k FROM events)")
def difficulty_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.difficulty_by_violations(F.col("user_id") % 5).alias("difficulty"))


@query("SELECT item_id, '1. ' || rtrim(text, '.') || chr(10) || '2. Be brief' AS rubric FROM benchmark")
def render_rubric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.render_rubric(F.array("text", F.lit("Be brief."))).alias("rubric"))


@query("SELECT doc_id, 'Judge.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || source || chr(10) || chr(10) || '### Response A:' || chr(10) || text AS prompt FROM documents")
def judge_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.judge_prompt("Judge.", ("Instruction", F.col("source")), ("Response A", F.col("text"))).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'B' WHEN doc_id % 3 = 1 THEN 'A' END AS judgment FROM documents")
def final_judgment(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, "\nFinal Judgment: Response A\nFinal judgment: Response B").when(F.col("doc_id") % 3 == 1, "\nFinal Judgment: a").otherwise("")
    return table(spark, d, "documents").select("doc_id", T.final_judgment(F.concat("text", tail)).alias("judgment"))


@query("SELECT doc_id, sha256(trim(text || chr(10) || 'Winner: Response ' || CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END)) AS record, CASE WHEN doc_id % 2 = 0 THEN 'Response A' ELSE 'Response B' END AS label FROM documents WHERE len(regexp_extract_all(trim(text), '(?m)^Winner:[ \\t]*(Response [AB])[ \\t]*$')) = 0")
def winner_extract(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B")
    rows = table(spark, d, "documents").select("doc_id", T.strip(F.concat("text", F.lit("\nWinner: Response "), side)).alias("record"))
    found = F.regexp_extract_all("record", F.lit(r"(?m)(?d)^Winner:[ \t]*(Response [AB])[ \t]*$"), F.lit(1))
    return rows.where(F.size(found) == 1).select("doc_id", F.sha2(F.col("record").cast("binary"), 256).alias("record"), F.get(found, F.lit(0)).alias("label"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS signature FROM documents")
def signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")).cast("binary"), 256).alias("signature"))


@query("""SELECT doc_id, CAST(n AS INT) AS bucket, CASE WHEN n < 800 THEN 'train' WHEN n < 900 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id,
CAST(CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) % 1000 AS INT) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents))""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """The first eight digest bytes, little-endian, modulo 1000."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    number = F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, 10).cast("decimal(20,0)")
    rows = table(spark, d, "documents").select("doc_id", (number % 1000).cast("int").alias("bucket"))
    return rows.withColumn("split", F.when(F.col("bucket") < 800, "train").when(F.col("bucket") < 900, "validation").otherwise("test"))


@query("SELECT event_id, CAST(p[1] AS INT) AS a, CAST(p[2] AS INT) AS b FROM (SELECT event_id, [user_id % 7, user_id % 5] AS p FROM events)")
def parse_list_like(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from a string such as "(1, 2)"."""
    text = F.format_string("(%d, %d)", F.col("user_id") % 7, F.col("user_id") % 5)
    pair = F.from_json(F.translate(text, "()", "[]"), "array<int>")
    return table(spark, d, "events").select("event_id", F.get(pair, F.lit(0)).alias("a"), F.get(pair, F.lit(1)).alias("b"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'met' WHEN 'view' THEN 'not_met' WHEN 'signup' THEN 'partial' END AS status FROM events")
def normalize_status(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "click", " MET").when(F.col("event_type") == "view", "Not  met").when(F.col("event_type") == "signup", "not fully  Met").otherwise("?")
    return table(spark, d, "events").select("event_id", T.normalise_status(raw).alias("status"))
