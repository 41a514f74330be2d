"""The driver's tables as the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollouts, each a vote of its user; an error is no vote."""
    vote = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    label = F.when(F.col("event_type").isin("click", "purchase"), "Response A").when(F.col("event_type").isin("view", "signup"), "Response B")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("eval_index"), vote.alias("vote_index"), label.alias("prediction"), F.col("value").alias("generation_seconds"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


#: The same in SQL, for oracles.
ROLLOUTS_SQL = """
SELECT user_id AS eval_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vote_index,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'Response A' WHEN event_type IN ('view', 'signup') THEN 'Response B' END AS prediction,
  value AS generation_seconds, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged pairs."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source_index"), F.col("l_linenumber").alias("pair_index"), F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("difficulty"),
        (F.col("l_discount") > 0.05).alias("correct"), (F.col("l_linenumber") % 2 == 1).alias("exchange"))


RESULTS_SQL = "SELECT l_orderkey AS source_index, l_linenumber AS pair_index, l_returnflag AS domain, l_linestatus AS difficulty, l_discount > 0.05 AS correct, l_linenumber % 2 = 1 AS exchange FROM lineitem"
