"""Majority votes of repeated judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_vote(rollouts: DataFrame) -> DataFrame:
    """(eval_index, prediction, vote_num, vote_valid_count, n_a, n_b, vote_tied,
    vote_selected_index, generation_seconds): invalid (null) predictions don't
    vote; of tied labels the one voted for first wins; without a valid vote the
    first rollout is selected.  One aggregation, combined before the shuffle."""
    count = lambda label: F.count_if(F.col("prediction") == label)
    first = lambda label: F.min(F.when(F.col("prediction") == label, F.col("vote_index")))
    votes = rollouts.groupBy("eval_index").agg(
        F.count("*").alias("vote_num"), F.count("prediction").alias("vote_valid_count"), count("Response A").alias("n_a"), count("Response B").alias("n_b"),
        first("Response A").alias("_a"), first("Response B").alias("_b"), F.min("vote_index").alias("_first"), F.max("generation_seconds").alias("generation_seconds"))
    a_wins = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("_a") < F.col("_b")))
    none = F.col("vote_valid_count") == 0
    return votes.select(
        "eval_index", F.when(none, None).when(a_wins, "Response A").otherwise("Response B").alias("prediction"), "vote_num", "vote_valid_count", "n_a", "n_b",
        ((F.col("n_a") == F.col("n_b")) & ~none).alias("vote_tied"), F.when(none, F.col("_first")).when(a_wins, F.col("_a")).otherwise(F.col("_b")).cast("long").alias("vote_selected_index"), "generation_seconds")
