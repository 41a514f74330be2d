"""The benchmarks by name: what reads them, what scores them, their subsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from . import benchmarks as B

# Names, and the subsets that count by default.
BENCHMARKS = ("rewardbench", "rewardbench2", "ppe-ifeval", "ifbench", "rm-bench", "helpsteer3")
DEFAULT_SUBSETS = {
    "rewardbench": tuple(M.SECTIONS["Chat"]) + tuple(M.SECTIONS["Chat Hard"]),
    "rewardbench2": ("Precise IF", "Focus"),
    "rm-bench": ("rm-bench-chat",),
}

BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "rewardbench": B.chosen_rejected,
    "rewardbench2": B.grouped_prompts,
    "ppe-ifeval": B.conflict_pairs,
    "ifbench": B.constraint_pairs,
    "rm-bench": B.style_pairs,
    "helpsteer3": B.preference_pairs,
}


def builder(name: str) -> Callable[..., DataFrame]:
    if name not in BUILDERS:
        raise KeyError(f"Unknown benchmark: {name}")
    return BUILDERS[name]


def _micro(rows: DataFrame) -> DataFrame:
    return rows.agg(M.accuracy().alias("score")).select(F.lit("Score").alias("name"), "score")


def _styles(rows: DataFrame) -> DataFrame:
    return M.macro_of_macro(rows, "domain", "difficulty").where("domain = 'Score'").select(F.col("domain").alias("name"), "score")


#: Benchmarks with a score of their own; others are summed up by the general one.
SUMMARIES: dict[str, Callable[[DataFrame], DataFrame]] = {"rm-bench": _styles, "helpsteer3": _micro, "ppe-ifeval": _micro, "ifbench": _micro}


def summarise(name: str, results: DataFrame) -> DataFrame:
    """(name, score) of a benchmark's headline."""
    if name not in SUMMARIES:
        raise KeyError(f"No summary for {name}")
    return SUMMARIES[name](results)


def defaults(spark: SparkSession) -> DataFrame:
    """(benchmark, subset, place); a benchmark of which all subsets count has one
    row without a subset."""
    rows = [(b, s, k) for b in BENCHMARKS for k, s in (list(enumerate(DEFAULT_SUBSETS[b])) if b in DEFAULT_SUBSETS else [(None, None)])]
    return spark.createDataFrame(rows, "benchmark string, subset string, place int")


def counted(rows: DataFrame, benchmark: str = "benchmark", subset: str = "subset") -> DataFrame:
    """(benchmark, subset, place, n): rows of each subset that counts; where all
    do, the benchmark's."""
    listed = F.col(benchmark).isin(*DEFAULT_SUBSETS)
    found = rows.groupBy(F.col(benchmark).alias("_b"), F.when(listed, F.col(subset)).alias("_s")).agg(F.count("*").alias("n"))
    names = defaults(rows.sparkSession)
    both = names.join(found, (F.col("benchmark") == F.col("_b")) & F.col("subset").eqNullSafe(F.col("_s")), "left")
    return both.select("benchmark", "subset", "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
