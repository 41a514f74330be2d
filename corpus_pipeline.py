"""A training corpus from ``documents``, in stages that are written and reread.

Toxic documents go; of equal texts the row with the largest doc_id stays; of
near copies (Jaccard of five-word shingles 0.75 or more) the smallest; documents
contaminated by ``benchmark`` go; what is left is mixed by source weights.

Results for odd inputs: null texts count as empty and aren't toxic, copies of
anything but each other, or contaminated; rows are told apart by row numbers, so
that ids may repeat or be null; with one id, the first row as stored counts as
the smaller one; repeated rows are exact copies; an empty table gives an empty
table; other columns stay until the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from judgeloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, toxicity
from judgeloom.sources.folders import new_folder, remove, scratch
from judgeloom.sources.stages import Graph, Stage, identity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, lexicon)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources)]

#: The first and third stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet and read again."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        before, written = written, new_folder(spark, "pipeline")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)


def graph(spark: SparkSession, sf_dir: str, folder: str) -> Graph:
    """The stages over a folder that keeps their results: stages that are done
    are skipped, and a run that was killed goes on where it stopped.  Other
    tables, or a stage beyond them, need new results."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("documents", "labels", "benchmark")]

    def made(stage):  # noqa: ANN001, ANN202
        return lambda spark, docs: stage(spark, docs, sf_dir)

    stages = [Stage("documents", lambda spark: spark.read.parquet(paths[0]), inputs=[x for p in paths for x in identity(spark, p)])]
    for name, stage in STAGES:
        stages.append(Stage(name.replace(" ", "-"), made(stage), [stages[-1].name]))
    return Graph(spark, folder, stages)
