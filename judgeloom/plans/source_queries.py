"""Benchmark formats, layouts and logs, on projections of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..sources import benchmarks as B
from ..sources.folders import new_folder
from ..sources.tables import table
from ..streaming import resume
from .registry import query


def _styles(name: str):
    return F.array(*[F.concat(F.lit(f"{name}{k} "), F.col("text")) for k in range(B.STYLES)])


@query("""
SELECT item_id * 9 + c * 3 + r AS dataset_index, 'rm-bench-' || d AS subset, CASE WHEN c < r THEN 'hard' WHEN c = r THEN 'normal' ELSE 'easy' END AS difficulty, x AS exchange,
  CASE WHEN x THEN 'r' || r ELSE 'c' || c END || ' ' || text AS response_a, CASE WHEN x THEN 'c' || c ELSE 'r' || r END || ' ' || text AS response_b, CASE WHEN x THEN 'response_b' ELSE 'response_a' END AS label
FROM (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN 'chat' ELSE 'safety' END AS d FROM benchmark), range(3) a(c), range(3) b(r), (VALUES (false), (true)) t(x)
""")
def style_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").alias(B.SOURCE), F.col("item_id").alias("id"), F.lit("a prompt").alias("prompt"), F.when(F.col("item_id") % 2 == 0, "Chat").otherwise("safety-refuse").alias("domain"),
        _styles("c").alias("chosen"), _styles("r").alias("rejected"))
    return B.both_directions(B.style_pairs(rows)).select("dataset_index", "subset", "difficulty", "exchange", "response_a", "response_b", "label")


@query("""
SELECT row_number() OVER (ORDER BY item_id, p) - 1 AS dataset_index, CAST(item_id AS VARCHAR) AS question_id, CAST(p AS INT) AS pair_index, 'unknown' AS model_name, text || '-1' AS response_a,
  text || CASE WHEN p = 0 THEN '-2' ELSE '-3' END AS response_b, CASE WHEN item_id % 2 = 0 THEN 'response_a' ELSE 'response_b' END AS label
FROM benchmark, range(2) t(p)
""")
def sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("item_id") % 2 == 0
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").alias(B.SOURCE), F.col("item_id").alias("question_id"), F.lit("").alias("model_name"), F.lit("a prompt").alias("prompt"), F.when(even, "[True, False, False]").otherwise("[False, True, True]").alias("scores"),
        F.lit("[(0, 1), (0, 2,)]").alias("sampled_conflict_pairs"), *[F.concat("text", F.lit(f"-{k}")).alias(f"response_{k}") for k in (1, 2, 3)])
    return B.conflict_pairs(rows, 3).select("dataset_index", "question_id", "pair_index", "model_name", "response_a", "response_b", "label")


@query("SELECT item_id, text FROM benchmark")
def resume_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table as a JSON log, read by a stream that is started twice."""
    folder = new_folder(spark, "resume")
    rows = table(spark, d, "benchmark").select("item_id", "text")
    rows.write.option("ignoreNullFields", "false").json(f"{folder}/in")
    for _ in range(2):
        resume.ingest(spark, f"{folder}/in", "item_id long, text string", f"{folder}/log", f"{folder}/state")
    return resume.completed(spark.read.parquet(f"{folder}/log").drop("batch"), "item_id")


@query("""
SELECT user_id, epoch_us(first) - epoch_us(queued) AS ttft_us, epoch_us(finish) - epoch_us(first) AS decode_us, epoch_us(finish) - epoch_us(queued) AS e2e_us
FROM (SELECT user_id, min(ts) AS queued, min(CASE WHEN event_type = 'click' THEN ts END) AS first, max(ts) AS finish FROM events GROUP BY user_id)
""")
def latency_derivation(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    times = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("queued"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("first"), F.max("ts").alias("finish"))
    return times.select("user_id", (us("first") - us("queued")).alias("ttft_us"), (us("finish") - us("first")).alias("decode_us"), (us("finish") - us("queued")).alias("e2e_us"))


_IDS = "list_transform(string_split(text, ' '), lambda w: length(w))"


@query(f"""
SELECT doc_id, sha256(array_to_string(p || [-1] || list_transform(range(n), lambda i: -100) || [-2] || a, ',')) AS input_sha256,
  sha256(array_to_string(list_transform(range(len(p) + 1 + n), lambda i: -100) || [-2] || a, ',')) AS labels_sha256, CAST(len(p) + 1 AS INT) AS latent_start, CAST(len(p) + 1 + n AS INT) AS latent_end
FROM (SELECT doc_id, n, t[1:greatest(len(t) - 4, 0)] AS p, t[greatest(len(t) - 4, 0) + 1:] AS a FROM (SELECT doc_id, {_IDS} AS t, CAST(doc_id % 5 AS INT) AS n FROM documents))
""")
def teacher_forced_layout(spark: SparkSession, d: str) -> DataFrame:
    """Prefix, left marker, latent span, right marker and answer (the last four
    words); labels only from the right marker on."""
    t = F.transform(F.split(F.col("text"), " "), lambda w: F.length(w))
    cut = F.greatest(F.size(t) - 4, F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", F.slice(t, F.lit(1), cut).alias("prefix"), F.slice(t, cut + 1, F.lit(4)).alias("answer"), (F.col("doc_id") % 5).cast("int").alias("n"))
    masked = lambda n: F.array_repeat(F.lit(-100), n)
    start = F.size("prefix") + 1
    ids = F.concat("prefix", F.array(F.lit(-1)), masked(F.col("n")), F.array(F.lit(-2)), "answer")
    labels = F.concat(masked(start + F.col("n")), F.array(F.lit(-2)), "answer")
    digest = lambda a: F.sha2(F.array_join(a.cast("array<string>"), ",").cast("binary"), 256)
    return rows.select("doc_id", digest(ids).alias("input_sha256"), digest(labels).alias("labels_sha256"), start.alias("latent_start"), (start + F.col("n")).alias("latent_end"))


#: A word of one letter stands for padding, one of two for a special token.
@query(f"""
SELECT doc_id, CAST(p AS INT) AS position, CASE WHEN w = 1 THEN 0 ELSE 1 + coalesce(sum(CASE WHEN w > 2 OR w = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS n_keys
FROM (SELECT doc_id, unnest({_IDS}) AS w, unnest(range(len(string_split(text, ' ')))) AS p FROM documents)
""")
def induction_mask(spark: SparkSession, d: str) -> DataFrame:
    """How many keys each position attends to: itself, and the earlier ones
    that are neither special nor padding.  A running count, not pairs."""
    t = F.transform(F.split(F.col("text"), " "), lambda w: F.length(w))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(t).alias("position", "w"))
    earlier = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.sum(F.when(F.col("w").isin(1, 2), 0).otherwise(1)).over(earlier), F.lit(0))
    return rows.select("doc_id", "position", F.when(F.col("w") == 1, F.lit(0).cast("long")).otherwise(kept + 1).alias("n_keys"))


def _unit(*parts: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _unit_sql(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) + 0.5) / {1 << 52}.0)"


_TOP = "SELECT vec_id, i, k, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, v, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) - 1 AS k FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings)) WHERE k < 10"


@query(f"""
WITH z AS (SELECT vec_id, k, (ln(p + 1e-10) - ln(-ln({_unit_sql("7", "vec_id", "k")}))) / 0.8 AS z FROM ({_TOP}))
SELECT vec_id, CAST(k AS INT) AS rank, round(exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w, 6) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z) WINDOW w AS (PARTITION BY vec_id)
""")
def gumbel_topk(spark: SparkSession, d: str) -> DataFrame:
    """softmax((ln(p + 1e-10) + g) / T) over each vector's ten largest entries;
    the noise is a function of seed, id and rank, so partitioning doesn't
    change it."""
    top = table(spark, d, "embeddings").select("vec_id", A.softmax(A.top_k(F.col("embedding").cast("array<double>"), 10)["value"]).alias("p"))
    noisy = A.perturbed(F.col("p"), lambda k: _unit(F.lit(7), F.col("vec_id"), k), 1.0, 0.8)
    return top.select("vec_id", F.posexplode(A.softmax(noisy)).alias("rank", "p")).withColumn("p", F.round("p", 6))


#: Tries of the safe variant.
TRIES = 100


@query(f"""
WITH t AS ({_TOP}), e AS (SELECT vec_id, label % 5 AS stop FROM embeddings),
z AS (SELECT vec_id, a, arg_max(k, z) AS best FROM (SELECT vec_id, k, a, ln(p + 1e-10) - ln(-ln({_unit_sql("7", "vec_id", "a", "k")})) AS z FROM t, range({TRIES}) r(a)) GROUP BY vec_id, a)
SELECT vec_id, CAST(coalesce(min(a) FILTER (best <> stop), {TRIES - 1}) AS INT) AS attempt, CAST(arg_min(best, CASE WHEN best <> stop THEN a ELSE {TRIES} + {TRIES - 1} - a END) AS INT) AS best FROM z JOIN e USING (vec_id) GROUP BY vec_id
""")
def gumbel_safe(spark: SparkSession, d: str) -> DataFrame:
    """Noise drawn again, up to a hundred times, until the end token (here one
    of the first five ranks) isn't the largest; the last draw otherwise."""
    top = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 5).alias("stop"), A.softmax(A.top_k(F.col("embedding").cast("array<double>"), 10)["value"]).alias("p"))

    def best(a: Column) -> Column:
        noisy = A.perturbed(F.col("p"), lambda k: _unit(F.lit(7), F.col("vec_id"), a, k), 1.0, 1.0)
        return A.let(noisy, lambda z: F.array_position(z, F.array_max(z)).cast("int") - 1)

    draws = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda a: F.struct(a.alias("attempt"), best(a).alias("best")))
    rows = top.select("vec_id", "stop", draws.alias("draws"))
    safe = F.filter("draws", lambda x: x["best"] != F.col("stop"))
    chosen = F.coalesce(F.get(safe, F.lit(0)), F.element_at("draws", -1))
    return rows.select("vec_id", chosen.alias("c")).select("vec_id", "c.attempt", "c.best")
