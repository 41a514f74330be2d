"""Votes, scores, joins of results, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import metrics as M
from ..operators.vote import majority_vote as vote
from ..sources.tables import RESULTS_SQL, ROLLOUTS_SQL, results, rollouts, table
from .registry import query

VOTE_SQL = f"""
SELECT eval_index, CASE WHEN valid = 0 THEN NULL WHEN a > b OR (a = b AND fa < fb) THEN 'Response A' ELSE 'Response B' END AS prediction,
  CAST(n AS BIGINT) AS vote_num, CAST(valid AS BIGINT) AS vote_valid_count, CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, a = b AND valid > 0 AS vote_tied,
  CAST(CASE WHEN valid = 0 THEN f WHEN a > b OR (a = b AND fa < fb) THEN fa ELSE fb END AS BIGINT) AS vote_selected_index, generation_seconds
FROM (SELECT eval_index, count(*) AS n, count(prediction) AS valid, count(*) FILTER (prediction = 'Response A') AS a, count(*) FILTER (prediction = 'Response B') AS b,
  min(vote_index) FILTER (prediction = 'Response A') AS fa, min(vote_index) FILTER (prediction = 'Response B') AS fb, min(vote_index) AS f, max(generation_seconds) AS generation_seconds
  FROM ({ROLLOUTS_SQL}) GROUP BY eval_index)
"""


@query(VOTE_SQL)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return vote(rollouts(spark, d))


_SUBSETS = [x for xs in M.SECTIONS.values() for x in xs]
_WEIGHTS_SQL = ", ".join(f"('{s}', '{x}', {M.WEIGHTS[x]}, {_SUBSETS.index(x)})" for s, xs in M.SECTIONS.items() for x in xs)


@query(f"""
WITH v AS ({VOTE_SQL}), w AS (SELECT * FROM (VALUES {_WEIGHTS_SQL}) AS t(section, subset, weight, k)),
a AS (SELECT section, weight, avg(CASE WHEN prediction = CASE WHEN eval_index % 2 = 0 THEN 'Response A' ELSE 'Response B' END THEN 1.0 ELSE 0.0 END) AS acc FROM v JOIN w ON eval_index % {len(_SUBSETS)} = k GROUP BY section, subset, weight)
SELECT section, round(sum(acc * weight) / sum(weight), 6) AS score, CAST(count(*) AS BIGINT) AS subsets FROM a GROUP BY section
""")
def weighted_sections(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, _SUBSETS))
    expected = F.when(F.col("eval_index") % 2 == 0, "Response A").otherwise("Response B")
    rows = vote(rollouts(spark, d)).select(F.element_at(names, (F.col("eval_index") % len(_SUBSETS) + 1).cast("int")).alias("subset"), F.coalesce(F.col("prediction") == expected, F.lit(False)).alias("correct"))
    return M.weighted_sections(rows, F.broadcast(M.section_weights(spark))).withColumn("score", F.round("score", 6))


@query(f"SELECT domain, difficulty, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (correct) AS BIGINT) AS n_correct, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({RESULTS_SQL}) GROUP BY ALL")
def bucket_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.bucket_metrics(results(spark, d), "domain", "difficulty").withColumn("accuracy", F.round("accuracy", 6))


@query(f"""SELECT domain, round(f, 6) AS forward, round(r, 6) AS reverse, round(coalesce((f + r) / 2, f, r), 6) AS score FROM
(SELECT domain, avg(CAST(correct AS INT)) FILTER (NOT exchange) AS f, avg(CAST(correct AS INT)) FILTER (exchange) AS r FROM ({RESULTS_SQL}) GROUP BY domain)""")
def direction_average(spark: SparkSession, d: str) -> DataFrame:
    return M.direction_average(results(spark, d), "domain").select("domain", *[F.round(c, 6).alias(c) for c in ("forward", "reverse", "score")])


@query(f"""WITH c AS (SELECT domain, difficulty, avg(CAST(correct AS INT)) AS a FROM ({RESULTS_SQL}) GROUP BY ALL), o AS (SELECT domain, avg(a) AS score FROM c GROUP BY domain)
SELECT domain, round(score, 6) AS score FROM o UNION ALL SELECT 'Score', round(avg(score), 6) FROM o""")
def macro_of_macro(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_of_macro(results(spark, d), "domain", "difficulty").withColumn("score", F.round("score", 6))


@query(f"""SELECT domain, CAST(count(*) AS BIGINT) AS prompts, round(avg(p), 6) AS score FROM (SELECT domain, source_index, CAST(bool_and(correct) AS INT) AS p FROM ({RESULTS_SQL}) GROUP BY ALL) GROUP BY domain""")
def all_pass_prompt(spark: SparkSession, d: str) -> DataFrame:
    return M.all_pass(results(spark, d), "domain", "source_index").withColumn("score", F.round("score", 6))


@query(f"""SELECT domain, difficulty, CAST(count(*) AS BIGINT) AS samples, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({RESULTS_SQL}) GROUP BY GROUPING SETS ((), (domain), (difficulty))""")
def micro_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    return rows.groupingSets([[], ["domain"], ["difficulty"]], "domain", "difficulty").agg(F.count("*").alias("samples"), F.round(M.accuracy(), 6).alias("accuracy")).select("domain", "difficulty", "samples", "accuracy")


@query("""WITH l AS (SELECT label, count(*) FILTER (q = t AND q = label) AS tp, count(*) FILTER (t = label AND q <> label) AS fp, count(*) FILTER (q = label AND t <> label) AS fn
FROM (SELECT quality AS q, toxic AS t FROM labels), (VALUES (0), (1)) AS v(label) WHERE q = label OR t = label GROUP BY label)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM l""")
def confusion_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = M.confusion(table(spark, d, "labels"), "quality", "toxic")
    return rows.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return M.stats(table(spark, d, "events"), "value", "event_type").withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS rollouts, CAST(sum(tokens) AS BIGINT) AS tokens, (SELECT round(avg(s), 6) FROM (SELECT sum(tokens) AS s FROM ({ROLLOUTS_SQL}) GROUP BY eval_index)) AS tokens_per_sample, CAST(count(generation_seconds) AS BIGINT) AS timed FROM ({ROLLOUTS_SQL})""")
def efficiency_two_grain(spark: SparkSession, d: str) -> DataFrame:
    by = rollouts(spark, d).groupBy("eval_index").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.count("generation_seconds").alias("g"))
    return by.agg(F.sum("n").alias("rollouts"), F.sum("t").alias("tokens"), F.round(F.avg("t"), 6).alias("tokens_per_sample"), F.sum("g").alias("timed"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (prediction IS NULL) AS BIGINT) AS invalid, round(avg(CAST(vote_tied AS INT)), 6) AS tie_rate, round(avg(CAST(greatest(n_a, n_b) = vote_num AS INT)), 6) AS unanimous, max(generation_seconds) AS slowest FROM ({VOTE_SQL})""")
def vote_summary(spark: SparkSession, d: str) -> DataFrame:
    v = vote(rollouts(spark, d))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return v.agg(F.count("*").alias("samples"), F.count_if(F.col("prediction").isNull()).alias("invalid"), share(F.col("vote_tied")).alias("tie_rate"), share(F.greatest("n_a", "n_b") == F.col("vote_num")).alias("unanimous"), F.max("generation_seconds").alias("slowest"))


@query(f"""SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS samples, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({RESULTS_SQL}) JOIN orders ON source_index = o_orderkey GROUP BY 1""")
def join_results_data(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"), F.col("o_orderpriority").alias("priority"))
    return results(spark, d).join(data, "source_index").groupBy("priority").agg(F.count("*").alias("samples"), F.round(M.accuracy(), 6).alias("accuracy"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS extra, l.doc_id IS NULL AS missing FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def completeness_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("l_id"))
    both = a.join(b, F.col("doc_id") == F.col("l_id"), "full_outer")
    return both.where("doc_id is null or l_id is null").select(F.coalesce("doc_id", "l_id").alias("doc_id"), F.col("doc_id").isNull().alias("extra"), F.col("l_id").isNull().alias("missing"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_orderkey AS source_index, l_linenumber AS pair_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS dense_index FROM lineitem")
def dense_ordinal(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_index"), F.col("l_linenumber").alias("pair_index"), (F.row_number().over(w) - 1).alias("dense_index"))


@query("SELECT source, arg_max(lang, doc_id) AS lang, max(doc_id) AS doc_id FROM documents GROUP BY source")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("lang", "doc_id").alias("lang"), F.max("doc_id").alias("doc_id"))


@query("SELECT sha256(text) AS request_id, count(*) > 1 AS repeated, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY 1")
def dedup_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("request_id"), "lang")
    return rows.groupBy("request_id").agg((F.count("*") > 1).alias("repeated"), (F.count_distinct("lang") > 1).alias("conflict"))


@query("""SELECT event_id, user_id, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) IS NOT NULL AS has_header,
last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header_id FROM events""")
def asof_header(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("event_id", "user_id", header.isNotNull().alias("has_header"), header.alias("header_id"))


@query("SELECT doc_id, toxic, coalesce(lead(doc_id) OVER (PARTITION BY toxic ORDER BY doc_id), first_value(doc_id) OVER (PARTITION BY toxic ORDER BY doc_id)) AS donor FROM labels")
def donor_derangement(spark: SparkSession, d: str) -> DataFrame:
    return blocks.successor(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", "donor")


@query("SELECT o_custkey, o_orderkey, CAST(sum(o_custkey % 7 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS frontier FROM orders")
def frontier_running_sum(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(F.col("o_custkey") % 7 + 1).over(w).alias("frontier"))


@query("SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS size FROM orders")
def frontier_sizes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.lag("o_orderkey", 1, 0).over(w)).alias("size"))


@query(f"""SELECT domain, round(avg(CAST(f > r AS INT)), 6) AS fraction FROM (SELECT domain, source_index, avg(CAST(correct AS INT)) FILTER (NOT exchange) AS f, avg(CAST(correct AS INT)) FILTER (exchange) AS r FROM ({RESULTS_SQL}) GROUP BY ALL) WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY domain""")
def paired_fraction(spark: SparkSession, d: str) -> DataFrame:
    by = results(spark, d).groupBy("domain", "source_index").agg(F.avg(F.when(~F.col("exchange"), F.col("correct").cast("int"))).alias("f"), F.avg(F.when(F.col("exchange"), F.col("correct").cast("int"))).alias("r"))
    return by.dropna().groupBy("domain").agg(F.round(F.avg((F.col("f") > F.col("r")).cast("int")), 6).alias("fraction"))


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM events")
def active_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.sum(F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1)).over(w).alias("active"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') ORDER BY doc_id LIMIT 100")
def subset_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the first rows of the wanted subsets."""
    return table(spark, d, "documents").where(F.col("lang").isin("en", "de")).select("doc_id").orderBy("doc_id").limit(100)


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS rows, CAST(max(doc_id) - min(doc_id) + 1 - count(*) AS BIGINT) AS gaps FROM documents GROUP BY ALL")
def shard_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("rows"), (F.max("doc_id") - F.min("doc_id") + 1 - F.count("*")).alias("gaps"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, l.doc_id IS NOT NULL AS overlaid FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay_join(spark: SparkSession, d: str) -> DataFrame:
    over = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    return table(spark, d, "documents").select("doc_id").join(over, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("found", F.lit(False)).alias("overlaid"))


@query("SELECT event_id, CASE WHEN value > 0 AND user_id > 0 AND value >= user_id / 100.0 THEN round(value - user_id / 100.0, 6) END AS latency FROM events")
def request_latency(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("user_id") / 100.0
    ok = (F.col("value") > 0) & (F.col("user_id") > 0) & (F.col("value") >= start)
    return table(spark, d, "events").select("event_id", F.when(ok, F.round(F.col("value") - start, 6)).alias("latency"))


@query(f"SELECT eval_index, vote_index, prediction, coalesce(prediction = 'Response A', false) AS correct, tokens + 1 AS total_tokens FROM ({ROLLOUTS_SQL})")
def result_row(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).select("eval_index", "vote_index", "prediction", F.coalesce(F.col("prediction") == "Response A", F.lit(False)).alias("correct"), (F.col("tokens") + 1).alias("total_tokens"))
