"""Score roll-ups, completeness, reports and ratios."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import settings
from ..sources.tables import ROLLOUTS_SQL, results, rollouts, table
from .measure_queries import _HALVES_SQL, _halves
from .registry import query

#: Line items as cells of a prompt's grid of two by three.
_CELLS = "SELECT l_orderkey AS prompt, (l_linenumber - 1) % 2 AS chosen, CAST(l_suppkey % 3 AS INT) AS rejected, CASE WHEN l_orderkey % 2 = 0 THEN 'ref' ELSE 'tied' END || ':' || l_orderkey AS prompt_id, l_discount > 0.02 AS correct FROM lineitem"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(k.alias("prompt"), ((F.col("l_linenumber") - 1) % 2).alias("chosen"), (F.col("l_suppkey") % 3).cast("int").alias("rejected"), F.concat(F.when(k % 2 == 0, "ref").otherwise("tied"), F.lit(":"), k.cast("string")).alias("prompt_id"), (F.col("l_discount") > 0.02).alias("correct"), F.lit(2).alias("num_correct"), F.lit(3).alias("num_incorrect"))


@query(f"WITH c AS (SELECT prompt, chosen, rejected, count(*) AS n FROM ({_CELLS}) GROUP BY ALL) SELECT prompt, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicates, CAST(6 - count(*) AS BIGINT) AS missing FROM c GROUP BY prompt")
def pair_grid(spark: SparkSession, d: str) -> DataFrame:
    """What a prompt's grid of pairs lacks, and what it has twice."""
    return M.pair_grid(_cells(spark, d), "prompt", "chosen", "rejected", "num_correct", "num_incorrect")


@query(f"SELECT p.prompt, CAST(c AS INT) AS chosen, CAST(r AS INT) AS rejected FROM (SELECT prompt, c, r FROM (SELECT DISTINCT prompt FROM ({_CELLS})), range(2) a(c), range(3) b(r)) p ANTI JOIN ({_CELLS}) x ON x.prompt = p.prompt AND x.chosen = c AND x.rejected = r")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return M.missing_cells(_cells(spark, d), "prompt", "chosen", "rejected", "num_correct", "num_incorrect")


@query(f"SELECT split_part(prompt_id, ':', 1) AS kind, CAST(count(*) AS BIGINT) AS samples, round(avg(CAST(s AS INT)), 6) AS score FROM (SELECT prompt_id, bool_and(correct) AS s FROM ({_CELLS}) GROUP BY prompt_id) GROUP BY 1")
def prefix_means(spark: SparkSession, d: str) -> DataFrame:
    """Prompts all of whose pairs are right, by the kind before the colon."""
    prompts = _cells(spark, d).groupBy("prompt_id").agg(F.bool_and("correct").alias("s"))
    return M.prefix_means(prompts, "prompt_id", F.col("s").cast("int")).withColumn("score", F.round("score", 6))


_ROWS = "SELECT CASE l_suppkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'normal' ELSE 'hard' END AS difficulty, 'm' || l_suppkey % 5 AS model_name, l_linenumber % 2 = 1 AS exchange, l_discount > 0.05 AS correct, CASE WHEN l_tax > 0.01 THEN 'Response A' END AS prediction FROM lineitem"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(F.when(s % 3 == 0, "simple").when(s % 3 == 1, "normal").otherwise("hard").alias("difficulty"), F.concat(F.lit("m"), (s % 5).cast("string")).alias("model_name"), (F.col("l_linenumber") % 2 == 1).alias("exchange"), (F.col("l_discount") > 0.05).alias("correct"), F.when(F.col("l_tax") > 0.01, "Response A").alias("prediction"))


# How many pairs of each difficulty a complete run has.
_EXPECTED = {"simple": 47, "normal": 133, "hard": 264}


@query(f"""
SELECT CASE WHEN exchange THEN 'reverse' ELSE 'forward' END AS direction, difficulty, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, CAST(count(*) FILTER (prediction IS NULL) AS BIGINT) AS invalid, round(100 * avg(CAST(correct AS INT)), 6) AS score_percent,
  CASE WHEN grouping(difficulty) = 1 THEN count(*) = 444 AND count(*) FILTER (difficulty = 'simple') = 47 AND count(*) FILTER (difficulty = 'normal') = 133 AND count(*) FILTER (difficulty = 'hard') = 264 END AS complete
FROM ({_ROWS}) GROUP BY GROUPING SETS ((exchange), (exchange, difficulty))
""")
def difficulty_summary(spark: SparkSession, d: str) -> DataFrame:
    """Both directions as a whole and by difficulty, and whether all expected
    pairs are there."""
    out = M.by_group(_judged(spark, d), "difficulty", _EXPECTED)
    return out.select("direction", "difficulty", "samples", "correct", "invalid", F.round(100 * F.col("accuracy"), 6).alias("score_percent"), "complete")


@query(f"SELECT CASE WHEN exchange THEN 'reverse' ELSE 'forward' END AS direction, model_name, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, round(100 * avg(CAST(correct AS INT)), 6) AS score_percent FROM ({_ROWS}) GROUP BY GROUPING SETS ((exchange), (exchange, model_name))")
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    out = M.by_group(_judged(spark, d), "model_name", {})
    return out.select("direction", "model_name", "samples", "correct", F.round(100 * F.col("accuracy"), 6).alias("score_percent"))


@query(f"""
WITH s AS (SELECT direction, coalesce(model_name, 'Score') AS name, a FROM (SELECT CASE WHEN exchange THEN 'reverse' ELSE 'forward' END AS direction, model_name, avg(CAST(correct AS INT)) AS a FROM ({_ROWS}) WHERE NOT (exchange AND model_name = 'm1') GROUP BY GROUPING SETS ((exchange), (exchange, model_name))))
SELECT name, round(max(a) FILTER (direction = 'forward'), 6) AS forward, round(max(a) FILTER (direction = 'reverse'), 6) AS reverse, round((max(a) FILTER (direction = 'forward') + max(a) FILTER (direction = 'reverse')) / 2, 6) AS average FROM s WHERE name IN ('Score', 'm0', 'm1') GROUP BY name
""")
def score_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Headline scores side by side; a direction that lacks one has null."""
    rows = _judged(spark, d).where(~(F.col("exchange") & (F.col("model_name") == "m1")))
    scores = M.by_group(rows, "model_name", {}).select("direction", F.coalesce("model_name", F.lit("Score")).alias("name"), F.col("accuracy").alias("score"))
    out = M.headline(scores, ["Score", "m0", "m1"])
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("forward", "reverse", "average")])


_LABELS = ["met", "not_met", "partial"]
_STATUS = "CASE {} % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'not_met' WHEN 2 THEN 'partial' END"


def _criteria(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as criteria of their customers: gold statuses, and told ones of
    some of them."""
    status = lambda n: F.when(n % 4 == 0, "met").when(n % 4 == 1, "not_met").when(n % 4 == 2, "partial")
    k = F.col("o_orderkey")
    p, s = F.when(F.col("o_custkey") % 3 == 0, k % 3).otherwise(k * 7 % 11), k * 13 % 17
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("record"), k.alias("number"), p.alias("p"), s.alias("s"))
    return rows.select("record", "number", status(F.col("p")).alias("gold")), rows.where("s % 5 <> 0").select("record", "number", F.when(F.col("s") % 3 == 0, status(F.col("s"))).otherwise(status(F.col("p"))).alias("told"))


@query(f"""
WITH o AS (SELECT o_custkey AS record, o_orderkey AS number, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 3 ELSE o_orderkey * 7 % 11 END AS p, o_orderkey * 13 % 17 AS s FROM orders),
g AS (SELECT record, number, {_STATUS.format("p")} AS gold, s % 5 <> 0 AS answered, CASE WHEN s % 5 <> 0 THEN CASE WHEN s % 3 = 0 THEN {_STATUS.format("s")} ELSE {_STATUS.format("p")} END END AS told FROM o),
f AS (SELECT label, count(*) FILTER (gold = label AND coalesce(told = gold, false)) AS tp, count(*) FILTER (told = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND NOT coalesce(told = gold, false)) AS fn FROM g, (VALUES ('met'), ('not_met'), ('partial')) v(label) GROUP BY label),
p AS (SELECT tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM f),
v AS (SELECT count(*) FILTER (ok) / greatest(count(*), 1) AS vector_exact, count(*) AS full_records FROM (SELECT bool_and(coalesce(told = gold, false)) AS ok FROM g GROUP BY record HAVING count(gold) = count(*)))
SELECT CAST(count(DISTINCT record) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS criteria, CAST(count(gold) AS BIGINT) AS labels, CAST((SELECT full_records FROM v) AS BIGINT) AS full_records, round(count(*) FILTER (gold IS NOT NULL AND told IS NOT NULL) / greatest(count(gold), 1), 6) AS coverage, round(count(*) FILTER (gold = told) / greatest(count(gold), 1), 6) AS accuracy,
  round((SELECT sum(2 * p * r / greatest(p + r, 1e-12)) / 3 FROM p), 6) AS macro_f1, round((SELECT vector_exact FROM v), 6) AS vector_exact, round(count(*) FILTER (answered) / greatest(count(*), 1), 6) AS semantic_coverage FROM g
""")
def criterion_report(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, accuracy, macro-F1 and exact vectors of told statuses."""
    out = M.criterion_report(*_criteria(spark, d), ["record", "number"], "record", _LABELS)
    return out.select("records", "criteria", "labels", "full_records", *[F.round(c, 6).alias(c) for c in ("coverage", "accuracy", "macro_f1", "vector_exact", "semantic_coverage")])


@query(f"""
WITH h AS (SELECT doc_id, list_transform(a, lambda w: length(w)) AS a, list_transform(b, lambda w: length(w)) AS b, len(b) AS whole FROM ({_HALVES_SQL})),
e AS (SELECT doc_id, a, b, whole, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]) AS eq FROM h),
c AS (SELECT doc_id, sum(least(x, y)) AS o FROM (SELECT doc_id, w, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, unnest(a) AS w, 1 AS x, 0 AS y FROM h UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM h) GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT e.doc_id, coalesce(nullif(list_position(eq, false), 0) - 1, len(eq)) AS prefix, len(list_filter(eq, lambda x: x)) AS aligned, CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END ELSE 2.0 * o / (len(a) + len(b)) END AS f1, a = b AS exact, len(a) AS predicted, len(b) AS target, whole FROM e LEFT JOIN c USING (doc_id))
SELECT lang, CAST(count(*) AS BIGINT) AS examples, round(sum(prefix) / count(*), 6) AS mean_prefix, round(sum(aligned) / greatest(sum(target), 1), 6) AS aligned_accuracy, round(sum(f1) / count(*), 5) AS token_f1, round(sum(CAST(exact AS INT)) / count(*), 6) AS exact_match, round(sum(predicted) / greatest(sum(whole), 1), 6) AS length_ratio, round(sum(target) / greatest(sum(whole), 1), 6) AS coverage
FROM m JOIN documents USING (doc_id) GROUP BY lang
""")
def generation_quality(spark: SparkSession, d: str) -> DataFrame:
    """First halves as predictions of second ones, by language."""
    ids = lambda c: F.transform(c, lambda w: F.length(w))
    rows = _halves(spark, d).select("doc_id", ids("a").alias("a"), ids("b").alias("b"), F.size("b").alias("whole"))
    both = F.least(F.size("a"), F.size("b"))
    eq = F.zip_with(F.slice("a", F.lit(1), both), F.slice("b", F.lit(1), both), lambda x, y: x == y)
    rows = rows.withColumn("eq", eq)
    miss = F.array_position("eq", False)
    rows = rows.select("doc_id", F.when(miss > 0, miss.cast("int") - 1).otherwise(F.size("eq")).alias("prefix"), F.size(F.filter("eq", lambda x: x)).alias("aligned"), M.bag_f1(F.col("a"), F.col("b")).alias("f1"), (F.col("a") == F.col("b")).alias("exact"), F.size("a").alias("predicted"), F.size("b").alias("target"), "whole")
    out = M.generation_quality(rows.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "lang")
    return out.select("lang", "examples", "mean_prefix", *[F.round(c, 6).alias(c) for c in ("aligned_accuracy", "exact_match", "length_ratio", "coverage")], F.round("token_f1", 5).alias("token_f1")).withColumn("mean_prefix", F.round("mean_prefix", 6))


@query("SELECT o_orderkey, sha256('{\"backend\": \"native\", \"data\": \"' || o_orderstatus || '\", \"max_samples\": ' || o_custkey || ', \"vote\": 5}') AS signature FROM orders")
def run_signature(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a run's settings, sorted by name."""
    names = {"vote": F.lit("5"), "max_samples": F.col("o_custkey").cast("string"), "data": F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), "backend": F.lit('"native"')}
    return table(spark, d, "orders").select("o_orderkey", M.signature(names).alias("signature"))


_PLAIN = json.dumps(settings.as_dict(settings.Evaluation(vote=-1, max_samples=-2)), sort_keys=True).replace("-1", "' || c_custkey || '").replace("-2", "' || CASE WHEN c_nationkey = 7 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END || '")


@query(f"SELECT c_custkey, sha256('{_PLAIN}') AS signature FROM customer")
def settings_signature(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all settings of a run, a run a customer."""
    nation = F.col("c_nationkey")
    entries = settings.row_entries(vote=F.col("c_custkey"), max_samples=F.when(nation != 7, nation))
    return table(spark, d, "customer").select("c_custkey", M.signature(entries).alias("signature"))


@query("SELECT p_brand AS module, CAST(sum(p_size) AS BIGINT) AS parameters, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS trainable, bool_and(p_size > 0) AS all_ready, bool_or(p_size > 45) AS any_ready FROM part GROUP BY p_brand")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Parameter counts of modules, and whether all or any of their files are."""
    trainable = F.sum(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).otherwise(0))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(F.sum("p_size").cast("long").alias("parameters"), trainable.cast("long").alias("trainable"), F.bool_and(F.col("p_size") > 0).alias("all_ready"), F.bool_or(F.col("p_size") > 45).alias("any_ready"))


@query("SELECT o_custkey, round(100 * avg(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderstatus = 'F' AS INT) END), 6) AS score_percent FROM orders GROUP BY o_custkey")
def percent_of(spark: SparkSession, d: str) -> DataFrame:
    """Means in percent; of nothing, null."""
    ok = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("int"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(M.percent(F.avg(ok)), 6).alias("score_percent"))


@query("SELECT c_custkey, CAST(ceil(ceil(ceil(c_custkey * 1000.0 / w) / 4) / 8) AS BIGINT) AS steps FROM (SELECT c_custkey, c_custkey % 7 + 1 AS w FROM customer)")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of an epoch: records by workers, by batch, by accumulation, each
    rounded up."""
    return table(spark, d, "customer").select("c_custkey", M.nested_ceil(F.col("c_custkey") * 1000, F.col("c_custkey") % 7 + 1, F.lit(4), F.lit(8)).alias("steps"))


@query(f"SELECT round(count(*) / sum(generation_seconds), 6) AS rollouts_a_second, round(sum(tokens) / sum(generation_seconds), 6) AS tokens_a_second, round(sum(generation_seconds) / count(DISTINCT eval_index), 6) AS seconds_a_sample, round(sum(tokens) / count(DISTINCT eval_index), 6) AS tokens_a_sample, CAST(NULL AS DOUBLE) AS by_nothing FROM ({ROLLOUTS_SQL})")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Ratios that are null where there is nothing to divide by."""
    rows = rollouts(spark, d).groupBy("eval_index").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("generation_seconds").alias("s"))
    sums = rows.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("s").alias("s"), F.count("*").alias("samples"))
    ratio = lambda a, b: F.round(M.ratio(a, b), 6)
    s, samples = F.col("s"), F.col("samples")
    return sums.select(ratio(F.col("n"), s).alias("rollouts_a_second"), ratio(F.col("t"), s).alias("tokens_a_second"), ratio(s, samples).alias("seconds_a_sample"), ratio(F.col("t"), samples).alias("tokens_a_sample"), M.ratio(F.col("n"), F.lit(0)).alias("by_nothing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS absent, -1 AS absent_or_default FROM events")
def nested_get(spark: SparkSession, d: str) -> DataFrame:
    """Entries of nested objects, with a default."""
    tree = F.from_json(F.concat(F.lit('{"modes": {"correct": '), "props", F.lit("}}")), "struct<modes: map<string, map<string, long>>>")
    at = lambda mode, key: F.try_element_at(F.try_element_at(F.col("t.modes"), F.lit(mode)), F.lit(key))
    return table(spark, d, "events").select("event_id", tree.alias("t")).select("event_id", at("correct", "k").alias("k"), at("zero", "k").alias("absent"), F.coalesce(at("zero", "k"), F.lit(-1)).cast("int").alias("absent_or_default"))


@query("SELECT n_nationkey, '{\"a\":' || n_regionkey || ',\"b\":{\"c\":\"' || n_name || '\",\"d\":null}}' AS json FROM nation")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects as text with sorted keys and nulls."""
    inner = M.sorted_struct({"d": F.lit(None).cast("string"), "c": F.col("n_name")})
    return table(spark, d, "nation").select("n_nationkey", F.to_json(M.sorted_struct({"b": inner, "a": F.col("n_regionkey")}), {"ignoreNullFields": "false"}).alias("json"))


@query("SELECT c_custkey, c_custkey % 3 AS a, 100 AS b, c_nationkey AS c FROM customer")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one, in which the later wins; a key is dropped again."""
    entry = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("long"))])
    merged = M.merged(entry(a=F.col("c_custkey") % 3, b=F.col("c_custkey"), gone=F.lit(1)), entry(b=F.lit(100), c=F.col("c_nationkey")))
    kept = M.without_keys(merged, ["gone"])
    at = lambda k: F.try_element_at("m", F.lit(k))
    return table(spark, d, "customer").select("c_custkey", kept.alias("m")).where("not map_contains_key(m, 'gone')").select("c_custkey", at("a").alias("a"), at("b").cast("int").alias("b"), at("c").cast("int").alias("c"))


@query(f"""
WITH h AS ({_HALVES_SQL}), c AS (SELECT doc_id, w, sum(x) AS ca, sum(y) AS cb FROM (SELECT doc_id, unnest(a) AS w, 1 AS x, 0 AS y FROM h UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM h) GROUP BY ALL),
f AS (SELECT doc_id, CASE WHEN sum(cb) = 0 OR sum(ca) = 0 THEN 0.0 ELSE 2.0 * sum(least(ca, cb)) / (sum(ca) + sum(cb)) END AS f1 FROM c GROUP BY doc_id)
SELECT lang, CAST(count(*) AS BIGINT) AS criteria, CAST(count(*) FILTER (doc_id % 4 <> 0) AS BIGINT) AS covered, round(sum(CASE WHEN doc_id % 4 <> 0 THEN f1 ELSE 0 END) / count(*), 5) AS score FROM f JOIN documents USING (doc_id) GROUP BY lang
""")
def justification_scores(spark: SparkSession, d: str) -> DataFrame:
    """Justifications against their references by a scorer that can be given,
    the F1 of bags of words by default; a missing one counts as zero."""
    rows = _halves(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("a")).alias("candidate"), F.col("b").alias("reference"))
    rows = rows.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return M.semantic_scores(rows, "lang").withColumn("score", F.round("score", 5))


def _share(c: Column) -> Column:
    return F.round(c, 6)


@query("SELECT domain, round(100 * avg(CAST(correct AS INT)), 6) AS score_percent, CAST(count(*) AS BIGINT) AS samples FROM (SELECT l_returnflag AS domain, l_discount > 0.05 AS correct FROM lineitem) GROUP BY domain ORDER BY domain")
def sorted_report(spark: SparkSession, d: str) -> DataFrame:
    """Domains in order, as a report lists them."""
    by = results(spark, d).groupBy("domain").agg(_share(M.percent(M.accuracy())).alias("score_percent"), F.count("*").alias("samples"))
    return by.orderBy("domain")
