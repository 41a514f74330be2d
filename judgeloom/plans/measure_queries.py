"""Summaries, interval joins, invariants, text likeness and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arrays as A
from ..operators import intervals, nearest
from ..operators import metrics as M
from ..sources.tables import ROLLOUTS_SQL, rollouts, table
from .registry import query

_EXPECTED = "CASE WHEN eval_index % 2 = 0 THEN 'Response A' ELSE 'Response B' END"


@query(f"""
SELECT CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (ok) AS BIGINT) AS n_correct, round(avg(CAST(ok AS INT)), 6) AS accuracy, CAST(count(*) - count(prediction) AS BIGINT) AS invalid,
  round((count(*) - count(prediction)) / count(*), 6) AS invalid_rate, round(count(*) FILTER (ok) / greatest(count(prediction), 1), 6) AS valid_accuracy, round(avg(tokens), 6) AS mean_tokens, max(tokens) AS most_tokens
FROM (SELECT *, coalesce(prediction = {_EXPECTED}, false) AS ok FROM ({ROLLOUTS_SQL}))
""")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = rollouts(spark, d).withColumn("ok", F.coalesce(F.col("prediction") == F.expr(_EXPECTED), F.lit(False)))
    n, valid, ok = F.count("*"), F.count("prediction"), F.count_if("ok")
    return rows.agg(
        n.alias("samples"), ok.alias("n_correct"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), (n - valid).alias("invalid"), F.round((n - valid) / n, 6).alias("invalid_rate"),
        F.round(ok / F.greatest(valid, F.lit(1)), 6).alias("valid_accuracy"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.max("tokens").alias("most_tokens"))


@query("""
SELECT response, CAST(count(*) AS BIGINT) AS n, CAST(count(p.status) AS BIGINT) AS labelled, round(avg(CASE WHEN p.status = g.status THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS response, doc_id AS number, CASE WHEN toxic = 1 THEN 'hard rule' ELSE 'principle' END AS kind, CASE WHEN quality = 1 THEN 'met' ELSE 'not_met' END AS status FROM labels) g
LEFT JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS response, doc_id AS number, CASE WHEN n_chars % 2 = 0 THEN 'hard rule' ELSE 'principle' END AS kind, CASE WHEN lang = 'en' THEN 'met' ELSE 'not_met' END AS status FROM documents) p
USING (response, number, kind) GROUP BY response
""")
def criterion_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Only the gold criteria count; one without a prediction is wrong."""
    side = F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("response")
    kind = lambda c: F.when(c, "hard rule").otherwise("principle").alias("kind")
    status = lambda c, name: F.when(c, "met").otherwise("not_met").alias(name)
    gold = table(spark, d, "labels").select(side, F.col("doc_id").alias("number"), kind(F.col("toxic") == 1), status(F.col("quality") == 1, "gold"))
    told = table(spark, d, "documents").select(side, F.col("doc_id").alias("number"), kind(F.col("n_chars") % 2 == 0), status(F.col("lang") == "en", "told"))
    rows = gold.join(told, ["response", "number", "kind"], "left")
    return rows.groupBy("response").agg(F.count("*").alias("n"), F.count("told").alias("labelled"), F.round(M.accuracy(F.col("told") == F.col("gold")), 6).alias("accuracy"))


@query("""
WITH e AS (SELECT user_id, event_type = 'signup' AS head, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
b AS (SELECT user_id, event_id AS header_id, pos AS start, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos), 9000000000) AS stop FROM e WHERE head)
SELECT e.user_id, header_id, CAST(count(*) AS BIGINT) AS n_items FROM e LEFT JOIN b ON e.user_id = b.user_id AND pos >= start AND pos < stop WHERE NOT head GROUP BY e.user_id, header_id
""")
def range_block_join(spark: SparkSession, d: str) -> DataFrame:
    """Items in the block their position falls into; null for those before the
    first header, which a trace mustn't have."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "signup").alias("head"))
    placed = rows.withColumn("header_id", intervals.block_of("user_id", F.col("head"), F.col("event_id"), "ts", "event_id"))
    return placed.where(~F.col("head")).groupBy("user_id", "header_id").agg(F.count("*").alias("n_items"))


_TOKENS_SQL = """
SELECT *, stop - k AS start FROM (SELECT user_id, event_id, event_type, k, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k FROM events))
"""


@query(f"""
WITH t AS ({_TOKENS_SQL}), a AS (SELECT user_id, event_id, start - 60 AS lo, stop + 60 AS hi FROM t WHERE event_type = 'purchase'),
o AS (SELECT a.user_id, a.event_id, min(n) AS first, max(n) AS last FROM a JOIN t ON a.user_id = t.user_id AND t.stop > a.lo AND t.start < a.hi GROUP BY ALL)
SELECT DISTINCT user_id, CAST(unnest(range(first, last)) AS BIGINT) AS cut FROM o WHERE last - first + 1 BETWEEN 2 AND 10
""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Token edges that lie inside protected spans."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.get_json_object("props", "$.k").cast("long") + 1
    tokens = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", k.alias("k")).withColumn("end", F.sum("k").over(w)).withColumn("start", F.col("end") - F.col("k"))
    spans = tokens.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), (F.col("start") - 60).alias("start"), (F.col("end") + 60).alias("end"))
    return intervals.forbidden_cuts(intervals.spans_over_tokens(tokens, spans, "user_id", "span"), "user_id")


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """A document's words, the first half (at least one) and the rest."""
    t = F.split(F.coalesce("text", F.lit("")), " ")
    half = F.greatest(F.lit(1), F.floor(F.size(t) / 2).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.slice(t, F.lit(1), half).alias("a"), F.slice(t, half + 1, F.size(t)).alias("b"))


_HALVES_SQL = "SELECT doc_id, t[1:h] AS a, t[h + 1:] AS b FROM (SELECT doc_id, t, greatest(1, len(t) // 2) AS h FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS t FROM documents))"


@query(f"""
WITH h AS ({_HALVES_SQL}), c AS (SELECT doc_id, w, sum(x) AS ca, sum(y) AS cb FROM (SELECT doc_id, unnest(a) AS w, 1 AS x, 0 AS y FROM h UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM h) GROUP BY ALL)
SELECT doc_id, CAST(sum(least(ca, cb)) AS BIGINT) AS overlap, round(CASE WHEN sum(cb) = 0 THEN 0.0 ELSE 2.0 * sum(least(ca, cb)) / (sum(ca) + sum(cb)) END, 6) AS f1 FROM c GROUP BY doc_id
""")
def multiset_f1(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of two bags of words, each document by itself."""
    h = _halves(spark, d).select("doc_id", M.bag_overlap(F.col("a"), F.col("b")).cast("long").alias("overlap"), F.size("a").alias("na"), F.size("b").alias("nb"))
    # 2PR / (P + R) of counts; without a second half there is nothing to match
    return h.select("doc_id", "overlap", F.round(F.when(F.col("nb") == 0, 0.0).otherwise(2.0 * F.col("overlap") / (F.col("na") + F.col("nb"))), 6).alias("f1"))


@query(f"""
SELECT doc_id, CAST(coalesce(nullif(list_position(eq, false), 0) - 1, len(eq)) AS INT) AS prefix, CAST(len(list_filter(eq, lambda x: x)) AS INT) AS aligned, CAST(nb AS INT) AS target, len(eq) = nb AND na = nb AND coalesce(list_position(eq, false), 0) = 0 AS exact
FROM (SELECT doc_id, len(a) AS na, len(b) AS nb, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: length(a[i]) = length(b[i])) AS eq FROM ({_HALVES_SQL}))
""")
def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """The halves as token ids (here a word's length): matching prefix, aligned
    matches, whether all is equal."""
    letter = lambda a: F.transform(a, lambda w: F.length(w))
    both = F.least(F.size("a"), F.size("b"))
    eq = F.zip_with(letter(F.slice("a", F.lit(1), both)), letter(F.slice("b", F.lit(1), both)), lambda x, y: x == y)
    rows = _halves(spark, d).select("doc_id", F.size("a").alias("na"), F.size("b").alias("target"), eq.alias("eq"))
    miss = F.array_position("eq", False)
    return rows.select("doc_id", F.when(miss > 0, miss.cast("int") - 1).otherwise(F.size("eq")).alias("prefix"), F.size(F.filter("eq", lambda x: x)).alias("aligned"), "target", ((miss == 0) & (F.col("na") == F.col("target"))).alias("exact"))


_RAW = ["mt-bench-easy", "hep-go", "Precise IF", "rm-bench-code", "helpsteer3-stem", "helpsteer3-general", "ifbench", "ppe-ifeval", "other", ""]


@query("""
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'Chat' WHEN 1 THEN 'Reasoning' WHEN 2 THEN 'Precise IF' WHEN 3 THEN CASE WHEN lang = 'en' THEN 'En' ELSE 'Code' END WHEN 4 THEN CASE WHEN lang = 'en' THEN 'En' ELSE 'STEM' END
  WHEN 5 THEN CASE WHEN lang = 'en' THEN 'En' ELSE 'General' END WHEN 6 THEN CASE WHEN lang IN ('de', 'fr') THEN upper(lang[1]) || lang[2:] ELSE 'IFBench' END WHEN 7 THEN 'PPE-IFEval' WHEN 8 THEN 'other' ELSE 'unknown' END AS reporting_group FROM documents
""")
def official_subset(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("doc_id") % 10 + 1).cast("int"))
    domain, difficulty = F.when(F.col("lang") == "en", F.col("lang")), F.when(F.col("lang").isin("de", "fr"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.reporting_group(raw, domain, difficulty, M.SECTIONS).alias("reporting_group"))


_FRAGMENTS = ["- Criterion 3", "Not Met. There", "Justification: This", "The response also", "Response A clearly provides", "met. the response", "It", "All is well", "The answer mentions more than five tokens here"]
_COSTS = [8.0, 8.0, 8.0, 8.0, 4.0, 8.0, 8.0, 0.0, 0.0]


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN 0.0 ELSE CAST([{', '.join(map(str, _COSTS))}][doc_id % 9 + 1] AS DOUBLE) END AS penalty FROM documents")
def fragment_penalty(spark: SparkSession, d: str) -> DataFrame:
    fragment = F.element_at(F.array(*map(F.lit, _FRAGMENTS)), (F.col("doc_id") % 9 + 1).cast("int"))
    whole = F.when(F.col("lang") == "en", F.concat(fragment, F.lit(" and so on"))).otherwise(fragment)
    return table(spark, d, "documents").select("doc_id", T.fragment_penalty(whole, F.size(F.split(whole, " "))).alias("penalty"))


_EDGES_SQL = "SELECT doc_id, n, list_transform(generate_series(1, c), lambda i: CAST(round_even(i * n / c, 0) AS INT)) AS ends FROM (SELECT doc_id, CAST(len(string_split(coalesce(text, ''), ' ')) AS INT) AS n, CAST(ceil(len(string_split(coalesce(text, ''), ' ')) / 8) AS INT) AS c FROM documents)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, t, n, ends): words, their number, and chunk ends at even splits."""
    t = F.split(F.coalesce("text", F.lit("")), " ")
    rows = table(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("n", F.size("t")).withColumn("c", F.ceil(F.col("n") / 8).cast("int"))
    return rows.select("doc_id", "t", "n", F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: F.bround(i * F.col("n") / F.col("c"), 0).cast("int")).alias("ends"))


@query(f"""
SELECT doc_id, CAST(len(ends) AS INT) AS n_chunks, n > 0 AND len(list_filter(range(1, len(ends) + 1), lambda i: ends[i] <= CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END)) = 0 AS increasing, ends[-1] = n - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS complete FROM ({_EDGES_SQL})
""")
def frontier_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Frontiers increase and end at the length; here every fifth record's
    stored length is off by one."""
    length = F.col("n") - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return _edges(spark, d).select("doc_id", F.size("ends").alias("n_chunks"), A.increasing(F.col("ends")).alias("increasing"), (F.try_element_at("ends", F.lit(-1)) == length).alias("complete"))


@query("""
SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, list_min(embedding) >= 0 AS non_negative, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) > 0 AS has_mass FROM embeddings
""")
def probability_invariants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", *A.probability_checks(F.col("embedding").cast("array<double>")))


@query(f"""
SELECT size, chunks, round(chunks / sum(chunks) OVER (), 6) AS share, size = 8 AS at_rate, size NOT BETWEEN 6 AND 10 AS outside
FROM (SELECT CAST(ends[i] - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END AS INT) AS size, CAST(count(*) AS BIGINT) AS chunks FROM (SELECT ends, unnest(range(1, len(ends) + 1)) AS i FROM ({_EDGES_SQL})) GROUP BY 1)
""")
def chunk_histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.chunk_histogram(_edges(spark, d).select(F.explode(A.differences(F.col("ends"))).alias("size"))).withColumn("share", F.round("share", 6))


@query(f"""
WITH s AS (SELECT ends[i] - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END AS size FROM (SELECT ends, unnest(range(1, len(ends) + 1)) AS i FROM ({_EDGES_SQL})))
SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(sum(size) AS BIGINT) AS tokens, CAST(min(size) AS INT) AS least, CAST(max(size) AS INT) AS most, CAST(count(*) FILTER (size = 8) AS BIGINT) AS at_rate, CAST(count(*) FILTER (size < 8) AS BIGINT) AS below_rate,
  CAST(count(*) FILTER (size > 8) AS BIGINT) AS above_rate, CAST(count(*) FILTER (size < 6) AS BIGINT) AS below_preferred, CAST(count(*) FILTER (size > 10) AS BIGINT) AS above_preferred, round(sum(size) / count(*), 6) AS tokens_per_chunk FROM s
""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    hist = M.chunk_histogram(_edges(spark, d).select(F.explode(A.differences(F.col("ends"))).alias("size")))
    return M.chunk_stats(hist).withColumn("tokens_per_chunk", F.round("tokens_per_chunk", 6))


@query("""
SELECT doc_id, CAST(i AS INT) AS slot, t[CAST(round_even(i * (len(t) - 1) / 7, 0) AS INT) + 1] AS word FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS t FROM documents), range(8) r(i)
""")
def linspace_resample(spark: SparkSession, d: str) -> DataFrame:
    """Eight words at even distances, positions rounded half to even."""
    t = F.split(F.coalesce("text", F.lit("")), " ")
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.posexplode(A.resample(F.col("t"), 8)).alias("slot", "word"))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT vec_id, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) - 1 AS k FROM e),
p AS (SELECT vec_id, k, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM r WHERE k < 5), m AS (SELECT *, sqrt(p) / sum(sqrt(p)) OVER (PARTITION BY vec_id) AS q FROM p)
SELECT vec_id, CAST(k AS INT) AS rank, mode, round(CASE mode WHEN 'weighted' THEN p WHEN 'top1' THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END WHEN 'uniform' THEN 0.2 ELSE q END, 6) AS p FROM m, (VALUES ('weighted'), ('top1'), ('uniform'), ('temperature')) t(mode)
""")
def soft_modes(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest entries under each mode; temperature two."""
    top = table(spark, d, "embeddings").select("vec_id", A.softmax(F.slice(F.sort_array(F.col("embedding").cast("array<double>"), asc=False), 1, 5)).alias("p"))
    modes = F.create_map(*[x for mode in A.SOFT_MODES for x in (F.lit(mode), A.soft_mode(F.col("p"), mode, 2.0))])
    rows = top.select("vec_id", F.explode(modes).alias("mode", "q"))
    return rows.select("vec_id", "mode", F.posexplode("q").alias("rank", "p")).withColumn("p", F.round("p", 6))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label AS word, i, avg(v) AS v FROM e GROUP BY ALL), n AS (SELECT word, sqrt(sum(v * v)) AS n FROM c GROUP BY word),
m AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY vec_id), s AS (SELECT vec_id, word, sum(e.v * c.v) AS s FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id AS id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s / (m.n * n.n) DESC, word) - 1 AS INT) AS rank, word, round(s / (m.n * n.n), 4) + 0.0 AS cosine FROM s JOIN n USING (word) JOIN m USING (vec_id) QUALIFY rank < 3
""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three label means that each vector is most like."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    vocabulary = means.groupBy(F.col("label").alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return nearest.cosine_top_k(rows.select("id", "v"), vocabulary, 3).withColumn("cosine", F.round("cosine", 4) + 0.0)


@query("SELECT vec_id, round(m + ln(sum(exp(v - m))), 6) + 0.0 AS lse FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings) GROUP BY vec_id, m")
def logsumexp(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rest = F.aggregate(F.transform(v, lambda x: F.exp(x - F.array_max(v))), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", (F.round(F.array_max(v) + F.ln(rest), 6) + 0.0).alias("lse"))


@query("""
SELECT batch, round(avg(loss), 6) AS ce, CAST(count(*) FILTER (loss IS NULL) AS BIGINT) AS without_target
FROM (SELECT l_orderkey % 16 AS batch, l_orderkey, avg(CASE WHEN l_tax > 0 THEN l_discount END) AS loss FROM lineitem GROUP BY ALL) GROUP BY batch
""")
def ce_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of an example's targets, then of a batch's examples; examples
    without a target are told apart."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("loss"))
    examples = rows.groupBy("l_orderkey").agg(F.avg("loss").alias("loss"))
    return examples.groupBy((F.col("l_orderkey") % 16).alias("batch")).agg(F.round(F.avg("loss"), 6).alias("ce"), F.count_if(F.col("loss").isNull()).alias("without_target"))


_SCOPES = "(VALUES ('first_1', 1), ('first_8', 8), ('first_32', 32), ('first_64', 64), ('all', 1 << 30), ('chunk_boundaries', 0)) s(scope, width)"


@query(f"""
SELECT scope, CAST(count(*) AS BIGINT) AS tokens, round(sum(loss) / count(*), 6) AS nll, round(exp(least(sum(loss) / count(*), 20)), 6) AS perplexity
FROM (SELECT l_linenumber AS pos, CAST(l_discount AS DOUBLE) AS loss FROM lineitem), {_SCOPES} WHERE pos <= width OR (scope = 'chunk_boundaries' AND pos % 3 = 1) GROUP BY scope
""")
def scoped_nll(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the first tokens, the starts of chunks and all: one pass, one
    small aggregation."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("pos"), F.col("l_discount").cast("double").alias("loss"))
    out = M.scoped_loss(rows, "pos", "loss", F.col("pos") % 3 == 1)
    return out.select("scope", "tokens", F.round("nll", 6).alias("nll"), F.round("perplexity", 6).alias("perplexity"))


@query(f"""
SELECT doc_id, CAST(f AS INT) AS frontier, array_to_string([-1] || list_transform(range(f), lambda i: -100) || s || [-2], ',') AS input_ids, array_to_string(list_transform(range(f + 1), lambda i: -100) || s || [-2], ',') AS labels
FROM (SELECT doc_id, f, CASE WHEN len(x) <= 16 THEN x ELSE x[1:8] || x[-8:] END AS s FROM (SELECT doc_id, f, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))[ends[f] + 1:] AS x
  FROM (SELECT e.doc_id, text, ends, 1 + e.doc_id % len(ends) AS f FROM ({_EDGES_SQL}) e JOIN documents USING (doc_id))))
""")
def frontier_view(spark: SparkSession, d: str) -> DataFrame:
    """A record seen from one of its frontiers: latent places up to it, then
    the explicit rest within its budget; only the rest has labels."""
    rows = _edges(spark, d).withColumn("frontier", (F.col("doc_id") % F.size("ends") + 1).cast("int"))
    ids = F.transform("t", lambda w: F.length(w))
    rest = F.slice(ids, F.get("ends", F.col("frontier") - 1) + 1, F.col("n"))
    rows = rows.select("doc_id", "frontier", A.head_tail(rest, 16).alias("s"))
    blank, text = F.array_repeat(F.lit(-100), F.col("frontier")), lambda a: F.array_join(a.cast("array<string>"), ",")
    mark = lambda n: F.array(F.lit(n))
    return rows.select("doc_id", "frontier", text(F.concat(mark(-1), blank, "s", mark(-2))).alias("input_ids"), text(F.concat(mark(-100), blank, "s", mark(-2))).alias("labels"))


@query("SELECT vec_id, label FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred vectors, the same for a seed however the table is split; the
    limit is the feature."""
    return table(spark, d, "embeddings").select("vec_id", "label").orderBy(F.md5(F.concat(F.lit("7:"), F.col("vec_id").cast("string")).cast("binary")), "vec_id").limit(100)
