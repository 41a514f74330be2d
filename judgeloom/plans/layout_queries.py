"""Records, views, budgets and seeds, on projections of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arrays as A
from ..operators import blocks, evidence
from ..operators import layout as L
from ..operators import metrics as M
from ..sources.tables import ROLLOUTS_SQL, rollouts, table
from .measure_queries import _EDGES_SQL, _edges
from .registry import query


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS judgment, CASE doc_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS stored FROM documents")
def judgment_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Without a stated verdict, the response named first in the last section."""
    tail = F.when(F.col("doc_id") % 3 == 0, "\n--- Final Judgment ---\nAll in all response b does better than Response A.").when(F.col("doc_id") % 3 == 1, "\n**Final Judgement:** Response A").otherwise("\nFinal thoughts: Response A")
    stored = F.when(F.col("doc_id") % 2 == 0, " Response A ").otherwise("b")
    return table(spark, d, "documents").select("doc_id", T.final_judgment(F.concat(F.coalesce("text", F.lit("")), tail)).alias("judgment"), T.normalise_judgment(stored).alias("stored"))


@query("""
SELECT item_id AS eval_index, CASE WHEN item_id % 3 = 0 THEN 'P' || item_id ELSE 'Judge.' || chr(10) || chr(10) || 'Task' || chr(10) || 'Instruction:' || chr(10) || 'I' || item_id || chr(10) || 'Rubric:' || chr(10) || CASE WHEN item_id % 3 = 1 THEN 'R' ELSE '' END || chr(10) || 'Response A:' || chr(10) || 'a' || chr(10) || 'Response B:' || chr(10) || 'b' END AS problem,
  CASE item_id % 3 WHEN 0 THEN 'Response A' WHEN 1 THEN 'Response B' END AS cot_answer, 'ifbench' AS subset, 'Hard' AS official_subset, item_id % 2 = 0 AS exchange, CASE WHEN item_id % 3 = 2 THEN 'missing rubric' END AS fault FROM benchmark
""")
def eval_record(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 3
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").alias("eval_index"), F.when(k == 0, F.concat(F.lit(" P"), F.col("item_id").cast("string"))).alias("problem"), F.when(k == 0, F.lit("Response A ")).alias("cot_answer"), F.concat(F.lit("I"), F.col("item_id").cast("string")).alias("instruction"),
        F.when(k == 1, "R").otherwise("").alias("rubric"), F.lit("a").alias("response_a"), F.lit(" b").alias("response_b"), F.when(k == 1, F.lit("response_b")).otherwise(F.lit("tie")).alias("label"), F.lit("ifbench").alias("subset"), F.lit("hard").alias("difficulty"), (F.col("item_id") % 2 == 0).alias("exchange"))
    return L.eval_records(rows, "Judge.", "Task")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, dense_rank() OVER (ORDER BY l_orderkey) AS k FROM lineitem) WHERE k <= 100")
def prompt_limit(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the first hundred prompts."""
    return L.first_units(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 100)


@query(f"""
SELECT doc_id, CAST(v AS INT) AS view, CAST(f AS INT) AS frontier, CAST(4 + f AS INT) AS target_start, sha256(array_to_string([1, 2, 3, -1] || list_transform(range(f), lambda i: 0) || t || [-2], ',')) AS input_sha256, sha256(array_to_string(list_transform(range(f + 4), lambda i: -100) || t || [-2], ',')) AS labels_sha256
FROM (SELECT doc_id, v, f, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))[1:ends[f]] AS t FROM (SELECT e.doc_id, v, text, ends, CAST(greatest(1, least(len(ends), ceil(len(ends) * (v + 1) / 4.0))) AS INT) AS f FROM ({_EDGES_SQL}) e JOIN documents USING (doc_id), range(4) r(v)))
""")
def prefix_views(spark: SparkSession, d: str) -> DataFrame:
    """Four views of each record, at quarters of its chunks."""
    rows = _edges(spark, d).select("doc_id", F.transform("t", lambda w: F.length(w)).alias("ids"), "ends", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("view"))
    rows = rows.withColumn("frontier", A.quantile_frontier(F.size("ends"), F.col("view"), 4))
    ids, labels = L.prefix_view(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("ids"), F.col("ends"), F.col("frontier"), [-1], [-2], 0)
    digest = lambda a: F.sha2(F.array_join(a.cast("array<string>"), ","), 256)
    return rows.select("doc_id", "view", "frontier", (F.col("frontier") + 4).alias("target_start"), digest(ids).alias("input_sha256"), digest(labels).alias("labels_sha256"))


@query("""
WITH e AS (SELECT vec_id, embedding AS p, coalesce(lead(embedding) OVER w, first(embedding) OVER w) AS donor FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT vec_id, mode, CASE mode WHEN 'correct' THEN p WHEN 'reverse' THEN list_reverse(p) WHEN 'uniform' THEN list_transform(p, lambda x: 1.0 / len(p)) WHEN 'zero' THEN list_transform(p, lambda x: 0.0) ELSE donor END AS q FROM e, (VALUES ('correct'), ('reverse'), ('uniform'), ('zero'), ('shuffled')) t(mode))
SELECT vec_id, mode, CAST(i - 1 AS INT) AS dim, round(CAST(q[i] AS DOUBLE), 5) + 0.0 AS p FROM m, range(1, 65) r(i)
""")
def latent_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as it is, reversed, even, zero, and its donor's: the next
    one of its label, the first after the last."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("p"))
    donors = blocks.successor(vectors.select("vec_id", "label"), "label", "vec_id", "donor_id")
    rows = vectors.join(donors.select("vec_id", "donor_id"), "vec_id").join(vectors.select(F.col("vec_id").alias("donor_id"), F.col("p").alias("donor")), "donor_id")
    modes = F.create_map(*[x for mode in L.LATENT_MODES for x in (F.lit(mode), L.latent_mode(F.col("p"), F.col("donor"), mode))])
    out = rows.select("vec_id", F.explode(modes).alias("mode", "q")).select("vec_id", "mode", F.posexplode("q").alias("dim", "p"))
    return out.withColumn("p", F.round("p", 5) + 0.0)


@query("""
SELECT doc_id, CAST(b AS INT) AS budget, CASE WHEN b >= 0 THEN array_to_string(CASE WHEN len(t) <= b THEN t ELSE t[1:CAST(ceil(b / 2.0) AS INT)] || t[len(t) - b // 2 + 1:] END, ' ') END AS kept
FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS t, 18 - doc_id % 20 AS b FROM documents)
""")
def budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes cut to what markers, latents and answer leave; null where
    those alone are too long."""
    budget = L.prefix_budget(24, F.lit(2), F.lit(4), F.col("doc_id") % 20).cast("int")
    return table(spark, d, "documents").select("doc_id", budget.alias("budget"), F.array_join(L.head_tail_to(F.split(F.coalesce("text", F.lit("")), " "), budget), " ").alias("kept"))


@query(f"SELECT eval_index, CAST(vote_index AS INT) AS vote_index, CAST(42 + eval_index + vote_index * 1000 AS BIGINT) AS by_rounds, CAST(42 + eval_index * 1009 + vote_index AS BIGINT) AS by_strides FROM ({ROLLOUTS_SQL})")
def seed_schedule(spark: SparkSession, d: str) -> DataFrame:
    rounds, strides = L.seeds(42, F.col("eval_index"), F.col("vote_index"), 1000)
    return rollouts(spark, d).select("eval_index", "vote_index", rounds.alias("by_rounds"), strides.alias("by_strides"))


@query("SELECT doc_id, CAST(i AS INT) AS part, CAST(ceil(n * i / c) AS INT) AS frontier FROM (SELECT doc_id, length(coalesce(text, '')) AS n, doc_id % 7 + 1 AS c FROM documents), LATERAL (SELECT unnest(generate_series(1, c)) AS i)")
def even_frontiers(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.length(F.coalesce("text", F.lit(""))), (F.col("doc_id") % 7 + 1).cast("int")
    return table(spark, d, "documents").select("doc_id", F.posexplode(L.even_frontiers(n, c)).alias("part", "frontier")).withColumn("part", F.col("part") + 1)


@query(f"""
WITH s AS (SELECT doc_id, list_transform(range(1, len(ends) + 1), lambda i: ends[i] - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) AS sizes FROM ({_EDGES_SQL}))
SELECT doc_id, CAST(g AS INT) AS segment, array_to_string(CASE WHEN g = 0 THEN sizes[1:1] ELSE sizes[2:] END, ',') AS sizes FROM s, range(2) r(g)
""")
def regroup_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Chunk sizes by segment: the first chunk, and all others."""
    sizes = A.differences(F.col("ends"))
    groups = L.regroup(sizes, F.array(F.lit(1), F.size("ends") - 1))
    return _edges(spark, d).select("doc_id", F.posexplode(groups).alias("segment", "g")).select("doc_id", "segment", F.array_join(F.col("g").cast("array<string>"), ",").alias("sizes"))


@query(r"""
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(regexp_replace(f[i], '[^\n]', ' ', 'g'), '')), '')) AS masked_sha256
FROM (SELECT doc_id, regexp_extract_all(x, p) AS f, regexp_split_to_array(x, p) AS b FROM (SELECT doc_id, coalesce(text, '') || ' `a b` and $x$ <b>' AS x, '```[\s\S]*?(?:```|\z)|`[^`\n]*`|\$\$[\s\S]*?\$\$|\$[^$\n]+\$|<[^<>\n]+>' AS p FROM documents))
""")
def masked_regions(spark: SparkSession, d: str) -> DataFrame:
    """Code, mathematics and tags as blanks of the same length."""
    x = F.concat(F.coalesce("text", F.lit("")), F.lit(" `a b` and $x$ <b>"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.masked(x, evidence.LITERAL.pattern.replace(r"\Z", r"\z")), 256).alias("masked_sha256"))


@query(f"SELECT eval_index, CAST(count(*) FILTER (prediction = 'Response A') AS BIGINT) AS n_a, CAST(count(*) FILTER (prediction = 'Response B') AS BIGINT) AS n_b, CAST(greatest(count(*) FILTER (prediction = 'Response A'), count(*) FILTER (prediction = 'Response B')) AS BIGINT) AS most FROM ({ROLLOUTS_SQL}) GROUP BY eval_index")
def vote_maps(spark: SparkSession, d: str) -> DataFrame:
    """Counts by label as a map: lookups with a default, the largest value."""
    counts = rollouts(spark, d).groupBy("eval_index", "prediction").agg(F.count("*").alias("n"))
    entry = F.when(F.col("prediction").isNotNull(), F.struct("prediction", "n"))
    maps = counts.groupBy("eval_index").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("long"))
    return maps.select("eval_index", get("Response A").alias("n_a"), get("Response B").alias("n_b"), F.coalesce(F.array_max(F.map_values("m")), F.lit(0).cast("long")).alias("most"))


@query("""
SELECT scope, round(b.nll - a.nll, 6) + 0.0 AS gain FROM (SELECT scope, l_returnflag AS mode, avg(CAST(l_discount AS DOUBLE)) AS nll FROM lineitem, (VALUES ('first_1', 1), ('first_8', 8), ('first_32', 32), ('first_64', 64), ('all', 1 << 30), ('chunk_boundaries', 0)) s(scope, width) WHERE l_linenumber <= width OR (scope = 'chunk_boundaries' AND l_linenumber % 3 = 1) GROUP BY ALL) a
JOIN (SELECT scope, l_returnflag AS mode, avg(CAST(l_discount AS DOUBLE)) AS nll FROM lineitem, (VALUES ('first_1', 1), ('first_8', 8), ('first_32', 32), ('first_64', 64), ('all', 1 << 30), ('chunk_boundaries', 0)) s(scope, width) WHERE l_linenumber <= width OR (scope = 'chunk_boundaries' AND l_linenumber % 3 = 1) GROUP BY ALL) b USING (scope) WHERE a.mode = 'A' AND b.mode = 'N'
""")
def information_gain(spark: SparkSession, d: str) -> DataFrame:
    """What a control loses against the correct latents, by scope."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("pos"), F.col("l_discount").cast("double").alias("loss"), "l_returnflag")
    of = lambda mode, name: M.scoped_loss(rows.where(F.col("l_returnflag") == mode), "pos", "loss", F.col("pos") % 3 == 1).select("scope", F.col("nll").alias(name))
    return of("A", "correct").join(of("N", "control"), "scope").select("scope", (F.round(F.col("control") - F.col("correct"), 6) + 0.0).alias("gain"))


@query("SELECT o_custkey, max(o_orderkey) AS step FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def latest_complete(spark: SparkSession, d: str) -> DataFrame:
    """The last complete step of each run."""
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("step"))
