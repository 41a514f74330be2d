"""Records, requests and names, on projections of the tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, generate, records, settings
from ..operators import metrics as M
from ..operators.traces import spread
from ..sources import benchmarks as B
from ..sources import registry
from ..sources.tables import RESULTS_SQL, results, table
from .registry import query


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'lang' END, 'rubric', CASE WHEN text IS NULL OR length(text) % 2 = 1 THEN 'text' END, CASE WHEN doc_id % 5 < 2 THEN 'winner' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents
""")
def required_columns(spark: SparkSession, d: str) -> DataFrame:
    """The fields that documents, as JSON records of many shapes, don't have."""
    k = F.col("doc_id")
    fields = (k, F.when(k % 7 != 0, F.col("lang")).alias("lang"), F.when(F.length("text") % 2 == 0, F.col("text")).alias("text"), F.when(k % 5 >= 2, "A").alias("winner"))
    record = F.to_json(F.struct(*fields))  # leaves out what is null
    return table(spark, d, "documents").select("doc_id", F.array_join(records.absent(record, ("doc_id", "lang", "rubric", "text", "winner")), ",").alias("missing"))


_WINNER = "CASE doc_id % 6 WHEN 0 THEN 'Model-A' WHEN 1 THEN ' response b ' WHEN 2 THEN 'x: a' WHEN 3 THEN 'tie' WHEN 4 THEN 'B' ELSE 'Assistant_A' END"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw training records, some without a field."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.when(k % 11 == 1, " \t").otherwise(F.concat(F.lit(" Ask "), k.cast("string"))).alias("instruction"), F.when(k % 13 == 2, None).otherwise(F.lit("A rubric ")).alias("rubric"), F.when(k % 17 == 3, "").otherwise(F.col("lang")).alias("response_a"),
        F.when(k % 23 == 5, F.lit(f"x {records.TASK} y")).otherwise(F.col("source")).alias("response_b"), F.concat(F.lit("Reason: "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.when(k % 9 == 4, "\nWinner: Response b ").when(k % 9 == 5, "\nwinner: A\n").when(k % 9 == 6, " and the winner: B").when(k % 9 == 7, "\nWINNER:\tresponse A\nWinner: Response A").otherwise("")).alias("judge"),
        F.expr(_WINNER).alias("winner"))


_REASON = f"CASE WHEN doc_id % 11 = 1 THEN 'empty instruction' WHEN doc_id % 13 = 2 THEN 'empty rubric' WHEN doc_id % 17 = 3 THEN 'empty response_a' WHEN {_WINNER} = 'tie' THEN 'winner' END"


@query(f"SELECT doc_id, reason, CASE WHEN reason IS NULL THEN CAST(row_number() OVER (PARTITION BY reason IS NULL ORDER BY doc_id) - 1 AS BIGINT) END AS source_index FROM (SELECT doc_id, {_REASON} AS reason FROM documents)")
def skipped_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left out with their reason; the others numbered again."""
    kept, skipped = records.split_valid(_raw(spark, d), "doc_id")
    return kept.select("doc_id", F.lit(None).cast("string").alias("reason"), "source_index").unionByName(skipped.withColumn("source_index", F.lit(None).cast("long")))


@query(f"""
WITH r AS (SELECT doc_id, {_WINNER} AS w, 'Reason: ' || regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS j, CASE doc_id % 9 WHEN 6 THEN ' and the winner: B' ELSE '' END AS tail, lang, source, contains(lower(coalesce(text, '')), 'winner:') AS has FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 23 = 5 THEN 'task marker' WHEN doc_id % 9 = 6 OR (has AND doc_id % 9 NOT IN (4, 5, 7)) THEN 'winner lines: 0' WHEN doc_id % 9 = 7 THEN 'winner lines: 2' WHEN doc_id % 9 = 5 THEN 'winner label' END AS fault FROM r)
SELECT doc_id, fault, CASE WHEN fault IS NULL THEN CASE WHEN doc_id % 9 = 4 THEN 'Response B' WHEN doc_id % 6 IN (0, 2, 5) THEN 'Response A' ELSE 'Response B' END END AS cot_answer, CASE WHEN fault IS NULL THEN sha256(trim(j)) END AS cot_sha256,
  CASE WHEN fault IS NULL THEN 'Judge.' || chr(10) || chr(10) || 'Task to Evaluate:' || chr(10) || 'Instruction:' || chr(10) || CASE WHEN doc_id % 11 = 1 THEN '' ELSE 'Ask ' || doc_id END || chr(10) || 'Rubric:' || chr(10) || 'A rubric' || chr(10) || 'Response A:' || chr(10) || CASE WHEN doc_id % 17 = 3 THEN '' ELSE lang END || chr(10) || 'Response B:' || chr(10) || source END AS problem
FROM f WHERE doc_id % 13 <> 2
""")
def training_records(spark: SparkSession, d: str) -> DataFrame:
    """Judges' texts with one line that names the winner, without any, with two,
    or with one that isn't a line of its own."""
    return records.training_records(_raw(spark, d).where("rubric is not null"), "doc_id", "Judge.").select("doc_id", "fault", "cot_answer", F.sha2(F.col("cot").cast("binary"), 256).alias("cot_sha256"), "problem")


@query(f"""
WITH r AS (SELECT doc_id, x, lang, source, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE {_WINNER} END AS w, CASE WHEN doc_id % 3 = 0 THEN 'a' END AS l FROM documents, (VALUES (false), (true)) t(x)),
n AS (SELECT *, CASE WHEN coalesce(nullif(w, ''), l) IS NULL THEN NULL WHEN nullif(w, '') IS NULL THEN 'response_a' WHEN doc_id % 6 IN (0, 2, 5) THEN 'response_a' WHEN doc_id % 6 = 3 THEN NULL ELSE 'response_b' END AS label FROM r)
SELECT doc_id AS id, 'named' AS layout, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source) AS instruction, CASE WHEN x THEN source ELSE lang END AS response_a, CASE WHEN x THEN lang ELSE source END AS response_b,
  CASE WHEN NOT x THEN label WHEN label = 'response_a' THEN 'response_b' WHEN label = 'response_b' THEN 'response_a' END AS label, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS subset, x AS exchange FROM n
UNION ALL SELECT doc_id, 'chosen', lang, CASE WHEN x THEN source ELSE lang END, CASE WHEN x THEN lang ELSE source END, CASE WHEN x THEN 'response_b' ELSE 'response_a' END, 'unknown', x FROM r
""")
def reward_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Both layouts, both ways round, with the label that can be inferred."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    named = docs.select(k.alias("id"), F.when(k % 2 == 0, "").otherwise(F.col("lang")).alias("prompt"), F.col("source").alias("input"), F.col("lang").alias("response_a"), F.col("source").alias("response_b"), F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise(F.expr(_WINNER)).alias("winner"), F.when(k % 3 == 0, "a").alias("label"), F.when(k % 5 == 0, "").otherwise(F.col("lang")).alias("category"))
    chosen = docs.select(k.alias("id"), F.col("lang").alias("question"), F.col("lang").alias("chosen"), F.col("source").alias("rejected"))
    out = None
    for layout, rows in (("named", named), ("chosen", chosen)):
        for exchange in (False, True):
            part = records.reward_pairs(rows, exchange).withColumn("layout", F.lit(layout))
            out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') ORDER BY doc_id LIMIT 50")
def requested_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Subsets by their names, which must be there; the limit is the feature."""
    return records.select_subsets(table(spark, d, "documents").select("doc_id", "lang"), records.parse_names("fr, de,,fr "), "lang", "doc_id", 50)


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'domain' END, CASE WHEN doc_id % 9 - 4 NOT BETWEEN -3 AND 3 THEN 'preference' END, CASE WHEN doc_id % 5 NOT IN (3) THEN 'chosen_styles' END, CASE WHEN doc_id % 7 = 0 THEN 'text' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents
""")
def format_violations(spark: SparkSession, d: str) -> DataFrame:
    """All rules that a row breaks: names, ranges, lengths of lists, blanks."""
    rows = table(spark, d, "documents")
    k = F.col("doc_id")
    rules = {"domain": F.col("lang").isin("en", "de"), "preference": (k % 9 - 4).between(-3, 3), "chosen_styles": F.size(F.sequence(F.lit(0), (k % 5).cast("int"))) == 4, "text": F.length(T.strip(F.when(k % 7 == 0, " \n").otherwise("x"))) > 0}
    return rows.select("doc_id", F.array_join(records.violations(rows, **rules), ",").alias("broken"))


@query("""
SELECT item_id AS dataset_index, CAST(item_id AS VARCHAR) AS source_id, CASE WHEN item_id % 3 = 0 THEN 'hard' WHEN item_id % 3 = 1 THEN 'normal' ELSE 'simple' END AS difficulty, CAST(item_id % 3 + 1 AS INT) AS unsatisfied_constraint_count,
  'Select the response that follows every requirement in the instruction. A response satisfying all constraints is better than one violating any constraint. Evaluate these requirements:' || chr(10) || '1. The response must be brief ' || item_id || '.' || chr(10) || '2. The response must cite.' || CASE WHEN item_id % 2 = 0 THEN chr(10) || '3. The response must use code.' ELSE '' END AS rubric FROM benchmark
""")
def constraint_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nested lists of constraints as one numbered text."""
    k = F.col("item_id")
    one = lambda c: F.struct(c.alias("constraint"))
    code = F.when(k % 2 == 0, F.array(one(F.lit("use code")))).otherwise(F.array().cast("array<struct<constraint: string>>"))
    answer = lambda text, n: F.struct(F.lit(text).alias("content"), F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("string")).alias("unsatisfied_constraints"))
    none = F.struct(F.lit("good").alias("content"), F.array().cast("array<string>").alias("unsatisfied_constraints"))
    rows = table(spark, d, "benchmark").select(k.alias(B.SOURCE), k.alias("id"), F.lit("").alias("source"), F.lit(" ask ").alias("instruction"), F.array(one(F.concat(F.lit(" be brief "), k.cast("string"), F.lit(".. "))), one(F.lit("cite"))).alias("llm_constraints_used"), code.alias("code_constraints_used"), none.alias("chosen"), answer("bad", (k % 3).cast("int")).alias("rejected"))
    return B.constraint_pairs(rows).select("dataset_index", "source_id", "difficulty", "unsatisfied_constraint_count", "rubric")


@query("SELECT doc_id, 'lang=' || lang || CASE WHEN doc_id % 2 = 0 THEN ',source=' || source ELSE '' END AS entries FROM documents")
def without_rubric(spark: SparkSession, d: str) -> DataFrame:
    """Records of several shapes without their rubric, which some don't have."""
    pairs = lambda *names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col("text" if n == "rubric" else n) for n in names]))
    k = F.col("doc_id") % 4
    entries = F.when(k == 0, pairs("lang", "rubric", "source")).when(k == 1, pairs("rubric", "lang")).when(k == 2, pairs("lang", "source")).otherwise(pairs("lang"))
    kept = F.transform(F.array_sort(F.map_entries(records.without(entries, "rubric"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, ",").alias("entries"))


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal / 1000 <= 0 THEN 'gumbel_temperature' END, CASE WHEN c_nationkey <> 7 AND c_nationkey - 5 <= 0 THEN 'max_samples' END, CASE WHEN 100 + c_custkey % 400 <= 264 THEN 'max_total_length' END, CASE WHEN c_acctbal < 0 THEN 'noise_scale' END, CASE WHEN c_custkey % 4 - 1 <= 0 THEN 'vote' END], lambda x: x IS NOT NULL), ',') AS faults FROM customer
""")
def argument_checks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as settings of runs, with those that can't be."""
    k, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    faults = settings.row_faults(vote=k % 4 - 1, max_samples=F.when(nation != 7, nation - 5), gumbel_temperature=balance / 1000, noise_scale=balance, max_total_length=100 + k % 400)
    return table(spark, d, "customer").select("c_custkey", F.array_join(faults, ",").alias("faults"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'semantic' END AS use, CASE WHEN doc_id % 3 = 2 THEN 'Unknown use: ' || lang || ' ' || source END AS fault FROM documents")
def normalized_use(spark: SparkSession, d: str) -> DataFrame:
    """The use that each document names, however it is written, or why it has none."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.lit(" Semantic\n")).when(k == 1, F.lit("SEMANTIC")).otherwise(F.concat("lang", F.lit(" "), "source"))
    use = settings.use(raw)
    return table(spark, d, "documents").select("doc_id", use.alias("use"), F.when(use.isNull(), F.concat(F.lit("Unknown use: "), raw)).alias("fault"))


@query("""
SELECT doc_id, CAST(len(p) AS INT) AS n, sha256(array_to_string(CASE WHEN len(p) <= b THEN p ELSE p[1:CAST(ceil(b / 2.0) AS INT)] || p[len(p) - b // 2 + 1:] END, ' ')) AS prefix_sha256
FROM (SELECT doc_id, p, 300 - len(t) AS b FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS t, string_split(source || ' ' || coalesce(text, ''), ' ') AS p FROM documents)) WHERE b >= 0
""")
def within_length(spark: SparkSession, d: str) -> DataFrame:
    """Records with a target over 300 tokens go; the prefix of the others is cut
    to what is left."""
    words = lambda c: F.split(c, " ")
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", words(text).alias("target"), words(F.concat("source", F.lit(" "), text)).alias("prefix"))
    cut = records.within_length(rows.withColumn("n", F.size("prefix")), "prefix", "target", 300)
    return cut.select("doc_id", "n", F.sha2(F.array_join("prefix", " ").cast("binary"), 256).alias("prefix_sha256"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS request_id, 'Rubric of ' || min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS rubric FROM documents")
def request_join(spark: SparkSession, d: str) -> DataFrame:
    """One rubric for each different instruction, by its digest, shared by all
    of its pairs."""
    pairs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("instruction"))
    rubrics = pairs.groupBy(records.request_id(pairs).alias("request_id")).agg(F.concat(F.lit("Rubric of "), F.min("doc_id").cast("string")).alias("rubric"))
    return records.with_rubrics(pairs, rubrics).select("doc_id", "request_id", "rubric")


@query("""
WITH w AS (SELECT doc_id, k, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS stop FROM (SELECT doc_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS t FROM documents))),
q AS (SELECT doc_id, unnest(range(100, length(coalesce(text, '')) + 1, 100)) AS b FROM documents)
SELECT q.doc_id, CAST(b AS BIGINT) AS char_at, CAST(coalesce(k, 0) AS BIGINT) AS token FROM q ASOF LEFT JOIN w ON q.doc_id = w.doc_id AND q.b >= w.stop
""")
def token_at(spark: SparkSession, d: str) -> DataFrame:
    """The token that each hundredth character falls into: the first that ends
    after it.  Ends are counted by hundreds, then summed up."""
    t = F.split(F.coalesce("text", F.lit("")), " ")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(t).alias("k", "word"))
    order = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("doc_id", (F.sum(F.length("word") + 1).over(order) - 1).alias("stop"))
    by = ends.groupBy("doc_id", F.ceil(F.col("stop") / 100).alias("block")).agg(F.count("*").alias("n"))
    wanted = table(spark, d, "documents").select("doc_id", F.floor(F.length(F.coalesce("text", F.lit(""))) / 100).alias("last")).where("last > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("block"))
    both = by.withColumn("asked", F.lit(False)).unionByName(wanted.select("doc_id", "block", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    sums = both.withColumn("token", F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rangeBetween(Window.unboundedPreceding, 0)))
    return sums.where("asked").select("doc_id", (F.col("block") * 100).alias("char_at"), "token")


_DEFAULTS = ", ".join(f"('{b}', '{s}', {k})" for b, names in registry.DEFAULT_SUBSETS.items() for k, s in enumerate(names))
_SUBSETS = [s for names in registry.DEFAULT_SUBSETS.values() for s in names] + ["other"]
_numbered = lambda names: ", ".join(f"({k}, '{n}')" for k, n in enumerate(names))


@query(f"""
WITH d AS (SELECT * FROM (VALUES {_DEFAULTS}) t(benchmark, subset, place) UNION ALL SELECT benchmark, NULL, NULL FROM (VALUES ('ppe-ifeval'), ('ifbench'), ('helpsteer3')) t(benchmark)),
r AS (SELECT b.name AS benchmark, s.name AS subset FROM lineitem JOIN (VALUES {_numbered(registry.BENCHMARKS)}) b(k, name) ON b.k = l_suppkey % {len(registry.BENCHMARKS)} JOIN (VALUES {_numbered(_SUBSETS)}) s(k, name) ON s.k = l_partkey % {len(_SUBSETS)})
SELECT d.benchmark, d.subset, CAST(place AS INT) AS place, count(r.benchmark) AS n FROM d LEFT JOIN r ON r.benchmark = d.benchmark AND (d.subset IS NULL OR r.subset = d.subset) GROUP BY ALL
""")
def benchmark_registry(spark: SparkSession, d: str) -> DataFrame:
    """The benchmarks and the subsets that count unless others are asked for,
    with the line items that are theirs."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(pick(registry.BENCHMARKS, F.col("l_suppkey")).alias("benchmark"), pick(_SUBSETS, F.col("l_partkey")).alias("subset"))
    return registry.counted(rows)


@query("""
SELECT l_orderkey AS source_index, CASE WHEN o_orderkey IS NULL THEN 'out of range' ELSE 'twice' END AS fault, count(*) AS n FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderkey HAVING o_orderkey IS NULL OR count(*) > 1
""")
def index_faults(spark: SparkSession, d: str) -> DataFrame:
    """Line items as results of the orders that aren't pending: those of none,
    and orders with several."""
    data = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("source_index"))
    return records.index_faults(results(spark, d), data, "source_index")


@query("SELECT doc_id, quality, toxic, lang, source FROM labels JOIN documents USING (doc_id)")
def indexed_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the source and language of their documents; one without a
    document would be an error."""
    return records.joined_by_index(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(f"""
WITH r AS ({RESULTS_SQL}), m AS (SELECT 'rm-bench' AS benchmark, 'Score' AS name, avg(a) AS score FROM (SELECT domain, avg(a) AS a FROM (SELECT domain, difficulty, avg(CAST(correct AS INT)) AS a FROM r GROUP BY ALL) GROUP BY domain)
UNION ALL SELECT 'helpsteer3', 'Score', avg(CAST(correct AS INT)) FROM r UNION ALL SELECT 'ppe-ifeval', 'Score', avg(CAST(correct AS INT)) FROM r UNION ALL SELECT 'ifbench', 'Score', avg(CAST(correct AS INT)) FROM r)
SELECT benchmark, name, round(100 * score, 6) AS score_percent FROM m
""")
def benchmark_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The same results as four benchmarks would score them."""
    out = None
    rows = results(spark, d)
    for name in ("rm-bench", "helpsteer3", "ppe-ifeval", "ifbench"):
        part = registry.summarise(name, rows).select(F.lit(name).alias("benchmark"), "name", F.round(100 * F.col("score"), 6).alias("score_percent"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, sha256('<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END) AS prefix_sha256 FROM documents")
def chat_prefix(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    both = F.when(F.col("doc_id") % 2 == 0, records.chat_prefix(text, thinking=False)).otherwise(records.chat_prefix(text))
    return table(spark, d, "documents").select("doc_id", F.sha2(both.cast("binary"), 256).alias("prefix_sha256"))


_LEXEME = r"\p{Nd}+(?:[.,]\p{Nd}+)+|[\p{L}\p{M}\p{Nd}\p{Pc}]+(?:['’][\p{L}\p{M}\p{Nd}\p{Pc}]+)*"
_BINDS = "because although unless whereas however therefore but and or if not never no".split()


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS lexemes, sha256(array_to_string(w, '|')) AS lexemes_sha256, CAST(len(list_filter(w, lambda x: lower(x) IN {tuple(_BINDS)})) AS INT) AS connectives FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_LEXEME.replace(chr(39), chr(39) * 2)}') AS w FROM documents)")
def lexemes(spark: SparkSession, d: str) -> DataFrame:
    """Words and numbers as they are kept whole, and those that bind."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_LEXEME), F.lit(0))
    found = table(spark, d, "documents").select("doc_id", w.alias("w"))
    return found.select("doc_id", F.size("w").alias("lexemes"), F.sha2(F.array_join("w", "|").cast("binary"), 256).alias("lexemes_sha256"), F.size(F.filter("w", lambda x: F.lower(x).isin(_BINDS))).alias("connectives"))


@query("SELECT o_orderkey, CAST(o_orderkey * 10 AS BIGINT) AS start, CAST(o_orderkey * 10 + o_custkey AS BIGINT) AS stop, CAST(3 AS INT) AS names FROM orders")
def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    """Ranges from the names of shard files, and lists between commas."""
    name = F.concat(F.lit("/data/batch_"), (F.col("o_orderkey") * 10).cast("string"), F.lit("_"), (F.col("o_orderkey") * 10 + F.col("o_custkey")).cast("string"), F.lit(".pt"))
    start, stop = T.shard_range(name)
    return table(spark, d, "orders").select("o_orderkey", start.alias("start"), stop.alias("stop"), F.size(T.listed(F.lit(" a, b,,a ,c"))).alias("names"))


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, n in zip(pdf["o_orderkey"], pdf["n"], strict=True):
            words = [evidence.Word(10 * i, 10 * i + 9, (i + 1) // 2 - 1 if i else 0, "conj" if i % 2 else "advcl", "VERB" if i % 5 else "NOUN") for i in range(n)]
            out += [(key, i, *(span or (None, None))) for i, span in enumerate(evidence.clause_spans("x" * 10 * n, words))]
        yield pd.DataFrame(out, columns=["o_orderkey", "word", "start", "stop"]).astype({"start": "Int64", "stop": "Int64"})


@query("""
WITH RECURSIVE n AS (SELECT l_orderkey AS k, CAST(count(*) * 2 AS INT) AS n FROM lineitem GROUP BY 1), w AS (SELECT k, CAST(unnest(range(n)) AS INT) AS i FROM n),
up AS (SELECT k, i, i AS a FROM w UNION ALL SELECT k, i, (a + 1) // 2 - 1 FROM up WHERE a > 0), s AS (SELECT k, a, min(i) AS lo, max(i) AS hi, count(*) AS c FROM up GROUP BY ALL)
SELECT k AS o_orderkey, a AS word, CASE WHEN ok THEN CAST(10 * lo AS BIGINT) END AS start, CASE WHEN ok THEN CAST(10 * hi + 9 AS BIGINT) END AS stop FROM (SELECT *, hi - lo + 1 = c AND a % 5 <> 0 AS ok FROM s)
""")
def clause_spans(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of made-up parses: a word's head is the one at half its place."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") * 2).cast("int").alias("n"))
    return rows.mapInPandas(_trees, "o_orderkey long, word int, start long, stop long")


@query("SELECT item_id, 'Winner: Response ' || CASE WHEN CAST('0x' || substr(sha256(text), 1, 2) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS output FROM benchmark")
def generated(spark: SparkSession, d: str) -> DataFrame:
    """Prompts through a generator, here the stub."""
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return generate.generate(rows, lambda: generate.stub).select("item_id", "output")


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        frontiers = [1 + int.from_bytes(hashlib.blake2b(f"42:{i}:{v}".encode(), digest_size=8).digest(), "little") % c for i, v, c in zip(pdf["doc_id"], pdf["view"], pdf["count"], strict=True)]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "view": pdf["view"], "frontier": frontiers})


@query()
def seeded_frontiers(spark: SparkSession, d: str) -> DataFrame:
    """Frontiers by a digest of seed, record and view, as published: eight bytes
    of BLAKE2b, which no SQL function gives."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    rows = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("view"), F.ceil(n / 8).cast("int").alias("count"))
    return spread(rows).mapInPandas(_digested, "doc_id long, view int, frontier long")


@query("SELECT user_id, CAST(sum(CASE WHEN k IS NOT NULL AND event_type <> 'error' THEN k END) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS rows FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id")
def extracted_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Totals of whatever number a given expression takes from a row."""
    count = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("long"))
    return M.token_totals(table(spark, d, "events"), "user_id", count)
