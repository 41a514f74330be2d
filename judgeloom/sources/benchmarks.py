"""Six pairwise benchmarks as one table of judged pairs.

Each builder takes the source rows with a ``source_dataset_index`` and gives
(dataset_index, source_dataset_index, subset, exchange, instruction,
response_a, response_b, label, ...).  A row that breaks its format's rules
raises when it is read.  ``both_directions`` adds every pair the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SOURCE = "source_dataset_index"
# The rubrics and limits that the benchmarks are judged by.
IFEVAL_RUBRIC = "Select the response that follows every explicit instruction in the user prompt. A response satisfying all constraints is better than one that violates any constraint. Judge only instruction-following compliance."
STYLE_RUBRIC = "Decide which response is better for the user prompt. You may consider any criteria appropriate. Judge substantive response quality rather than response length, level of detail, or Markdown formatting."
CONSTRAINT_RUBRIC = "Select the response that follows every requirement in the instruction. A response satisfying all constraints is better than one violating any constraint. Evaluate these requirements:\n"
HELPFUL_RUBRIC = "Choose the response that is more helpful overall. Prioritize instruction following and factual correctness/completeness, then relevance, coherence, clarity, and appropriate style. Response length alone is not evidence of higher quality."
HELPFUL_DOMAINS = ("general", "stem", "code", "multilingual")
ROLES = ("system", "user", "assistant")
STYLES = 3
CONSTRAINTS = (2, 5)


def demand(rows: DataFrame, **rules: Column) -> DataFrame:
    """The rows; one that breaks a rule (or has null for it) is an error that
    names the rule."""
    for name, rule in rules.items():
        fail = F.raise_error(F.concat(F.lit(f"{name}: row "), F.coalesce(F.col(SOURCE).cast("string"), F.lit("?"))))
        rows = rows.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(fail.cast("boolean")))
    return rows


def dense_index(rows: DataFrame, *order: str, block: int = 10_000) -> DataFrame:
    """dataset_index from 0 in the given order.  Rows are counted by blocks of
    source rows; only the block totals pass through one task."""
    rows = rows.withColumn("_block", F.floor(F.col(SOURCE) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    return rows.join(starts, "_block").withColumn("dataset_index", F.col("_start") + place).drop("_block", "_start")


def both_directions(pairs: DataFrame) -> DataFrame:
    """Originals, and each with its responses and label exchanged."""
    swapped = {
        "exchange": F.lit(True),
        "response_a": F.col("response_b"),
        "response_b": F.col("response_a"),
        "label": F.when(F.col("label") == "response_a", "response_b").otherwise("response_a"),
    }
    return pairs.unionByName(demand(pairs, not_exchanged_yet=~F.col("exchange")).withColumns(swapped))


def as_list(x: Column, kind: str) -> Column:
    """A list written as text, in brackets or parentheses, as an array."""
    plain = F.translate(x, "()", "[]")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(F.regexp_replace(plain, r",\s*\]", "]"), f"array<{kind}>")


def _all_filled(xs: Column) -> Column:
    return (F.size(xs) > 0) & F.forall(xs, lambda x: F.length(T.strip(F.coalesce(x, F.lit("None")))) > 0)


def _filled(x: Column) -> Column:
    return x.isNotNull() & (F.length(T.strip(x)) > 0)


def chosen_rejected(rows: DataFrame, exchange: bool = False) -> DataFrame:
    """One chosen and one rejected response a row; exchanged ones are relabelled."""
    rows = demand(rows, instruction=F.col("prompt").isNotNull(), responses=F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    a, b = ("rejected", "chosen") if exchange else ("chosen", "rejected")
    return rows.select(
        F.col(SOURCE).alias("dataset_index"), SOURCE, F.coalesce(F.nullif("subset", F.lit("")), F.lit("unknown")).alias("subset"), F.lit(exchange).alias("exchange"),
        F.col("prompt").alias("instruction"), F.col(a).alias("response_a"), F.col(b).alias("response_b"), F.lit("response_b" if exchange else "response_a").alias("label"))


def grouped_prompts(rows: DataFrame, subsets: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Every chosen with every rejected response of a prompt; a limit counts
    prompts of the subsets asked for."""
    rows = rows.withColumn("subset", F.coalesce(F.nullif("subset", F.lit("")), F.lit("unknown")))
    if subsets is not None:
        rows = rows.where(F.col("subset").isin(subsets))
    if limit is not None:
        rows = rows.orderBy(SOURCE).limit(limit)
    rows = demand(rows, missing_prompt=F.col("prompt").isNotNull() & (F.col("prompt") != ""), chosen=_all_filled(F.col("chosen")), rejected=_all_filled(F.col("rejected")))
    counts = {"num_correct": F.size("chosen"), "num_incorrect": F.size("rejected"), "total_completions": F.size("chosen") + F.size("rejected")}
    pairs = rows.withColumns(counts).select("*", F.posexplode("chosen").alias("chosen_index", "response_a")).select("*", F.posexplode("rejected").alias("rejected_index", "response_b"))
    pairs = pairs.select(
        SOURCE, F.coalesce(F.col("id").cast("string"), F.col(SOURCE).cast("string")).alias("prompt_id"), "chosen_index", "rejected_index", *counts, "subset",
        F.lit(False).alias("exchange"), F.col("prompt").alias("instruction"), "response_a", "response_b", F.lit("response_a").alias("label"))
    return dense_index(pairs, SOURCE, "chosen_index", "rejected_index")


def conflict_pairs(rows: DataFrame, n_responses: int) -> DataFrame:
    """Sampled pairs of responses, one of which is right; scores and pairs as
    arrays or as text."""
    kinds = dict(rows.dtypes)
    scores = as_list(F.col("scores"), "boolean") if kinds["scores"] == "string" else F.col("scores")
    pairs = as_list(F.col("sampled_conflict_pairs"), "array<int>") if kinds["sampled_conflict_pairs"] == "string" else F.col("sampled_conflict_pairs")
    responses = F.array(*[F.col(f"response_{i + 1}") for i in range(n_responses)])
    rows = demand(rows.withColumns({"scores": scores, "pairs": pairs, "responses": responses}), lists=F.col("scores").isNotNull() & F.col("pairs").isNotNull())
    rows = rows.select("*", F.posexplode("pairs").alias("pair_index", "pair"))
    left, right = F.get("pair", F.lit(0)), F.get("pair", F.lit(1))
    rows = demand(rows, two_indices=F.size("pair") == 2)
    rows = rows.withColumns({"left_response_index": left, "right_response_index": right})
    inside = lambda i: (F.col(i) >= 0) & (F.col(i) < F.size("scores"))
    rows = demand(rows, index_out_of_range=inside("left_response_index") & inside("right_response_index"))
    score = lambda i: F.coalesce(F.get("scores", F.col(i)), F.lit(False))
    rows = demand(rows, no_conflict=score("left_response_index") != score("right_response_index"))
    out = rows.select(
        SOURCE, F.col("question_id").cast("string").alias("question_id"), "pair_index", "left_response_index", "right_response_index",
        F.coalesce(F.nullif("model_name", F.lit("")), F.lit("unknown")).alias("model_name"), F.lit("ppe-ifeval").alias("subset"), F.lit(False).alias("exchange"),
        F.col("prompt").alias("instruction"), F.lit(IFEVAL_RUBRIC).alias("rubric"), F.get("responses", F.col("left_response_index")).alias("response_a"),
        F.get("responses", F.col("right_response_index")).alias("response_b"), F.when(score("left_response_index"), "response_a").otherwise("response_b").alias("label"))
    return dense_index(out, SOURCE, "pair_index")


def constraint_pairs(rows: DataFrame) -> DataFrame:
    """A response that meets all constraints against one that doesn't."""
    texts = F.transform(F.concat("llm_constraints_used", "code_constraints_used"), lambda c: T.strip(c["constraint"]))
    broken = F.size("rejected.unsatisfied_constraints")
    rows = rows.withColumns({"constraints": texts, "unsatisfied_constraint_count": broken})
    rows = demand(
        rows, instruction=_filled(F.col("instruction")), chosen=_filled(F.col("chosen.content")), rejected=_filled(F.col("rejected.content")), chosen_breaks_none=F.size("chosen.unsatisfied_constraints") == 0,
        rejected_breaks_one=F.col("unsatisfied_constraint_count") > 0, constraint_count=F.size("constraints").between(*CONSTRAINTS), constraint_text=F.forall("constraints", lambda c: F.coalesce(c != "", F.lit(False))))
    rows = demand(rows.withColumn("_times", F.count("*").over(Window.partitionBy("id"))), duplicate_id=F.col("_times") == 1)
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". The response must "), F.rtrim(c, F.lit(".")), F.lit("."))
    rubric = F.concat(F.lit(CONSTRAINT_RUBRIC), F.array_join(F.transform("constraints", line), "\n"))
    out = rows.select(
        SOURCE, F.col("id").cast("string").alias("source_id"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"), F.lit("ifbench").alias("subset"),
        T.difficulty_by_violations(F.col("unsatisfied_constraint_count")).alias("difficulty"), "unsatisfied_constraint_count", F.lit(False).alias("exchange"), T.strip(F.col("instruction")).alias("instruction"),
        rubric.alias("rubric"), F.col("chosen.content").alias("response_a"), F.col("rejected.content").alias("response_b"), F.lit("response_a").alias("label"))
    return dense_index(out, SOURCE)


def style_pairs(rows: DataFrame) -> DataFrame:
    """Three styles of the chosen against three of the rejected response."""
    rows = demand(rows.withColumn("domain", T.normalise_domain(F.col("domain"))), chosen_styles=F.size("chosen") == STYLES, rejected_styles=F.size("rejected") == STYLES, prompt=_filled(F.col("prompt")), domain=F.col("domain").isNotNull())
    pairs = rows.select("*", F.posexplode("chosen").alias("chosen_style", "response_a")).select("*", F.posexplode("rejected").alias("rejected_style", "response_b"))
    place = F.col(SOURCE) * STYLES**2 + F.col("chosen_style") * STYLES + F.col("rejected_style")
    return pairs.select(
        place.alias("dataset_index"), SOURCE, F.coalesce(F.col("id").cast("string"), F.col(SOURCE).cast("string")).alias("source_id"), F.concat(F.lit("rm-bench-"), "domain").alias("subset"), "domain",
        T.difficulty_by_styles(F.col("chosen_style"), F.col("rejected_style")).alias("difficulty"), "chosen_style", "rejected_style", F.lit(False).alias("exchange"),
        T.strip(F.col("prompt")).alias("instruction"), F.lit(STYLE_RUBRIC).alias("rubric"), "response_a", "response_b", F.lit("response_a").alias("label"))


def rendered_context(messages: Column) -> Column:
    """A conversation as text, each turn under its role."""
    turn = lambda m: F.concat(F.initcap(F.lower(T.strip(m["role"]))), F.lit(":\n"), T.strip(m["content"]))
    return F.concat(F.lit("Conversation context:\n\n"), F.array_join(F.transform(messages, turn), "\n\n"))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with a signed preference; negative ones prefer the first response.
    Ties, and rows without one of the responses, are left out."""
    rows = rows.withColumn("domain", F.lower(T.strip(F.coalesce("domain", F.lit("")))))
    rows = demand(rows, domain=F.col("domain").isin(*HELPFUL_DOMAINS), preference=F.col("overall_preference").between(-3, 3))
    rows = rows.where((F.col("overall_preference") != 0) & _filled(F.col("response1")) & _filled(F.col("response2")))
    told = lambda m: F.coalesce(F.lower(T.strip(m["role"])).isin(*ROLES) & m["content"].isNotNull(), F.lit(False))
    rows = demand(rows, context=(F.size("context") > 0) & F.forall("context", told))
    out = rows.select(
        SOURCE, F.concat(F.lit("helpsteer3-"), "domain").alias("subset"), "domain", F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language"),
        F.abs("overall_preference").alias("preference_strength"), "overall_preference", F.lit(False).alias("exchange"), rendered_context(F.col("context")).alias("instruction"),
        F.lit(HELPFUL_RUBRIC).alias("rubric"), F.col("response1").alias("response_a"), F.col("response2").alias("response_b"),
        F.when(F.col("overall_preference") < 0, "response_a").otherwise("response_b").alias("label"))
    return dense_index(out, SOURCE)


def preference_counts(rows: DataFrame) -> DataFrame:
    """(domain, source, ties, scored) of the rows before and after."""
    scored = (F.col("overall_preference") != 0) & _filled(F.col("response1")) & _filled(F.col("response2"))
    return rows.groupBy(F.lower(T.strip(F.col("domain"))).alias("domain")).agg(F.count("*").alias("source"), F.count_if(F.col("overall_preference") == 0).alias("ties"), F.count_if(scored).alias("scored"))
