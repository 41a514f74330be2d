"""Records checked, converted, and told why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import benchmarks as B

# What separates a judge's preamble from its task.
TASK = "Task to Evaluate:"
#: The five fields that a training record needs.
REQUIRED = ("instruction", "rubric", "response_a", "response_b", "judge")


def missing_columns(rows: DataFrame, needed: tuple[str, ...]) -> list[str]:
    return sorted(set(needed) - set(rows.columns))


def absent(record: Column, needed: tuple[str, ...]) -> Column:
    """The names, in order, that a record in JSON doesn't have; all of them if it
    is null or no object."""
    names = F.array(*[F.lit(n) for n in sorted(needed)])
    return F.array_except(names, F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")))


def without(entries: Column, *names: str) -> Column:
    """A map without some names, which it may not have."""
    return F.map_filter(entries, lambda k, _: ~k.isin(*names))


def _once(rows: DataFrame, key: str, row: str, n: str) -> DataFrame:
    """(key, row, n): one row of each key and how many there are, counted before
    the shuffle."""
    return rows.groupBy(F.col(key).alias(key)).agg(F.any_value(F.struct(*[F.col(c) for c in rows.columns if c != key], F.lit(1).alias("_there"))).alias(row), F.count("*").alias(n))


def _matched(results: DataFrame, data: DataFrame, key: str) -> tuple[DataFrame, Column]:
    both = _once(results, key, "_result", "_n").join(_once(data, key, "_data", "_places"), key, "left")
    return both, F.when(F.col("_places").isNull(), "out of range").when(F.col("_places") > 1, "twice in the data").when(F.col("_n") > 1, "twice")


def index_faults(results: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """(key, fault, n): indexes of results that the data doesn't have (null is
    one), has twice, or that come twice themselves."""
    both, fault = _matched(results, data, key)
    return both.select(key, fault.alias("fault"), F.col("_n").alias("n")).where("fault is not null")


def joined_by_index(results: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Results with the columns of the row that they were made from, by its index.

    Unlike an inner join, an index that has a fault stops the job and is named."""
    both, fault = _matched(results, data, key)
    stop = F.raise_error(F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), fault))
    # a filter, since columns that nobody reads aren't worked out
    kept = both.where(F.when(fault.isNotNull(), stop.cast("boolean")).otherwise(True))
    mine = [c for c in results.columns if c != key]
    return kept.select(key, *[F.col(f"_result.`{c}`").alias(c) for c in mine], *[F.col(f"_data.`{c}`").alias(c) for c in data.columns if c != key and c not in mine])


def reason(rows: DataFrame) -> Column:
    """Why a row is skipped: the first required field without text, or a winner
    that isn't one of two; null if it isn't."""
    out = F
    for name in REQUIRED:
        out = out.when(F.length(T.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))) == 0, f"empty {name}")
    return out.when(T.normalise_winner(T.strip(F.col("winner"))).isNull(), "winner")


def split_valid(rows: DataFrame, index: str) -> tuple[DataFrame, DataFrame]:
    """The valid rows, numbered again from 0, and (index, reason) of the others."""
    judged = rows.withColumn("_reason", reason(rows)).withColumn(B.SOURCE, F.col(index))
    kept = B.dense_index(judged.where("_reason is null").drop("_reason"), index).withColumnRenamed("dataset_index", "source_index").drop(B.SOURCE)
    return kept, judged.where("_reason is not null").select(F.col(index), F.col("_reason").alias("reason"))


def training_records(rows: DataFrame, index: str, preamble: str) -> DataFrame:
    """(index, problem, cot, cot_answer, fault): the prompt, the judge's text
    without its one line that names the winner, and that name.  A judge that
    doesn't name any gets a line from the column ``winner``.  ``fault`` says what
    keeps a record from being one; the rest of it is null then."""
    parts = (("Instruction", "instruction"), ("Rubric", "rubric"), ("Response A", "response_a"), ("Response B", "response_b"))
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{name}:\n"), T.strip(F.col(c))) for name, c in parts])
    judge = T.strip(F.col("judge"))
    named = F.when(T.normalise_winner(T.strip(F.col("winner"))) == "response_a", "A").otherwise("B")
    whole = F.when(F.lower(judge).contains("winner:"), judge).otherwise(F.concat(judge, F.lit("\nWinner: Response "), named))
    line = r"(?im)(?d)^[ \t]*Winner:[ \t]*(.*?)[ \t]*$"
    rows = rows.select(index, body.alias("body"), whole.alias("whole"), F.regexp_extract_all(whole, F.lit(line), F.lit(1)).alias("lines"))
    label = F.regexp_extract(T.strip(F.get("lines", F.lit(0))), r"^(?i)Response[ \t]+([AB])$", 1)
    cot = T.strip(F.regexp_replace("whole", line, ""))
    fault = F.when(F.col("body").contains(TASK), "task marker").when(F.size("lines") != 1, F.concat(F.lit("winner lines: "), F.size("lines").cast("string"))).when(label == "", "winner label").when(cot == "", "no reasoning")
    rows = rows.select(index, "body", cot.alias("cot"), F.upper(label).alias("label"), fault.alias("fault"))
    good = lambda c: F.when(F.col("fault").isNull(), c)
    problem = F.concat(F.lit(f"{preamble}\n\n{TASK}\n"), F.col("body"))
    return rows.select(index, good(problem).alias("problem"), good(F.col("cot")).alias("cot"), good(F.concat(F.lit("Response "), F.col("label"))).alias("cot_answer"), "fault")


def inferred_label(rows: DataFrame) -> Column:
    """response_a or response_b, by the first of winner, label and chosen_label
    that is given; without any, the first response where the columns are a chosen
    and a rejected one; null if the given one names neither."""
    links = [F.nullif(F.col(c), F.lit("")) for c in ("winner", "label", "chosen_label") if c in rows.columns]
    given = F.coalesce(*links, F.lit(None).cast("string"))
    otherwise = F.lit("response_a") if {"chosen", "rejected"} <= set(rows.columns) else F.lit(None).cast("string")
    return F.when(given.isNotNull(), T.normalise_winner(T.strip(given))).otherwise(otherwise)


def reward_pairs(rows: DataFrame, exchange: bool) -> DataFrame:
    """(id, instruction, response_a, response_b, label, subset, exchange) of rows
    with two named responses or with a chosen and a rejected one.  Exchanged,
    the former swap responses and label, the latter are labelled anew."""
    there = lambda names: [F.col(c) for c in names if c in rows.columns]
    first = lambda *names: T.truthy(*there(names))
    subset = F.coalesce(*[F.nullif(c, F.lit("")) for c in there(("subset", "category", "section", "source"))], F.lit("unknown"))
    if {"response_a", "response_b"} <= set(rows.columns):
        a, b, label = F.col("response_a"), F.col("response_b"), inferred_label(rows)
        other = F.when(label == "response_a", "response_b").when(label == "response_b", "response_a")
        a, b, label = (b, a, other) if exchange else (a, b, label)
    else:
        a, b = (F.col("rejected"), F.col("chosen")) if exchange else (F.col("chosen"), F.col("rejected"))
        label = F.lit("response_b" if exchange else "response_a")
    return rows.select("id", first("prompt", "instruction", "question", "input").alias("instruction"), a.alias("response_a"), b.alias("response_b"), label.alias("label"), subset.alias("subset"), F.lit(exchange).alias("exchange"))


def parse_names(csv: str | None) -> list[str]:
    """Names between commas, each once, in order; blank ones not at all."""
    return list(dict.fromkeys(x.strip() for x in (csv or "").split(",") if x.strip()))


def select_subsets(rows: DataFrame, names: list[str], column: str = "subset", index: str = "eval_index", most: int | None = None) -> DataFrame:
    """The rows of these subsets (all without any names), the first ``most`` by
    index.  A name that no row has, or nothing left, is an error."""
    if names:
        there = {r[0] for r in rows.where(F.col(column).isin(names)).select(column).distinct().collect()}
        if absent := [n for n in names if n not in there]:
            raise ValueError(f"No rows of subsets {absent}")
        rows = rows.where(F.col(column).isin(names))
    if rows.isEmpty():
        raise ValueError("No rows to evaluate")
    return rows if most is None else rows.orderBy(index).limit(most)


def violations(rows: DataFrame, **rules: Column) -> Column:
    """The names of the rules that a row breaks, or has null for."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def request_id(rows: DataFrame) -> Column:
    """What a rubric is asked for by: the source prompt's number, or the pair's,
    or a digest of the instruction, by the columns there are."""
    for c in ("source_dataset_index", "dataset_index"):
        if c in rows.columns:
            return F.col(c).cast("string")
    return F.sha2(F.col("instruction").cast("binary"), 256)


def with_rubrics(pairs: DataFrame, rubrics: DataFrame) -> DataFrame:
    """pairs with the rubric of their request; one without is an error."""
    joined = pairs.withColumn("request_id", request_id(pairs)).join(rubrics.select("request_id", "rubric"), "request_id", "left")
    fail = F.raise_error(F.concat(F.lit("No rubric for request "), F.col("request_id"))).cast("boolean")
    return joined.where(F.when(F.col("rubric").isNull(), fail).otherwise(True))


def chat_prefix(content: Column, thinking: bool = True) -> Column:
    """A user's turn and the opening of the assistant's, in the public ChatML
    form; without thinking, an empty thought is given."""
    # Fixed value: the form of a turn.
    tail = "" if thinking else "<think>\n\n</think>\n\n"
    return F.concat(F.lit("<|im_start|>user\n"), content, F.lit(f"<|im_end|>\n<|im_start|>assistant\n{tail}"))


def within_length(rows: DataFrame, prefix: str, target: str, most: int) -> DataFrame:
    """Records whose target fits beside any prefix at all; their prefix is cut at
    its middle to what is left.  A record with a longer target goes."""
    from .layout import head_tail_to

    left = F.lit(most) - F.size(target)
    return rows.where(left >= 0).withColumn(prefix, head_tail_to(F.col(prefix), left))
