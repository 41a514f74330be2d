"""Records of evaluation and training, laid out as rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import arrays as A
from .metrics import SECTIONS

#: Ids that are broadcast at most.
BROADCAST_UNITS = 100_000
#: Labels that count for nothing.
IGNORED = -100
# The strides of the seeds of two backends.
EXAMPLE_STRIDE = 1009


def eval_records(rows: DataFrame, preamble: str, marker: str) -> DataFrame:
    """(eval_index, problem, cot_answer, subset, official_subset, exchange,
    fault) of rows of either kind: those with ``problem`` or ``cot_answer``
    have their prompt; pairs get one from instruction, rubric and responses.
    ``rows`` has eval_index; any other column may be missing."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    blank = lambda c: T.strip(F.coalesce(has(c), F.lit(""))) == ""
    ready = has("problem").isNotNull() | has("cot_answer").isNotNull()
    parts = [("Instruction", "instruction"), ("Rubric", "rubric"), ("Response A", "response_a"), ("Response B", "response_b")]
    task = F.concat_ws("\n", *[F.concat(F.lit(f"{name}:\n"), T.strip(has(c))) for name, c in parts])
    problem = F.when(ready, T.strip(has("problem"))).otherwise(T.strip(F.concat(F.lit(f"{preamble}\n\n{marker}\n"), task)))
    answer = F.when(ready, T.parse_label(has("cot_answer"))).otherwise(T.external_label(has("label")))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(has(c), F.lit("")) == "", c) for c in ("instruction", "rubric", "response_a", "response_b", "label")]))
    fault = F.when(ready & blank("problem"), "problem").when(~ready & (F.size(lacking) > 0), F.concat(F.lit("missing "), F.array_join(lacking, " "))).when(answer.isNull(), F.when(ready, "cot_answer").otherwise("label"))
    exchange = F.coalesce(has("exchange").cast("boolean"), F.lit(False))
    return rows.select(
        "eval_index", problem.alias("problem"), answer.alias("cot_answer"), F.coalesce(F.nullif(has("subset"), F.lit("")), F.lit("unknown")).alias("subset"),
        T.reporting_group(has("subset"), has("domain"), has("difficulty"), SECTIONS).alias("official_subset"), exchange.alias("exchange"), fault.alias("fault"))


def head_tail_to(tokens: Column, budget: Column) -> Column:
    """Cut to a budget that differs by row, the first half the longer; null if
    the budget is below zero."""
    head, tail = F.ceil(budget / 2).cast("int"), F.floor(budget / 2).cast("int")
    cut = F.concat(F.slice(tokens, F.lit(1), head), F.slice(tokens, F.size(tokens) - tail + 1, tail))
    return F.when(budget >= 0, F.when(F.size(tokens) <= budget, tokens).otherwise(cut))


def prefix_budget(most: int, *fixed: Column) -> Column:
    """What is left for a prefix beside parts of fixed lengths."""
    left = F.lit(most)
    for n in fixed:
        left = left - n
    return left


def prefix_view(prefix: Column, explicit: Column, ends: Column, frontier: Column, left: list[int], right: list[int], fill: int, latents: bool = True) -> tuple[Column, Column]:
    """(input ids, labels) of a record up to one of its frontiers: prefix and
    left marker, a place for each latent (without any, the prompt alone), then
    the explicit tokens as targets."""
    mark = lambda ids: F.array(*map(F.lit, ids))
    target = F.concat(F.slice(explicit, F.lit(1), F.get(ends, frontier - 1)), mark(right))
    start = F.concat(prefix, mark(left), F.array_repeat(F.lit(fill), frontier)) if latents else F.concat(prefix, mark(left))
    return F.concat(start, target), F.concat(F.array_repeat(F.lit(IGNORED), F.size(start)), target)


def even_frontiers(length: Column, count: Column) -> Column:
    """Ends at even distances, rounded up; the last is the length."""
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.when(i == count, length).otherwise(F.ceil(length * i / count).cast("int")))


def regroup(sizes: Column, counts: Column) -> Column:
    """Chunk sizes by segment, each with its count of them."""
    return F.transform(F.arrays_zip(A.running(counts).alias("end"), counts.alias("n")), lambda g: F.slice(sizes, g["end"] - g["n"] + 1, g["n"]))


def seeds(seed: int, example: Column, vote: Column, examples: int) -> tuple[Column, Column]:
    """Seeds of a vote: by rounds over all examples, and by strides."""
    return F.lit(seed) + example + vote * examples, F.lit(seed) + example * EXAMPLE_STRIDE + vote


LATENT_MODES = ("correct", "reverse", "uniform", "zero", "shuffled")


def latent_mode(p: Column, donor: Column, mode: str) -> Column:
    zeros = F.transform(p, lambda x: F.lit(0.0))
    return {"correct": p, "reverse": F.reverse(p), "uniform": F.transform(p, lambda x: F.lit(1.0) / F.size(p)), "zero": zeros, "shuffled": donor}[mode]


def first_units(rows: DataFrame, unit: str, most: int) -> DataFrame:
    """All rows of the first ``most`` units by id, not of the first rows.  The
    ids kept are at most ``most``, and broadcast if that is few."""
    kept = rows.select(F.col(unit).alias("_unit")).distinct().orderBy("_unit").limit(most)
    kept = F.broadcast(kept) if most <= BROADCAST_UNITS else kept
    return rows.join(kept, F.col(unit) == F.col("_unit"), "left_semi")


def packed(rows: DataFrame, index: str, values: str, size: int) -> DataFrame:
    """(shard, first, values, offsets): the sequences of ``size`` records in one
    array, record r at offsets[r] to offsets[r + 1]."""
    shard = F.floor(F.col(index) / size)
    held = rows.groupBy(shard.alias("shard")).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(values).alias("v")))).alias("r"))
    offsets = F.aggregate("r", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, F.lit(-1)) + F.size(x["v"]))))
    return held.select("shard", F.col("r.i").alias("records"), F.flatten(F.col("r.v")).alias("values"), offsets.alias("offsets"))


def unpacked(shards: DataFrame) -> DataFrame:
    """(record_index, t) of packed shards."""
    rows = shards.select("values", "offsets", F.posexplode("records").alias("r", "record_index"))
    start = F.get("offsets", F.col("r"))
    return rows.select("record_index", F.slice("values", start + 1, F.get("offsets", F.col("r") + 1) - start).alias("t"))


def flattened(parts: DataFrame, batch: str, part: str, results: str) -> DataFrame:
    """(batch, place, r): the results of a batch's parts one after another, by
    the parts' order; ``parts`` has n, the number of results of each."""
    before = Window.partitionBy(batch).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.select(batch, "_before", F.posexplode(results).alias("_at", "r"))
    return rows.select(batch, (F.col("_before") + F.col("_at")).cast("int").alias("place"), "r")


#: Kinds of tokens in a mask.
PLAIN, PADDING, SPECIAL = 0, 1, 2


def mask_row(kinds: Column, position: Column, own: Column) -> Column:
    """Which tokens a position attends to: none if it is padding, otherwise
    itself and the earlier plain ones."""
    seen = lambda k, j: (j <= position) & (own != PADDING) & (k != PADDING) & ((j == position) | (k != SPECIAL))
    return F.transform(kinds, lambda k, j: seen(k, j).cast("int"))
