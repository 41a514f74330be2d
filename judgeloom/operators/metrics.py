"""Scores of judged rows.  All are one or two aggregations with partial sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

# Example weights of evaluation subsets, and their sections.
WEIGHTS = {
    "alpacaeval-easy": 100, "alpacaeval-length": 95, "alpacaeval-hard": 95, "mt-bench-easy": 28, "mt-bench-med": 40, "mt-bench-hard": 37,
    "math-prm": 984, "refusals-dangerous": 100, "refusals-offensive": 100, "llmbar-natural": 100, "llmbar-adver-neighbor": 134,
    "llmbar-adver-GPTInst": 92, "llmbar-adver-GPTOut": 47, "llmbar-adver-manual": 46, "xstest-should-refuse": 154, "xstest-should-respond": 250,
    "donotanswer": 136, "hep-cpp": 164, "hep-go": 164, "hep-java": 164, "hep-js": 164, "hep-python": 164, "hep-rust": 164,
}
SECTIONS = {
    "Chat": ["alpacaeval-easy", "alpacaeval-length", "alpacaeval-hard", "mt-bench-easy", "mt-bench-med"],
    "Chat Hard": ["mt-bench-hard", "llmbar-natural", "llmbar-adver-neighbor", "llmbar-adver-GPTInst", "llmbar-adver-GPTOut", "llmbar-adver-manual"],
    "Safety": ["refusals-dangerous", "refusals-offensive", "xstest-should-refuse", "xstest-should-respond", "donotanswer"],
    "Reasoning": ["math-prm", "hep-cpp", "hep-go", "hep-java", "hep-js", "hep-python", "hep-rust"],
}


def accuracy(correct: Column | str = "correct") -> Column:
    return F.avg(F.coalesce(F.col(correct) if isinstance(correct, str) else correct, F.lit(False)).cast("int"))


def bucket_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if("correct").alias("n_correct"), accuracy().alias("accuracy"))


def section_weights(spark, sections: dict = SECTIONS, weights: dict = WEIGHTS) -> DataFrame:
    return spark.createDataFrame([(s, x, weights[x]) for s, xs in sections.items() for x in xs], "section string, subset string, weight long")


def weighted_sections(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(section, score, subsets): subset accuracies by fixed weights, normalised
    by the weights that are present.  ``weights`` is a small lookup table."""
    by_subset = rows.groupBy("subset").agg(accuracy().alias("accuracy")).join(weights, "subset")
    return by_subset.groupBy("section").agg((F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight")).alias("score"), F.count("*").alias("subsets"))


def direction_average(rows: DataFrame, key: str) -> DataFrame:
    """Per key: accuracy in each direction, and the mean of the directions there are."""
    by = rows.groupBy(key).agg(accuracy(F.when(~F.col("exchange"), F.col("correct"))).alias("_"), F.avg(F.when(~F.col("exchange"), F.col("correct").cast("int"))).alias("forward"), F.avg(F.when(F.col("exchange"), F.col("correct").cast("int"))).alias("reverse"))
    return by.select(key, "forward", "reverse", F.coalesce((F.col("forward") + F.col("reverse")) / 2, "forward", "reverse").alias("score"))


def macro_of_macro(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Accuracy by (outer, inner), averaged by outer, then over all."""
    cells = rows.groupBy(outer, inner).agg(accuracy().alias("accuracy"))
    by_outer = cells.groupBy(outer).agg(F.avg("accuracy").alias("score"))
    total = by_outer.agg(F.avg("score").alias("score")).select(F.lit("Score").alias(outer), "score")
    return by_outer.unionByName(total)


def all_pass(rows: DataFrame, group: str, unit: str) -> DataFrame:
    """Share of units all of whose rows are correct, by group."""
    return rows.groupBy(group, unit).agg(F.bool_and("correct").alias("passed")).groupBy(group).agg(F.count("*").alias("prompts"), F.avg(F.col("passed").cast("int")).alias("score"))


def confusion(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1); a null guess is only a miss."""
    pairs = rows.select(F.explode(F.array_distinct(F.array_compact(F.array(gold, guess)))).alias("label"), gold, guess)
    hit, tells, is_it = F.col(gold).eqNullSafe(F.col(guess)), F.col(guess).eqNullSafe(F.col("label")), F.col(gold).eqNullSafe(F.col("label"))
    c = pairs.groupBy("label").agg(F.count_if(hit & is_it).alias("tp"), F.count_if(tells & ~is_it).alias("fp"), F.count_if(is_it & ~tells).alias("fn"))
    safe = lambda x: F.greatest(x, F.lit(1))
    return c.select("label", "tp", "fp", "fn", (F.col("tp") / safe(F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / safe(F.col("tp") + F.col("fn"))).alias("recall"), (2 * F.col("tp") / safe(2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def chunk_histogram(sizes: DataFrame, rate: int = 8, preferred: tuple[int, int] = (6, 10)) -> DataFrame:
    """(size, chunks, share, at_rate, outside) of one row a chunk."""
    counts = sizes.groupBy("size").agg(F.count("*").alias("chunks"))
    # sizes are few, so the total is over a handful of rows
    total = counts.agg(F.sum("chunks").alias("total"))
    return counts.join(F.broadcast(total)).select("size", "chunks", (F.col("chunks") / F.col("total")).alias("share"), (F.col("size") == rate).alias("at_rate"), (~F.col("size").between(*preferred)).alias("outside"))


def chunk_stats(histogram: DataFrame, rate: int = 8, preferred: tuple[int, int] = (6, 10)) -> DataFrame:
    """One row of counts from a histogram."""
    size, n = F.col("size"), F.col("chunks")
    some = lambda c: F.sum(F.when(c, n).otherwise(0))
    return histogram.agg(
        F.sum(n).alias("chunks"), F.sum(size * n).alias("tokens"), F.min(size).alias("least"), F.max(size).alias("most"), some(size == rate).alias("at_rate"), some(size < rate).alias("below_rate"), some(size > rate).alias("above_rate"),
        some(size < preferred[0]).alias("below_preferred"), some(size > preferred[1]).alias("above_preferred"), (F.sum(size * n) / F.sum(n)).alias("tokens_per_chunk"))


# How many first tokens the scopes of a loss take.
SCOPES = {"first_1": 1, "first_8": 8, "first_32": 32, "first_64": 64}


def scoped_loss(rows: DataFrame, position: str, loss: str, starts_chunk: Column) -> DataFrame:
    """(scope, tokens, nll, perplexity); positions count from one.  Rows are
    summed by scope in each task, in columns, before they are turned."""
    scopes = {name: F.col(position) <= n for name, n in SCOPES.items()} | {"all": F.lit(True), "chunk_boundaries": starts_chunk}
    sums = rows.agg(*[F.struct(F.count_if(c).alias("tokens"), F.sum(F.when(c, F.col(loss))).alias("sum")).alias(name) for name, c in scopes.items()])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("scope"), f"{name}.*") for name in scopes])).alias("s")).select("s.*")
    nll = F.coalesce("sum", F.lit(0.0)) / F.greatest("tokens", F.lit(1))
    return long.select("scope", "tokens", nll.alias("nll"), F.exp(F.least(nll, F.lit(20.0))).alias("perplexity"))


def token_totals(rows: DataFrame, key: str, count: Column) -> DataFrame:
    """Totals by key of what an expression counts in a row; null counts for
    nothing."""
    return rows.groupBy(key).agg(F.sum(count).alias("tokens"), F.count("*").alias("rows"))


def pair_grid(rows: DataFrame, prompt: str, chosen: str, rejected: str, n_chosen: str, n_rejected: str) -> DataFrame:
    """(prompt, pairs, duplicates, missing): the pairs that a prompt's grid of
    chosen and rejected responses lacks, and those it has more than once."""
    by = rows.groupBy(prompt, chosen, rejected).agg(F.count("*").alias("_n"), F.max(n_chosen).alias("_c"), F.max(n_rejected).alias("_r"))
    inside = (F.col(chosen) < F.col("_c")) & (F.col(rejected) < F.col("_r")) & (F.col(chosen) >= 0) & (F.col(rejected) >= 0)
    grid = F.max(F.col("_c") * F.col("_r"))
    return by.groupBy(prompt).agg(F.count("*").alias("pairs"), F.count_if(F.col("_n") > 1).alias("duplicates"), (grid - F.count_if(inside)).alias("missing"))


def missing_cells(rows: DataFrame, prompt: str, chosen: str, rejected: str, n_chosen: str, n_rejected: str) -> DataFrame:
    """(prompt, chosen, rejected) of the cells that a grid lacks."""
    sizes = rows.groupBy(prompt).agg(F.max(n_chosen).alias("_c"), F.max(n_rejected).alias("_r"))
    cells = sizes.where("_c > 0 and _r > 0").select(prompt, F.explode(F.sequence(F.lit(0), F.col("_c").cast("int") - 1)).alias(chosen), "_r").select(prompt, chosen, F.explode(F.sequence(F.lit(0), F.col("_r").cast("int") - 1)).alias(rejected))
    return cells.join(rows.select(prompt, F.col(chosen).cast("int").alias(chosen), F.col(rejected).cast("int").alias(rejected)).distinct(), [prompt, chosen, rejected], "left_anti")


def prefix_means(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(kind, samples, score): means by what stands before the first colon."""
    return rows.groupBy(F.substring_index(key, ":", 1).alias("kind")).agg(F.count("*").alias("samples"), F.avg(value).alias("score"))


def by_group(rows: DataFrame, group: str, expected: dict[str, int]) -> DataFrame:
    """(direction, group, samples, correct, invalid, accuracy, complete): each
    direction as a whole (group null) and by group; complete says whether the
    groups have as many rows as expected, which only the whole can."""
    direction = F.when(F.col("exchange"), "reverse").otherwise("forward").alias("direction")
    cube = rows.withColumn("_d", direction).groupingSets([["_d"], ["_d", group]], "_d", group)
    found = cube.agg(F.count("*").alias("samples"), F.count_if("correct").alias("correct"), F.count_if(F.col("prediction").isNull()).alias("invalid"), accuracy().alias("accuracy"), F.grouping(group).alias("_all"), *[F.count_if(F.col(group) == g).alias(f"_n{k}") for k, g in enumerate(expected)])
    whole = F.col("samples") == sum(expected.values())
    for k, n in enumerate(expected.values()):
        whole = whole & (F.col(f"_n{k}") == n)
    return found.select(F.col("_d").alias("direction"), group, "samples", "correct", "invalid", "accuracy", F.when(F.col("_all") == 1, whole).alias("complete"))


def headline(scores: DataFrame, names: list[str]) -> DataFrame:
    """(name, forward, reverse, average) of headline scores from scores(direction,
    name, score): a direction that there isn't stays null, and an average takes
    the names that both have, or all of the only one."""
    of = lambda way: F.max(F.when(F.col("direction") == way, F.col("score")))
    by = scores.where(F.col("name").isin(names)).groupBy("name").agg(of("forward").alias("forward"), of("reverse").alias("reverse"))
    sides = scores.agg(F.count_distinct("direction").alias("sides"))
    mean = F.when(F.col("sides") == 2, (F.col("forward") + F.col("reverse")) / 2).otherwise(F.coalesce("forward", "reverse"))
    return by.join(F.broadcast(sides)).select("name", "forward", "reverse", mean.alias("average"))  # one row


def criterion_report(gold: DataFrame, told: DataFrame, keys: list[str], record: str, labels: list[str]) -> DataFrame:
    """One row of what gold(keys, gold) and told(keys, told) statuses agree on.
    A missing answer is wrong, an answer to nothing counts for nothing; a record
    is exact if all of its gold statuses are there and answered right."""
    rows = gold.join(told.withColumn("_answered", F.lit(True)), keys, "left")
    right = F.coalesce(F.col("gold") == F.col("told"), F.lit(False))
    by = rows.groupBy(record).agg(
        F.count("*").alias("criteria"), F.count("gold").alias("labels"), F.count_if(F.col("_answered")).alias("answered"), F.count_if(F.col("gold").isNotNull() & F.col("told").isNotNull()).alias("covered"), F.count_if(right).alias("right"),
        *[F.count_if(c).alias(f"_{kind}{k}") for k, x in enumerate(labels) for kind, c in (("tp", right & (F.col("gold") == x)), ("fp", (F.col("told") == x) & (F.col("gold") != x)), ("fn", (F.col("gold") == x) & ~right))])
    full = F.col("criteria") == F.col("labels")
    sums = by.agg(
        F.count("*").alias("records"), F.sum("criteria").alias("criteria"), F.sum("labels").alias("labels"), F.count_if(full).alias("full_records"), F.count_if(full & (F.col("right") == F.col("criteria"))).alias("exact"),
        F.sum("answered").alias("answered"), F.sum("covered").alias("covered"), F.sum("right").alias("right"), *[F.sum(f"_{kind}{k}").alias(f"_{kind}{k}") for k in range(len(labels)) for kind in ("tp", "fp", "fn")])
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def f1(k: int) -> Column:
        tp, fp, fn = (F.col(f"_{kind}{k}") for kind in ("tp", "fp", "fn"))
        p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
        return 2 * p * r / F.greatest(p + r, F.lit(1e-12))

    macro = f1(0)
    for k in range(1, len(labels)):
        macro = macro + f1(k)
    return sums.select("records", "criteria", "labels", "full_records", share("covered", "labels").alias("coverage"), share("right", "labels").alias("accuracy"), (macro / len(labels)).alias("macro_f1"), share("exact", "full_records").alias("vector_exact"), share("answered", "criteria").alias("semantic_coverage"))


def generation_quality(rows: DataFrame, key: str) -> DataFrame:
    """By key, from rows(prefix, aligned, f1, exact, predicted, target, whole):
    means over examples, and ratios of totals (whole is the target's length
    before it is cut off)."""
    n = F.greatest(F.count("*"), F.lit(1))
    total = lambda c: F.greatest(F.sum(c), F.lit(1))
    return rows.groupBy(key).agg(
        F.count("*").alias("examples"), (F.sum("prefix") / n).alias("mean_prefix"), (F.sum("aligned") / total("target")).alias("aligned_accuracy"), (F.sum("f1") / n).alias("token_f1"),
        (F.sum(F.col("exact").cast("int")) / n).alias("exact_match"), (F.sum("predicted") / total("whole")).alias("length_ratio"), (F.sum("target") / total("whole")).alias("coverage"))


def _counted(xs: Column, side: int) -> Column:
    """(token, side, times) of each distinct token, by where its run in the
    sorted array starts; in the time of a sort."""
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.coalesce(F.get(s, i - 1), x)), i)), lambda i: i.isNotNull())
    runs = lambda s: A.let(starts(s), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("token"), F.lit(side).alias("side"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))
    return A.let(F.array_sort(xs), runs)


def bag_overlap(a: Column, b: Column) -> Column:
    """How many tokens two bags share: the i-th of equal tokens meets the i-th.
    Null tokens are left out."""
    known = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    both = F.array_sort(F.concat(_counted(known(a), 0), _counted(known(b), 1)))
    # a token that both have stands beside itself
    meet = lambda xs: F.zip_with(xs, F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1))), lambda x, y: F.when(x["token"] == y["token"], F.least(x["n"], y["n"])).otherwise(0))
    return F.aggregate(A.let(both, meet), F.lit(0), lambda s, n: s + F.coalesce(n, F.lit(0)))


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of tokens; one if both are empty, zero if one is."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * bag_overlap(a, b) / (F.size(a) + F.size(b)))


def word_f1(rows: DataFrame) -> DataFrame:
    """rows(doc_id, candidate, reference) with the F1 of their words, each row
    by itself; null sides count as empty, and two empty sides are alike."""
    words = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return rows.withColumn("f1", bag_f1(words("candidate"), words("reference")))


def semantic_scores(rows: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame] = word_f1) -> DataFrame:
    """(key, criteria, covered, score): means of what a scorer gives for each
    candidate and reference (a column f1), a missing candidate as zero."""
    scored = scorer(rows)
    there = F.col("candidate").isNotNull()
    return scored.groupBy(key).agg(F.count("*").alias("criteria"), F.count_if(there).alias("covered"), (F.sum(F.when(there, F.coalesce("f1", F.lit(0.0))).otherwise(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("score"))


def percent(x: Column) -> Column:
    """In percent; null stays null."""
    return x * 100


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def nested_ceil(n: Column, *parts: Column) -> Column:
    """n by each part after another, rounded up each time."""
    for p in parts:
        n = F.ceil(n / p)
    return n.cast("long")


def sorted_struct(entries: dict[str, Column]) -> Column:
    return F.struct(*[entries[k].alias(k) for k in sorted(entries)])


def signature(entries: dict[str, Column]) -> Column:
    """SHA-256 of entries (as JSON texts) by their names in order."""
    parts = [F.concat(F.lit(f'"{k}": '), entries[k]) for k in sorted(entries)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary"), 256)


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; of keys that both have, the second's entry."""
    rest = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(rest, second)


def without_keys(entries: Column, keys: list[str]) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(keys))
