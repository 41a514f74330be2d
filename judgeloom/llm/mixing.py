"""Mixing sources to target weights by Sainte-Laguë apportionment.

Tokens are dealt in equal blocks.  Sources get blocks by the highest quotients
``target / (2k + 1)``; a source's blocks are dealt to its shards in the same
way, by the shards' sizes.  A shard's words, its documents in the order of a
seeded digest, are cut into blocks of equal length, and its quota are the first
of these, so that a document at an edge is taken in part; a quota beyond the
shard's size first takes every document once.

The quotients aren't enumerated: below a bound near ``seats / votes`` all are
won, above another none is, and only the few between (about two for each
party) are ranked.  All of it is DataFrame and SQL functions; texts are read
once, for their sizes, and never shuffled.

A source's words may be wanted at most ``most_repeats`` times.  What its weight
asks beyond that is shared among the others by weight, until none is above.

Results for odd inputs: a null text has no words; null is a source of its own,
last in order; a null id is dealt as an empty string; repeated rows are
documents of their own; empty sources and tables take nothing; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packs import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK, SHARD_WORDS = 16, 4_000_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size) with the number of words."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most_repeats: int = 2) -> DataFrame:
    """(source, source_size, target) from sizes(source, size).

    Sources in the order of size by weight are capped one after another; the
    first that needs no cap gives the share of a unit of weight for all after
    it.  One row a source, so a single partition can hold the window."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    rows = by_source.select("source", "source_size", weight.cast("long").alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    cap = F.lit(most_repeats).cast("decimal(38,0)") * F.col("source_size")
    rows = rows.withColumn("wanted", F.lit(share_percent).cast("decimal(38,0)") * F.sum("source_size").over(Window.partitionBy()))
    capped = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", (F.col("wanted") - 100 * capped).cast("decimal(38,0)")).withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)"))
    fits = F.col("weight") * F.col("left") <= 100 * cap * F.col("open")
    rows = rows.withColumn("unit", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "left", "open"))).over(Window.partitionBy()))
    share = F.col("weight") * F.col("unit.left").cast("double") / (100 * F.col("unit.open")).cast("double")
    target = F.when(fits, share).otherwise(cap.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: Column, seats: Column, order: list[Column]) -> DataFrame:
    """parties with the column seats_won: within each group, ``seats`` seats by
    the highest averages of Sainte-Laguë, ties in ``order``."""
    g = Window.partitionBy(*group)
    rows = parties.withColumn("_votes", votes.cast("double")).withColumn("_seats", seats.cast("long"))
    rows = rows.withColumn("_total", F.sum("_votes").over(g)).withColumn("_slack", F.count("*").over(g) / 2 + 1)
    won = lambda n: F.when(F.col("_total") > 0, F.floor(n * F.col("_votes") / F.col("_total") + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("_sure", won(F.greatest(F.col("_seats") - F.col("_slack"), F.lit(0.0)))).withColumn("_most", won(F.col("_seats") + F.col("_slack")))
    rows = rows.withColumn("_left", F.col("_seats") - F.sum("_sure").over(g)).withColumn("_key", F.row_number().over(g.orderBy(*order)))
    tried = rows.where("_most > _sure").select(*group, "_key", "_left", F.col("_votes"), F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    rank = F.row_number().over(g.orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") + 1)), "_key", "_k"))
    extra = tried.withColumn("_rank", rank).where("_rank <= _left").groupBy(*group, "_key").agg(F.count("*").alias("_extra"))
    on = F.col("p._key") == F.col("e._key")
    for c in group:
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}"))
    joined = rows.alias("p").join(extra.alias("e"), on, "left")
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in parties.columns], (F.col("p._sure") + F.coalesce("e._extra", F.lit(0))).alias("seats_won"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most_repeats: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, taken) for every row."""
    # the size too, so that rows of one id (or none) don't all have one digest
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    rows = checkpointed(sized(docs, id_col, text_col, source_col).withColumn("digest", digest))
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    rows = rows.withColumn("shard", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % shards)
    goals = targets(rows, weights, share_percent, most_repeats)
    all_seats = F.floor(F.sum("target").over(Window.partitionBy()) / block)
    goals = apportion(goals.withColumn("one", F.lit(1)).withColumn("all_seats", all_seats), ["one"], F.col("target"), F.col("all_seats"), [F.col("source").asc_nulls_last()])
    goals = goals.select("source", "source_size", "target", F.col("seats_won").alias("blocks"))
    parts = rows.groupBy("source", "shard").agg(F.sum("size").alias("part_size")).alias("r")
    parts = parts.join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "g.source_size", "g.target", "g.blocks")
    parts = apportion(parts, ["source"], F.col("part_size"), F.col("blocks"), [F.col("shard")])
    quota = F.least(F.col("seats_won") * block, most_repeats * F.col("part_size"))
    parts = checkpointed(parts.select("source", "shard", "source_size", "target", "part_size", quota.alias("quota")))
    both = rows.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.shard") == F.col("p.shard")))
    both = both.select("r.doc_id", "r.source", "r.size", "r.digest", "p.source_size", "p.target", "r.shard", "p.part_size", "p.quota")
    times = F.when(F.col("part_size") > 0, F.floor(F.col("quota") / F.col("part_size"))).otherwise(0).cast("long")
    both = both.withColumn("times", times).withColumn("rest", F.col("quota") - F.col("times") * F.col("part_size"))
    w = Window.partitionBy("source", "shard").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(w), F.lit(0))
    taken = F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return both.select("doc_id", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))
