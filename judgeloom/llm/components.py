"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packs import BROADCAST_ROWS, checkpointed, heavy_at, looked_up


def components(edges: DataFrame, rounds: int = 60, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, component) for every id of edges(a, b): the smallest id reachable.

    Each round takes the least label among an id's neighbours, then that
    label's own label, so that chains shorten by half.  Labels of a hub's
    neighbours are combined before they are shuffled.  Up to ``broadcast_rows``
    labels are broadcast to the edges; beyond that the edges are shuffled to
    them, but for those to hubs, of which there are 50,000 at most.  Of a
    label's own labels only those count that are no roots; they too are broadcast
    if they are few, and else those of very many ids, so that a giant component's
    members needn't meet in one task.  Raises if labels still change after ``rounds``."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")))
    n = labels.count()
    few = n <= broadcast_rows
    hubs = None if few else checkpointed(both.groupBy("b").count().where(F.col("count") >= heavy_at(both.count())).select("b"))
    for _ in range(rounds):
        of_b = labels.select(F.col("id").alias("b"), "component")
        if few:
            seen = both.join(F.broadcast(of_b), "b")
        else:
            to_hubs = both.join(F.broadcast(of_b.join(F.broadcast(hubs), "b", "left_semi")), "b")
            seen = both.join(F.broadcast(hubs), "b", "left_anti").join(of_b.hint("merge"), "b").unionByName(to_hubs)
        near = seen.groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        jump = labels.where("component <> id").select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(F.broadcast(jump), "component", "left") if few or jump.count() <= broadcast_rows else looked_up(lower, jump, "component", n)
        now = checkpointed(jumped.select("id", "was", F.least("component", "next").alias("component")))
        labels = now.select("id", "component")
        if now.where("component <> was").isEmpty():
            return labels
    raise RuntimeError("components: labels still change")
