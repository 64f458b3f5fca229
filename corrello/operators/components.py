"""Connected components of an undirected graph held as an edge DataFrame.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each round is two aggregations
with map-side partial minima and two equi-joins, so a hub is never collected;
adaptive skew handling may split its partition.  Rounds are written to the
shared folder, which keeps lineage flat and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrello.store import forget, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = low.select("a", F.col("low").alias("b"))
    return moved.union(own).where("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)``; component is the smallest node reachable.

    Self-loops keep their node as a component of one.  Rows with a null end are
    ignored.  Repeated and reversed edges are harmless.  An empty input gives an
    empty result.
    """
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    start = keep(clean.distinct(), "cc-start")
    state, before = start.where("a <> b"), None
    held: DataFrame | None = None
    for _ in range(max_rounds):
        after = keep(_small_star(_large_star(state)), "cc-round")
        seen = _digest(after)
        if held is not None:
            forget(held)
        state = held = after
        if seen == before or seen[0] == 0:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = start.select(F.col("a").alias("node")).union(start.select(F.col("b").alias("node"))).distinct()
    return nodes.join(state.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
