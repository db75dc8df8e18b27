"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed


def _stars(edges: DataFrame, keep_above: bool) -> DataFrame:
    """Both directions of each edge, then every node's neighbours are tied to the smallest of them.

    Minima come from partial aggregation and go back by a join, which adaptive execution splits where a hub is hot.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if keep_above else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("low", "src").alias("low"))
    joined = both.join(low, "src")
    if keep_above:
        out = joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut: Callable[[DataFrame], DataFrame] = checkpointed, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node that it reaches.

    Null ends and self-loops are left out. Each round is written through `cut`, so lineage stays short and a lost
    executor costs one round. Raises if `max_rounds` do not suffice.
    """
    now = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    last = mark(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        now = cut(_stars(_stars(now, True), False))
        seen = mark(now)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
