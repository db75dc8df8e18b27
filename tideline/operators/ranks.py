"""Positions of values in their group's order, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`left` with the other columns of `right`, which has each key once; null keys are equal; without keys, its one row."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    if not keys:
        return left.crossJoin(F.broadcast(right))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(right, on).drop(*(f"__k_{k}" for k in keys))


def positions(df: DataFrame, keys: Sequence[str], column: str, parts: int = 64, sums: dict[str, Column] | None = None, weight: str = "n", cut_from: DataFrame | None = None, cut_keys: Sequence[str] | None = None) -> DataFrame:
    """(keys, column, n, below) of each distinct value: how many rows have it and how many a smaller one.

    Rows are counted by value first. A bounded quantile sketch cuts each group into about `parts` ranges; running sums go
    within a range, and the ranges' totals, `parts` for each group at most, carry over. `sums` adds further sums by value; `weight` names the one that `below` adds up.
    `cut_from` and `cut_keys` take the cuts from other rows with fewer keys, where many groups have the same values.
    """
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(*keys, column).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in (sums or {}).items()))
    cut_keys = keys if cut_keys is None else cut_keys
    cuts = (known if cut_from is None else cut_from.where(F.col(column).isNotNull())).groupBy(*cut_keys).agg(F.percentile_approx(column, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(2000)).alias("__cuts"))
    cut = meet(counts, cuts, cut_keys).select(*counts.columns, F.size(F.filter("__cuts", lambda c: c < F.col(column))).alias("__part"))
    total = cut.groupBy(*keys, "__part").agg(F.sum(weight).alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.withColumn("__base", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).drop("__m")
    inside = cut.withColumn("__in", F.sum(weight).over(Window.partitionBy(*keys, "__part").orderBy(column)) - F.col(weight))
    return meet(inside, base, [*keys, "__part"]).select(*counts.columns, (F.col("__in") + F.col("__base")).alias("below"))
