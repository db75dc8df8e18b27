"""Joins: forward as-of, validated one-to-one and many-to-one, semi, anti, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .contracts import enforce, expect_unique

#: Rows of a schedule up to which it is sent to every task; beyond, the as-of join sorts both sides by time.
BROADCAST_ROWS = 200_000


def asof_forward(events: DataFrame, schedule: DataFrame, at: str, close: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Each event with the first row of `schedule` whose `close` is not before `at`; nulls where none is.

    A schedule of a bounded, counted size is broadcast as intervals (previous close, close], keyed by day so that the
    join is a hash join; a larger one meets the events in one sorted pass for each day bucket.
    """
    small = schedule.limit(most + 1).count() <= most
    steps = schedule.where(F.col(close).isNotNull()).withColumn("__prev", F.lag(close).over(Window.orderBy(close)))
    if not small:
        return _asof_sorted(events, schedule, at, close)
    first_day = F.to_date(F.coalesce("__prev", close))
    # intervals are spread over the days they touch; the first one reaches back without end and is joined apart
    days = steps.where("__prev IS NOT NULL").withColumn("__day", F.explode(F.sequence(first_day, F.to_date(close))))
    head = steps.where("__prev IS NULL").drop("__prev")
    names = schedule.columns
    hit = events.withColumn("__at_day", F.to_date(at)).join(F.broadcast(days), (F.col("__at_day") == F.col("__day")) & (F.col(at) > F.col("__prev")) & (F.col(at) <= F.col(close)), "left").drop("__at_day", "__day", "__prev")
    opening = F.broadcast(head.select(*(F.col(c).alias(f"__h_{c}") for c in names)))  # one row
    both = hit.join(opening, F.col(close).isNull() & (F.col(at) <= F.col(f"__h_{close}")), "left")
    return both.withColumns({c: F.coalesce(c, f"__h_{c}") for c in names}).drop(*(f"__h_{c}" for c in names))


def _asof_sorted(events: DataFrame, schedule: DataFrame, at: str, close: str) -> DataFrame:
    """As-of by one window for each day over both sides, with the first close of later days carried over."""
    row = F.struct(*schedule.columns)
    left = events.withColumn("__t", F.col(at)).withColumn("__row", F.lit(None).cast(schedule.select(row.alias("r")).schema["r"].dataType)).withColumn("__event", F.lit(True))
    right = schedule.select(F.col(close).alias("__t"), row.alias("__row"), F.lit(False).alias("__event"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__day", F.to_date("__t"))
    here = Window.partitionBy("__day").orderBy(F.desc("__t"), "__event")  # from the end of the day; of equal times the close comes first
    near = F.last("__row", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    firsts = right.groupBy(F.to_date("__t").alias("__day")).agg(F.min_by("__row", "__t").alias("__first"))
    days = both.select("__day").distinct().join(firsts, "__day", "left").withColumn("__next", F.first("__first", ignorenulls=True).over(Window.orderBy("__day").rowsBetween(1, Window.unboundedFollowing)))
    out = both.withColumn("__near", near).where("__event").join(days.select("__day", "__next"), "__day", "left").withColumn("__hit", F.coalesce("__near", "__next"))
    return out.select(*events.columns, *(F.col(f"__hit.{c}").alias(c) for c in schedule.columns))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides must both have each key once at most."""
    enforce(expect_unique(left, keys))
    enforce(expect_unique(right, keys))
    return left.join(right, keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must have each key once at most."""
    enforce(expect_unique(right, keys))
    return left.join(right, keys, how)


def left_join_fill(left: DataFrame, right: DataFrame, keys: list[str], fill: dict, flag: str) -> DataFrame:
    """Left join; `flag` says whether the right side had the row, and only then are gaps filled."""
    out = many_to_one(left, right.withColumn(flag, F.lit(True)), keys)
    return out.withColumn(flag, F.coalesce(flag, F.lit(False))).na.fill(fill)


def contrast(df: DataFrame, keys: list[str], arm: str, base: str, other: str, metrics: list[str]) -> DataFrame:
    """Metrics of two arms beside each other and their differences, in one aggregation instead of a self-join."""
    pick = lambda v, m: F.max(F.when(F.col(arm) == v, F.col(m)))
    both = df.where(F.col(arm).isin(base, other)).groupBy(*keys).agg(*(pick(v, m).alias(f"{m}_{v}") for m in metrics for v in (base, other)))
    return both.withColumns({f"{m}_delta": F.col(f"{m}_{other}") - F.col(f"{m}_{base}") for m in metrics})


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def matching_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")
