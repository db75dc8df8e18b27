"""Aggregations over groups of events and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import meet, positions


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; `empty` where b is 0 or either is null."""
    r = F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def weighted_mean(value: str | Column, weight: str | Column, empty: float | None = 0.0) -> Column:
    """Sum of weight times value over the sum of weights; `empty` where the weights add up to 0."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return ratio(F.sum(v * w), F.sum(w), empty)


def present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known: groups of null keys don't count unless asked for."""
    return df.dropna(subset=list(keys))


def daily_sentiment(df: DataFrame, keys: Sequence[str], score: str, label: str, title: str, off_session: str, classes: Sequence[str] = ("positive", "negative", "neutral")) -> DataFrame:
    """Mean, median, least and largest score, rows (with or without score), rows off session, rows and shares of each class."""
    stats = [F.avg(score).alias("sentiment_mean"), F.median(score).alias("sentiment_median"), F.min(score).alias("sentiment_min"), F.max(score).alias("sentiment_max"), F.count("*").alias("news_count"), F.sum(F.col(off_session).cast("int")).alias("non_trading_news_count")]
    counts = [F.count(F.when(F.col(label) == c, F.col(title))).alias(f"{c}_news_count") for c in classes]
    out = present(df, keys).groupBy(*keys).agg(*stats, *counts)
    return out.withColumns({f"{c}_news_ratio": ratio(F.col(f"{c}_news_count"), F.col("news_count")) for c in classes})


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], counted: str) -> DataFrame:
    """Rows with a known `counted`, by value of `column`, one column each; values that do not occur give 0."""
    return present(df, keys).groupBy(*keys).pivot(column, list(values)).agg(F.count(counted)).na.fill(0)


def dispersion(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Population deviation and mean size of scores in each group."""
    return present(df, keys).groupBy(*keys).agg(F.stddev_pop(score).alias("score_std"), F.avg(F.abs(score)).alias("score_abs"))


def coverage(df: DataFrame, keys: Sequence[str], flag: str, count: str) -> DataFrame:
    """Rows, rows with the flag, sum of counts and the share of flagged rows."""
    out = present(df, keys).groupBy(*keys).agg(F.count("*").alias("sessions"), F.sum(F.col(flag).cast("int")).alias("covered"), F.sum(count).alias("items"))
    return out.withColumn("coverage", ratio(F.col("covered"), F.col("sessions")))


def share_of_total(df: DataFrame, within: Sequence[str], item: str) -> DataFrame:
    """Rows of each item and their share within its group."""
    out = df.groupBy(*within, item).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, and their share of all rows with a value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, prefix: str = "n_", normalise: bool = False) -> DataFrame:
    """Counts by two columns, or with `normalise` shares within each row."""
    cells = {f"{prefix}{v}": F.count_if(F.col(column) == v) for v in values}
    out = df.where(F.col(row).isNotNull()).groupBy(row).agg(*(c.alias(n) for n, c in cells.items()))
    if normalise:
        total = sum((F.col(n) for n in list(cells)[1:]), F.col(next(iter(cells))))
        out = out.select(row, *(ratio(F.col(n), total).alias(n) for n in cells))
    return out


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows have an equal one, keys being equal, in one aggregation by key; nulls are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("n_repeated"), F.count("*").alias("n_distinct"))


def quantiles(df: DataFrame, keys: Sequence[str], column: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles, linear between neighbours, with count, mean and extremes; no task holds a whole group."""
    values = positions(df, keys, column)
    total = values.groupBy(*keys).agg(F.sum("n").alias("__n"), (F.sum(F.col(column) * F.col("n")) / F.sum("n")).alias("__mean"), F.min(column).alias("__min"), F.max(column).alias("__max"))
    both = meet(values, total, keys)
    out, picks = {}, []
    for q in at:
        name, place = f"q{round(1000 * q)}", F.lit(float(q)) * (F.col("__n") - 1)
        value = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col(column)))
        picks += [value(F.floor(place)).alias(f"__lo_{name}"), value(F.ceil(place)).alias(f"__hi_{name}")]
        part = F.lit(float(q)) * (F.col("n") - 1)
        out[name] = F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (part - F.floor(part))
    agg = both.groupBy(*keys).agg(F.max("__n").alias("__rows"), F.max("__mean").alias("mean"), F.max("__min").alias("min"), F.max("__max").alias("max"), *picks).withColumnRenamed("__rows", "n")
    return agg.select(*keys, "n", "mean", "min", "max", *(c.alias(n) for n, c in out.items()))
