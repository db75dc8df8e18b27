"""Contracts as data: each returns a one-row aggregate of violations; `enforce` raises on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what it promised."""


def enforce(report: DataFrame) -> None:
    """Raise unless every count of violations in the one-row report is zero or null, every flag true, and n_rows, if there, positive."""
    row = report.first().asDict()
    row = {k: v for k, v in row.items() if isinstance(v, (bool, int, float))}
    broken = {k: v for k, v in row.items() if (not v if k == "n_rows" or isinstance(v, bool) else v)}
    if broken:
        raise ContractError(f"contract broken: {broken}")


def _bad(c: Column) -> Column:
    return F.count_if(c)


def expect_panel(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Rows, rows with a null key or target, rows beyond one for each key, targets other than 0 and 1; in one aggregation."""
    null = F.lit(False)
    for k in [*keys, target]:
        null = null | F.col(k).isNull()
    return df.agg(F.count("*").alias("n_rows"), _bad(null).alias("n_null"), (F.count("*") - F.count_distinct(F.struct(*keys))).alias("n_repeated"), _bad(~F.col(target).isin(0, 1)).alias("n_bad_target"))


def expect_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(F.struct(*keys))).alias("n_repeated"))


def expect_between(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside of closed bounds, by column; nulls are counted apart."""
    out = []
    for c, (lo, hi) in bounds.items():
        out += [_bad(~F.col(c).between(lo, hi)).alias(f"{c}_outside"), _bad(F.col(c).isNull()).alias(f"{c}_null")]
    return df.agg(*out)


def expect_in(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.agg(_bad(~F.col(column).isin(allowed) | F.col(column).isNull()).alias(f"{column}_unknown"))


def expect_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that are null, not a number or infinite, by column."""
    return df.agg(*(_bad(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"{c}_not_finite") for c in columns))


def expect_probabilities(df: DataFrame, labels: list[str], score: str, label: str, positive: str, negative: str, eps: float = 1e-6) -> DataFrame:
    """Vectors that don't sum to 1, scores other than positive - negative, labels other than the first largest entry."""
    total = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    top = F.greatest(*labels)
    best = F.coalesce(*(F.when(F.col(c) == top, F.lit(c)) for c in labels))
    outside = F.lit(False)
    for c in labels:
        outside = outside | ~F.col(c).between(0, 1) | F.isnan(c)
    return df.agg(
        _bad(outside).alias("n_outside"),
        _bad(F.abs(total - 1) > eps).alias("n_bad_sum"),
        _bad(F.abs(F.col(score) - (F.col(positive) - F.col(negative))) > eps).alias("n_bad_score"),
        _bad(F.col(label) != best).alias("n_bad_label"),
    )


def expect_paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted, without comparing in order."""
    left, right = a.select(*keys), b.select(*keys)
    missing = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    return missing.crossJoin(right.exceptAll(left).agg(F.count("*").alias("only_right")))  # one row on either side


def expect_predictions(df: DataFrame, keys: list[str], probability: str = "probability", prediction: str = "prediction") -> DataFrame:
    """Probabilities outside of [0, 1], predictions other than probability >= 0.5, repeated keys."""
    return df.agg(
        _bad(~F.col(probability).between(0, 1) | F.col(probability).isNull() | F.isnan(probability)).alias("n_bad_probability"),
        _bad(F.col(prediction) != (F.col(probability) >= 0.5).cast("int")).alias("n_bad_prediction"),
        (F.count("*") - F.count_distinct(F.struct(*keys))).alias("n_repeated"),
    )


def expect_separated(train: DataFrame, test: DataFrame, time: str) -> DataFrame:
    """Whether all of train lies before test."""
    a, b = train.agg(F.max(time).alias("last_train")), test.agg(F.min(time).alias("first_test"))
    return a.crossJoin(b).select("last_train", "first_test", (F.col("last_train") < F.col("first_test")).alias("separated"))  # one row on either side


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], frozen: list[str]) -> DataFrame:
    """Keys on which either side is missing or a frozen column differs, nulls being equal."""
    right = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in frozen), F.lit(1).alias("__r"))
    both = old.select(*keys, *frozen, F.lit(1).alias("__l")).join(right, keys, "full")
    differs = F.col("__l").isNull() | F.col("__r").isNull()
    for c in frozen:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return both.where(differs).select(*keys)
