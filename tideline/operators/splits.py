"""Temporal splits: no training row may know what happens at or after the first test date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_index(df: DataFrame, time: str = "date") -> DataFrame:
    """(time, at, n): distinct dates numbered from 0. Only distinct dates are sorted in one place."""
    days = df.select(time).distinct()
    return days.withColumn("at", F.row_number().over(Window.orderBy(time)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def purged(df: DataFrame, start, time: str = "date", end: str = "target_end") -> DataFrame:
    """Rows before `start` whose label ends before `start` too."""
    s = F.lit(start) if not hasattr(start, "_jc") else start
    return df.where((F.col(time) < s) & (F.col(end) < s))


def time_split(df: DataFrame, share: float = 0.8, time: str = "date", end: str = "target_end") -> DataFrame:
    """Adds split: "test" from the date at floor(n * share) on, "train" where the label ends before it, else "purged"."""
    cut = date_index(df, time).where(F.col("at") == F.floor(F.col("n") * share)).select(F.col(time).alias("__cut"))  # one row
    out = df.crossJoin(F.broadcast(cut))
    return out.withColumn("split", F.when(F.col(time) >= F.col("__cut"), "test").when(F.col(end) < F.col("__cut"), "train").otherwise("purged")).drop("__cut")


def expanding_folds(df: DataFrame, folds: int = 3, time: str = "date", least: int = 2) -> DataFrame:
    """(fold, valid_start, valid_end): k blocks of floor(n / (k + 1)) dates after the first one; the last takes the rest."""
    days = date_index(df, time).withColumn("size", F.floor(F.col("n") / (folds + 1)))
    fold = F.least(F.floor(F.col("at") / F.col("size")), F.lit(folds)).cast("int")
    return days.where(F.col("size") >= least).withColumn("fold", fold).where("fold >= 1").groupBy("fold").agg(F.min(time).alias("valid_start"), F.max(time).alias("valid_end"))


def outer_folds(df: DataFrame, start, folds: int = 3, time: str = "date") -> DataFrame:
    """(fold, valid_start, valid_end): the dates from `start` on in k near-equal parts, larger ones first."""
    days = df.where(F.col(time) >= F.lit(start)).select(time).distinct()
    return days.withColumn("fold", F.ntile(folds).over(Window.orderBy(time))).groupBy("fold").agg(F.min(time).alias("valid_start"), F.max(time).alias("valid_end"))


def fold_roles(df: DataFrame, folds: DataFrame, time: str = "date", end: str = "target_end") -> DataFrame:
    """Rows of each fold with role "valid" or "train"; training rows are purged. `folds` has as many rows as folds."""
    f = F.broadcast(folds)
    role = F.when(F.col(time).between(F.col("valid_start"), F.col("valid_end")), "valid").when((F.col(time) < F.col("valid_start")) & (F.col(end) < F.col("valid_start")), "train")
    return df.crossJoin(f).withColumn("role", role).where("role IS NOT NULL").drop("valid_start", "valid_end")


def training_window(df: DataFrame, start, years: int | None, time: str = "date", end: str = "target_end") -> DataFrame:
    """Purged training rows of the last `years` (3, 5 or all) before `start`."""
    if years not in (None, 3, 5):
        raise ValueError("training windows are 3 or 5 years, or all")
    out = purged(df, start, time, end)
    return out if years is None else out.where(F.col(time) >= F.add_months(F.lit(start), -12 * years))


def boundaries(df: DataFrame, keys: list[str], time: str = "date") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(time).alias("first_date"), F.max(time).alias("last_date"), F.count("*").alias("n_rows"))
