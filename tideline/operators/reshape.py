"""Pivots, unpivots, indicators, interactions, replication, feature-schema algebra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_first(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Long to wide; the values are named, so no pass is spent on finding them."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values))


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """Indicators of all values but the first, which is the reference."""
    return df.withColumns({f"{prefix}{v}": (F.col(column) == v).cast("double") for v in values[1:]})


def interactions(df: DataFrame, column: str, values: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Products of indicators and features, `value__feature`, made in one projection."""
    return df.select("*", *((F.when(F.col(column) == v, F.col(f)).otherwise(F.lit(0.0))).cast("double").alias(f"{v}__{f}") for v in values[1:] for f in features))


def replicate(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Every row once under each label."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, labels))))


def variants(df: DataFrame, keys: Sequence[str], texts: dict[str, Column], name: str = "variant", value: str = "text") -> DataFrame:
    """One row for each named variant of a row that has a text."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in texts.items()))).alias("v")
    return df.select(*keys, rows).select(*keys, "v.*").where(F.col(value).isNotNull() & (F.trim(value) != ""))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def feature_subset(full: Sequence[str], clean: Sequence[str], feature: str, mode: str) -> list[str]:
    """Order-preserving schemas of an ablation: "drop" takes a feature's family out of `full`, "add" puts it onto `clean`."""
    family = [c for c in full if c == feature or c.startswith(f"{feature}_lag_") or c.startswith(f"{feature}_mean_")]
    if not family:
        raise ValueError(f"unknown feature {feature}")
    if mode == "drop":
        return [c for c in full if c not in family]
    if mode == "add":
        return [c for c in full if c in family or c in clean]
    raise ValueError(f"unknown mode {mode}")
