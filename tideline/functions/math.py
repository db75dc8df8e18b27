"""Arithmetic that does not raise, and vectors in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_double(text: str | Column) -> Column:
    """A number, or null for what is none; NaN and infinities are null too."""
    v = _c(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null."""
    out = v = _c(x)
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(v.isNotNull(), out)


def softmax(xs: str | Column) -> Column:
    """Probabilities from an array of logits, shifted by the largest."""
    x = F.transform(_c(xs), lambda v: v.cast("double"))
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(xs: str | Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(_c(xs), F.array_max(_c(xs))) - 1


def label_of(probabilities: dict[str, Column]) -> Column:
    """The name of the first largest probability."""
    top = F.greatest(*probabilities.values())
    return F.coalesce(*(F.when(p == top, F.lit(n)) for n, p in probabilities.items()))
