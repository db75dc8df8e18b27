"""Time-series operators over (entity, time) panels. Every window has a total order; nothing crosses entities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY, TIME = "ticker", "date"
#: Below this, a spread counts as none: constant windows leave rounding residue.
FLAT = 1e-9


def spec(entity: str = ENTITY, time: str = TIME):
    return Window.partitionBy(entity).orderBy(time)


def past(rows: int, entity: str = ENTITY, time: str = TIME):
    """The last `rows` rows, this one included."""
    return spec(entity, time).rowsBetween(-(rows - 1), 0)


def history(rows: int, entity: str = ENTITY, time: str = TIME):
    """The `rows` rows before this one."""
    return spec(entity, time).rowsBetween(-rows, -1)


def next_label(df: DataFrame, value: str, target: str = "target", entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Next value, its time and whether it is larger; the last row of an entity goes. Equal or null counts as 0."""
    w = spec(entity, time)
    out = df.withColumns({f"next_{value}": F.lead(value).over(w), "target_end": F.lead(time).over(w)})
    out = out.withColumn(target, F.coalesce(F.col(f"next_{value}") > F.col(value), F.lit(False)).cast("int"))
    return out.where(F.col(f"next_{value}").isNotNull())


def simple_return(value: str, entity: str = ENTITY, time: str = TIME) -> Column:
    """Change against the row before; a null value stands for the last one known, the first row gets 0."""
    known = F.last(value, ignorenulls=True).over(spec(entity, time).rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(value, ignorenulls=True).over(spec(entity, time).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.try_divide(known, F.nullif(before, F.lit(0.0))) - 1, F.lit(0.0))


def moving_averages(df: DataFrame, value: str, sizes: Sequence[int] = (5, 20, 50), prefix: str = "sma", entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Means of the last rows, partial at the start; all from one sort."""
    return df.withColumns({f"{prefix}_{n}": F.avg(value).over(past(n, entity, time)) for n in sizes})


def volatility(value: str, rows: int = 20, entity: str = ENTITY, time: str = TIME) -> Column:
    """Sample deviation of the last rows; 0 where there are fewer than two."""
    return F.coalesce(F.stddev_samp(value).over(past(rows, entity, time)), F.lit(0.0))


def smoothed(df: DataFrame, outputs: dict[str, tuple[str, float]], min_periods: int = 0, entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Add exponential averages y = (1 - a) y + a x from the first value on: outputs maps a column to its (x, a).

    The recursion unrolls into a running sum of values divided by powers of 1 - a. Chunks of rows keep the powers within a
    double, and a chunk begins with what the one before it ended with: by then the weight of what is older is below 1e-130.
    A null leaves the average as it is; it is null until there are `min_periods` values.
    """
    w = spec(entity, time).rowsBetween(Window.unboundedPreceding, 0)
    for name, (value, a) in outputs.items():
        keep = 1.0 - a
        size = max(1, math.ceil(300 / -math.log(keep))) if keep > 0 else 1
        x = F.col(value).cast("double")
        out = df.withColumn("__k", F.count(x).over(w)).withColumns({"__c": F.floor((F.col("__k") - 1) / size), "__j": F.pmod(F.col("__k") - 1, F.lit(size))})
        term = x * F.when(F.col("__k") == 1, 1.0).otherwise(a) * F.pow(F.lit(keep), -F.col("__j"))
        chunk = Window.partitionBy(entity, "__c").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("__y", F.sum(term).over(chunk) * F.pow(F.lit(keep), F.col("__j")))
        ends = F.last(F.when(F.col("__j") == size - 1, F.col("__y")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        y = F.col("__y") + F.when(F.col("__c") > 0, F.coalesce(ends, F.lit(0.0)) * F.pow(F.lit(keep), F.col("__j") + 1)).otherwise(0.0)
        last = F.last(F.when(x.isNotNull(), F.col("__z")), ignorenulls=True).over(w)
        df = out.withColumn("__z", y).withColumn(name, F.when(F.col("__k") >= max(1, min_periods), last)).drop("__k", "__c", "__j", "__y", "__z")
    return df


def ewm(df: DataFrame, value: str, outputs: dict[str, float], entity: str = ENTITY, time: str = TIME, min_periods: int = 0) -> DataFrame:
    """(entity, time, averages): one exponential average of `value` for each a in `outputs`."""
    out = smoothed(df.select(entity, time, value), {c: (value, a) for c, a in outputs.items()}, min_periods, entity, time)
    return out.select(entity, time, *outputs)


def rsi(df: DataFrame, value: str, periods: int = 14, entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """(entity, time, rsi): smoothed rises in percent of smoothed moves either way, by Wilder's smoothing; 50 until there are `periods` changes, and where nothing moves."""
    change = F.col(value) - F.lag(value).over(spec(entity, time))
    moves = df.select(entity, time, change.alias("__d")).withColumns({"__up": (F.abs("__d") + F.col("__d")) / 2, "__all": F.abs("__d")})
    out = smoothed(moves, {"__rise": ("__up", 1 / periods), "__move": ("__all", 1 / periods)}, periods, entity, time)
    return out.select(entity, time, F.coalesce(F.try_divide(F.col("__rise") * 100, F.nullif(F.col("__move"), F.lit(0.0))), F.lit(50.0)).alias("rsi"))


def macd(df: DataFrame, value: str, fast: int = 12, slow: int = 26, signal: int = 9, entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """(entity, time, macd, macd_signal): difference of two exponential averages and an exponential average of it."""
    share = lambda span: 2 / (span + 1)
    lines = smoothed(df.select(entity, time, value), {"__fast": (value, share(fast)), "__slow": (value, share(slow))}, 0, entity, time)
    return smoothed(lines.withColumn("macd", F.col("__fast") - F.col("__slow")), {"macd_signal": ("macd", share(signal))}, 0, entity, time).select(entity, time, "macd", "macd_signal")


def lags(df: DataFrame, columns: Sequence[str], steps: Sequence[int] = (1, 2, 3), fill: float | None = 0.0, entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Columns `c_lag_k`; where no row is k back, `fill`."""
    w = spec(entity, time)
    at = lambda c, k: F.lag(F.col(c).cast("double"), k).over(w)
    return df.withColumns({f"{c}_lag_{k}": at(c, k) if fill is None else F.coalesce(at(c, k), F.lit(fill)) for c in columns for k in steps})


def rolling_means(df: DataFrame, columns: Sequence[str], sizes: Sequence[int] = (3, 5), entity: str = ENTITY, time: str = TIME) -> DataFrame:
    return df.withColumns({f"{c}_mean_{n}": F.avg(F.col(c).cast("double")).over(past(n, entity, time)) for c in columns for n in sizes})


def against_history(value: str, rows: int = 20, entity: str = ENTITY, time: str = TIME) -> Column:
    """A value over the mean of the rows before it; 0 where that mean is 0 or unknown."""
    return F.coalesce(F.try_divide(F.col(value).cast("double"), F.nullif(F.avg(value).over(history(rows, entity, time)), F.lit(0.0))), F.lit(0.0))


def tone_surprise(df: DataFrame, tone: str, present: str, rows: int = 20, least: int = 5, entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """tone_history: mean tone of rows with news among those before, null under `least`; tone_ready; tone_surprise, 0 without news."""
    w = history(rows, entity, time)
    seen = F.when(F.col(present), F.col(tone))
    out = df.withColumn("tone_history", F.when(F.count(seen).over(w) >= least, F.avg(seen).over(w)))
    return out.withColumns({"tone_ready": F.col("tone_history").isNotNull().cast("double"), "tone_surprise": F.when(F.col(present) & F.col("tone_history").isNotNull(), F.col(tone) - F.col("tone_history")).otherwise(0.0)})


def volume_surprise(count: str, rows: int = 20, least: int = 5, clip: float = 5.0, entity: str = ENTITY, time: str = TIME) -> Column:
    """z-score of log(1 + count) against the rows before, clipped; 0 under `least` rows or without spread."""
    w, x = history(rows, entity, time), F.log1p(F.col(count).cast("double"))
    mean, spread = F.avg(x).over(w), F.stddev_pop(x).over(w)
    z = F.when((F.count(x).over(w) >= least) & (spread > FLAT), (x - mean) / spread)
    return F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).otherwise(0.0)


def relative_features(df: DataFrame, price: str, averages: Sequence[str], macds: Sequence[str] = ()) -> DataFrame:
    """Price over each average less 1, and oscillators over the price: free of the scale of prices."""
    out = {f"rel_{c}": F.col(price) / F.col(c) - 1 for c in averages} | {f"rel_{c}": F.col(c) / F.col(price) for c in macds}
    return df.withColumns(out)


def next_distinct(df: DataFrame, time: str = TIME) -> DataFrame:
    """(time, next_time) over all entities: the next date that any entity has; null at the last."""
    return df.select(time).distinct().withColumn(f"next_{time}", F.lead(time).over(Window.orderBy(time)))


def indexed(value: str, entity: str = ENTITY, time: str = TIME, base: float = 100.0) -> Column:
    """A series with its first value as `base`."""
    return F.col(value) / F.first(value).over(spec(entity, time).rowsBetween(Window.unboundedPreceding, 0)) * base


def varies(by: str | Sequence[str], column: str) -> Column:
    """Whether a group has more than one value of a column, on each of its rows."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    return F.coalesce(F.min(column).over(w) != F.max(column).over(w), F.lit(False))
