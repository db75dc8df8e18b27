"""Trading sessions of the US stock exchanges from the public rules: weekends, holidays, early closes, daylight saving."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Closures that no rule gives.
SPECIAL_CLOSURES = (date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9))
ZONE, CLOSE, EARLY = "America/New_York", "16:00:00", "13:00:00"


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th given weekday of a month; from the end if n is negative."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year, month, 28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7 + 7 * (-n - 1))


def easter(year: int) -> date:
    """Easter Sunday in the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(year, f // 31, f % 31 + 1)


def _observed(d: date) -> date | None:
    """Sunday holidays are kept on Monday, Saturday ones on Friday."""
    return d + timedelta(days=1) if d.weekday() == 6 else d - timedelta(days=1) if d.weekday() == 5 else d


def holidays(year: int) -> set[date]:
    new_year = date(year, 1, 1)
    out = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(days=2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    if new_year.weekday() != 5:  # a Saturday's new year is not kept in the old year
        out.add(_observed(new_year))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return out | {d for d in SPECIAL_CLOSURES if d.year == year}


def early_closes(year: int) -> set[date]:
    out = {_nth(year, 11, 3, 4) + timedelta(days=1)}
    for d in (date(year, 7, 3), date(year, 12, 24)):
        if d.weekday() < 5:
            out.add(d)
    return out - holidays(year)


def trading_schedule(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(trading_date, market_close): sessions of a closed range with their closes as instants in UTC."""
    years = range(start.year, end.year + 1)
    closed = sorted(d for y in years for d in holidays(y))
    early = sorted(d for y in years for d in early_closes(y))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("trading_date"))
    off = F.col("trading_date").isin(closed) if closed else F.lit(False)
    hour = F.when(F.col("trading_date").isin(early), EARLY).otherwise(CLOSE)
    local = F.to_timestamp(F.concat(F.col("trading_date").cast("string"), F.lit(" "), hour))
    return days.where((F.weekday("trading_date") < 5) & ~off).select("trading_date", F.to_utc_timestamp(local, ZONE).alias("market_close"))
