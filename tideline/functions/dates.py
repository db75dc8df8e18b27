"""Dates and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_compact(text: str | Column) -> Column:
    """A stamp such as 20240102T093000; null if it is none."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text, F.lit("yyyyMMdd'T'HHmmss"))


def local_date(instant: str | Column, zone: str = "America/New_York") -> Column:
    """The date that an instant in UTC has in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def month(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def years_before(date: str | Column, years: int) -> Column:
    return F.add_months(date, -12 * years)


def midpoint(start: str | Column, end: str | Column) -> Column:
    """The date half way, the earlier of two."""
    s = F.col(start) if isinstance(start, str) else start
    return F.date_add(s, F.floor(F.datediff(end, s) / 2).cast("int"))
