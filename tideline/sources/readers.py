"""Scans with declared schemas, and planning of ranged downloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in all floating columns: files write missing numbers as NaN."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str = ",", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV or TSV with a header and a declared schema; a value that does not parse is null; numbers are never NaN."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("sep", sep).option("dateFormat", date_format).option("mode", "PERMISSIVE").csv(path if isinstance(path, str) else list(path)))


def read_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """All columns as strings, empty ones as "": nothing is taken for a missing value."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", "\x00").option("emptyValue", "").csv(path).na.fill("")


def read_many(spark: SparkSession, paths: Sequence[str], schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Files that may be absent or empty, with the file of each row; none at all gives an empty table of the schema."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := hadoop.Path(p)).getFileSystem(conf).globStatus(q)]
    full = T.StructType([*schema.fields, T.StructField("source_file", T.StringType())])
    if not there:
        return spark.createDataFrame([], full)
    reader = spark.read.schema(schema)
    reader = reader.option("header", True) if fmt == "csv" else reader
    return reader.format(fmt).load(there).withColumn("source_file", F.col("_metadata.file_path"))


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is not yet materialised: resumption of an interrupted run."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def yearly_ranges(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(year, range_start, range_end) that cover a closed range of dates."""
    s, e = F.lit(start), F.lit(end)
    years = spark.range(1).select(F.explode(F.sequence(F.year(s), F.year(e))).alias("year"))
    return years.select("year", F.greatest(s, F.make_date("year", F.lit(1), F.lit(1))).alias("range_start"), F.least(e, F.make_date("year", F.lit(12), F.lit(31))).alias("range_end"))


class Saturated(RuntimeError):
    """A single day holds more rows than one request returns."""


@dataclass(frozen=True)
class DayRange:
    start: date
    end: date

    def halves(self) -> tuple[DayRange, DayRange]:
        middle = self.start + timedelta(days=(self.end - self.start).days // 2)
        return DayRange(self.start, middle), DayRange(middle + timedelta(days=1), self.end)


def bisected(whole: DayRange, count: Callable[[DayRange], int], most: int = 950) -> Iterator[tuple[DayRange, int]]:
    """Ranges, in order, each of which holds fewer than `most` rows; a range that is full is halved, a full day raises."""
    n = count(whole)
    if n < most:
        yield whole, n
    elif whole.start == whole.end:
        raise Saturated(str(whole.start))
    else:
        for half in whole.halves():
            yield from bisected(half, count, most)


def bisected_days(counts: DataFrame, day: str, n: str, most: int = 950) -> list[tuple[date, date, int]]:
    """`bisected` over a table of rows by day (one row for each day, so of bounded size)."""
    by = {r[day]: r[n] for r in counts.select(day, n).collect()}
    if not by:
        return []
    total = lambda r: sum(v for d, v in by.items() if r.start <= d <= r.end)
    return [(r.start, r.end, c) for r, c in bisected(DayRange(min(by), max(by)), total, most)]


FEED = T.StructType(
    [
        T.StructField(
            "feed",
            T.ArrayType(
                T.StructType(
                    [
                        *(T.StructField(c, T.StringType()) for c in ("title", "summary", "url", "source", "source_domain", "time_published", "banner_image", "overall_sentiment_score", "overall_sentiment_label")),
                        T.StructField("ticker_sentiment", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "relevance_score", "ticker_sentiment_score", "ticker_sentiment_label")]))),
                    ]
                )
            ),
        )
    ]
)


def flatten_feed(df: DataFrame, json: str, ticker: str | Column) -> DataFrame:
    """One row for each article of a JSON answer with what it says of `ticker`; an article that says nothing has nulls.

    An answer without a readable feed raises: it must never pass for an empty one.
    """
    t = F.col(ticker) if isinstance(ticker, str) else ticker
    parsed = df.withColumn("__feed", F.from_json(json, FEED)["feed"])
    checked = parsed.withColumn("__feed", F.when(F.col("__feed").isNull(), F.raise_error(F.lit("answer without a feed"))).otherwise(F.col("__feed")))
    rows = checked.withColumn("__t", t).select("__t", F.explode("__feed").alias("a"))
    own = F.try_element_at(F.filter("a.ticker_sentiment", lambda x: x["ticker"] == F.col("__t")), F.lit(1))
    top = [f.name for f in FEED["feed"].dataType.elementType.fields if f.name != "ticker_sentiment"]
    return rows.select(F.col("__t").alias("ticker"), *(F.col(f"a.{c}").alias(c) for c in top), *(own[c].alias(c) for c in ("relevance_score", "ticker_sentiment_score", "ticker_sentiment_label")))
