"""A partitioned source for news answers: one partition for each entity and range of days, with retries where it is read."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import FEED, DayRange, bisected

#: Answers that say no more than that one should ask again later.
TRANSIENT_KEYS = ("Note", "Information")


class TransientError(RuntimeError):
    """Worth another try: too many requests, a server's failure, a notice instead of an answer."""


class MalformedAnswer(RuntimeError):
    """An answer without a readable feed; never taken for an empty one."""


def checked(status: int, body: str) -> list[dict]:
    """The articles of an answer."""
    if status == 429 or status >= 500:
        raise TransientError(f"status {status}")
    try:
        answer = json.loads(body)
    except ValueError as e:
        raise MalformedAnswer("no JSON") from e
    if status != 200:
        raise MalformedAnswer(f"status {status}")
    if isinstance(answer, dict) and "feed" not in answer and any(k in answer for k in TRANSIENT_KEYS):
        raise TransientError("a notice instead of an answer")
    if not isinstance(answer, dict) or not isinstance(answer.get("feed"), list):
        raise MalformedAnswer("no feed")
    return answer["feed"]


def retried(ask: Callable[[], tuple[int, str]], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> list[dict]:
    """The articles, asking again after 1, 2, 4, ... seconds where that may help."""
    for k in range(attempts):
        try:
            return checked(*ask())
        except TransientError:
            if k + 1 == attempts:
                raise
            wait(2.0**k)
    raise AssertionError("no attempts")


def _fetcher(name: str) -> Callable[[str, date, date], tuple[int, str]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Range(InputPartition):
    def __init__(self, ticker: str, start: str, end: str) -> None:
        super().__init__(None)
        self.ticker, self.start, self.end = ticker, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(*r.split("/")) for r in self.options["ranges"].split(";") if r]

    def read(self, partition: _Range) -> Iterator[tuple]:
        fetch = _fetcher(self.options["fetcher"])
        start, end = date.fromisoformat(partition.start), date.fromisoformat(partition.end)
        articles = retried(lambda: fetch(partition.ticker, start, end), int(self.options.get("attempts", 3)))
        yield partition.ticker, start, end, json.dumps({"feed": articles})


class FeedSource(DataSource):
    """Rows (ticker, range_start, range_end, json); option `fetcher` names module:function of (ticker, start, end)."""

    @classmethod
    def name(cls) -> str:
        return "news_feed"

    def schema(self) -> str:
        return "ticker string, range_start date, range_end date, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_feed(spark: SparkSession, fetcher: str, ranges: Sequence[tuple[str, date, date]], attempts: int = 3) -> DataFrame:
    """Answers of an injected fetcher; flatten them with `readers.flatten_feed`."""
    spark.dataSource.register(FeedSource)
    wanted = ";".join(f"{t}/{a}/{b}" for t, a, b in ranges)
    return spark.read.format("news_feed").options(fetcher=fetcher, ranges=wanted, attempts=attempts).load()


def planned(ticker: str, start: date, end: date, count: Callable[[DayRange], int], most: int = 950) -> list[tuple[str, date, date]]:
    """Ranges of an entity none of which fills an answer."""
    return [(ticker, r.start, r.end) for r, _ in bisected(DayRange(start, end), count, most)]


__all__ = ["FEED", "FeedSource", "MalformedAnswer", "TransientError", "checked", "planned", "read_feed", "retried"]
