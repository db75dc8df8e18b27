"""The domain's tables from the given ones: a session panel from orders, news from events, predictions from labels.

Each builder has a view of the same name in SQL, for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import case_map
from ..operators import windows
from .catalog import table

#: Entities, in the order of the remainder that gives an event its entity.
ENTITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Days from the first session that news fall on to the first event.
SHIFT = 9496
CLASSES = {"purchase": "positive", "signup": "positive", "error": "negative"}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, px, volume): mean order value in whole cents, so that sums of it are exact, and orders, by priority and day."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.floor(cents.cast("double") / F.count("*")).cast("double").alias("px"), F.count("*").alias("volume"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with next_px, target_end and target."""
    return windows.next_label(panel(spark, sf_dir), "px")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, ticker, user_id, title, label, score, relevance, date): score within [-1, 1], relevance within [0, 1]."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.element_at(F.array(*map(F.lit, ENTITIES)), (F.col("user_id") % 5 + 1).cast("int")).alias("ticker"),
        "user_id",
        F.concat_ws(" ", "event_type", (F.col("user_id") % 7).cast("string")).alias("title"),
        case_map("event_type", CLASSES, "neutral").alias("label"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 10) / 20)).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("relevance"),
        F.date_sub(F.to_date("ts"), SHIFT).alias("date"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by entity and day: mean score, rows, off-hours rows, whether there were any."""
    n = news(spark, sf_dir)
    return n.groupBy("ticker", "date").agg(F.avg("score").alias("tone"), F.count("*").alias("news_count"), F.count_if(F.hour("ts") >= 20).alias("late_count"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its news; has_news tells sessions without news from those with a neutral tone."""
    both = panel(spark, sf_dir).join(daily(spark, sf_dir), ["ticker", "date"], "left").withColumn("has_news", F.col("news_count").isNotNull())
    return both.na.fill({"tone": 0.0, "news_count": 0, "late_count": 0})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ticker, year, outer_fold, target, other, probability, prediction) of the labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = F.floor(F.col("n_chars") * 1000 / (F.col("n_chars") + 1500)).cast("double") / 1000
    both = table(spark, sf_dir, "labels").join(d, "doc_id")
    return both.select("doc_id", F.col("source").alias("ticker"), F.col("lang").alias("year"), (F.col("doc_id") % 3).alias("outer_fold"), F.col("quality").alias("target"), F.col("toxic").alias("other"), p.alias("probability")).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, a, b): three classes by status and by value."""
    o = table(spark, sf_dir, "orders")
    b = F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 350000, "O").otherwise("P")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("a"), b.alias("b"))


_ENTITY = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENTITIES)) + " END"
_LABEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items()) + " ELSE 'neutral' END"

#: View: (views that it needs, SQL).
VIEWS: dict[str, tuple[str, str]] = {
    "panel": ("", "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, CAST(floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS DOUBLE) AS px, count(*) AS volume FROM orders GROUP BY 1, 2"),
    "labelled": ("panel", "SELECT * FROM (SELECT *, lead(px) OVER w AS next_px, lead(date) OVER w AS target_end, CASE WHEN lead(px) OVER w > px THEN 1 ELSE 0 END AS target FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE next_px IS NOT NULL"),
    "news": ("", f"SELECT event_id, ts, {_ENTITY} AS ticker, user_id, event_type || ' ' || CAST(user_id % 7 AS VARCHAR) AS title, {_LABEL} AS label, greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), (value - 10) / 20)) AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS relevance, CAST(ts AS DATE) - {SHIFT} AS date FROM events"),
    "daily": ("news", "SELECT ticker, date, avg(score) AS tone, count(*) AS news_count, count(*) FILTER (hour(ts) >= 20) AS late_count FROM news GROUP BY 1, 2"),
    "sessions": ("panel news daily", "SELECT p.*, coalesce(d.tone, 0) AS tone, coalesce(d.news_count, 0) AS news_count, coalesce(d.late_count, 0) AS late_count, d.news_count IS NOT NULL AS has_news FROM panel p LEFT JOIN daily d USING (ticker, date)"),
    "predictions": ("", "SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (SELECT doc_id, source AS ticker, lang AS year, doc_id % 3 AS outer_fold, quality AS target, toxic AS other, floor(CAST(n_chars * 1000 AS DOUBLE) / (n_chars + 1500)) / CAST(1000 AS DOUBLE) AS probability FROM labels JOIN documents USING (doc_id))"),
    "annotated": ("", "SELECT o_orderkey, o_orderpriority AS ticker, o_orderstatus AS a, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'P' END AS b FROM orders"),
    "schedule": ("", "SELECT d AS trading_date, CAST(d AS TIMESTAMP) + INTERVAL 20 HOURS AS market_close FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) WHERE isodow(d) < 6"),
}


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trading_date, market_close): week days that have events, closing at 20:00."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("trading_date")).distinct().where(F.weekday("trading_date") < 5)
    return days.withColumn("market_close", F.expr("cast(trading_date as timestamp_ntz) + INTERVAL 20 HOURS"))
