"""Named pipelines: the point-in-time dataset, feature variants, quality audit, comparison of approaches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month
from ..operators import aggregates, contracts, dedup, joins, metrics, reshape
from ..operators import windows as w
from . import domain
from .catalog import query, table
from .substrate import labelled, news, panel, predictions, sessions


def clean_news(raw: DataFrame, entities: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """News of known entities with stamp and title, the first of each key."""
    out = raw.where(F.col("ticker").isin(list(entities))).dropna(subset=["ts", "ticker"]).where(F.trim("title") != "")
    return dedup.keep_first(out, keys, order)


def point_in_time(prices: DataFrame, items: DataFrame, schedule: DataFrame) -> DataFrame:
    """The session panel with what was published up to each close: contracts, as-of join, aggregation, left join, fill.

    `prices` has ticker, date, px and labels; `items` ticker, ts, score, relevance, label, title; nothing that was
    published after a session's close reaches it.
    """
    contracts.enforce(contracts.expect_between(items, {"score": (-1.0, 1.0), "relevance": (0.0, 1.0)}))
    contracts.enforce(contracts.expect_unique(prices, ["ticker", "date"]))
    hit = joins.asof_forward(items, schedule, "ts", "market_close").where("market_close IS NOT NULL")
    hit = hit.withColumn("off_session", F.to_date("ts") != F.col("trading_date"))
    day = aggregates.daily_sentiment(hit, ["ticker", "trading_date"], "score", "label", "title", "off_session")
    mean = hit.groupBy("ticker", "trading_date").agg(aggregates.weighted_mean("score", "relevance").alias("sentiment_weighted"))
    both = day.join(mean, ["ticker", "trading_date"]).withColumnRenamed("trading_date", "date")
    fill = {c: 0 if c.endswith("count") else 0.0 for c in both.columns if c not in ("ticker", "date")}
    return joins.left_join_fill(prices, both, ["ticker", "date"], fill, "has_news")


@query(
    "point_in_time",
    "ticker s, date d, target i, sentiment_mean f6, news_count i, non_trading_news_count i, positive_news_count i, sentiment_weighted f6, has_news b",
    """SELECT l.ticker, l.date, l.target, coalesce(m, 0) AS sentiment_mean, coalesce(n, 0) AS news_count, coalesce(o, 0) AS non_trading_news_count, coalesce(p, 0) AS positive_news_count, coalesce(v, 0) AS sentiment_weighted, n IS NOT NULL AS has_news
    FROM labelled l LEFT JOIN (
      SELECT a.ticker, c.d AS date, avg(score) AS m, count(*) AS n, count(*) FILTER (CAST(a.at AS DATE) <> c.d) AS o, count(title) FILTER (label = 'positive') AS p, coalesce(sum(score * relevance) / nullif(sum(relevance), 0), 0) AS v
      FROM (SELECT *, ts - INTERVAL 9496 DAYS AS at FROM news) a ASOF JOIN (SELECT date AS d, CAST(date AS TIMESTAMP) + INTERVAL 20 HOURS AS close FROM (SELECT DISTINCT date FROM panel)) c ON a.at <= c.close GROUP BY 1, 2) x USING (ticker, date)""",
    "labelled news panel",
)
def _point_in_time(spark, sf):
    days = panel(spark, sf).select(F.col("date").alias("trading_date")).distinct().withColumn("market_close", F.expr("cast(trading_date as timestamp_ntz) + INTERVAL 20 HOURS"))
    items = news(spark, sf).drop("date").withColumn("ts", F.expr("ts - INTERVAL 9496 DAYS"))
    return point_in_time(labelled(spark, sf), items, days)


def feature_variants(df: DataFrame, price: str, volume: str, tone: str, count: str, flag: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Every column of the ablation in one plan of shared windows, and the schema of each variant."""
    out = w.moving_averages(df, price, (5, 20, 50))
    out = w.relative_features(out, price, ["sma_5", "sma_20", "sma_50"])
    out = out.withColumns({"daily_return": w.simple_return(price), "relative_volume": w.against_history(volume), "volume_surprise": w.volume_surprise(count)})
    out = w.tone_surprise(out, tone, flag)
    out = w.rolling_means(w.lags(out, [tone, count]), [tone, count])
    out = w.lags(out, ["tone_surprise", "volume_surprise"], [1])
    base = [price, volume, "daily_return", "sma_5", "sma_20", "sma_50"]
    relative = ["daily_return", "rel_sma_5", "rel_sma_20", "rel_sma_50", "relative_volume"]
    now = [tone, count, flag]
    lagged = [f"{c}_lag_{k}" for c in (tone, count) for k in (1, 2, 3)] + [f"{c}_mean_{k}" for c in (tone, count) for k in (3, 5)]
    enriched = ["tone_surprise", "tone_ready", "volume_surprise", "tone_surprise_lag_1", "volume_surprise_lag_1"]
    schemas = {"base": base, "sentiment": now, "hybrid": base + now, "lagged": base + now + lagged, "lag_1": base + now + [f"{tone}_lag_1", f"{count}_lag_1"], "relative": relative, "relative_hybrid": relative + now, "enriched": relative + now + enriched}
    return out, schemas


@query("feature_variants", "ticker s, date d, rel_sma_50 f6, relative_volume f6, tone_lag_2 f6, tone_mean_5 f6, tone_surprise_lag_1 f6, volume_surprise f5", """SELECT *, coalesce(lag(ts_) OVER (PARTITION BY ticker ORDER BY date), 0) AS tone_surprise_lag_1 FROM (
  SELECT ticker, date, px / avg(px) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) - 1 AS rel_sma_50, coalesce(volume / nullif(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 0) AS relative_volume, coalesce(lag(tone, 2) OVER w, 0) AS tone_lag_2, avg(tone) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tone_mean_5,
   CASE WHEN has_news AND count(CASE WHEN has_news THEN tone END) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 5 THEN tone - avg(CASE WHEN has_news THEN tone END) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) ELSE 0 END AS ts_,
   coalesce(CASE WHEN count(x) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 5 AND stddev_pop(x) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) > 1e-9 THEN greatest(-5, least(5, (x - avg(x) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) / stddev_pop(x) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))) END, 0) AS volume_surprise
  FROM (SELECT *, ln(1 + news_count) AS x FROM sessions) WINDOW w AS (PARTITION BY ticker ORDER BY date))""", "sessions")
def _feature_variants(spark, sf):
    return feature_variants(sessions(spark, sf), "px", "volume", "tone", "news_count", "has_news")[0]


def quality_audit(before: DataFrame, links: DataFrame, ident: str) -> DataFrame:
    """By entity and month: items, items that causal dedup removed, sources, and the largest source's share."""
    both = before.join(links.select(ident, "kept"), ident).withColumn("month", month("date"))
    by = both.groupBy("ticker", "month").agg(F.count("*").alias("items"), F.count_if(~F.col("kept")).alias("removed"), F.count_distinct("title").alias("titles"))
    top = aggregates.share_of_total(both, ["ticker", "month"], "title").groupBy("ticker", "month").agg(F.max("share").alias("largest_share"))
    return by.join(top, ["ticker", "month"]).withColumn("removed_share", aggregates.ratio(F.col("removed"), F.col("items")))


@query(
    "quality_audit",
    "ticker s, month s, items i, titles i, removed i, removed_share f6, largest_share f6",
    """SELECT *, removed / items AS removed_share FROM (WITH RECURSIVE o AS (SELECT event_id, ticker, title, ts, date, row_number() OVER (PARTITION BY ticker, title ORDER BY ts, event_id) AS k FROM news),
    f AS (SELECT ticker, title, date, k, true AS kept, ts AS anchor FROM o WHERE k = 1
      UNION ALL
      SELECT o.ticker, o.title, o.date, o.k, o.ts > f.anchor + INTERVAL 24 HOURS, CASE WHEN o.ts > f.anchor + INTERVAL 24 HOURS THEN o.ts ELSE f.anchor END
      FROM f JOIN o ON o.ticker = f.ticker AND o.title = f.title AND o.k = f.k + 1)
    SELECT ticker, month, sum(n) AS items, count(*) AS titles, CAST(sum(gone) AS BIGINT) AS removed, max(n) / sum(n) AS largest_share FROM (SELECT ticker, strftime(date, '%Y-%m') AS month, title, count(*) AS n, count(*) FILTER (NOT kept) AS gone FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
    "news",
)
def _quality_audit(spark, sf):
    n = news(spark, sf)
    return quality_audit(n, dedup.causal_dedup(n, ["ticker", "title"], "ts", "event_id"), "event_id")


def rebuild_sentiment(prices: DataFrame, kept: DataFrame) -> DataFrame:
    """Daily sentiment of a subset of news on the same panel; without any news all of it is 0."""
    day = kept.groupBy("ticker", "date").agg(F.avg("score").alias("tone"), aggregates.weighted_mean("score", "relevance").alias("weighted"), F.count("*").alias("news_count"))
    return joins.left_join_fill(prices, day, ["ticker", "date"], {"tone": 0.0, "weighted": 0.0, "news_count": 0}, "has_news")


@query("rebuild_sentiment", "ticker s, date d, tone f6, weighted f6, news_count i, has_news b", "SELECT p.ticker, p.date, coalesce(t, 0) AS tone, coalesce(v, 0) AS weighted, coalesce(n, 0) AS news_count, n IS NOT NULL AS has_news FROM panel p LEFT JOIN (SELECT ticker, date, avg(score) AS t, sum(score * relevance) / nullif(sum(relevance), 0) AS v, count(*) AS n FROM news WHERE relevance >= 0.5 GROUP BY 1, 2) USING (ticker, date)", "panel news")
def _rebuild(spark, sf):
    return rebuild_sentiment(panel(spark, sf), news(spark, sf).where("relevance >= 0.5"))


@query("compare_approaches", "ticker s, n i, auc_base f6, auc_other f6, delta f6", """SELECT *, auc_other - auc_base AS delta FROM (SELECT ticker, max(n) AS n, max(auc) FILTER (arm = 'base') AS auc_base, max(auc) FILTER (arm = 'other') AS auc_other FROM (
  SELECT ticker, arm, sum(m) AS n, sum(p * (below + q / CAST(2 AS DOUBLE))) / nullif(CAST(sum(p) AS DOUBLE) * sum(q), 0) AS auc FROM (SELECT *, p + q AS m, sum(q) OVER (PARTITION BY ticker, arm ORDER BY s) - q AS below FROM (
    SELECT ticker, arm, s, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS q FROM (SELECT ticker, target, 'base' AS arm, probability AS s FROM predictions UNION ALL SELECT ticker, target, 'other', round((probability + other) / 2, 4) FROM predictions) GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY 1)""", "predictions")
def _compare_approaches(spark, sf):
    """Two approaches on the same rows, after their pairing is checked."""
    p = predictions(spark, sf)
    other = p.withColumn("probability", F.round((F.col("probability") + F.col("other")) / 2, 4))
    contracts.enforce(contracts.expect_paired(p, other, ["doc_id", "target", "outer_fold"]))
    both = reshape.union_all(p.withColumn("arm", F.lit("base")), other.withColumn("arm", F.lit("other")))
    auc = metrics.roc_auc(both, ["ticker", "arm"]).join(both.groupBy("ticker", "arm").agg(F.count("*").alias("n")), ["ticker", "arm"])
    out = joins.contrast(auc, ["ticker"], "arm", "base", "other", ["auc", "n"])
    return out.withColumnsRenamed({"auc_delta": "delta", "n_base": "n"})


@query("clean_news", "event_id i, ticker s, title s", "SELECT event_id, ticker, title FROM (SELECT *, row_number() OVER (PARTITION BY ticker, title, date ORDER BY ts, event_id) AS k FROM news WHERE ticker IN ('1-URGENT', '2-HIGH') AND ts IS NOT NULL AND trim(title) <> '') WHERE k = 1", "news")
def _clean_news(spark, sf):
    return clean_news(news(spark, sf), ["1-URGENT", "2-HIGH"], ["ticker", "title", "date"], ["ts", "event_id"])


def _domain_news(spark, sf):
    """(ticker, published_at, url, title, summary, text) of the domain, made of events."""
    e = table(spark, sf, "events")
    names = F.element_at(F.array(*(F.lit(x) for x in ("Apple", "Microsoft", "Nvidia", "TSLA"))), (F.col("user_id") % 4 + 1).cast("int"))
    title = F.when(F.col("event_type") == "purchase", F.concat(names, F.lit(" Stock Price History"))).when(F.col("event_type") == "error", F.lit("ETF fund holdings of the week")).otherwise(F.concat(F.lit("News of "), names))
    summary = F.when(F.col("user_id") % 3 == 0, F.lit("Markets were calm. Nobody said why.")).otherwise(F.concat(F.lit("It rose. "), names, F.lit(" did so too.")))
    url = F.concat(F.lit("https://Example.com/"), F.when(F.col("user_id") % 5 == 0, "quote/").otherwise("News/"), F.col("event_id").cast("string"))
    ticker = F.element_at(F.array(*map(F.lit, domain.TICKERS)), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select("event_id", ticker.alias("ticker"), F.col("ts").cast("timestamp").alias("published_at"), url.alias("url"), title.alias("title"), summary.alias("summary"), F.when(F.col("user_id") % 11 == 0, " ").otherwise(summary).alias("text"))


_NAME = "CASE user_id % 4 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Microsoft' WHEN 2 THEN 'Nvidia' ELSE 'TSLA' END"
_DOMAIN_SQL = f"""SELECT *, CASE WHEN user_id % 11 = 0 THEN ' ' ELSE summary END AS text FROM (SELECT event_id, user_id, ts, CASE user_id % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'MSFT' WHEN 2 THEN 'NVDA' ELSE 'TSLA' END AS ticker,
  'https://Example.com/' || CASE WHEN user_id % 5 = 0 THEN 'quote/' ELSE 'News/' END || event_id AS url,
  CASE event_type WHEN 'purchase' THEN {_NAME} || ' Stock Price History' WHEN 'error' THEN 'ETF fund holdings of the week' ELSE 'News of ' || {_NAME} END AS title,
  CASE WHEN user_id % 3 = 0 THEN 'Markets were calm. Nobody said why.' ELSE 'It rose. ' || {_NAME} || ' did so too.' END AS summary FROM events)"""


@query(
    "domain_eligible",
    "event_id i, news_id s, explicit_company b, dynamic_page b, post_checkpoint b, eligible b",
    f"""SELECT *, explicit_company AND NOT dynamic_page AND post_checkpoint AND trim(text) <> '' AS eligible FROM (SELECT event_id, text,
    sha256(concat_ws(chr(31), ticker, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00', url, title, text)) AS news_id,
    regexp_matches(title || ' ' || summary, '(?i)\\b(?:' || CASE ticker WHEN 'AAPL' THEN 'Apple|AAPL' WHEN 'MSFT' THEN 'Microsoft|MSFT' WHEN 'NVDA' THEN 'NVIDIA|NVDA' ELSE 'Tesla|TSLA' END || ')\\b') AS explicit_company,
    regexp_matches(title, '{domain.DYNAMIC_TITLES}') OR user_id % 5 = 0 AS dynamic_page, ts >= TIMESTAMP '2024-01-15' AS post_checkpoint FROM ({_DOMAIN_SQL}))""",
)
def _domain_eligible(spark, sf):
    """Identity and the four conditions of eligibility of the domain's news."""
    return domain.eligible_news(_domain_news(spark, sf), date(2024, 1, 15))


@query(
    "domain_prepared",
    "event_id i, part s, multi_company b, cross_boundary b, group_size i, function_words i",
    f"""SELECT event_id, part, max(ticker) OVER g <> min(ticker) OVER g AS multi_company, max(part) OVER g <> min(part) OVER g AS cross_boundary, count(*) OVER g AS group_size, len(regexp_extract_all(text, '(?i)\\b(?:the|and|of|to|in|for|with|is|on|its)\\b')) AS function_words
    FROM (SELECT event_id, ticker, text, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'development' ELSE 'evaluation' END AS part FROM ({_DOMAIN_SQL}) WHERE user_id % 3 = 0 AND user_id % 11 <> 0)
    WINDOW g AS (PARTITION BY 1)""",
)
def _domain_prepared(spark, sf):
    """News that all share one text are one group, over entities and over the cutoff."""
    n = _domain_news(spark, sf).where(F.col("text") == "Markets were calm. Nobody said why.")
    out = domain.prepare_news(n, date(2024, 1, 15))
    return out.withColumn("group_size", F.count("*").over(Window.partitionBy("group_id"))).withColumnsRenamed({"partition": "part", "english_function_words": "function_words"})
