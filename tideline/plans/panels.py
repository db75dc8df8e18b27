"""Queries on panels: labels, indicators, lags, histories."""

from __future__ import annotations


from ..operators import windows as w
from .catalog import query
from .substrate import labelled, panel, sessions

K = "ticker s, date d"


@query("target_label", f"{K}, px f2, next_px f2, target_end d, target i", "SELECT * FROM labelled", "labelled")
def _target_label(spark, sf):
    return labelled(spark, sf)


@query("daily_return", f"{K}, daily_return f8", "SELECT ticker, date, coalesce(px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS daily_return FROM panel", "panel")
def _daily_return(spark, sf):
    return panel(spark, sf).withColumn("daily_return", w.simple_return("px"))


@query("sma", f"{K}, sma_5 f2, sma_20 f2, sma_50 f2", "SELECT ticker, date, " + ", ".join(f"avg(px) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sma_{n}" for n in (5, 20, 50)) + " FROM panel", "panel")
def _sma(spark, sf):
    return w.moving_averages(panel(spark, sf), "px")


RETURNS = "SELECT *, coalesce(px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS r FROM panel"


@query("volatility", f"{K}, volatility_20 f6", f"SELECT ticker, date, coalesce(stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS volatility_20 FROM ({RETURNS})", "panel")
def _volatility(spark, sf):
    return panel(spark, sf).withColumn("r", w.simple_return("px")).withColumn("volatility_20", w.volatility("r"))


NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel)"


@query(
    "macd",
    f"{K}, macd f2, macd_signal f2",
    f"""SELECT * FROM (WITH RECURSIVE {NUMBERED}, ema AS (
      SELECT ticker, date, k, px AS fast, px AS slow, CAST(0 AS DOUBLE) AS macd, CAST(0 AS DOUBLE) AS macd_signal FROM numbered WHERE k = 1
      UNION ALL
      SELECT ticker, date, k, fast, slow, fast - slow, macd_signal * (1 - CAST(2 AS DOUBLE) / 10) + (fast - slow) * (CAST(2 AS DOUBLE) / 10) FROM (
        SELECT n.ticker, n.date, n.k, e.fast * (1 - CAST(2 AS DOUBLE) / 13) + n.px * (CAST(2 AS DOUBLE) / 13) AS fast, e.slow * (1 - CAST(2 AS DOUBLE) / 27) + n.px * (CAST(2 AS DOUBLE) / 27) AS slow, e.macd_signal
        FROM ema e JOIN numbered n ON n.ticker = e.ticker AND n.k = e.k + 1))
    SELECT ticker, date, macd, macd_signal FROM ema)""",
    "panel",
)
def _macd(spark, sf):
    return w.macd(panel(spark, sf), "px")


@query(
    "rsi",
    f"{K}, rsi f4",
    """SELECT * FROM (WITH RECURSIVE moves AS (SELECT ticker, date, row_number() OVER w AS k, greatest(px - lag(px) OVER w, 0) AS gain, greatest(lag(px) OVER w - px, 0) AS loss, lag(px) OVER w IS NULL AS first_ FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    smooth AS (
      SELECT ticker, date, k, gain AS g, loss AS l FROM moves WHERE k = 2
      UNION ALL
      SELECT m.ticker, m.date, m.k, s.g * (1 - CAST(1 AS DOUBLE) / 14) + m.gain * (CAST(1 AS DOUBLE) / 14), s.l * (1 - CAST(1 AS DOUBLE) / 14) + m.loss * (CAST(1 AS DOUBLE) / 14) FROM smooth s JOIN moves m ON m.ticker = s.ticker AND m.k = s.k + 1)
    SELECT m.ticker, m.date, CASE WHEN m.k < 15 OR (s.g = 0 AND s.l = 0) THEN 50 WHEN s.l = 0 THEN 100 ELSE 100 - 100 / (1 + s.g / s.l) END AS rsi FROM moves m LEFT JOIN smooth s USING (ticker, k))""",
    "panel",
)
def _rsi(spark, sf):
    return w.rsi(panel(spark, sf), "px")


@query("ewm", f"{K}, ewm_slow f2", f"""SELECT * FROM (WITH RECURSIVE {NUMBERED}, e AS (SELECT ticker, date, k, px AS y FROM numbered WHERE k = 1 UNION ALL SELECT n.ticker, n.date, n.k, e.y * CAST(0.9 AS DOUBLE) + n.px * CAST(0.1 AS DOUBLE) FROM e JOIN numbered n ON n.ticker = e.ticker AND n.k = e.k + 1) SELECT ticker, date, y AS ewm_slow FROM e)""", "panel")
def _ewm(spark, sf):
    return w.ewm(panel(spark, sf), "px", {"ewm_slow": 0.1})


@query("lags", f"{K}, tone_lag_1 f6, tone_lag_2 f6, tone_lag_3 f6, news_count_lag_1 f6, has_news_lag_1 f6", "SELECT ticker, date, " + ", ".join(f"coalesce(lag(CAST({c} AS DOUBLE), {k}) OVER (PARTITION BY ticker ORDER BY date), 0) AS {c}_lag_{k}" for c, k in (("tone", 1), ("tone", 2), ("tone", 3), ("news_count", 1), ("has_news", 1))) + " FROM sessions", "sessions")
def _lags(spark, sf):
    return w.lags(sessions(spark, sf), ["tone", "news_count", "has_news"])


@query("rolling_means", f"{K}, tone_mean_3 f6, tone_mean_5 f6, news_count_mean_3 f6, news_count_mean_5 f6", "SELECT ticker, date, " + ", ".join(f"avg({c}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_mean_{n}" for c in ("tone", "news_count") for n in (3, 5)) + " FROM sessions", "sessions")
def _rolling_means(spark, sf):
    return w.rolling_means(sessions(spark, sf), ["tone", "news_count"])


HISTORY = "PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"


@query("relative_volume", f"{K}, relative_volume f6", f"SELECT ticker, date, coalesce(volume / nullif(avg(volume) OVER ({HISTORY}), 0), 0) AS relative_volume FROM panel", "panel")
def _relative_volume(spark, sf):
    return panel(spark, sf).withColumn("relative_volume", w.against_history("volume"))


@query(
    "tone_surprise",
    f"{K}, tone_history f6, tone_ready f1, tone_surprise f6",
    f"""SELECT ticker, date, h AS tone_history, CASE WHEN h IS NULL THEN 0 ELSE 1 END AS tone_ready, CASE WHEN has_news AND h IS NOT NULL THEN tone - h ELSE 0 END AS tone_surprise FROM (
      SELECT *, CASE WHEN count(CASE WHEN has_news THEN tone END) OVER ({HISTORY}) >= 5 THEN avg(CASE WHEN has_news THEN tone END) OVER ({HISTORY}) END AS h FROM sessions)""",
    "sessions",
)
def _tone_surprise(spark, sf):
    return w.tone_surprise(sessions(spark, sf), "tone", "has_news")


@query(
    "volume_surprise",
    f"{K}, volume_surprise f5",
    f"""SELECT ticker, date, coalesce(CASE WHEN n >= 5 AND s > 1e-9 THEN greatest(-5, least(5, (x - m) / s)) END, 0) AS volume_surprise FROM (
      SELECT *, count(x) OVER ({HISTORY}) AS n, avg(x) OVER ({HISTORY}) AS m, stddev_pop(x) OVER ({HISTORY}) AS s FROM (SELECT *, ln(1 + volume) AS x FROM panel))""",
    "panel",
)
def _volume_surprise(spark, sf):
    return panel(spark, sf).withColumn("volume_surprise", w.volume_surprise("volume"))


@query("relative_features", f"{K}, rel_sma_5 f6, rel_sma_20 f6, lag_rel_sma_5 f6", "SELECT ticker, date, r5 AS rel_sma_5, r20 AS rel_sma_20, coalesce(lag(r5) OVER (PARTITION BY ticker ORDER BY date), 0) AS lag_rel_sma_5 FROM (SELECT *, " + ", ".join(f"px / avg(px) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) - 1 AS r{n}" for n in (5, 20)) + " FROM panel)", "panel")
def _relative_features(spark, sf):
    df = w.relative_features(w.moving_averages(panel(spark, sf), "px", (5, 20)), "px", ["sma_5", "sma_20"])
    return w.lags(df, ["rel_sma_5"], [1]).withColumnRenamed("rel_sma_5_lag_1", "lag_rel_sma_5")


@query("legacy_horizon", f"{K}, next_date d", "SELECT ticker, date, n AS next_date FROM panel JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM panel)) USING (date) WHERE n IS NOT NULL", "panel")
def _legacy_horizon(spark, sf):
    p = panel(spark, sf)
    return p.join(w.next_distinct(p), "date").where("next_date IS NOT NULL")


@query("index_100", f"{K}, px_index f5", "SELECT ticker, date, px / first_value(px) OVER (PARTITION BY ticker ORDER BY date) * 100 AS px_index FROM panel", "panel")
def _index_100(spark, sf):
    return panel(spark, sf).withColumn("px_index", w.indexed("px"))


@query("group_transform", "event_id i, mixed b", "SELECT event_id, min(label) OVER (PARTITION BY ticker, user_id) <> max(label) OVER (PARTITION BY ticker, user_id) AS mixed FROM news", "news")
def _group_transform(spark, sf):
    from .substrate import news

    return news(spark, sf).withColumn("mixed", w.varies(["ticker", "user_id"], "label"))


@query(
    "flagship",
    f"{K}, px f2, target i, sma_5 f2, sma_20 f2, sma_50 f2, tone f6, news_count i, has_news b",
    "SELECT l.ticker, l.date, l.px, l.target, " + ", ".join(f"a.sma_{n}" for n in (5, 20, 50)) + ", s.tone, s.news_count, s.has_news FROM labelled l JOIN sessions s USING (ticker, date) JOIN (SELECT ticker, date, " + ", ".join(f"avg(px) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sma_{n}" for n in (5, 20, 50)) + " FROM panel) a USING (ticker, date)",
    "labelled sessions",
)
def flagship(spark, sf):
    """Per entity and session: price features, next-session label and what the news said."""
    return w.next_label(w.moving_averages(sessions(spark, sf), "px"), "px").select("*")


_TONE, _COUNT = (", ".join(f"'{c}{x}'" for x in ("", "_lag_1", "_lag_2", "_lag_3", "_mean_3", "_mean_5")) for c in ("tone", "news_count"))
_LISTS = {"add_tone": f"'px', 'volume', {_TONE}", "add_news_count": f"'px', 'volume', {_COUNT}", "drop_tone": f"'px', 'volume', {_COUNT}", "drop_news_count": f"'px', 'volume', {_TONE}"}


@query("ablation_schema", "variant s, position i, feature s", " UNION ALL ".join(f"SELECT '{v}' AS variant, generate_subscripts([{x}], 1) - 1 AS position, unnest([{x}]) AS feature" for v, x in _LISTS.items()))
def _ablation_schema(spark, sf):
    """Schemas of the ablation variants of one feature family, in order."""
    from ..operators.reshape import feature_subset

    clean = ["px", "volume"]
    full = [*clean, *(f"{c}{x}" for c in ("tone", "news_count") for x in ("", "_lag_1", "_lag_2", "_lag_3", "_mean_3", "_mean_5"))]
    rows = [(f"{mode}_{f}", i, c) for mode in ("add", "drop") for f in ("tone", "news_count") for i, c in enumerate(feature_subset(full, clean, f, mode))]
    return spark.createDataFrame(rows, "variant string, position int, feature string")


