"""Queries on scans, filters, null handling, contracts, joins, sets and reshaping."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import aggregates, contracts, joins, reshape
from ..sources import readers
from ..sources.calendar import early_closes, holidays, trading_schedule
from .catalog import query, table
from .substrate import ENTITIES, annotated, daily, labelled, news, panel, predictions, schedule, sessions

E5 = ", ".join(f"'{e}'" for e in ENTITIES)


@query("scan_filter_project", "order_id i, status s, price f2, origin s", "SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price, 'orders' AS origin FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL")
def _scan(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).dropna(subset=["o_totalprice"])
    return o.withColumnsRenamed({"o_orderkey": "order_id", "o_orderstatus": "status", "o_totalprice": "price"}).withColumn("origin", F.lit("orders")).drop("o_custkey")


@query("date_range_filter", "o_orderkey i, o_orderdate d", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def _date_range(spark, sf):
    o = table(spark, sf, "orders")
    between = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return o.where(between).where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")


@query("nulls_first", "k i, event_id i, score f6", "SELECT row_number() OVER (ORDER BY s NULLS FIRST, event_id) AS k, event_id, s AS score FROM (SELECT event_id, CASE WHEN label <> 'neutral' THEN score END AS s FROM news) ORDER BY 1 LIMIT 20", "news")
def _nulls_first(spark, sf):
    from pyspark.sql import Window

    few = news(spark, sf).withColumn("score", F.when(F.col("label") != "neutral", F.col("score")))
    ordered = few.orderBy(F.col("score").asc_nulls_first(), "event_id").limit(20)
    return ordered.withColumn("k", F.row_number().over(Window.orderBy(F.col("score").asc_nulls_first(), "event_id")))


@query("limit", "o_orderkey i, digest s", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS digest FROM orders ORDER BY 2, 1 LIMIT 16")
def _limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest")).orderBy("digest", "o_orderkey").limit(16)


@query("left_join_fill", "ticker s, date d, volume i, tone f6, news_count i, has_news b", "SELECT * FROM sessions", "sessions")
def _left_join_fill(spark, sf):
    return joins.left_join_fill(panel(spark, sf), daily(spark, sf), ["ticker", "date"], {"tone": 0.0, "news_count": 0}, "has_news")


@query("safe_cast", "event_id i, k f6, bad f6, at t", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad, TRY_CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP) AS at FROM events")
def _safe_cast(spark, sf):
    from ..functions.math import safe_double

    e = table(spark, sf, "events")
    return e.select("event_id", safe_double(F.get_json_object("props", "$.k")).alias("k"), safe_double("event_type").alias("bad"), F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd"), F.lit("yyyy-MM-dd")).alias("at"))


@query("json_extract", "event_id i, k i, again s", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def _json_extract(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


@query("flatten_feed", "ticker s, title s, relevance_score f2, ticker_sentiment_label s", "SELECT ticker, title, CASE WHEN user_id % 2 = 0 THEN relevance END AS relevance_score, CASE WHEN user_id % 2 = 0 THEN label END AS ticker_sentiment_label FROM news", "news")
def _flatten_feed(spark, sf):
    n = news(spark, sf)
    own = F.struct(F.when(F.col("user_id") % 2 == 0, F.col("ticker")).otherwise("other").alias("ticker"), F.col("relevance").cast("string").alias("relevance_score"), F.lit("0").alias("ticker_sentiment_score"), F.col("label").alias("ticker_sentiment_label"))
    feed = F.to_json(F.struct(F.array(F.struct("title", F.array(own).alias("ticker_sentiment"))).alias("feed")))
    return readers.flatten_feed(n.select("ticker", feed.alias("json")), "json", "ticker")


@query("yearly_ranges", "year i, range_start d, range_end d", "SELECT y AS year, greatest(DATE '2015-03-10', make_date(y, 1, 1)) AS range_start, least(DATE '2018-06-30', make_date(y, 12, 31)) AS range_end FROM (SELECT unnest(range(2015, 2019)) AS y)")
def _yearly_ranges(spark, sf):
    return readers.yearly_ranges(spark, date(2015, 3, 10), date(2018, 6, 30))


@query(
    "range_split",
    "range_start d, range_end d, n_rows i",
    """SELECT * FROM (WITH RECURSIVE d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT min(day) AS s, max(day) AS e FROM d
      UNION ALL
      SELECT CASE h WHEN 0 THEN s ELSE s + CAST((e - s) // 2 + 1 AS INTEGER) END, CASE h WHEN 0 THEN s + CAST((e - s) // 2 AS INTEGER) ELSE e END
      FROM (SELECT s, e FROM r JOIN d ON day BETWEEN s AND e GROUP BY s, e HAVING sum(n) >= (SELECT greatest(100, sum(n) // 10) FROM d)), (SELECT unnest([0, 1]) AS h))
    SELECT s AS range_start, e AS range_end, coalesce(sum(n), 0) AS n_rows FROM r LEFT JOIN d ON day BETWEEN s AND e GROUP BY s, e HAVING coalesce(sum(n), 0) < (SELECT greatest(100, sum(n) // 10) FROM d))""",
)
def _range_split(spark, sf):
    """Days of orders, halved until no range holds a tenth of all."""
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    most = max(100, days.agg(F.sum("n")).first()[0] // 10)
    return spark.createDataFrame(readers.bisected_days(days, "day", "n", most), "range_start date, range_end date, n_rows long")


_CLOSED = ", ".join(f"DATE '{d}'" for y in (2023, 2024, 2025) for d in sorted(holidays(y)))
_EARLY = ", ".join(f"DATE '{d}'" for y in (2023, 2024, 2025) for d in sorted(early_closes(y)))
#: Daylight saving in the years of the query: second Sunday of March to first Sunday of November.
_SUMMER = " OR ".join(f"d BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in (("2023-03-12", "2023-11-04"), ("2024-03-10", "2024-11-02"), ("2025-03-09", "2025-11-01")))


@query("calendar", "trading_date d, market_close t", f"SELECT d AS trading_date, CAST(d AS TIMESTAMP) + to_hours(CASE WHEN d IN ({_EARLY}) THEN 18 ELSE 21 END - CASE WHEN {_SUMMER} THEN 1 ELSE 0 END) AS market_close FROM (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND d NOT IN ({_CLOSED})")
def _calendar(spark, sf):
    return trading_schedule(spark, date(2023, 1, 1), date(2025, 12, 31))


@query("panel_contract", "n_rows i, n_null i, n_repeated i, n_bad_target i", "SELECT count(*) AS n_rows, count(*) FILTER (ticker IS NULL OR date IS NULL OR target IS NULL) AS n_null, count(*) - count(DISTINCT (ticker, date)) AS n_repeated, count(*) FILTER (target NOT IN (0, 1)) AS n_bad_target FROM labelled", "labelled")
def _panel_contract(spark, sf):
    return contracts.expect_panel(labelled(spark, sf), ["ticker", "date"], "target")


@query("range_contract", "score_outside i, score_null i, relevance_outside i, relevance_null i", "SELECT count(*) FILTER (score NOT BETWEEN -0.5 AND 0.5) AS score_outside, count(*) FILTER (score IS NULL) AS score_null, count(*) FILTER (relevance NOT BETWEEN 0 AND 1) AS relevance_outside, count(*) FILTER (relevance IS NULL) AS relevance_null FROM news", "news")
def _range_contract(spark, sf):
    return contracts.expect_between(news(spark, sf), {"score": (-0.5, 0.5), "relevance": (0.0, 1.0)})


@query("finite_contract", "px_not_finite i, ratio_not_finite i", "SELECT count(*) FILTER (px IS NULL OR isnan(px) OR isinf(px)) AS px_not_finite, count(*) FILTER (r IS NULL OR isnan(r) OR isinf(r)) AS ratio_not_finite FROM (SELECT px, CASE WHEN volume > 1 THEN px / (volume - 1) END AS r FROM panel)", "panel")
def _finite_contract(spark, sf):
    return contracts.expect_finite(panel(spark, sf).withColumn("ratio", F.when(F.col("volume") > 1, F.col("px") / (F.col("volume") - 1))), ["px", "ratio"])


@query("target_consistency", "n_rows i, n_different i", "SELECT count(*) AS n_rows, count(*) FILTER (day(date) = 13) AS n_different FROM labelled", "labelled")
def _target_consistency(spark, sf):
    """Stored labels, wrong on every 13th, against labels computed anew from the session in which each label ends."""
    stored = labelled(spark, sf).withColumn("target", F.when(F.dayofmonth("date") == 13, 1 - F.col("target")).otherwise(F.col("target")))
    end = panel(spark, sf).select("ticker", F.col("date").alias("target_end"), F.col("px").alias("end_px"))
    both = stored.join(end, ["ticker", "target_end"])
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("target") != (F.col("end_px") > F.col("px")).cast("int")).alias("n_different"))


@query("separation", "last_train d, first_test d, separated b", "SELECT a AS last_train, b AS first_test, a < b AS separated FROM (SELECT max(date) AS a FROM panel WHERE date < DATE '1999-01-01'), (SELECT min(date) AS b FROM panel WHERE date >= DATE '1999-01-01')", "panel")
def _separation(spark, sf):
    p, cut = panel(spark, sf), F.lit(date(1999, 1, 1))
    return contracts.expect_separated(p.where(F.col("date") < cut), p.where(F.col("date") >= cut), "date")


@query("pairing", "only_left i, only_right i", "SELECT (SELECT count(*) FROM (SELECT doc_id, target, outer_fold FROM predictions EXCEPT ALL SELECT doc_id, target, outer_fold FROM predictions WHERE probability < 0.9)) AS only_left, (SELECT count(*) FROM (SELECT doc_id, target, outer_fold FROM predictions WHERE probability < 0.9 EXCEPT ALL SELECT doc_id, target, outer_fold FROM predictions)) AS only_right", "predictions")
def _pairing(spark, sf):
    p = predictions(spark, sf)
    return contracts.expect_paired(p, p.where("probability < 0.9"), ["doc_id", "target", "outer_fold"])


@query("prediction_contract", "n_bad_probability i, n_bad_prediction i, n_repeated i", "SELECT count(*) FILTER (probability IS NULL OR probability NOT BETWEEN 0 AND 1) AS n_bad_probability, count(*) FILTER (prediction <> CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END) AS n_bad_prediction, count(*) - count(DISTINCT doc_id) AS n_repeated FROM predictions", "predictions")
def _prediction_contract(spark, sf):
    return contracts.expect_predictions(predictions(spark, sf), ["doc_id"])


PROBS = "probs AS (SELECT doc_id, floor(probability * 900) / 1000 AS positive, CASE WHEN doc_id % 11 = 0 THEN 0.05 ELSE CAST(0.1 AS DOUBLE) END AS negative, 1 - floor(probability * 900) / 1000 - 0.1 AS neutral FROM predictions)"


@query(
    "prob_contract",
    "n_outside i, n_bad_sum i, n_bad_score i, n_bad_label i",
    f"SELECT * FROM (WITH {PROBS} SELECT count(*) FILTER (positive NOT BETWEEN 0 AND 1 OR negative NOT BETWEEN 0 AND 1 OR neutral NOT BETWEEN 0 AND 1) AS n_outside, count(*) FILTER (abs(positive + negative + neutral - 1) > 1e-6) AS n_bad_sum, 0 AS n_bad_score, count(*) FILTER (CASE WHEN positive >= 0.5 THEN 'positive' ELSE 'neutral' END <> CASE WHEN positive >= greatest(negative, neutral) THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END) AS n_bad_label FROM probs)",
    "predictions",
)
def _prob_contract(spark, sf):
    pos = F.floor(F.col("probability") * 900) / 1000
    p = predictions(spark, sf).select("doc_id", pos.alias("positive"), F.when(F.col("doc_id") % 11 == 0, 0.05).otherwise(0.1).alias("negative"), (1 - pos - 0.1).alias("neutral"))
    p = p.withColumns({"score": F.col("positive") - F.col("negative"), "label": F.when(F.col("positive") >= 0.5, "positive").otherwise("neutral")})
    return contracts.expect_probabilities(p, ["positive", "negative", "neutral"], "score", "label", "positive", "negative")


@query("changed_rows", "o_orderkey i", "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0 OR (o_orderkey % 89 = 0 AND o_orderstatus <> 'X')")
def _changed_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    return contracts.changed_rows(o, new, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


ASOF = "SELECT n.event_id, n.ts, s.trading_date, s.market_close FROM news n ASOF LEFT JOIN schedule s ON n.ts <= s.market_close"


@query("asof_forward", "event_id i, ts t, trading_date d, market_close t, assigned_later_date b, is_non_trading_day b", f"SELECT a.*, a.trading_date > CAST(a.ts AS DATE) AS assigned_later_date, CAST(a.ts AS DATE) NOT IN (SELECT trading_date FROM schedule) AS is_non_trading_day FROM ({ASOF}) a", "news schedule")
def _asof_forward(spark, sf):
    s = schedule(spark, sf)
    hit = joins.asof_forward(news(spark, sf).select("event_id", "ts"), s, "ts", "market_close").withColumn("day", F.to_date("ts"))
    days = s.select(F.col("trading_date").alias("day"), F.lit(True).alias("session"))
    return hit.join(days, "day", "left").withColumns({"assigned_later_date": F.col("trading_date") > F.col("day"), "is_non_trading_day": F.col("session").isNull()})


@query("asof_unaligned", "event_id i, ts t", f"SELECT event_id, ts FROM ({ASOF}) WHERE market_close IS NULL", "news schedule")
def _asof_unaligned(spark, sf):
    return joins.asof_forward(news(spark, sf).select("event_id", "ts"), schedule(spark, sf), "ts", "market_close").where("market_close IS NULL")


@query("inner_join", "ticker s, date d, px f2, news_count i", "SELECT p.ticker, p.date, p.px, d.news_count FROM panel p JOIN daily d USING (ticker, date)", "panel daily")
def _inner_join(spark, sf):
    return joins.one_to_one(panel(spark, sf), daily(spark, sf), ["ticker", "date"])


@query("many_to_one", "event_id i, ticker s, px_day f2", "SELECT n.event_id, n.ticker, p.px AS px_day FROM news n LEFT JOIN panel p USING (ticker, date)", "news panel")
def _many_to_one(spark, sf):
    return joins.many_to_one(news(spark, sf), panel(spark, sf).select("ticker", "date", F.col("px").alias("px_day")), ["ticker", "date"])


@query("semi_join", "event_id i, ticker s, date d", "SELECT event_id, ticker, date FROM news WHERE (ticker, date) IN (SELECT ticker, date FROM panel)", "news panel")
def _semi_join(spark, sf):
    return joins.matching_keys(news(spark, sf), panel(spark, sf), ["ticker", "date"])


@query("anti_join", "event_id i, ticker s, date d", "SELECT event_id, ticker, date FROM news n WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.ticker = n.ticker AND p.date = n.date)", "news panel")
def _anti_join(spark, sf):
    return joins.missing_keys(news(spark, sf), panel(spark, sf), ["ticker", "date"])


@query("map_lookup", "event_id i, region s", f"SELECT event_id, CASE ticker WHEN '{ENTITIES[0]}' THEN 'fast' WHEN '{ENTITIES[1]}' THEN 'fast' WHEN '{ENTITIES[4]}' THEN 'slow' END AS region FROM news", "news")
def _map_lookup(spark, sf):
    names = spark.createDataFrame([(ENTITIES[0], "fast"), (ENTITIES[1], "fast"), (ENTITIES[4], "slow")], "ticker string, region string")
    return news(spark, sf).join(F.broadcast(names), "ticker", "left")


@query("cross_join", "ticker s, variant s, fold i", f"SELECT ticker, variant, fold FROM (SELECT unnest([{E5}]) AS ticker), (SELECT unnest(['base', 'hybrid']) AS variant), (SELECT unnest([1, 2, 3]) AS fold)")
def _cross_join(spark, sf):
    """The grid of an experiment: a product of bounded lists."""
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], [name])
    return one("ticker", ENTITIES).crossJoin(one("variant", ["base", "hybrid"])).crossJoin(one("fold", [1, 2, 3]))


ARMS = "SELECT ticker, arm, accuracy, n FROM (SELECT ticker, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'hybrid' END AS arm, avg(CASE WHEN target = prediction THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy, count(*) AS n FROM predictions GROUP BY 1, 2)"


def arms(spark, sf):
    p = predictions(spark, sf).withColumn("arm", F.when(F.col("doc_id") % 2 == 0, "base").otherwise("hybrid"))
    return p.groupBy("ticker", "arm").agg(F.avg((F.col("target") == F.col("prediction")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


@query("delta_compare", "ticker s, accuracy_base f6, accuracy_hybrid f6, accuracy_delta f6, n_delta i", f"SELECT *, accuracy_hybrid - accuracy_base AS accuracy_delta, n_h - n_b AS n_delta FROM (SELECT ticker, max(accuracy) FILTER (arm = 'base') AS accuracy_base, max(accuracy) FILTER (arm = 'hybrid') AS accuracy_hybrid, max(n) FILTER (arm = 'base') AS n_b, max(n) FILTER (arm = 'hybrid') AS n_h FROM ({ARMS}) GROUP BY 1)", "predictions")
def _delta_compare(spark, sf):
    return joins.contrast(arms(spark, sf), ["ticker"], "arm", "base", "hybrid", ["accuracy", "n"])


@query("contrasts", "contrast s, ticker s, delta f6", f"SELECT c.contrast, a.ticker, b.accuracy - a.accuracy AS delta FROM (VALUES ('hybrid_vs_base', 'base', 'hybrid'), ('base_vs_hybrid', 'hybrid', 'base')) c(contrast, lo, hi) JOIN ({ARMS}) a ON a.arm = c.lo JOIN ({ARMS}) b ON b.arm = c.hi AND b.ticker = a.ticker", "predictions")
def _contrasts(spark, sf):
    pairs = spark.createDataFrame([("hybrid_vs_base", "base", "hybrid"), ("base_vs_hybrid", "hybrid", "base")], "contrast string, lo string, hi string")
    a = arms(spark, sf).select("ticker", F.col("arm").alias("lo"), F.col("accuracy").alias("a"))
    b = arms(spark, sf).select("ticker", F.col("arm").alias("hi"), F.col("accuracy").alias("b"))
    return F.broadcast(pairs).join(a, "lo").join(b, ["ticker", "hi"]).withColumn("delta", F.col("b") - F.col("a"))


@query("pivot_join", "doc_id i, p0 f6, p1 f6, n_chars i", "SELECT p.doc_id, max(probability) FILTER (outer_fold = 0) AS p0, max(probability) FILTER (outer_fold = 1) AS p1, max(n_chars) AS n_chars FROM predictions p JOIN documents d USING (doc_id) GROUP BY 1", "predictions")
def _pivot_join(spark, sf):
    wide = reshape.pivot_first(predictions(spark, sf), ["doc_id"], "outer_fold", [0, 1], "probability", "p")
    return wide.join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


@query("union_all", "event_id i, label s, extra s", "SELECT event_id, label, NULL AS extra FROM news WHERE label = 'positive' UNION ALL SELECT event_id, NULL, title FROM news WHERE label = 'negative'", "news")
def _union_all(spark, sf):
    n = news(spark, sf)
    return reshape.union_all(n.where("label = 'positive'").select("event_id", "label"), n.where("label = 'negative'").select("event_id", F.col("title").alias("extra")))


@query("except_keys", "user_id i", "SELECT user_id FROM news EXCEPT SELECT user_id FROM news WHERE label = 'positive' AND ticker = '1-URGENT'", "news")
def _except_keys(spark, sf):
    n = news(spark, sf)
    return n.select("user_id").subtract(n.where("label = 'positive' AND ticker = '1-URGENT'").select("user_id"))


@query("pending_keys", "doc_id i", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _pending_keys(spark, sf):
    return readers.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("set_equality", "equal b, missing i", "SELECT count(*) = 0 AS equal, count(*) AS missing FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _set_equality(spark, sf):
    gap = table(spark, sf, "labels").select("doc_id").subtract(table(spark, sf, "documents").select("doc_id"))
    return gap.agg(F.count("*").alias("missing")).withColumn("equal", F.col("missing") == 0)


@query("category_union", "category s", "SELECT a AS category FROM annotated UNION SELECT b FROM annotated UNION SELECT label FROM news", "annotated news")
def _category_union(spark, sf):
    a = annotated(spark, sf)
    one = lambda df, c: df.select(F.col(c).alias("category")).distinct()
    return one(a, "a").union(one(a, "b")).union(one(news(spark, sf), "label")).distinct()


@query("replicate_rows", "doc_id i, approach s", "SELECT doc_id, unnest(['matched', 'deduplicated']) AS approach FROM predictions", "predictions")
def _replicate(spark, sf):
    return reshape.replicate(predictions(spark, sf), "approach", ["matched", "deduplicated"])


@query("unpivot_metrics", "ticker s, arm s, metric s, value f6", f"SELECT ticker, arm, 'accuracy' AS metric, accuracy AS value FROM ({ARMS}) UNION ALL SELECT ticker, arm, 'n', n FROM ({ARMS})", "predictions")
def _unpivot(spark, sf):
    a = arms(spark, sf).withColumn("n", F.col("n").cast("double"))
    long = reshape.melt(a.withColumnsRenamed({"accuracy": "accuracy_mean", "n": "n_mean"}), ["ticker", "arm"], ["accuracy_mean", "n_mean"])
    return long.withColumn("metric", F.replace("metric", F.lit("_mean"), F.lit("")))


@query("one_hot", "ticker s, date d, " + ", ".join(f"is_{i} f1" for i in range(1, 5)), "SELECT ticker, date, " + ", ".join(f"CASE WHEN ticker = '{e}' THEN 1 ELSE 0 END AS is_{i}" for i, e in enumerate(ENTITIES) if i) + " FROM panel", "panel")
def _one_hot(spark, sf):
    df = reshape.one_hot(panel(spark, sf), "ticker", ENTITIES, "is_")
    return df.withColumnsRenamed({f"is_{e}": f"is_{i}" for i, e in enumerate(ENTITIES)})


@query("interactions", "ticker s, date d, x1 f2, x2 f2, v4 f2", f"SELECT ticker, date, CASE WHEN ticker = '{ENTITIES[1]}' THEN px ELSE 0 END AS x1, CASE WHEN ticker = '{ENTITIES[2]}' THEN px ELSE 0 END AS x2, CASE WHEN ticker = '{ENTITIES[4]}' THEN volume ELSE 0 END AS v4 FROM panel", "panel")
def _interactions(spark, sf):
    df = reshape.interactions(panel(spark, sf), "ticker", ENTITIES, ["px", "volume"])
    return df.withColumnsRenamed({f"{ENTITIES[1]}__px": "x1", f"{ENTITIES[2]}__px": "x2", f"{ENTITIES[4]}__volume": "v4"})


@query("explode_variants", "doc_id i, variant s, text_md5 s", "SELECT doc_id, 'headline' AS variant, md5(split_part(text, chr(10), 1)) AS text_md5 FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '' UNION ALL SELECT doc_id, 'full_text', md5(text) FROM documents WHERE trim(text) <> '' UNION ALL SELECT doc_id, 'lang', md5(lang) FROM documents WHERE trim(lang) <> ''")
def _explode_variants(spark, sf):
    v = reshape.variants(table(spark, sf, "documents"), ["doc_id"], {"headline": F.substring_index("text", "\n", 1), "full_text": F.col("text"), "lang": F.col("lang")})
    return v.withColumn("text_md5", F.md5("text"))


@query("calendar_coverage", "ticker s, month s, sessions i, covered i, news i", "SELECT ticker, strftime(date, '%Y-%m') AS month, count(*) AS sessions, count(*) FILTER (has_news) AS covered, sum(news_count) AS news FROM sessions GROUP BY 1, 2", "sessions")
def _calendar_coverage(spark, sf):
    from ..functions.dates import month

    df = sessions(spark, sf).withColumn("month", month("date"))
    return aggregates.coverage(df, ["ticker", "month"], "has_news", "news_count").withColumnRenamed("items", "news")
