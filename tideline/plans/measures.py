"""Queries on aggregations and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, metrics, scoring
from .catalog import query, table
from .substrate import annotated, news, predictions, sessions


@query(
    "daily_agg",
    "ticker s, date d, sentiment_mean f6, sentiment_median f6, sentiment_min f6, sentiment_max f6, news_count i, non_trading_news_count i, positive_news_count i, negative_news_count i, neutral_news_count i, positive_news_ratio f6, negative_news_ratio f6, neutral_news_ratio f6",
    "SELECT *, " + ", ".join(f"{c}_news_count / news_count AS {c}_news_ratio" for c in ("positive", "negative", "neutral")) + " FROM (SELECT ticker, date, avg(s) AS sentiment_mean, median(s) AS sentiment_median, min(s) AS sentiment_min, max(s) AS sentiment_max, count(*) AS news_count, count(*) FILTER (hour(ts) >= 20) AS non_trading_news_count, " + ", ".join(f"count(title) FILTER (label = '{c}') AS {c}_news_count" for c in ("positive", "negative", "neutral")) + " FROM (SELECT *, CASE WHEN user_id % 10 <> 0 THEN score END AS s FROM news) GROUP BY 1, 2)",
    "news",
)
def _daily_agg(spark, sf):
    n = news(spark, sf).withColumn("s", F.when(F.col("user_id") % 10 != 0, F.col("score"))).withColumn("off", F.hour("ts") >= 20)
    return aggregates.daily_sentiment(n, ["ticker", "date"], "s", "label", "title", "off")


@query("pivot_counts", "ticker s, date d, positive i, negative i, neutral i, absent i, positive_share f6", "SELECT *, positive / nullif(positive + negative + neutral, 0) AS positive_share FROM (SELECT ticker, date, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral, 0 AS absent FROM news GROUP BY 1, 2)", "news")
def _pivot_counts(spark, sf):
    p = aggregates.pivot_counts(news(spark, sf), ["ticker", "date"], "label", ["positive", "negative", "neutral", "absent"], "title")
    return p.withColumn("positive_share", aggregates.ratio(F.col("positive"), F.col("positive") + F.col("negative") + F.col("neutral")))


@query("weighted_mean", "ticker s, date d, weighted f6", "SELECT ticker, date, coalesce(sum(score * relevance) / nullif(sum(relevance), 0), 0) AS weighted FROM news GROUP BY 1, 2", "news")
def _weighted_mean(spark, sf):
    return news(spark, sf).groupBy("ticker", "date").agg(aggregates.weighted_mean("score", "relevance").alias("weighted"))


@query("dispersion", "ticker s, date d, score_std f6, score_abs f6", "SELECT ticker, date, stddev_pop(score) AS score_std, avg(abs(score)) AS score_abs FROM news GROUP BY 1, 2", "news")
def _dispersion(spark, sf):
    return aggregates.dispersion(news(spark, sf), ["ticker", "date"], "score")


@query("coverage_audit", "ticker s, year i, sessions i, covered i, items i, coverage f6", "SELECT ticker, year(date) AS year, count(*) AS sessions, count(*) FILTER (has_news) AS covered, sum(news_count) AS items, count(*) FILTER (has_news) / count(*) AS coverage FROM sessions GROUP BY 1, 2", "sessions")
def _coverage_audit(spark, sf):
    return aggregates.coverage(sessions(spark, sf).withColumn("year", F.year("date")), ["ticker", "year"], "has_news", "news_count")


@query("null_groups", "grp s, n i, mean_score f6, low f6, high f6", "SELECT CASE WHEN user_id % 4 > 0 THEN label END AS grp, count(*) AS n, avg(score) AS mean_score, min(score) AS low, max(score) AS high FROM news GROUP BY 1", "news")
def _null_groups(spark, sf):
    """Groups of unknown keys are kept here; `aggregates.present` drops them elsewhere."""
    n = news(spark, sf).withColumn("grp", F.when(F.col("user_id") % 4 > 0, F.col("label")))
    return n.groupBy("grp").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("dup_count", "n_repeated i, n_distinct i", "SELECT sum(n - 1) AS n_repeated, count(*) AS n_distinct FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def _dup_count(spark, sf):
    return aggregates.repeated(table(spark, sf, "documents"), ["text"])


@query("distinct_agg", "ticker s, dates i, users i, titles i, first_date d", "SELECT ticker, count(DISTINCT date) AS dates, count(DISTINCT user_id) AS users, count(DISTINCT title) AS titles, min(date) AS first_date FROM news GROUP BY 1", "news")
def _distinct_agg(spark, sf):
    return news(spark, sf).groupBy("ticker").agg(F.count_distinct("date").alias("dates"), F.count_distinct("user_id").alias("users"), F.count_distinct("title").alias("titles"), F.min("date").alias("first_date"))


@query("share_of_total", "ticker s, title s, n i, share f6", "SELECT ticker, title, n, n / sum(n) OVER (PARTITION BY ticker) AS share FROM (SELECT ticker, title, count(*) AS n FROM news GROUP BY 1, 2)", "news")
def _share_of_total(spark, sf):
    return aggregates.share_of_total(news(spark, sf), ["ticker"], "title")


@query("value_counts", "o_orderstatus s, n i, share f6", "SELECT o_orderstatus, n, n / sum(n) OVER () AS share FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)")
def _value_counts(spark, sf):
    return aggregates.value_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("crosstab", "a s, n_F i, n_O i, n_P i, share_F f6", "SELECT *, \"n_F\" / (\"n_F\" + \"n_O\" + \"n_P\") AS \"share_F\" FROM (SELECT a, count(*) FILTER (b = 'F') AS \"n_F\", count(*) FILTER (b = 'O') AS \"n_O\", count(*) FILTER (b = 'P') AS \"n_P\" FROM annotated GROUP BY 1)", "annotated")
def _crosstab(spark, sf):
    a = annotated(spark, sf)
    shares = aggregates.crosstab(a, "a", "b", ["F", "O", "P"], "share_", normalise=True)
    return aggregates.crosstab(a, "a", "b", ["F", "O", "P"]).join(shares.select("a", "share_F"), "a")


@query("quantiles", "ticker s, n i, mean f6, min f6, max f6, q500 f6, q900 f6, q990 f6, q1000 f6", "SELECT ticker, count(score) AS n, avg(score) AS mean, min(score) AS min, max(score) AS max, quantile_cont(score, 0.5) AS q500, quantile_cont(score, 0.9) AS q900, quantile_cont(score, 0.99) AS q990, quantile_cont(score, 1.0) AS q1000 FROM news GROUP BY 1", "news")
def _quantiles(spark, sf):
    return aggregates.quantiles(news(spark, sf), ["ticker"], "score", [0.5, 0.9, 0.99, 1.0])


RATES = """(tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
 (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1,
 coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0) AS mcc"""
CELLS = "count(*) FILTER (target = 0 AND prediction = 0) AS tn, count(*) FILTER (target = 0 AND prediction = 1) AS fp, count(*) FILTER (target = 1 AND prediction = 0) AS fn, count(*) FILTER (target = 1 AND prediction = 1) AS tp, count(*) AS n"
RATE_SHAPE = "tn i, fp i, fn i, tp i, accuracy f6, precision f6, recall f6, f1 f6, balanced_accuracy f6, macro_f1 f6, mcc f6"


@query("confusion_metrics", f"ticker s, {RATE_SHAPE}", f"SELECT *, {RATES} FROM (SELECT ticker, {CELLS} FROM predictions GROUP BY 1)", "predictions")
def _confusion(spark, sf):
    return metrics.rates(predictions(spark, sf).groupBy("ticker").agg(*metrics.confusion()))


@query("metrics_grouping_sets", f"scope s, group s, n i, {RATE_SHAPE}", f"SELECT *, {RATES} FROM (SELECT 'global' AS scope, 'all' AS \"group\", {CELLS} FROM predictions UNION ALL SELECT 'ticker', ticker, {CELLS} FROM predictions GROUP BY ticker UNION ALL SELECT 'year', year, {CELLS} FROM predictions GROUP BY year UNION ALL SELECT 'outer_fold', CAST(outer_fold AS VARCHAR), {CELLS} FROM predictions GROUP BY outer_fold)", "predictions")
def _grouping_sets(spark, sf):
    return metrics.metrics_by_scope(predictions(spark, sf), ["ticker", "year", "outer_fold"])


AUC = "SELECT {k}, sum(p * (below + n / CAST(2 AS DOUBLE))) / nullif(CAST(sum(p) AS DOUBLE) * sum(n), 0) AS auc FROM (SELECT {k}, p, n, sum(n) OVER (PARTITION BY {k} ORDER BY probability) - n AS below FROM (SELECT {k}, probability, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM predictions GROUP BY {k}, probability)) GROUP BY {k}"


@query("roc_auc", "ticker s, auc f6", AUC.format(k="ticker"), "predictions")
def _roc_auc(spark, sf):
    return metrics.roc_auc(predictions(spark, sf), ["ticker"])


@query("pooled_auc", "n_rows i, auc f6", "SELECT (SELECT count(*) FROM predictions) AS n_rows, (SELECT count(*) FILTER (a.probability > b.probability) + count(*) FILTER (a.probability = b.probability) / CAST(2 AS DOUBLE) FROM predictions a, predictions b WHERE a.target = 1 AND b.target = 0) / (SELECT CAST(count(*) FILTER (target = 1) AS DOUBLE) * count(*) FILTER (target = 0) FROM predictions) AS auc", "predictions")
def _pooled_auc(spark, sf):
    p = predictions(spark, sf)
    return metrics.roc_auc(p, []).crossJoin(p.agg(F.count("*").alias("n_rows")))  # one row on either side


@query("macro_metrics", "n_entities i, macro_auc f6, macro_accuracy f6, fold_auc f6, fold_std f6", f"SELECT count(*) AS n_entities, avg(auc) AS macro_auc, avg(accuracy) AS macro_accuracy, max(fold_auc) AS fold_auc, max(fold_std) AS fold_std FROM ({AUC.format(k='ticker')}) JOIN (SELECT ticker, avg(CASE WHEN target = prediction THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy FROM predictions GROUP BY 1) USING (ticker), (SELECT avg(auc) AS fold_auc, stddev_samp(auc) AS fold_std FROM ({AUC.format(k='outer_fold')}))", "predictions")
def _macro(spark, sf):
    p = predictions(spark, sf)
    each = metrics.roc_auc(p, ["ticker"]).join(metrics.rates(p.groupBy("ticker").agg(*metrics.confusion())), "ticker")
    folds = metrics.roc_auc(p, ["outer_fold"]).agg(F.avg("auc").alias("fold_auc"), F.stddev_samp("auc").alias("fold_std"))
    return metrics.macro(each, "ticker", [], ["auc", "accuracy"]).crossJoin(folds)  # one row on either side


WEIGHTED = "SELECT ticker, probability AS s, CAST(sum(CASE WHEN target = 1 THEN doc_id % 6 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN target = 0 THEN doc_id % 6 ELSE 0 END) AS DOUBLE) AS n FROM predictions GROUP BY 1, 2"


@query("weighted_auc", "ticker s, auc f6", f"SELECT ticker, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY ticker ORDER BY s) - n AS below FROM ({WEIGHTED})) GROUP BY 1", "predictions")
def _weighted_auc(spark, sf):
    """Integer weights, as a bootstrap draws them."""
    return metrics.weighted_auc(predictions(spark, sf), ["ticker"], (F.col("doc_id") % 6).cast("long"))


CLASS = "SELECT coalesce(x.c, y.c) AS class, coalesce(s, 0) AS support, coalesce(p, 0) AS predicted, coalesce(h, 0) AS hits FROM (SELECT a AS c, count(*) AS s, count(*) FILTER (a = b) AS h FROM annotated GROUP BY 1) x FULL JOIN (SELECT b AS c, count(*) AS p FROM annotated GROUP BY 1) y ON x.c = y.c"
CLASS = f"SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM ({CLASS})"


@query("multiclass_report", "class s, support i, predicted i, hits i, precision f6, recall f6, f1 f6", CLASS, "annotated")
def _multiclass(spark, sf):
    return metrics.multiclass(annotated(spark, sf), "a", "b")


@query("multiclass_averages", "accuracy f6, macro_f1 f6, weighted_f1 f6, weighted_recall f6", f"SELECT sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(recall * support) / sum(support) AS weighted_recall FROM ({CLASS})", "annotated")
def _multiclass_averages(spark, sf):
    return metrics.multiclass_averages(metrics.multiclass(annotated(spark, sf), "a", "b"))


@query("coverage_rollup", "ticker s, eligible i, scored i, abstained i, coverage f6", "SELECT coalesce(ticker, 'all') AS ticker, count(*) AS eligible, count(*) FILTER (a <> 'P') AS scored, count(*) FILTER (a = 'P') AS abstained, count(*) FILTER (a <> 'P') / count(*) AS coverage FROM annotated GROUP BY ROLLUP (ticker)", "annotated")
def _coverage_rollup(spark, sf):
    r = annotated(spark, sf).rollup("ticker").agg(F.count("*").alias("eligible"), F.count_if(F.col("a") != "P").alias("scored"), F.count_if(F.col("a") == "P").alias("abstained"))
    return r.withColumns({"ticker": F.coalesce("ticker", F.lit("all")), "coverage": aggregates.ratio(F.col("scored"), F.col("eligible"))})


@query("cohen_kappa", "n i, agreement f6, kappa f6", "SELECT n, po AS agreement, (po - pe) / nullif(1 - pe, 0) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN a = b THEN CAST(1 AS DOUBLE) ELSE 0 END) AS po, (SELECT sum(CAST(x.n AS DOUBLE) * y.n) FROM (SELECT a AS c, count(*) AS n FROM annotated GROUP BY 1) x JOIN (SELECT b AS c, count(*) AS n FROM annotated GROUP BY 1) y ON x.c = y.c) / (CAST(count(*) AS DOUBLE) * count(*)) AS pe FROM annotated)", "annotated")
def _cohen_kappa(spark, sf):
    return metrics.cohen_kappa(annotated(spark, sf), "a", "b")


@query("agreement", "ticker s, n i, agreement f6", "SELECT ticker, count(*) AS n, avg(CASE WHEN a = b THEN CAST(1 AS DOUBLE) ELSE 0 END) AS agreement FROM annotated GROUP BY 1", "annotated")
def _agreement(spark, sf):
    return scoring.agreement(annotated(spark, sf), ["ticker"], "a", "b")


@query("correlations", "ticker s, n i, pearson f6, spearman f6", "SELECT ticker, count(*) AS n, corr(score, relevance) AS pearson, corr(rs, rr) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY score) + (count(*) OVER (PARTITION BY ticker, score) - 1) / CAST(2 AS DOUBLE) AS rs, rank() OVER (PARTITION BY ticker ORDER BY relevance) + (count(*) OVER (PARTITION BY ticker, relevance) - 1) / CAST(2 AS DOUBLE) AS rr FROM news) GROUP BY 1", "news")
def _correlations(spark, sf):
    return metrics.correlations(news(spark, sf), ["ticker"], "score", "relevance")


@query("group_importance", "family s, total f6, share f6", "SELECT family, total, total / sum(total) OVER () AS share FROM (SELECT CASE WHEN title LIKE 'purchase%' OR title LIKE 'signup%' THEN 'positive' WHEN title LIKE 'error%' THEN 'negative' ELSE 'other' END AS family, sum(abs(score)) AS total FROM news GROUP BY 1)", "news")
def _group_importance(spark, sf):
    from pyspark.sql import Window

    family = F.when(F.col("title").startswith("purchase") | F.col("title").startswith("signup"), "positive").when(F.col("title").startswith("error"), "negative").otherwise("other")
    g = news(spark, sf).groupBy(family.alias("family")).agg(F.sum(F.abs("score")).alias("total"))
    return g.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


TH = [round(0.4 + 0.025 * i, 3) for i in range(9)]


@query("threshold_opt", "ticker s, threshold f3, f1 f6", "SELECT ticker, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY f1 DESC, round(abs(threshold - 0.5), 9), threshold DESC) AS k FROM (SELECT ticker, t AS threshold, coalesce(2 * count(*) FILTER (probability >= t AND target = 1) / nullif(count(*) FILTER (probability >= t) + count(*) FILTER (target = 1), 0), 0) AS f1 FROM predictions, (SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in TH) + "]) AS t) GROUP BY 1, 2)) WHERE k = 1", "predictions")
def _threshold_opt(spark, sf):
    return metrics.best_threshold(predictions(spark, sf), ["ticker"], TH)


def _two_arms(spark, sf):
    p = predictions(spark, sf).withColumn("session", (F.col("doc_id") % 60).cast("int"))
    base = p.select("ticker", "session", "target", "probability").withColumn("arm", F.lit("base"))
    return base.unionByName(p.select("ticker", "session", "target", F.round((F.col("probability") + F.col("other")) / 2, 4).alias("probability")).withColumn("arm", F.lit("other")))


def _bootstrap_sql(entity: str, sessions: int = 60, block: int = 10, repeats: int = 200) -> str:
    """The drawn sessions as a table of values, and areas and percentiles over it."""
    import numpy as np

    weights = np.vstack([np.ones(sessions, int), metrics.block_weights(sessions, block, repeats)])
    values = ", ".join(f"({r - 1}, {d}, {weights[r, d]})" for r, d in zip(*(x.tolist() for x in np.nonzero(weights))))
    return f"""SELECT * FROM (WITH w(rep, session, times) AS (VALUES {values}),
  arms AS (SELECT {entity} AS entity, doc_id % {sessions} AS session, target, 'base' AS arm, probability AS s FROM predictions UNION ALL SELECT {entity}, doc_id % {sessions}, target, 'other', round((probability + other) / 2, 4) FROM predictions),
  c AS (SELECT entity, arm, rep, s, CAST(sum(CASE WHEN target = 1 THEN times ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN target = 0 THEN times ELSE 0 END) AS DOUBLE) AS q FROM arms JOIN w USING (session) GROUP BY ALL),
  a AS (SELECT entity, arm, rep, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY entity, arm, rep ORDER BY s) - q AS below FROM c) GROUP BY ALL),
  e AS (SELECT x.entity, x.rep, y.auc - x.auc AS delta FROM a x JOIN a y ON x.entity = y.entity AND x.rep = y.rep AND x.arm = 'base' AND y.arm = 'other'),
  d AS (SELECT * FROM e UNION ALL SELECT 'macro', rep, CASE WHEN count(delta) = (SELECT count(DISTINCT entity) FROM e) THEN avg(delta) END FROM e GROUP BY rep)
  SELECT entity, 'base' AS base, 'other' AS other, max(delta) FILTER (rep = -1) AS delta, CASE WHEN count(delta) FILTER (rep >= 0) >= 0.9 * {repeats} THEN quantile_cont(delta, 0.025) FILTER (rep >= 0) END AS low,
    CASE WHEN count(delta) FILTER (rep >= 0) >= 0.9 * {repeats} THEN quantile_cont(delta, 0.975) FILTER (rep >= 0) END AS high, count(delta) FILTER (rep >= 0) AS valid FROM d GROUP BY entity)"""


@query("block_bootstrap", "entity s, base s, other s, delta f6, low f6, high f6, valid i", _bootstrap_sql("'pooled'"), "predictions")
def _block_bootstrap(spark, sf):
    """Intervals of paired differences of AUC under shared blocks of sessions, pooled over entities."""
    pooled = _two_arms(spark, sf).withColumn("entity", F.lit("pooled"))
    return metrics.bootstrap_auc(pooled, "entity", "session", "arm", [("base", "other")], block=10, repeats=200)


@query("panel_intervals", "ticker s, base s, other s, delta f6, low f6, high f6, valid i", f"SELECT *, entity AS ticker FROM ({_bootstrap_sql('ticker')})", "predictions")
def _panel_intervals(spark, sf):
    """The same for each entity and for their mean, all on the same drawn sessions."""
    return metrics.bootstrap_auc(_two_arms(spark, sf), "ticker", "session", "arm", [("base", "other")], block=10, repeats=200)
