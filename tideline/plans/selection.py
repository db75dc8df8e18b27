"""Queries on deduplication, sampling, top-k, temporal splits and models."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import dedup, ml, splits
from ..operators import windows as w
from .catalog import query, table
from .substrate import labelled, news, panel


@query("dedup_first", "doc_id i, source s", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def _dedup_first(spark, sf):
    return dedup.keep_first(table(spark, sf, "documents"), ["text"], ["doc_id"])


@query(
    "causal_dedup",
    "event_id i, kept b, representative i",
    """SELECT * FROM (WITH RECURSIVE o AS (SELECT event_id, ticker, title, ts, row_number() OVER (PARTITION BY ticker, title ORDER BY ts, event_id) AS k FROM news),
    f AS (SELECT event_id, ticker, title, k, true AS kept, event_id AS representative, ts AS anchor FROM o WHERE k = 1
      UNION ALL
      SELECT o.event_id, o.ticker, o.title, o.k, o.ts > f.anchor + INTERVAL 24 HOURS, CASE WHEN o.ts > f.anchor + INTERVAL 24 HOURS THEN o.event_id ELSE f.representative END, CASE WHEN o.ts > f.anchor + INTERVAL 24 HOURS THEN o.ts ELSE f.anchor END
      FROM f JOIN o ON o.ticker = f.ticker AND o.title = f.title AND o.k = f.k + 1)
    SELECT event_id, kept, representative FROM f)""",
    "news",
)
def _causal_dedup(spark, sf):
    return dedup.causal_dedup(news(spark, sf), ["ticker", "title"], "ts", "event_id")


@query(
    "dup_components",
    "doc_id i, component i",
    """SELECT * FROM (WITH RECURSIVE k AS (SELECT doc_id, 'text' AS kind, text AS key FROM documents UNION ALL SELECT doc_id, 'head', split_part(text, chr(10), 1) FROM documents WHERE split_part(text, chr(10), 1) <> ''),
    e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (kind, key)),
    r AS (SELECT doc_id, doc_id AS component FROM documents UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.doc_id)
    SELECT doc_id, min(component) AS component FROM r GROUP BY 1)""",
)
def _dup_components(spark, sf):
    return dedup.duplicate_components(table(spark, sf, "documents"), "doc_id", {"text": F.col("text"), "head": F.substring_index("text", "\n", 1)})


@query(
    "hash_sample",
    "cell s, doc_id i",
    """SELECT * FROM (WITH p AS (SELECT doc_id, lang AS cell, text AS grp, sha256('50:' || CAST(doc_id AS VARCHAR)) AS p FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY cell, grp ORDER BY p, doc_id) AS k FROM p),
    x AS (SELECT * FROM b WHERE cell = 'en' AND k = 1 ORDER BY p, doc_id LIMIT 20),
    y AS (SELECT * FROM b WHERE cell = 'de' AND k = 1 AND grp NOT IN (SELECT grp FROM x) ORDER BY p, doc_id LIMIT 20),
    z AS (SELECT * FROM b WHERE cell = 'fr' AND k = 1 AND grp NOT IN (SELECT grp FROM x UNION SELECT grp FROM y) ORDER BY p, doc_id LIMIT 20)
    SELECT cell, doc_id FROM x UNION ALL SELECT cell, doc_id FROM y UNION ALL SELECT cell, doc_id FROM z)""",
)
def _hash_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cell"), F.md5("text").alias("grp"))
    return dedup.hash_sample(d, "doc_id", "grp", "cell", ["en", "de", "fr"], 20)


@query("fraction_topk", "ticker s, event_id i", "SELECT ticker, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sha256('50:' || CAST(event_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM news) WHERE k <= greatest(1, n // 4)", "news")
def _fraction(spark, sf):
    return dedup.fraction_of_group(news(spark, sf), ["ticker"], [dedup.hash_priority("event_id")])


@query("topk_per_group", "ticker s, rank i, date d, volume i", "SELECT ticker, k AS rank, date, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY volume DESC, date) AS k FROM panel) WHERE k <= 10", "panel")
def _topk(spark, sf):
    return dedup.top_k(panel(spark, sf), ["ticker"], [F.desc("volume"), F.col("date")], 10)


CONFIGS = "SELECT ticker, outer_fold, avg(CASE WHEN target = prediction THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy, count(*) AS n FROM predictions GROUP BY 1, 2"


@query("best_config", "ticker s, outer_fold i, accuracy f6", f"SELECT ticker, outer_fold, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(accuracy, 9) DESC, n DESC, outer_fold) AS k FROM ({CONFIGS})) WHERE k = 1", "predictions")
def _best_config(spark, sf):
    from .substrate import predictions

    c = predictions(spark, sf).groupBy("ticker", "outer_fold").agg(F.avg((F.col("target") == F.col("prediction")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    best = F.max(F.struct(F.round("accuracy", 9).alias("a"), "n", (-F.col("outer_fold")).alias("f"), "accuracy")).alias("b")
    return c.groupBy("ticker").agg(best).select("ticker", (-F.col("b.f")).alias("outer_fold"), F.col("b.accuracy").alias("accuracy"))


@query("earliest_row", "ticker s, event_id i, ts t", "SELECT ticker, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, title, event_id) AS k FROM news) WHERE k = 1", "news")
def _earliest(spark, sf):
    n = news(spark, sf).groupBy("ticker").agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "title", "event_id")).alias("x"))
    return n.select("ticker", "x.*")


CUT = "SELECT date AS cut FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos_, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM labelled)) WHERE pos_ = CAST(floor(n * 0.8) AS BIGINT)"


@query("time_split", "ticker s, date d, split s", f"SELECT ticker, date, CASE WHEN date >= cut THEN 'test' WHEN target_end < cut THEN 'train' ELSE 'purged' END AS split FROM labelled, ({CUT})", "labelled")
def _time_split(spark, sf):
    return splits.time_split(labelled(spark, sf))


@query("purged_train", "ticker s, date d, target_end d, target i", "SELECT * FROM labelled WHERE date < DATE '1999-06-01' AND target_end < DATE '1999-06-01'", "labelled")
def _purged(spark, sf):
    return splits.purged(labelled(spark, sf), date(1999, 6, 1))


FOLDS = "SELECT least(pos_ // size, 3) AS fold, min(date) AS valid_start, max(date) AS valid_end FROM (SELECT *, n // 4 AS size FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos_, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM labelled))) WHERE pos_ >= size GROUP BY 1"


@query("expanding_folds", "fold i, valid_start d, valid_end d, n_train i, n_valid i", f"SELECT f.fold, f.valid_start, f.valid_end, count(*) FILTER (l.date < f.valid_start AND l.target_end < f.valid_start) AS n_train, count(*) FILTER (l.date BETWEEN f.valid_start AND f.valid_end) AS n_valid FROM ({FOLDS}) f, labelled l GROUP BY 1, 2, 3", "labelled")
def _expanding(spark, sf):
    df = labelled(spark, sf)
    folds = splits.expanding_folds(df, 3)
    n = splits.fold_roles(df, folds).groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "valid").alias("n_valid"))
    return folds.join(n, "fold")


@query("outer_folds", "fold i, valid_start d, valid_end d", "SELECT k AS fold, min(date) AS valid_start, max(date) AS valid_end FROM (SELECT date, ntile(3) OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM labelled WHERE date >= DATE '2000-01-01')) GROUP BY 1", "labelled")
def _outer(spark, sf):
    return splits.outer_folds(labelled(spark, sf), date(2000, 1, 1))


@query("training_window", "ticker s, date d", "SELECT ticker, date FROM labelled WHERE date < DATE '2000-02-29' AND target_end < DATE '2000-02-29' AND date >= DATE '1997-02-28'", "labelled")
def _window(spark, sf):
    return splits.training_window(labelled(spark, sf), date(2000, 2, 29), 3)


@query("boundaries", "ticker s, split s, first_date d, last_date d, n_rows i", f"SELECT ticker, split, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM (SELECT *, CASE WHEN date >= cut THEN 'test' WHEN target_end < cut THEN 'train' ELSE 'purged' END AS split FROM labelled, ({CUT})) GROUP BY 1, 2", "labelled")
def _boundaries(spark, sf):
    return splits.boundaries(splits.time_split(labelled(spark, sf)), ["ticker", "split"])


def _features(spark, sf):
    """Labels with a few features, nulls where history is short."""
    p = w.moving_averages(panel(spark, sf), "px", (5, 20)).withColumn("r", w.simple_return("px")).withColumn("rv", w.against_history("volume"))
    p = w.relative_features(p, "px", ["sma_5", "sma_20"])
    return w.next_label(p, "px").select("ticker", "date", "target_end", "target", "r", "rv", "rel_sma_5", "rel_sma_20")


FEATURES = ["r", "rv", "rel_sma_5", "rel_sma_20"]


@query("impute_scale", "feature s, median_ f6, mean_ f5, spread f5", "SELECT 'volume' AS feature, median(volume) AS median_, avg(volume) AS mean_, stddev_pop(volume) AS spread FROM panel", "panel")
def _impute(spark, sf):
    """Exact median, mean and population deviation that imputation and scaling are fitted with."""
    p = ml.fit_preparation(panel(spark, sf), ["volume"])
    return spark.createDataFrame([("volume", p.medians["volume"], p.means["volume"], p.spreads["volume"])], "feature string, median_ double, mean_ double, spread double")


@query("majority_baseline", "ticker s, n i, accuracy f6", "SELECT ticker, count(*) AS n, avg(CASE WHEN target = (SELECT CASE WHEN count(*) FILTER (target = 1) > count(*) FILTER (target = 0) THEN 1 ELSE 0 END FROM labelled WHERE date < DATE '2000-01-01' AND target_end < DATE '2000-01-01') THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy FROM labelled WHERE date >= DATE '2000-01-01' GROUP BY 1", "labelled")
def _majority(spark, sf):
    df = labelled(spark, sf)
    model = ml.fit(splits.purged(df, date(2000, 1, 1)), "dummy", [])
    found = model.predict(df.where(F.col("date") >= F.lit(date(2000, 1, 1))))
    return found.groupBy("ticker").agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("prediction")).cast("int")).alias("accuracy"))


@query("logistic_predictions", "ticker s, date d, target i, probability f4, prediction i")
def _logistic(spark, sf):
    """Logistic regression fitted on purged history, predictions on what follows."""
    df = _features(spark, sf)
    cut = date(2000, 1, 1)
    return ml.fit(splits.purged(df, cut), "logistic", FEATURES, c=1.0).predict(df.where(F.col("date") >= F.lit(cut)))


@query("nested_validation", "ticker s, date d, variant s, model_name s, outer_fold i, target i, probability f4, prediction i")
def _nested(spark, sf):
    """Nested purged validation of two feature sets with parameters chosen inside each fold."""
    df = _features(spark, sf)
    outer = splits.outer_folds(df, date(2000, 6, 1), 2)
    return ml.nested(df, outer, "logistic", {"returns": ["r", "rv"], "relative": FEATURES}, [{"c": 1.0}, {"c": 0.01}], ["ticker", "date"], inner=2)


@query("feature_importance", "feature s, importance f4, rank i")
def _importance(spark, sf):
    """Importance of features in a forest on purged history, with ranks."""
    model = ml.fit(splits.purged(_features(spark, sf), date(2000, 1, 1)), "forest", FEATURES, trees=20, depth=4)
    ranked = sorted(model.importance().items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")


_FEATURES_SQL = """SELECT ticker, date, target_end, target, coalesce(px / nullif(lag(px) OVER w, 0) - 1, 0) AS r, coalesce(volume / nullif(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 0) AS rv,
  px / avg(px) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 AS rel_sma_5, px / avg(px) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS rel_sma_20
  FROM (SELECT ticker, date, px, volume, lead(date) OVER v AS target_end, CASE WHEN lead(px) OVER v > px THEN 1 ELSE 0 END AS target FROM panel WINDOW v AS (PARTITION BY ticker ORDER BY date)) WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
_TRAIN_SQL = f"(SELECT * FROM ({_FEATURES_SQL}) WHERE target_end IS NOT NULL AND date < DATE '2000-01-01' AND target_end < DATE '2000-01-01')"


@query(
    "logistic_optimum",
    "feature s, moment f1",
    "SELECT 'intercept' AS feature, CAST(sum(target) AS DOUBLE) AS moment FROM "
    + _TRAIN_SQL
    + "".join(f" UNION ALL SELECT '{f}', sum(target * (x - m) / d) FROM (SELECT target, coalesce({f}, median({f}) OVER ()) AS x, avg(coalesce({f}, 0)) OVER () AS m, stddev_pop({f}) OVER () AS d FROM {_TRAIN_SQL})" for f in FEATURES),
    "panel",
)
def _logistic_optimum(spark, sf):
    """At the optimum of penalised logistic regression, predicted and observed moments of each standardised feature differ by its coefficient."""
    train = splits.purged(_features(spark, sf), date(2000, 1, 1))
    model = ml.fit(train, "logistic", FEATURES, c=1.0)
    found = model.preparation.apply(model.predict(train))
    moments = found.agg(F.sum("probability").alias("intercept"), *(F.sum(F.col("probability") * F.col(f)).alias(f) for f in FEATURES)).first()
    weights = {"intercept": 0.0} | dict(zip(FEATURES, map(float, model.model.coefficients)))
    return spark.createDataFrame([(f, moments[f] + weights[f]) for f in weights], "feature string, moment double")


@query(
    "nested_rows",
    "ticker s, date d, variant s, outer_fold i, target i, sound b",
    "SELECT l.ticker, l.date, v.variant, f.k AS outer_fold, l.target, true AS sound FROM labelled l JOIN (SELECT date, ntile(2) OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM labelled WHERE date >= DATE '2000-06-01')) f USING (date), (SELECT unnest(['returns', 'relative']) AS variant) v",
    "labelled",
)
def _nested_rows(spark, sf):
    """Each row of an outer fold is predicted once by each variant, with a probability that its prediction follows."""
    df = _features(spark, sf)
    outer = splits.outer_folds(df, date(2000, 6, 1), 2)
    found = ml.nested(df, outer, "logistic", {"returns": ["r", "rv"], "relative": FEATURES}, [{"c": 1.0}], ["ticker", "date"], inner=2)
    return found.withColumn("sound", F.col("probability").between(0, 1) & (F.col("prediction") == (F.col("probability") >= 0.5).cast("int")))


@query(
    "staged_contrasts",
    "variant s, ticker s, outer_fold i, n i, positives i",
    "SELECT v.variant, l.ticker, f.k AS outer_fold, count(*) AS n, CAST(sum(l.target) AS BIGINT) AS positives FROM labelled l JOIN (SELECT date, ntile(2) OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM labelled WHERE date >= DATE '2000-06-01')) f USING (date), (SELECT unnest(['base', 'returns', 'relative']) AS variant) v GROUP BY 1, 2, 3",
    "labelled",
)
def _staged_contrasts(spark, sf):
    """Three stages of features on the same folds: rows and positives that each stage's metrics stand on."""
    df = _features(spark, sf)
    outer = splits.outer_folds(df, date(2000, 6, 1), 2)
    stages = {"base": ["rv"], "returns": ["r", "rv"], "relative": FEATURES}
    _, scores, _ = ml.staged_contrasts(df, outer, "logistic", stages, [{"c": 1.0}], [("base", "returns"), ("returns", "relative")], ["ticker", "date"], "ticker", inner=2, repeats=100)
    return scores.withColumn("positives", F.col("tp") + F.col("fn"))
