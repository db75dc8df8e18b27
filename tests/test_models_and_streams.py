"""Models under purged validation, cached scoring, and the streaming forms."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import dedup, ml, scoring, splits
from tideline.operators.contracts import ContractError
from tideline.streaming import twins


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    days = [d.date() for d in pd.bdate_range("2022-01-03", periods=161)]
    rows = []
    for e in ("A", "B"):
        for i in range(160):
            x, z = rng.standard_normal(2)
            rows.append((e, days[i], days[i + 1], int(x + 0.5 * rng.standard_normal() > 0), float(x), None if i % 9 == 0 else float(z)))
    return spark.createDataFrame(rows, "ticker string, date date, target_end date, target int, x double, z double").cache()


def test_models_learn(frame):
    cut = date(2022, 6, 1)
    train, test = splits.purged(frame, cut), frame.where(F.col("date") >= F.lit(cut))
    for name, params in (("logistic", {"c": 1.0}), ("logistic", {"balanced": True}), ("forest", {"trees": 20, "depth": 4}), ("boosting", {"rounds": 5})):
        model = ml.fit(train, name, ["x", "z"], **params)
        rows = model.predict(test).collect()
        assert len(rows) == test.count() and np.mean([r.target == r.prediction for r in rows]) > 0.75
        assert all(r.prediction == int(r.probability >= 0.5) for r in rows)
        assert model.importance()["x"] > model.importance()["z"]
    dummy = ml.fit(train, "dummy", []).predict(test)
    assert dummy.select("probability").distinct().count() == 1


def test_models_are_saved_once(frame, tmp_path):
    for name in ("dummy", "logistic", "boosting"):
        model = ml.fit(frame, name, ["x", "z"], rounds=2)
        model.save(f"{tmp_path}/{name}")
        again = ml.Fitted.load(f"{tmp_path}/{name}")
        rows = lambda m: sorted(map(tuple, m.predict(frame).select("ticker", "date", "probability").collect()))  # noqa: E731, B023
        assert rows(model) == rows(again)
        with pytest.raises(Exception, match="(?i)exist"):
            model.save(f"{tmp_path}/{name}")


def test_logistic_solves_the_penalised_problem(spark, frame):
    model = ml.fit(frame, "logistic", ["x"], c=1.0)
    prep = model.preparation
    pdf = frame.toPandas()
    x = (pdf["x"] - prep.means["x"]) / prep.spreads["x"]
    b = np.zeros(2)
    for _ in range(50):  # Newton on 0.5 w^2 + sum of losses, intercept free
        p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
        g = np.array([(p - pdf["target"]).sum(), ((p - pdf["target"]) * x).sum() + b[1]])
        h = np.array([[(p * (1 - p)).sum(), (p * (1 - p) * x).sum()], [(p * (1 - p) * x).sum(), (p * (1 - p) * x * x).sum() + 1]])
        b -= np.linalg.solve(h, g)
    assert np.allclose([model.model.intercept, model.model.coefficients[0]], b, atol=1e-4)


def test_nested_selection_uses_only_the_past(frame):
    outer = splits.outer_folds(frame, date(2022, 6, 1), 2)
    out = ml.nested(frame, outer, "logistic", {"one": ["x"], "two": ["x", "z"]}, [{"c": 1.0}, {"c": 1e-4}], ["ticker", "date"], inner=2).collect()
    assert {r.variant for r in out} == {"one", "two"} and {r.outer_fold for r in out} == {1, 2}
    params, trace = ml.choose(splits.purged(frame, date(2022, 6, 1)), "logistic", ["x", "z"], [{"c": 1.0}, {"c": 1e-9}], folds=2, entity="ticker")
    assert params in ({"c": 1.0}, {"c": 1e-9}) and len(trace) == 4
    each = ml.for_each_entity(frame, "ticker", ["A", "B"], lambda d: ml.fit(d, "dummy", []).predict(d))
    assert each.count() == 320
    assert ml.tuned_threshold(ml.fit(frame, "logistic", ["x"]).predict(frame)) in [round(0.4 + 0.025 * i, 3) for i in range(9)]
    grid = ml.sampled_grid({"a": [1, 2, 3], "b": [4, 5]}, 4)
    assert len(grid) == 4 == len({tuple(g.items()) for g in grid}) and grid == ml.sampled_grid({"a": [1, 2, 3], "b": [4, 5]}, 4)


def toy():
    return lambda texts: [(min(1.0, t.count("a") / 10), 0.0, 1 - min(1.0, t.count("a") / 10)) for t in texts]


def test_cache_scores_each_text_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "aaa"), (2, "aaa"), (3, "b"), (4, None)], "id int, text string")
    path = f"{tmp_path}/scores"
    got = {r.id: r.positive for r in scoring.cached_scores(df, path, "v1", toy).collect()}
    assert got == {1: 0.3, 2: 0.3, 3: 0.0, 4: 0.0} and spark.read.parquet(path).count() == 3
    more = df.union(spark.createDataFrame([(5, "aaaa")], df.schema))
    scoring.cached_scores(more, path, "v1", toy).collect()
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ContractError):
        scoring.cached_scores(df, path, "v2", toy)
    with pytest.raises(Exception, match="lost or added"):
        scoring.score_texts(scoring.with_text_hash(df).select("text_sha256", F.coalesce("text", F.lit("")).alias("text")), lambda: lambda texts: []).collect()
    news = scoring.with_text_hash(df)
    assert scoring.replace_sentiment(news, spark.read.parquet(path).drop("version"), ["id"]).count() == 4
    with pytest.raises(ContractError):
        scoring.replace_sentiment(news, spark.read.parquet(path).drop("version").limit(1), ["id"])


def stream(spark, df, path, parts):
    """A file stream of `df`, one file for each part, read one at a time."""
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{path}/in/{k}")
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(f"{path}/in")


def drained(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_causal_dedup_stream_equals_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(k, base + timedelta(hours=h), i) for i, (k, h) in enumerate([("a", 1), ("b", 2), ("a", 5), ("a", 24), ("a", 25), ("a", 26), ("b", 30), ("a", 60)])]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    parts = [df.where("id < 3"), df.where("id BETWEEN 3 AND 5"), df.where("id > 5")]
    got = drained(twins.causal_dedup_stream(stream(spark, df, str(tmp_path), parts), ["key"], "ts", "id", delay="30 days"), spark, "causal")
    want = {(r.id, r.kept, r.representative) for r in dedup.causal_dedup(df, ["key"], "ts", "id").collect()}
    assert {(r.id, r.kept, r.representative) for r in got} == want


def test_daily_stream_and_resumable_scoring(spark, tmp_path):
    rows = [("a", datetime(2024, 1, d, 10), float(d), "aa" * d) for d in (1, 1, 2, 3, 9)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, score double, text string")
    source = stream(spark, df, str(tmp_path), [df.where("score < 3"), df.where("score >= 3")])
    days = drained(twins.daily_sentiment_stream(source, "ticker", "ts", "score"), spark, "days")
    assert {(r.date.day, r.news_count) for r in days} >= {(1, 2), (2, 1)}
    for _ in range(2):
        twins.resumable_scoring(stream(spark, df, str(tmp_path), []), f"{tmp_path}/scores", f"{tmp_path}/check", "v1", toy).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 4
