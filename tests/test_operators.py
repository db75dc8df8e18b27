"""Boundaries, contracts and invariants of the operators on small tables."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideline.functions import dates, text
from tideline.operators import aggregates, contracts, dedup, joins, metrics, reshape, splits
from tideline.operators import windows as w
from tideline.operators.graph import connected_components
from tideline.sources import readers, sinks
from tideline.sources.calendar import early_closes, easter, holidays, trading_schedule


def panel(spark, n=60, entities=("AAPL", "MSFT"), bump=0.0):
    days = [d.date() for d in pd.bdate_range("2024-01-02", periods=n + 1)]
    rows = [(e, days[i], days[i + 1], i % 2, float(i + 10 + (bump if i > 40 else 0)), float(i % 7)) for i in range(n) for e in entities]
    return spark.createDataFrame(rows, "ticker string, date date, target_end date, target int, px double, volume double")


@pytest.mark.parametrize("most", [200_000, 0])
def test_asof_boundaries(spark, most):
    schedule = trading_schedule(spark, date(2024, 7, 1), date(2024, 7, 8))
    cases = {
        "2024-07-03 16:59:00": date(2024, 7, 3),
        "2024-07-03 17:01:00": date(2024, 7, 5),
        "2024-07-04 10:00:00": date(2024, 7, 5),
        "2024-07-05 20:00:00": date(2024, 7, 5),
        "2024-07-05 20:00:01": date(2024, 7, 8),
        "2024-07-06 12:00:00": date(2024, 7, 8),
        "2024-06-01 12:00:00": date(2024, 7, 1),
        "2024-07-08 20:00:01": None,
    }
    events = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("ts", F.to_timestamp("s"))
    got = {r.s: r.trading_date for r in joins.asof_forward(events, schedule, "ts", "market_close", most).collect()}
    assert got == cases


def test_calendar_follows_daylight_saving_and_holidays(spark):
    close = {r.trading_date: r.market_close for r in trading_schedule(spark, date(2024, 3, 8), date(2024, 3, 11)).collect()}
    assert close[date(2024, 3, 8)].hour == 21 and close[date(2024, 3, 11)].hour == 20
    assert [easter(y) for y in (2019, 2024, 2025)] == [date(2019, 4, 21), date(2024, 3, 31), date(2025, 4, 20)]
    assert {date(2021, 12, 24), date(2022, 6, 20), date(2023, 1, 2), date(2024, 3, 29), date(2025, 1, 9)} <= holidays(2021) | holidays(2022) | holidays(2023) | holidays(2024) | holidays(2025)
    assert date(2021, 12, 31) not in holidays(2021) | holidays(2022)
    assert {date(2024, 7, 3), date(2024, 11, 29), date(2024, 12, 24)} == early_closes(2024)


def test_purge_folds_and_windows(spark):
    df = panel(spark)
    start = date(2024, 2, 1)
    train = splits.purged(df, start).collect()
    assert train and all(r.date < start and r.target_end < start for r in train)
    folds = splits.expanding_folds(df, 3)
    rows = folds.orderBy("fold").collect()
    assert [r.fold for r in rows] == [1, 2, 3] and all(a.valid_end < b.valid_start for a, b in zip(rows, rows[1:]))
    roles = splits.fold_roles(df, folds).collect()
    for r in rows:
        assert all(x.target_end < r.valid_start for x in roles if x.fold == r.fold and x.role == "train")
    sizes = [(r.valid_end - r.valid_start).days for r in splits.outer_folds(df, date(2024, 1, 2), 3).orderBy("fold").collect()]
    assert len(sizes) == 3
    with pytest.raises(ValueError):
        splits.training_window(df, start, 4)
    long = spark.createDataFrame([(d.date(), (d + pd.offsets.BDay()).date()) for d in pd.bdate_range("2015-01-01", "2025-12-31")], "date date, target_end date")
    low = splits.training_window(long, date(2024, 2, 29), 3).agg(F.min("date")).first()[0]
    assert low == date(2021, 3, 1)  # 2021-02-28 was a Sunday
    assert splits.expanding_folds(df.limit(0), 3).count() == 0


def test_future_rows_and_other_entities_never_change_the_past(spark):
    def features(df):
        out = w.moving_averages(df, "px")
        out = w.lags(out.withColumns({"r": w.simple_return("px"), "v": w.volatility("px"), "rv": w.against_history("volume"), "z": w.volume_surprise("volume")}), ["px"])
        out = out.join(w.macd(df, "px"), ["ticker", "date"]).join(w.rsi(df, "px"), ["ticker", "date"])
        return {(r.ticker, r.date): r for r in out.drop("target", "target_end").collect()}

    before, after = features(panel(spark)), features(panel(spark, bump=50.0))
    cut = sorted({k[1] for k in before})[41]
    assert all(before[k] == after[k] for k in before if k[1] < cut) and any(before[k] != after[k] for k in before)
    alone = features(panel(spark, entities=("AAPL",)))
    assert all(alone[k] == before[k] for k in alone)


def test_indicators_against_pandas(spark):
    rng = np.random.default_rng(7)
    x = pd.Series(100 + rng.standard_normal(80).cumsum())
    days = [d.date() for d in pd.bdate_range("2024-01-02", periods=80)]
    df = spark.createDataFrame([("A", d, float(v)) for d, v in zip(days, x)], "ticker string, date date, px double")
    ewm = lambda s, n: s.ewm(span=n, adjust=False).mean()
    want = ewm(x, 12) - ewm(x, 26)
    got = w.macd(df, "px").orderBy("date").toPandas()
    assert np.allclose(got["macd"], want) and np.allclose(got["macd_signal"], ewm(want, 9))
    rsi = w.rsi(df, "px").orderBy("date").toPandas()["rsi"]
    d = x.diff()
    mean = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    exact = 100 - 100 / (1 + mean(d.clip(lower=0)) / mean(-d.clip(upper=0)))
    assert (rsi[:14] == 50).all() and np.allclose(rsi[14:], exact[14:])
    flat = w.rsi(df.withColumn("px", F.lit(5.0)), "px").toPandas()["rsi"]
    assert (flat == 50).all()
    up = w.rsi(df.withColumn("px", F.datediff("date", F.lit("2024-01-01")).cast("double")), "px").orderBy("date").toPandas()["rsi"]
    assert up.iloc[-1] == 100
    gap = spark.createDataFrame([("A", days[0], 1.0), ("A", days[1], None), ("A", days[2], 2.0), ("A", days[3], 4.0)], "ticker string, date date, px double")
    assert [r.r for r in gap.withColumn("r", w.simple_return("px")).orderBy("date").collect()] == [0.0, 0.0, 1.0, 1.0]


def test_surprises_exclude_today(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-02", periods=12)]
    df = spark.createDataFrame([("A", d, 0.7 if i == 10 else 0.2, True, 3) for i, d in enumerate(days)], "ticker string, date date, tone double, has_news boolean, n int")
    out = w.tone_surprise(df, "tone", "has_news").withColumn("z", w.volume_surprise("n")).orderBy("date").collect()
    assert math.isclose(out[10].tone_surprise, 0.5) and out[10].tone_ready == 1.0
    assert out[4].tone_history is None and out[4].tone_surprise == 0.0
    assert all(r.z == 0.0 for r in out)


def test_labels(spark):
    df = spark.createDataFrame([("A", date(2024, 1, i), x) for i, x in ((1, 5.0), (2, 5.0), (3, 6.0), (4, None), (5, 4.0))], "ticker string, date date, px double")
    assert [r.target for r in w.next_label(df, "px").orderBy("date").collect()] == [0, 1, 0]


@pytest.mark.parametrize("hours", [[1, 5, 24, 25, 26, 60]])
def test_causal_dedup_is_no_lag_rule(spark, hours):
    base = datetime(2024, 1, 1)
    rows = [("k", base + timedelta(hours=h), h) for h in hours]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int")
    got = dedup.causal_dedup(df, ["key"], "ts", "id").collect()
    assert sorted(r.id for r in got if r.kept) == [1, 26, 60]
    assert {r.id: r.representative for r in got} == {1: 1, 5: 1, 24: 1, 25: 1, 26: 26, 60: 60}
    early = {r.id: r for r in dedup.causal_dedup(df.where("id <= 25"), ["key"], "ts", "id").collect()}
    assert all(early[r.id] == r for r in got if r.id in early)


def test_components_are_transitive(spark):
    rows = [(i, f"u{i}", f"t{i}") for i in range(40)]
    rows[1] = (1, "u0", "t1")
    rows[10] = (10, "u10", "t1")
    rows += [(100 + i, f"c{i}", f"c{i + 1}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, url string, title string")
    both = F.array("url", "title")
    got = {r.id: r.component for r in dedup.duplicate_components(df, "id", {"url": F.col("url"), "title": F.col("title")}).collect()}
    assert got[0] == got[1] == got[10] == 0 and got[2] == 2
    edges = df.select("id", F.explode(both).alias("k"))
    heads = edges.groupBy("k").agg(F.min("id").alias("h"))
    chain = connected_components(edges.join(heads, "k").select(F.col("h").alias("src"), F.col("id").alias("dst")))
    assert {r.component for r in chain.where("node >= 100").collect()} == {100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sampling_depends_on_identity_only(spark):
    rows = [(i, f"g{i // 2}", "AB"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, grp string, cell string")
    pick = lambda d: {(r.cell, r.id) for r in dedup.hash_sample(d, "id", "grp", "cell", ["A", "B"], 10).collect()}
    first = pick(df)
    assert pick(df.orderBy(F.desc("id"))) == first and len(first) == 20
    assert len({i // 2 for _, i in first}) == 20
    with pytest.raises(ValueError):
        dedup.hash_sample(df, "id", "grp", "cell", ["A", "B"], 60)


def test_contracts(spark):
    df = panel(spark)
    contracts.enforce(contracts.expect_panel(df, ["ticker", "date"], "target"))
    for bad in (df.union(df.limit(1)), df.withColumn("target", F.lit(2)), df.withColumn("ticker", F.lit(None).cast("string"))):
        with pytest.raises(contracts.ContractError):
            contracts.enforce(contracts.expect_panel(bad, ["ticker", "date"], "target"))
    score = spark.createDataFrame([(0.1, 0.7, 0.2, -0.6, "negative")], "positive double, negative double, neutral double, score double, label string")
    check = lambda d: contracts.enforce(contracts.expect_probabilities(d, ["positive", "negative", "neutral"], "score", "label", "positive", "negative"))
    check(score)
    for change in ({"positive": F.lit(float("nan"))}, {"positive": F.lit(1.1)}, {"label": F.lit("neutral")}, {"score": F.lit(0.0)}, {"neutral": F.lit(0.3)}):
        with pytest.raises(contracts.ContractError):
            check(score.withColumns(change))
    p = spark.createDataFrame([(1, 0.5, 1), (2, 0.4, 0)], "id int, probability double, prediction int")
    contracts.enforce(contracts.expect_predictions(p, ["id"]))
    for bad in (p.withColumn("probability", F.lit(1.2)), p.withColumn("prediction", F.lit(0)), p.union(p)):
        with pytest.raises(contracts.ContractError):
            contracts.enforce(contracts.expect_predictions(bad, ["id"]))
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.expect_paired(p, p.limit(1), ["id"]))
    with pytest.raises(contracts.ContractError):
        joins.many_to_one(df, df.union(df), ["ticker", "date"])


def test_metrics(spark):
    rows = [("A", 0, 0.1), ("A", 1, 0.2), ("B", 0, 0.8), ("B", 1, 0.9)]
    df = spark.createDataFrame(rows, "ticker string, target int, probability double")
    assert metrics.roc_auc(df, []).first()["auc"] == 0.75
    assert metrics.roc_auc(df, ["ticker"]).agg(F.avg("auc")).first()[0] == 1.0
    assert metrics.roc_auc(df.where("target = 1"), []).first()["auc"] is None
    base = spark.createDataFrame([(int(i < 60), 1, 0.6) for i in range(100)], "target int, prediction int, probability double")
    m = metrics.rates(base.agg(*metrics.confusion())).first()
    assert (m.balanced_accuracy, m.mcc, m.accuracy) == (0.5, 0.0, 0.6)
    assert metrics.roc_auc(base, []).first()["auc"] == 0.5
    same = spark.createDataFrame([("x", "x")] * 5, "a string, b string")
    k = metrics.cohen_kappa(same, "a", "b").first()
    assert k.agreement == 1.0 and k.kappa is None


def test_weighted_auc_equals_repeated_rows(spark):
    rng = np.random.default_rng(1)
    y, s = np.array([0, 1, 1, 0, 1, 0]), np.array([0.1, 0.6, 0.6, 0.6, 0.9, 0.9])
    weights = rng.integers(0, 6, (120, 6))
    weights[0] = 0
    rows = [(k, int(y[i]), float(s[i]), int(w[i])) for k, w in enumerate(weights) for i in range(6)]
    got = {r.k: r.auc for r in metrics.weighted_auc(spark.createDataFrame(rows, "k int, target int, probability double, w long"), ["k"], "w").collect()}
    for k, row in enumerate(weights):
        yy, ss = np.repeat(y, row), np.repeat(s, row)
        pairs = (ss[yy == 1][:, None] - ss[yy == 0][None, :]).ravel()
        assert got[k] is None if not len(pairs) else math.isclose(got[k], (np.sum(pairs > 0) + 0.5 * np.sum(pairs == 0)) / len(pairs))


def test_smoothing_over_chunks(spark):
    rng = np.random.default_rng(8)
    n = 12_000  # several chunks for each a
    rows = [(e, k, float(v)) for e in "ab" for k, v in enumerate(rng.standard_normal(n).cumsum() + 50)]
    df = spark.createDataFrame(rows, "ticker string, date int, px double").repartition(4)
    got = w.ewm(df, "px", {"slow": 2 / 27, "quick": 0.9, "whole": 1.0}).toPandas().sort_values(["ticker", "date"])
    for e in "ab":
        x = pd.Series([v for t, _, v in rows if t == e])
        for c, a in (("slow", 2 / 27), ("quick", 0.9), ("whole", 1.0)):
            assert np.allclose(got[got.ticker == e][c].to_numpy(), x.ewm(alpha=a, adjust=False).mean(), rtol=1e-11)


def test_causal_dedup_is_linear_in_a_session(spark):
    import time

    def seconds(n):
        df = spark.range(n).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), "id")
        began = time.perf_counter()
        got = dedup.causal_dedup(df, ["key"], "ts", "id").where("kept").count()
        assert got == -(-n // 145)
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(400_000) < 10 * seconds(100_000) + 5


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(e, d, arm, int(rng.random() < 0.5), float(round(rng.random(), 2))) for e in "AB" for d in range(60) for arm in ("x",)]
    df = spark.createDataFrame(rows, "ticker string, d int, arm string, target int, probability double")
    twice = df.union(df.withColumn("arm", F.lit("y")))
    out = metrics.bootstrap_auc(twice, "ticker", "d", "arm", [("x", "y")], block=10, repeats=120).collect()
    assert {r.ticker for r in out} == {"A", "B", "macro"} and all(r.delta == r.low == r.high == 0.0 for r in out)
    assert {r["rep"]: r["n"] for r in metrics.drawn_blocks(spark, 60, 20, 100).groupBy("rep").agg(F.sum("times").alias("n")).collect()} == dict.fromkeys(range(-1, 100), 60)
    weights = metrics.block_weights(60, 20, 100)
    assert (weights.sum(1) == 60).all() and (metrics.block_weights(60, 20, 100) == weights).all()
    rng = np.random.default_rng(42)
    for row in weights:  # the same draws as one replicate after the other
        starts = rng.integers(0, 41, size=3)
        assert (np.bincount(np.concatenate([np.arange(s, s + 20) for s in starts])[:60], minlength=60) == row).all()
    for bad in ((10, 10, 100), (10, 5, 50)):
        with pytest.raises(ValueError):
            metrics.block_weights(*bad)


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 2.0, 1.0), ("b", 4.0, 3.0), (None, 1.0, 1.0)], "k string, v double, w double")
    got = {r.k: r.m for r in df.groupBy("k").agg(aggregates.weighted_mean("v", "w").alias("m")).collect()}
    assert got == {"a": 0.0, "b": 3.5, None: 1.0}
    assert {r.k: r.score_std for r in aggregates.dispersion(df.withColumn("v", F.when(F.col("v") == 1, -0.8).when(F.col("v") == 3, 0.8)), ["k"], "v").collect()}["a"] == 0.8
    assert aggregates.present(df, ["k"]).count() == 4


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.canonical_url(F.lit("https://Example.test/news?id=1#x"))) == "https://example.test/news?id=1"
    assert one(text.canonical_url(F.lit("  no host "))) == "no host"
    summary = "Apple raised its outlook. Tesla lowered its outlook. Demand was mixed."
    assert one(text.company_context(F.lit(summary), ["Apple", "AAPL"])) == "Apple raised its outlook."
    assert one(text.company_context(F.lit(summary), ["Microsoft"])) == ""
    assert one(text.normalized(F.lit("  PROFIT  rises ﬁ Straße "))) == "profit rises fi strasse"
    assert one(text.clean_text(F.lit(" a \n b "))) == "a b"
    assert one(text.title_and_summary(F.lit("T"), F.lit(None).cast("string"))) == "T"
    rule = lambda t, u: one(text.eligible(F.lit(t), F.lit(u), F.lit("x"), F.lit(0.9), r"(?i)\b(etf (stock price|holdings)|overview)", "/quote/"))
    assert not rule("FIAX ETF Stock Price & Overview", "https://a.test/n") and not rule("Apple falls", "https://a.test/quote/AAPL") and rule("Apple stock price falls after results", "https://a.test/n")
    assert one(dates.midpoint(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 4)))) == date(2024, 1, 2)
    assert one(dates.parse_compact(F.lit("20240102T093000"))) == datetime(2024, 1, 2, 9, 30)
    assert one(dates.parse_compact(F.lit("nothing"))) is None


def test_feature_subset():
    full = ["px", "tone", "tone_lag_1", "tone_mean_3", "n", "n_lag_1"]
    assert reshape.feature_subset(full, ["px"], "tone", "drop") == ["px", "n", "n_lag_1"]
    assert reshape.feature_subset(full, ["px"], "n", "add") == ["px", "n", "n_lag_1"]
    for bad in (("zzz", "add"), ("n", "swap")):
        with pytest.raises(ValueError):
            reshape.feature_subset(full, ["px"], *bad)


def test_ranges():
    whole = readers.DayRange(date(2024, 1, 1), date(2024, 1, 31))
    per_day = lambda r: 100 * ((r.end - r.start).days + 1)
    parts = list(readers.bisected(whole, per_day))
    assert parts[0][0].start == whole.start and parts[-1][0].end == whole.end and all(n < 950 for _, n in parts)
    assert all(b[0].start - a[0].end == timedelta(days=1) for a, b in zip(parts, parts[1:]))
    with pytest.raises(readers.Saturated):
        list(readers.bisected(readers.DayRange(date(2024, 1, 1), date(2024, 1, 1)), lambda _: 950))


def test_files(spark, tmp_path):
    df = panel(spark)
    sinks.write_table(df, f"{tmp_path}/t", by=["ticker"])
    with pytest.raises(PySparkException):
        sinks.write_table(df, f"{tmp_path}/t", by=["ticker"])
    assert spark.read.parquet(f"{tmp_path}/t").where("ticker = 'AAPL'").count() == 60
    sinks.append_new(df.select("ticker", "date"), f"{tmp_path}/k", ["ticker", "date"])
    sinks.append_new(df.select("ticker", "date"), f"{tmp_path}/k", ["ticker", "date"])
    assert spark.read.parquet(f"{tmp_path}/k").count() == 120
    (tmp_path / "a.csv").write_text("date,px,n\n2024-01-02,1.5,x\n2024-01-03,NaN,\nbad,2.5,y\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("px", T.DoubleType()), T.StructField("n", T.StringType())])
    rows = readers.read_csv(spark, f"{tmp_path}/a.csv", schema).collect()
    assert [r.px for r in rows] == [1.5, None, 2.5] and rows[2].date is None
    assert [r.n for r in readers.read_strings(spark, f"{tmp_path}/a.csv", ["date", "px", "n"]).collect()] == ["x", "", "y"]
    many = readers.read_many(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/absent.csv"], schema)
    assert many.count() == 3 and many.first().source_file.endswith("a.csv")
    assert readers.read_many(spark, [f"{tmp_path}/absent.csv"], schema).count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x").write_text("1")
    m = sinks.manifest(spark, f"{tmp_path}/in", {"a": 1})
    assert sinks.changed_files(spark, f"{tmp_path}/in", m) == []
    (tmp_path / "in/x").write_text("2")
    assert len(sinks.changed_files(spark, f"{tmp_path}/in", m)) == 1
    done = sinks.manifest(spark, f"{tmp_path}/in", {"version": "2", "seed": 42}, "complete")
    sinks.write_json(spark, done, f"{tmp_path}/m.json")
    assert sinks.checked_reference(spark, f"{tmp_path}/m.json", f"{tmp_path}/in", "2", {"seed": 42})["inputs"] == done["inputs"]
    for version, protocol in (("1", {}), ("2", {"seed": 7})):
        with pytest.raises(contracts.ContractError):
            sinks.checked_reference(spark, f"{tmp_path}/m.json", f"{tmp_path}/in", version, protocol)
    (tmp_path / "in/x").write_text("3")
    with pytest.raises(contracts.ContractError, match="changed"):
        sinks.checked_reference(spark, f"{tmp_path}/m.json", f"{tmp_path}/in", "2", {})
    assert sinks.update_json(spark, f"{tmp_path}/r.json", a=1, t="é\n") | {"b": 2} == sinks.update_json(spark, f"{tmp_path}/r.json", b=2)
    assert [r.value for r in sinks.markdown(df.limit(1), "T", ["ticker"]).collect()][0] == "# T"


def test_feed_must_be_readable(spark):
    good = '{"feed":[{"title":"t","ticker_sentiment":[{"ticker":"A","relevance_score":"0.5"}]},{"title":"u"}]}'
    df = spark.createDataFrame([(good, "A")], "j string, t string")
    assert [(r.title, r.relevance_score) for r in readers.flatten_feed(df, "j", "t").collect()] == [("t", "0.5"), ("u", None)]
    with pytest.raises(PySparkException):
        readers.flatten_feed(spark.createDataFrame([('{"Note":"slow down"}', "A")], "j string, t string"), "j", "t").collect()


def test_feed_source_retries(spark):
    from tideline.sources import feed

    waits, answers = [], [(429, ""), (200, '{"Note": "slow down"}'), (200, '{"feed": []}')]
    assert feed.retried(lambda: answers.pop(0), wait=waits.append) == [] and waits == [1.0, 2.0]
    with pytest.raises(feed.TransientError):
        feed.retried(lambda: (503, ""), wait=lambda _: None)
    for body in ("{", '{"feed": 1}', "[]"):
        with pytest.raises(feed.MalformedAnswer):
            feed.retried(lambda: (200, body), wait=lambda _: None)  # noqa: B023
    ranges = feed.planned("A", date(2024, 1, 1), date(2024, 1, 31), lambda r: 100 * ((r.end - r.start).days + 1))
    df = feed.read_feed(spark, "tests.fake_feed:fetch", ranges)
    assert df.rdd.getNumPartitions() == len(ranges) > 1
    rows = readers.flatten_feed(df, "json", "ticker").collect()
    assert {r.title for r in rows} == {f"A {a}" for _, a, _ in ranges} and {r.relevance_score for r in rows} == {"0.5"}


def test_scans_are_pruned_and_filters_pushed(spark):
    from tideline.plans import registry

    def plan(name):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    scan = plan("date_range_filter")
    assert "PushedFilters: [IsNotNull(" in scan and "o_totalprice" not in scan.split("ReadSchema", 1)[1].split("\n", 1)[0]
    assert "BroadcastHashJoin" in plan("asof_forward")
    for name in ("daily_agg", "metrics_grouping_sets", "threshold_opt", "delta_compare"):
        assert "CartesianProduct" not in plan(name) and plan(name).count("Exchange ") <= 6


def test_news_domain(spark):
    import hashlib

    from tideline.plans import domain

    rows = []
    for x in domain.TICKERS:
        for year in (2020, 2024):
            for k in range(5):
                n = len(rows)
                rows.append((x, f"{domain.ALIASES[x][0]} item {n}", f"Summary {n}. {domain.ALIASES[x][0]} rose in the end.", f"text {n}", f"https://a.test/{n}", datetime(year, 1, 1 + k, 12)))
    rows[1] = (*rows[1][:4], rows[0][4].upper().replace("A.TEST", "a.test").lower(), rows[1][5])
    rows[10] = (rows[10][0], rows[1][1].upper(), *rows[10][2:])
    schema = "ticker string, title string, summary string, text string, url string, published_at timestamp"
    df = spark.createDataFrame([*rows, ("XYZ", "t", "s", "x", "u", datetime(2024, 1, 1))], schema)
    got = {r.text: r for r in domain.prepare_news(df).collect()}
    assert len(got) == 40
    one = {got[f"text {i}"].group_id for i in (0, 1, 10)}
    assert len(one) == 1 and len({r.group_id for r in got.values()}) == 38
    keys = [f"url:{r[4]}" for r in (rows[0], rows[1], rows[10])] + [f"title:{r[1].lower()}" for r in (rows[0], rows[1], rows[10])] + [f"text:{r[3]}" for r in (rows[0], rows[1], rows[10])]
    assert one == {hashlib.sha256(min(keys).encode()).hexdigest()}
    r = got["text 3"]
    want = "\x1f".join([r.ticker, "2020-01-04T12:00:00+00:00", r.url, r.title, r.text])
    assert r.news_id == hashlib.sha256(want.encode()).hexdigest()
    assert got["text 0"].multi_company and not got["text 3"].multi_company and got["text 10"].partition == "development"
    assert r.context == "Apple item 3 Apple rose in the end."
    sample = domain.sample_news(domain.prepare_news(df), per_cell=2).collect()
    assert len(sample) == 16 and len({x.group_id for x in sample}) == 16
    with pytest.raises(ValueError):
        domain.sample_news(domain.prepare_news(df), per_cell=6)
    more = spark.createDataFrame(
        [("AAPL", "FIAX ETF Stock Price & Overview Apple", "", "x", "https://a.test/n", datetime(2024, 1, 1)), ("AAPL", "IWY ETF Holdings List", "Apple.", "x", "https://a.test/n", datetime(2024, 1, 1)), ("AAPL", "Apple", "", "x", "https://a.test/quote/AAPL", datetime(2024, 1, 1)), ("AAPL", "Apple stock price falls after results", "", "x", "https://a.test/n", datetime(2024, 1, 1)), ("AAPL", "Apple", "", " ", "u", datetime(2024, 1, 1)), ("AAPL", "Apple", "", "x", "u", datetime(2020, 1, 1))],
        schema,
    )
    assert [r.eligible for r in domain.eligible_news(more).collect()] == [False, False, False, True, False, False]
    labels = spark.createDataFrame([("Bullish",), ("Somewhat-Bearish",), ("Neutral",), ("odd",), (None,)], "x string")
    assert [r.c for r in labels.select(domain.sentiment_class("x").alias("c")).collect()] == ["positive", "negative", "neutral", "neutral", "neutral"]
