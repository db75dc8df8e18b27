"""Classification metrics as relational aggregations, and the moving-block bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .aggregates import ratio
from .ranks import meet, positions

CELLS = ("tn", "fp", "fn", "tp")


def confusion(target: str = "target", prediction: str = "prediction") -> list[Column]:
    hit = lambda t, p: F.count_if((F.col(target) == t) & (F.col(prediction) == p))
    return [hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp")]


def rates(df: DataFrame) -> DataFrame:
    """Metrics from the four cells; whatever divides by zero is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in CELLS)
    f1 = lambda t, p, n: ratio(2 * t, 2 * t + p + n)
    both = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return df.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f1(tp, fp, fn),
            "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
            "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2,
            "mcc": ratio(tp * tn - fp * fn, both),
        }
    )


def weighted_auc(df: DataFrame, keys: Sequence[str], weight: str | Column, target: str = "target", score: str = "probability", **cuts) -> DataFrame:
    """Area under the curve by group where each row stands for `weight` rows, ties counting half; null unless both classes weigh something.

    Rows are counted by score, and the running sums of negatives are those of positions among negatives; `cuts` goes to `positions`.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    both = positions(df.withColumns({"__neg": F.when(F.col(target) == 0, w).otherwise(0), "__pos": F.when(F.col(target) == 1, w).otherwise(0)}), keys, score, sums={"p": F.sum("__pos"), "m": F.sum("__neg")}, weight="m", **cuts)
    out = both.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + F.col("m") / 2)).alias("wins"), F.sum("p").alias("pos"), F.sum("m").alias("neg"))
    return out.select(*keys, F.try_divide(F.col("wins"), F.nullif((F.col("pos") * F.col("neg")).cast("double"), F.lit(0.0))).alias("auc"))


def roc_auc(df: DataFrame, keys: Sequence[str], target: str = "target", score: str = "probability") -> DataFrame:
    """Area under the curve by group, ties counting half; null unless both classes occur."""
    return weighted_auc(df, keys, F.lit(1).cast("long"), target, score)


def metrics_by_scope(df: DataFrame, scopes: Sequence[str], target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Long table (scope, group, metrics): all rows, and each column of `scopes` by value, from one GROUPING SETS pass."""
    df = df.withColumns({f"__{c}": F.col(c).cast("string") for c in scopes})
    sets = [[], *([f"__{c}"] for c in scopes)]
    cols = [f"__{c}" for c in scopes]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, cols)).agg(*confusion(target, prediction), F.count("*").alias("n"), F.grouping_id().alias("__gid"), F.avg(target).alias("base_rate"))
    full = (1 << len(cols)) - 1
    names = {full: "global"} | {full - (1 << (len(cols) - 1 - i)): c for i, c in enumerate(scopes)}
    scope = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("__gid").cast("int"))
    group = F.coalesce(*map(F.col, cols), F.lit("all"))
    return rates(out).withColumns({"scope": scope, "group": group}).drop("__gid", *cols)


def macro(df: DataFrame, entity: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Plain means over entities of metrics that were computed for each entity."""
    return df.groupBy(*keys).agg(F.count_distinct(entity).alias("n_entities"), *(F.avg(m).alias(f"macro_{m}") for m in metrics))


def multiclass(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) of each class that occurs on either side."""
    cells = df.groupBy(target, prediction).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col(target).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(prediction).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n", (F.col(target) == F.col(prediction)).alias("hit"))
    out = sides.groupBy(F.col("s.class").alias("class")).agg(F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("predicted"), F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), F.col("n")).otherwise(0)).alias("hits"))
    return out.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support")), "f1": ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))})


def multiclass_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means, and accuracy, of a multiclass report."""
    weighted = lambda m: ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    return report.agg(ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), *(F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")), *(weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two annotators and kappa, null where chance alone agrees; from one pass over the cells."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, "c").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("chance"))
    out = total.crossJoin(chance)  # one row on either side
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total").cast("double") * F.col("total"))
    return out.select(F.col("total").alias("n"), po.alias("agreement"), F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson's correlation, and Spearman's as that of mean ranks."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    for c, r in ((x, "__rx"), (y, "__ry")):  # the mean rank of equal values, by value
        ranks = positions(df, keys, c).select(*keys, c, (F.col("below") + (F.col("n") + 1) / 2).alias(r))
        df = meet(df, ranks, [*keys, c])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def best_threshold(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], target: str = "target", score: str = "probability") -> DataFrame:
    """The threshold with the largest F1; of equal ones the closest to 0.5, then the larger. One pass: a bounded list of
    thresholds becomes aggregates, not rows."""
    hit = lambda t, c: F.count_if((F.col(score) >= t) & c)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [hit(t, F.col(target) == 1).alias(f"tp{i}"), hit(t, F.col(target) == 0).alias(f"fp{i}")]
    out = df.groupBy(*keys).agg(F.count_if(F.col(target) == 1).alias("pos"), *aggs)
    options = [F.struct(ratio(2 * F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}") + F.col("pos")).alias("f1"), F.lit(-round(abs(t - 0.5), 9)).alias("near"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]
    return out.withColumn("best", F.array_max(F.array(*options))).select(*keys, F.col("best.threshold").alias("threshold"), F.col("best.f1").alias("f1"))


def block_weights(n: int, block: int, repeats: int, seed: int = 42) -> np.ndarray:
    """How often each of n dates is drawn, by replicate, in blocks of consecutive dates cut off at n.

    Fixed: the generator, its seed and the order of its draws, on which the intervals depend.
    """
    if not 0 < block < n:
        raise ValueError("blocks must be shorter than the series")
    if repeats < 100:
        raise ValueError("at least 100 replicates are needed")
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n - block + 1, size=(repeats, -(-n // block)))
    drawn = (starts[:, :, None] + np.arange(block)).reshape(repeats, -1)[:, :n]
    return np.stack([np.bincount(row, minlength=n) for row in drawn])


def drawn_blocks(spark: SparkSession, n: int, block: int, repeats: int, seed: int = 42) -> DataFrame:
    """(rep, day, times): how often a replicate draws each of n days; replicate -1 is the sample itself. At most (repeats + 1) * n rows."""
    weights = np.vstack([np.ones(n, int), block_weights(n, block, repeats, seed)])
    rep, day = np.nonzero(weights)
    return spark.createDataFrame(pd.DataFrame({"rep": (rep - 1).astype("int32"), "day": day.astype("int32"), "times": weights[rep, day].astype("int64")}))


def bootstrap_auc(df: DataFrame, entity: str, time: str, arm: str, contrasts: Sequence[tuple[str, str]], block: int = 20, repeats: int = 1000, seed: int = 42, target: str = "target", score: str = "probability", least: float = 0.9) -> DataFrame:
    """(entity, base, other, delta, low, high, valid) of each contrast and entity, and of the mean over entities ("macro").

    All entities and arms share the drawn days. Rows are counted by day and score before they meet the draws, and the areas
    of all replicates are one aggregation: no task holds a replicate, an entity or a series. Percentiles are Spark's. Less
    than `least` valid replicates give nulls.
    """
    days = df.select(time).distinct().where(F.col(time).isNotNull())  # one row for each session
    numbered = days.withColumn("day", (F.row_number().over(Window.orderBy(time)) - 1).cast("int"))
    draws = drawn_blocks(df.sparkSession, days.count(), block, repeats, seed)
    counts = df.select(F.col(entity).cast("string").alias(entity), time, F.col(arm).cast("string").alias(arm), target, score).join(numbered, time)
    counts = counts.groupBy(entity, arm, "day", target, score).agg(F.count("*").alias("__n"))
    auc = weighted_auc(counts.join(draws, "day"), [entity, arm, "rep"], F.col("__n") * F.col("times"), target, score, cut_from=counts, cut_keys=[entity, arm])
    wide = auc.groupBy(entity, "rep").pivot(arm, sorted({x for c in contrasts for x in c})).agg(F.first("auc"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("base"), F.lit(b).alias("other"), (F.col(b) - F.col(a)).alias("delta")) for a, b in contrasts))).alias("c")
    long = wide.select(F.col(entity), "rep", pairs).select(entity, "rep", "c.*")
    every = long.select(entity).distinct().count()
    mean = long.groupBy("rep", "base", "other").agg(F.when(F.count("delta") == every, F.avg("delta")).alias("delta")).withColumn(entity, F.lit("macro"))
    both = long.unionByName(mean)
    drawn = F.when(F.col("rep") >= 0, F.col("delta"))
    enough = F.count(drawn) >= least * repeats
    return both.groupBy(entity, "base", "other").agg(F.max(F.when(F.col("rep") == -1, F.col("delta"))).alias("delta"), F.when(enough, F.percentile(drawn, F.lit(0.025))).alias("low"), F.when(enough, F.percentile(drawn, F.lit(0.975))).alias("high"), F.count(drawn).alias("valid"))
