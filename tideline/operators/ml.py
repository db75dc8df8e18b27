"""Fit, predict and select under purged temporal validation, on Spark ML.

Boosted trees of other libraries have no counterpart here; `GBTClassifier` stands in for all three of them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from .metrics import best_threshold, bootstrap_auc, confusion, rates, roc_auc
from .splits import expanding_folds, fold_roles


@dataclass
class Preparation:
    """Exact medians, and means and population deviations after imputation, of each feature."""

    features: list[str]
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    spreads: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame, scale: bool = True) -> DataFrame:
        out = {}
        for c in self.features:
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
            out[c] = (x - self.means[c]) / (self.spreads[c] or 1.0) if scale else x
        return df.withColumns(out)


def fit_preparation(df: DataFrame, features: Sequence[str]) -> Preparation:
    """Two aggregations: medians, then moments of the imputed features."""
    row = df.agg(*(F.median(F.col(c).cast("double")).alias(c) for c in features)).first()
    medians = {c: 0.0 if row[c] is None else float(row[c]) for c in features}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in features]
    row = df.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled))).first()
    return Preparation(list(features), medians, {c: float(row[f"m{i}"] or 0) for i, c in enumerate(features)}, {c: float(row[f"s{i}"] or 0) for i, c in enumerate(features)})


@dataclass
class Fitted:
    """A fitted model with what it needs to predict."""

    name: str
    preparation: Preparation | None
    model: object
    constant: float | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds probability of class 1 and prediction, probability >= 0.5."""
        if self.model is None:
            out = df.withColumn("probability", F.lit(self.constant))
        else:
            ready = self.preparation.apply(df.withColumn("__keep", F.struct(*df.columns)), self.name == "logistic")
            out = self.model.transform(VectorAssembler(inputCols=self.preparation.features, outputCol="__x").transform(ready))
            out = out.select("__keep.*", vector_to_array("__p")[1].alias("probability"))
        return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))

    def save(self, path: str) -> None:
        """Write the model and what it was prepared with; an existing path is refused."""
        spark = SparkSession.getActiveSession()
        prep = {} if self.preparation is None else {"features": self.preparation.features, "medians": self.preparation.medians, "means": self.preparation.means, "spreads": self.preparation.spreads}
        about = json.dumps({"name": self.name, "constant": self.constant, "preparation": prep})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/about")
        if self.model is not None:
            self.model.write().save(f"{path}/model")

    @staticmethod
    def load(path: str) -> Fitted:
        about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()[0])
        kinds = {"logistic": LogisticRegressionModel, "forest": RandomForestClassificationModel, "boosting": GBTClassificationModel}
        prep = Preparation(**about["preparation"]) if about["preparation"] else None
        model = kinds[about["name"]].load(f"{path}/model") if about["name"] in kinds else None
        return Fitted(about["name"], prep, model, about["constant"])

    def importance(self) -> dict[str, float]:
        """Impurity importance, or the size of coefficients."""
        if self.model is None:
            return {}
        v = self.model.coefficients.toArray() if self.name == "logistic" else self.model.featureImportances.toArray()
        return dict(zip(self.preparation.features, map(float, np.abs(v))))


def fit(df: DataFrame, name: str, features: Sequence[str], target: str = "target", seed: int = 42, **params) -> Fitted:
    """Fit "dummy", "logistic" (c, balanced), "forest" (trees, depth, leaf) or "boosting" (rounds, depth, rate)."""
    if name == "dummy":
        row = df.agg(F.count_if(F.col(target) == 1).alias("a"), F.count_if(F.col(target) == 0).alias("b")).first()
        return Fitted(name, None, None, 1.0 if row["a"] > row["b"] else 0.0)
    prep = fit_preparation(df, features)
    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(prep.apply(df, name == "logistic")).select("__x", F.col(target).cast("double").alias("__y"))
    common = {"featuresCol": "__x", "labelCol": "__y", "probabilityCol": "__p", "rawPredictionCol": "__r", "predictionCol": "__c"}
    if name == "logistic":
        row = ready.agg(F.count("*").alias("n"), F.sum("__y").alias("pos")).first()
        weight = F.lit(1.0)
        if params.get("balanced"):
            weight = F.when(F.col("__y") == 1, F.lit(row["n"] / (2 * row["pos"]))).otherwise(F.lit(row["n"] / (2 * (row["n"] - row["pos"]))))
        est = LogisticRegression(**common, regParam=1 / (params.get("c", 1.0) * row["n"]), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10, weightCol="__w")
        ready = ready.withColumn("__w", weight)
    elif name == "forest":
        est = RandomForestClassifier(**common, numTrees=params.get("trees", 300), maxDepth=params.get("depth", 8), minInstancesPerNode=params.get("leaf", 10), featureSubsetStrategy="sqrt", seed=seed)
    elif name == "boosting":
        est = GBTClassifier(featuresCol="__x", labelCol="__y", predictionCol="__c", maxIter=params.get("rounds", 50), maxDepth=params.get("depth", 3), stepSize=params.get("rate", 0.05), seed=seed)
        est.setProbabilityCol("__p").setRawPredictionCol("__r")
    else:
        raise ValueError(f"unknown model {name}")
    ready = ready.cache()
    try:
        return Fitted(name, prep, est.fit(ready))
    finally:
        ready.unpersist()


def choose(train: DataFrame, name: str, features: Sequence[str], grid: Sequence[dict], folds: int = 3, entity: str | None = None, time: str = "date", target: str = "target", threads: int = 4) -> tuple[dict, list[dict]]:
    """The parameters with the best mean AUC over purged expanding folds, and the trace of all; ties go to the first.

    With `entity`, AUC is the mean over entities. Fits are independent and run side by side.
    """
    roles = fold_roles(train, expanding_folds(train, folds, time), time).cache()
    numbers = [r[0] for r in roles.select("fold").distinct().orderBy("fold").collect()]

    def one(job: tuple[int, int]) -> dict:
        at, k = job
        part = roles.where(F.col("fold") == k)
        model = fit(part.where("role = 'train'"), name, features, target, **grid[at])
        auc = roc_auc(model.predict(part.where("role = 'valid'")), [entity] if entity else [], target).agg(F.avg("auc")).first()[0]
        return {"at": at, "fold": k, "auc": auc}

    with ThreadPoolExecutor(threads) as pool:
        trace = list(pool.map(one, [(a, k) for a in range(len(grid)) for k in numbers]))
    roles.unpersist()
    mean = [np.mean([x["auc"] for x in trace if x["at"] == a and x["auc"] is not None] or [-math.inf]) for a in range(len(grid))]
    return grid[int(np.argmax(mean))], [x | {"params": grid[x["at"]]} for x in trace]


def nested(df: DataFrame, outer: DataFrame, name: str, variants: dict[str, Sequence[str]], grid: Sequence[dict], keys: Sequence[str], inner: int = 3, entity: str | None = None, time: str = "date", target: str = "target") -> DataFrame:
    """Predictions (keys, target, variant, model_name, outer_fold, probability, prediction) on each outer fold.

    Parameters are chosen on the fold's own purged training rows only.
    """
    roles = checkpointed(fold_roles(df, outer, time))  # read once for each fold, and by the predictions later
    out: DataFrame | None = None
    for k in [r[0] for r in outer.select("fold").orderBy("fold").collect()]:
        part = roles.where(F.col("fold") == k)
        train, valid = part.where("role = 'train'").drop("fold", "role"), part.where("role = 'valid'").drop("fold", "role")
        for variant, features in variants.items():
            params, _ = choose(train, name, features, grid, inner, entity, time, target)
            found = fit(train, name, features, target, **params).predict(valid)
            found = found.select(*keys, target, F.lit(variant).alias("variant"), F.lit(name).alias("model_name"), F.lit(k).alias("outer_fold"), "probability", "prediction")
            out = found if out is None else out.unionByName(found)
    return out


def staged_contrasts(df: DataFrame, outer: DataFrame, name: str, variants: dict[str, Sequence[str]], grid: Sequence[dict], contrasts: Sequence[tuple[str, str]], keys: Sequence[str], entity: str, time: str = "date", target: str = "target", inner: int = 3, block: int = 20, repeats: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An experiment: (predictions of all variants on the same folds, metrics by variant, entity and fold, intervals of each contrast).

    All variants see the same rows; each is compared with the one before it in its stage under shared draws of sessions.
    """
    found = checkpointed(nested(df, outer, name, variants, grid, keys, inner, entity, time, target))
    scores = rates(found.groupBy("variant", entity, "outer_fold").agg(*confusion(target), F.count("*").alias("n")))
    auc = roc_auc(found, ["variant", entity, "outer_fold"], target)
    intervals = bootstrap_auc(found, entity, time, "variant", contrasts, block, repeats, target=target)
    return found, scores.join(auc, ["variant", entity, "outer_fold"]), intervals


def for_each_entity(df: DataFrame, entity: str, entities: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Independent models: `run` on each entity's rows, results together."""
    frames = [run(df.where(F.col(entity) == e)) for e in entities]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tuned_threshold(valid: DataFrame, target: str = "target") -> float:
    """The decision threshold among 0.400, 0.425, ..., 0.600 with the best F1 on predictions."""
    return best_threshold(valid, [], [round(0.4 + 0.025 * i, 3) for i in range(9)], target).first()["threshold"]


def sampled_grid(space: dict[str, Sequence], size: int, seed: int = 42) -> list[dict]:
    """Combinations drawn without replacement, in a fixed order; all of them if there are no more than `size`."""
    names = list(space)
    total = math.prod(len(v) for v in space.values())
    picks = range(total) if total <= size else np.sort(np.random.default_rng(seed).choice(total, size, replace=False))
    out = []
    for p in map(int, picks):
        row = {}
        for n in reversed(names):
            p, i = divmod(p, len(space[n]))
            row[n] = space[n][i]
        out.append({n: row[n] for n in names})
    return out
