"""Batch scoring of texts with a cache by content, and the checks on its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import ContractError, enforce, expect_probabilities, expect_unique

#: An injected model: texts in, one (positive, negative, neutral) for each out.
Predict = Callable[[list[str]], list[tuple[float, float, float]]]
LABELS = ("positive", "negative", "neutral")


def with_text_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("text_sha256", F.sha2(F.coalesce(text, F.lit("")), 256))


def score_texts(texts: DataFrame, load: Callable[[], Predict], batch: int = 16) -> DataFrame:
    """(text_sha256, positive, negative, neutral, score, label) of distinct (text_sha256, text); a model is loaded once a task.

    Batches hold texts of like length. A lost or extra result raises.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for f in frames:
            f = f.assign(n=f["text"].str.len()).sort_values(["n", "text_sha256"])
            rows: list[tuple] = []
            for i in range(0, len(f), batch):
                part = f["text"].iloc[i : i + batch].tolist()
                got = predict(part)
                if len(got) != len(part):
                    raise RuntimeError("the model lost or added rows")
                rows += got
            out = pd.DataFrame(rows, columns=list(LABELS), index=f.index)
            out.insert(0, "text_sha256", f["text_sha256"])
            yield out

    scored = texts.select("text_sha256", "text").mapInPandas(run, "text_sha256 string, positive double, negative double, neutral double")
    top = F.greatest(*LABELS)
    return scored.withColumns({"score": F.col("positive") - F.col("negative"), "label": F.coalesce(*(F.when(F.col(c) == top, F.lit(c)) for c in LABELS))})


def cached_scores(df: DataFrame, path: str, version: str, load: Callable[[], Predict], text: str = "text", batch: int = 16) -> DataFrame:
    """`df` with the score of its text; only texts that the table at `path` lacks are scored, each once, and appended.

    A table that another version wrote, or that repeats a key, is refused.
    """
    spark = df.sparkSession
    hashed = with_text_hash(df, text)
    unique = hashed.groupBy("text_sha256").agg(F.first(F.coalesce(text, F.lit(""))).alias("text"))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        have = spark.read.parquet(path)
        if have.where(F.col("version") != version).limit(1).count():
            raise ContractError("the cache was written by another version")
        enforce(expect_unique(have, ["text_sha256"]))
        unique = unique.join(have.select("text_sha256"), "text_sha256", "left_anti")
    score_texts(unique, load, batch).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    stored = spark.read.parquet(path).drop("version")
    return hashed.join(stored, "text_sha256", "left")


def replace_sentiment(news: DataFrame, scores: DataFrame, keep: Sequence[str]) -> DataFrame:
    """News with their scores replaced by those of a checked table: every text scored once, vectors in order."""
    enforce(expect_unique(scores, ["text_sha256"]))
    enforce(expect_probabilities(scores, list(LABELS), "score", "label", "positive", "negative"))
    out = news.join(scores.select("text_sha256", F.col("score").alias("ticker_sentiment_score"), F.col("label").alias("sentiment_label")), "text_sha256", "left")
    if out.where("ticker_sentiment_score IS NULL").limit(1).count():
        raise ContractError("some texts have no score")
    return out.select(*keep, "ticker_sentiment_score", "sentiment_label")


def truncation(df: DataFrame, text: str, most: int, count: Callable[[str], int]) -> DataFrame:
    """full, used and removed tokens of each text and whether it was cut, by an injected token counter."""

    @F.pandas_udf("long")
    def n(x: pd.Series) -> pd.Series:
        return x.fillna("").map(count)

    out = df.withColumn("full_tokens", n(text))
    return out.withColumns({"used_tokens": F.least(F.col("full_tokens"), F.lit(most)), "removed_tokens": F.greatest(F.col("full_tokens") - most, F.lit(0)), "truncated": F.col("full_tokens") > most})


def agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Share of rows on which two labels are equal, by group."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))
