"""Structured Streaming forms of the keyed operators: causal dedup, daily aggregation, resumable scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scoring import Predict, score_texts, with_text_hash


def causal_dedup_stream(df: DataFrame, keys: list[str], time: str, ident: str, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """(keys, ident, time, kept, representative): the batch rule on a stream; what comes later never changes what was emitted.

    The state of a key is its anchor; it is dropped once the watermark is a window past it.
    """
    window = timedelta(hours=hours)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ident, time]) + f", kept boolean, representative {kinds[ident]}"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, rep = state.get if state.exists else (None, None)
        anchor = None if anchor is None else datetime.fromisoformat(anchor)
        rows = pd.concat(list(frames)).sort_values([time, ident])
        out = []
        for i, t in zip(rows[ident].tolist(), rows[time].tolist()):
            t = t.to_pydatetime()
            kept = anchor is None or t > anchor + window
            if kept:
                anchor, rep = t, i
            out.append((*key, i, t, kept, rep))
        state.update((anchor.isoformat(), rep))
        state.setTimeoutTimestamp(max(int(anchor.timestamp() * 1000) + int(window.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, ident, time, "kept", "representative"])

    marked = df.select(*keys, ident, time).withWatermark(time, delay)
    return marked.groupBy(*keys).applyInPandasWithState(run, schema, f"anchor string, rep {kinds[ident]}", "append", GroupStateTimeout.EventTimeTimeout)


def daily_sentiment_stream(df: DataFrame, entity: str, time: str, score: str, delay: str = "2 hours") -> DataFrame:
    """Tumbling days by entity, emitted once the watermark has passed them."""
    days = df.withWatermark(time, delay).groupBy(F.window(time, "1 day"), entity)
    out = days.agg(F.avg(score).alias("sentiment_mean"), F.min(score).alias("sentiment_min"), F.max(score).alias("sentiment_max"), F.count("*").alias("news_count"))
    return out.select(F.to_date("window.start").alias("date"), entity, "sentiment_mean", "sentiment_min", "sentiment_max", "news_count")


def resumable_scoring(df: DataFrame, path: str, checkpoint: str, version: str, load: Callable[[], Predict], text: str = "text"):
    """Write the scores of texts not seen before, batch by batch; a restarted stream goes on where it stopped.

    A batch that is run again finds its keys in the table already, so each text is stored once.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        unique = with_text_hash(batch, text).groupBy("text_sha256").agg(F.first(F.coalesce(text, F.lit(""))).alias("text"))
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            unique = unique.join(spark.read.parquet(path).select("text_sha256"), "text_sha256", "left_anti")
        score_texts(unique, load).withColumn("version", F.lit(version)).write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
