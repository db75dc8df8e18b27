"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.checkpoint import checkpointed, delete_folder, release, shared_folder  # noqa: F401

#: Rows in one Arrow batch: texts can be very long, so batches hold few rows.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows, and so the memory, of each Arrow batch sent to a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """`df` written to the shared folder in buckets of `key`, so that it meets others by that key without a shuffle of its own; and what deletes it."""
    spark = df.sparkSession
    name = f"tideline_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folder(spark, path)

    return spark.table(name), drop


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Long rows as Python values, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """(value, rows) of each run of rows with the same value of `key`: only one run is held."""
    now, rows = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 64):  # long rows become Python values a few at a time
            for r in batch.slice(k, 64).to_pylist():
                if rows and r[key] != now:
                    yield now, rows
                    rows = []
                now = r[key]
                rows.append(r)
    if rows:
        yield now, rows


def trim() -> None:
    """Give memory that a finished task has freed back to the system, where the C library can."""
    import ctypes

    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits (wraps around silently)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, new: dict) -> pa.RecordBatch:
    """The columns of `schema`: those in `new`, else those of `batch`."""
    return pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name).cast(f.type) for f in schema], schema=schema)
