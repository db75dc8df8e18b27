"""Keep-first and causal deduplication, duplicate components, deterministic sampling, top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.checkpoint import checkpointed
from .graph import connected_components


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by a total order; null keys are equal."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def causal_dedup(df: DataFrame, keys: Sequence[str], time: str, ident: str, hours: int = 24) -> DataFrame:
    """(ident, kept, representative) of each row: within a key, a row no more than `hours` after the last kept one goes.

    Rows that go do not move the anchor, so this is no comparison with the row before. Rows between which lies more than
    the window can't depend on each other; they split each key into sessions. Sessions are sorted by the shuffle and pass
    through Arrow in order, which holds only the last kept row: the time is linear, the memory constant. A row without a
    time is kept and ends a session.
    """
    gap = F.expr(f"INTERVAL {hours} HOURS")
    w = Window.partitionBy(*keys).orderBy(time, ident)
    fresh = F.coalesce(F.col(time) > F.lag(time).over(w) + gap, F.lit(True))
    sessions = df.select(*keys, time, ident).withColumn("__fresh", fresh).withColumn("__s", F.count_if("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sessions = sessions.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    dealt = sessions.repartition(*(F.col(k) for k in keys), F.col("__s")).sortWithinPartitions(*(F.col(k) for k in keys), "__s", time, ident)
    span = hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = head = None
        for batch in batches:
            kept, heads = [], []
            for i, at, fresh in zip(*(c.to_pylist() for c in batch.columns)):
                keep = fresh or (at is not None and at > anchor + span)
                if keep:
                    anchor, head = at, i
                kept.append(keep)
                heads.append(head)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.bool_()), pa.array(heads, batch.column(0).type)], [ident, "kept", "representative"])

    kind = df.schema[ident].dataType
    out = T.StructType([T.StructField(ident, kind), T.StructField("kept", T.BooleanType()), T.StructField("representative", kind)])
    return dealt.select(ident, "__at", "__fresh").mapInArrow(run, out)


def duplicate_components(df: DataFrame, ident: str, keys: dict[str, Column]) -> DataFrame:
    """(ident, component): rows that share any key, directly or through others; component is the smallest ident.

    Each key ties its rows to the first of them, so a key that many rows share gives one edge for each row.
    """
    long = df.select(ident, F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), c.cast("string").alias("key")) for n, c in keys.items()))).alias("k")).select(ident, "k.*").where("key IS NOT NULL AND key <> ''")
    heads = long.groupBy("kind", "key").agg(F.min(ident).alias("head"))
    edges = long.join(heads, ["kind", "key"]).select(F.col("head").alias("src"), F.col(ident).alias("dst"))
    found = connected_components(edges).withColumnRenamed("node", ident)
    return df.select(ident).distinct().join(found, ident, "left").withColumn("component", F.coalesce("component", ident))


def hash_priority(ident: str | Column, seed: int = 50) -> Column:
    """A draw that depends on nothing but the row's identity and the seed."""
    i = F.col(ident) if isinstance(ident, str) else ident
    return F.sha2(F.concat(F.lit(f"{seed}:"), i.cast("string")), 256)


def hash_sample(df: DataFrame, ident: str, group: str, cell: str, cells: Sequence[str], size: int, seed: int = 50) -> DataFrame:
    """`size` rows of each cell, one of each group at most, by hash priority; groups that an earlier cell took are out.

    Cells are taken in their order, one bounded selection each. Raises if a cell has too few.
    """
    pool = df.withColumn("__p", hash_priority(ident, seed))
    taken: DataFrame | None = None
    for c in cells:
        own = keep_first(pool.where(F.col(cell) == c), [group], ["__p", ident])
        if taken is not None:
            own = own.join(taken.select(group).distinct(), group, "left_anti")
        chosen = checkpointed(own.orderBy("__p", ident).limit(size))
        if chosen.count() < size:
            raise ValueError(f"{c}: fewer than {size} groups are left")
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken.drop("__p")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; partial ranking prunes before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def fraction_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int = 4) -> DataFrame:
    """The first floor(n / parts) rows of each group, one at least."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"__n": F.row_number().over(w.orderBy(*order)), "__all": F.count("*").over(w)}).where(F.col("__n") <= F.greatest(F.lit(1), F.floor(F.col("__all") / parts))).drop("__n", "__all")
