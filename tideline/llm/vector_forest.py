"""Nearest neighbours by a hash-prefix forest: per tree a sorted array of long hash strings; a query descends to its longest
matching prefixes, then all trees ascend together, one bit at a time, until enough candidates are found.

Rows are dealt to shards by their hash; each shard holds a forest over its rows, the queries stream through every shard in
blocks, and the shards' best are merged. Only a query's candidates are scored. Equal vectors are one class, so a vector that
many rows share costs what one row costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpointed, partitions, small_batches, table


@dataclass(frozen=True)
class ForestParams:
    """trees, bits: hash strings. sample, sample_queries: bounds of the sample on which `share` is fitted, the part of a
    shard's rows at which the ascent ends, so that this recall is reached there. shard: classes in a shard, about."""

    trees: int = 48
    bits: int = 32
    seed: int = 17
    recall: float = 0.95
    sample: int = 8_192
    sample_queries: int = 200
    shard: int = 16_384
    spare: int = 12
    shares: tuple[float, ...] = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two near their largest component, so that no product overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def inner(a: np.ndarray, b: np.ndarray) -> float:
    """The exactly rounded sum of the rounded products; infinite only where it is too large for a double."""
    with np.errstate(over="ignore"):
        products = a * b
    if np.isfinite(products).all():
        try:
            return math.fsum(products.tolist())
        except OverflowError:
            pass
    i, j = (int(np.frexp(np.abs(x).max())[1]) for x in (a, b))
    s = math.fsum((np.ldexp(a, -i) * np.ldexp(b, -j)).tolist())
    try:
        return math.ldexp(s, i + j)
    except OverflowError:
        return math.copysign(math.inf, s)


class Forest:
    """Sorted arrays of the rows' hash strings. Inner products become angles by one more coordinate (0 for queries).

    Rows are held divided by one power of two, which changes no order. `scored` counts the rows that were compared.
    """

    def __init__(self, x: np.ndarray, p: ForestParams) -> None:
        self.p, self.scored = p, 0
        self.x = x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
        rng = np.random.default_rng((p.seed, x.shape[1]))
        self.planes = rng.standard_normal((x.shape[1] + 1, p.trees * p.bits))
        norms = np.sqrt((x * x).sum(1))
        top = norms.max()
        keys = self._keys(np.column_stack([x / top, np.sqrt(np.maximum(0, 1 - (norms / top) ** 2))]))
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def _keys(self, x: np.ndarray) -> np.ndarray:
        bits = (x @ self.planes > 0).reshape(len(x), self.p.trees, self.p.bits)
        return bits @ (1 << np.arange(self.p.bits - 1, -1, -1, dtype=np.int64))

    def candidates(self, q: np.ndarray, want: int) -> Iterator[np.ndarray]:
        """For each query a mask of the rows that share its prefix in some tree, at the longest length where these are `want` or more."""
        p, n = self.p, len(self.x)
        keys = self._keys(np.column_stack([scaled(q), np.zeros(len(q))]))
        lo = np.empty((p.bits + 1, p.trees, len(q)), np.int64)
        hi = np.empty_like(lo)
        for t in range(p.trees):
            for free in range(p.bits + 1):  # how many last bits may differ
                base = keys[:, t] >> free << free
                lo[free, t] = np.searchsorted(self.sorted[:, t], base)
                hi[free, t] = np.searchsorted(self.sorted[:, t], base + (1 << free))
        reach = (hi - lo).sum(1)
        want = min(want, n)
        for i in range(len(q)):
            mask = np.zeros(n, bool)
            free = int(np.searchsorted(reach[:, i], want))  # below, even all trees together have too few
            while free <= p.bits:
                for t in range(p.trees):
                    mask[self.order[lo[free, t, i] : hi[free, t, i], t]] = True
                if np.count_nonzero(mask) >= want:
                    break
                free += 1
            yield mask

    def nearest(self, q: np.ndarray, want: int, k: int) -> list[np.ndarray]:
        """Rows of the k largest inner products among each query's candidates; more where the last ones tie."""
        q = scaled(q)
        out = []
        for i, mask in enumerate(self.candidates(q, want)):
            rows = np.flatnonzero(mask)
            self.scored += len(rows)
            if len(rows) > k:
                s = self.x[rows] @ q[i]
                least = np.partition(s, len(s) - k)[len(s) - k]
                rows = rows[s >= least - 1e-12 * max(1.0, abs(least))]
            out.append(rows)
        return out


def fit_share(x: np.ndarray, k: int, p: ForestParams) -> float:
    """The smallest share of `p.shares` that reaches `p.recall` on the sample, its first rows taken as queries."""
    if len(x) < 4 * k:
        return 1.0
    nq = min(p.sample_queries, len(x) // 2)
    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
    score = scaled(x[:nq]) @ x.T
    score[np.arange(nq), np.arange(nq)] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    forest = Forest(x, p)
    low, high = 0, len(p.shares) - 1
    while low < high:  # recall grows with the share
        mid = (low + high) // 2
        hit = [mask[best[i]].mean() for i, mask in enumerate(forest.candidates(x[:nq], int(p.shares[mid] * len(x))))]
        low, high = (low, mid) if np.mean(hit) >= p.recall else (mid + 1, high)
    return p.shares[low]


def vector_classes(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(dim, vec, ids, queries) of the distinct valid vectors: vec packs doubles; ids holds the k + 1 smallest ids, which
    are all that a result of k can show."""
    small_batches(vectors.sparkSession, 4_000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, np.float64) + 0.0  # no negative zeros
                if np.isfinite(x).all() and x.any():
                    rows.append((i, x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "vec"])

    flat = vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(read, "id long, vec binary")
    return flat.withColumn("class", F.md5("vec"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, params: ForestParams = ForestParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, its k nearest found by inner product.

    Vectors null, empty, zero or with null or non-finite components, and rows with a null id, take no part. Only vectors
    of one length are compared. Rows that repeat an id with the same vector count once; an id with several vectors stands
    for each of them. Scores are exactly rounded sums of products, and infinite where no double holds them; ties go to the smaller id. Fewer than k
    candidates are all returned. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    p = params
    flat = checkpointed(vector_classes(vectors, k, id_col, vec_col).distinct())
    # the k + 1 smallest ids of each class: numbered in salted groups first, so a class with a third of all rows is split
    salt = F.pmod(F.xxhash64("id"), F.lit(max(8, partitions(spark))))
    some = flat.select("class", "id", "vec", F.row_number().over(W.Window.partitionBy("class", salt).orderBy("id")).alias("n")).where(F.col("n") <= k + 1)
    least = some.groupBy("class").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    classes = checkpointed(least.withColumn("dim", F.length("vec")))
    asks = flat.where(F.col("id") % every == 0).select("class", F.col("id").alias("query_id"))
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # as many rows as vectors have lengths
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = {}
    for dim, many in sizes.items():
        rows = classes.where(F.col("dim") == dim).orderBy("class").limit(p.sample).select("vec").collect()
        share[dim] = fit_share(np.array([np.frombuffer(r["vec"]) for r in rows]), k, p)
    shards = {dim: -(-many // p.shard) for dim, many in sizes.items()}
    count = F.element_at(F.create_map(*(F.lit(x) for kv in shards.items() for x in kv)), F.col("dim"))
    rows = classes.withColumn("shard", F.pmod(F.xxhash64("class"), count)).withColumn("asks", F.lit(False))
    queries = classes.join(asks.select("class").distinct(), "class", "left_semi").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))).withColumn("asks", F.lit(True))
    columns = ["dim", "shard", "asks", "class", "vec", "ids"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None
        for batch in batches:
            out = []
            todo: list[dict] = []

            def answer() -> None:
                if not todo or not held:
                    todo.clear()
                    return
                q = np.array([np.frombuffer(r["vec"]) for r in todo])
                for r, near in zip(todo, forest.nearest(q, math.ceil(share[now[0]] * len(held)), k + p.spare)):
                    v = np.frombuffer(r["vec"])
                    exact = [(inner(v, np.frombuffer(held[j]["vec"])), held[j]["ids"]) for j in near]
                    best = sorted(((-s, i) for s, ids in exact for i in ids))[: k + 1]
                    out.append((r["class"], [i for _, i in best], [-s for s, _ in best]))
                todo.clear()

            for r in batch.to_pylist():
                if (r["dim"], r["shard"]) != now:
                    answer()
                    now, held, forest = (r["dim"], r["shard"]), [], None
                if not r["asks"]:
                    held.append(r)
                else:
                    if forest is None and held:
                        forest = Forest(np.array([np.frombuffer(x["vec"]) for x in held]), p)
                    todo.append(r)
                    if len(todo) >= 512:
                        answer()
            answer()
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["class", "ids", "scores"])

    dealt = rows.select(columns).unionByName(queries.select(columns)).repartition(partitions(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "asks", "class")
    found = dealt.mapInArrow(search, "class string, ids array<long>, scores array<double>")
    pairs = found.select("class", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("class", F.col("x.ids").alias("id"), F.col("x.scores").alias("score")).distinct()
    top = pairs.withColumn("n", F.row_number().over(W.Window.partitionBy("class").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = top.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("list"))
    each = asks.join(lists, "class").select("query_id", F.filter("list", lambda x: x["id"] != F.col("query_id")).alias("list"))
    return each.select("query_id", F.posexplode(F.slice("list", 1, k))).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.score").alias("score"))


def op2_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_vector_forest": op2_vector_forest}
ORACLES: dict[str, str] = {}
