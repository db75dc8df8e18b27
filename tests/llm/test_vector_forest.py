import math

import numpy as np
import pytest

pytest.importorskip("tideline.llm")


def brute(rows, k=20, every=20):
    ok = [(i, [float(c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            near = sorted((-math.fsum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_recall_and_scores(spark):
    from tideline.llm.vector_forest import nearest

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got: dict = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        exact = dict(want[q])
        hits += sum(i in exact for _, i, _ in rows)
        assert all(exact[i] == s for _, i, s in rows if i in exact)
    assert hits / (20 * len(want)) >= 0.9


def test_odd_vectors(spark):
    from tideline.llm.vector_forest import nearest

    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (40, [-0.0, 3.0])]
    rows += [(100 + i, [5.0, 5.0]) for i in range(60)] + [(100, [5.0, 5.0])] + [(200 + i, rng.standard_normal(2).tolist()) for i in range(30)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, ids long").repartition(3)
    want = brute(list({str(r): r for r in rows}.values()))
    got: dict = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()} == want
    assert nearest(df.limit(0)).count() == 0
    few = nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 2.0)]


def test_recall_over_several_shards_and_rows_scored(spark):
    from tideline.llm.vector_forest import Forest, ForestParams, nearest

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    got: dict = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), params=ForestParams(shard=len(rows) // 5)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) / (20 * len(want)) >= 0.9
    rng = np.random.default_rng(3)  # clustered vectors: the ascent ends early, and only what it found is scored
    centres = rng.standard_normal((40, 64))
    x = np.repeat(centres, 100, axis=0) + 0.1 * rng.standard_normal((4000, 64))
    forest = Forest(x, ForestParams())
    near = forest.nearest(x[::100], 200, 20)
    assert forest.scored < 0.25 * 40 * len(x)
    hits = [len(set(f.tolist()) & set(np.argsort(-(x @ q))[:20].tolist())) for f, q in zip(near, x[::100])]
    assert sum(hits) / (20 * len(hits)) >= 0.9


def test_large_and_small_components(spark):
    from tideline.llm.vector_forest import nearest

    rng = np.random.default_rng(5)
    rows = [(i, (v * s).tolist()) for s, base in ((1e200, 0), (1e-200, 1000), (1.0, 2000)) for i, v in enumerate(rng.standard_normal((40, 3)), base)]
    rows += [(3000, [1.7e308, 1.7e308, -1.7e308]), (3001, [1.7e308, -1.7e308, 1.0]), (3002, [5e-324, 0.0, 0.0])]
    got: dict = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for x in got.values():
        x.sort()
        assert [r for r, *_ in x] == list(range(1, 21))
        assert [(-s, i) for _, i, s in x] == sorted((-s, i) for _, i, s in x)
    exact = dict(rows)
    assert all(s == math.fsum(a * b for a, b in zip(exact[2000], exact[i])) for _, i, s in got[2000] if math.isfinite(s))
