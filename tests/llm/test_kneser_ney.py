import math
from collections import Counter

import pytest

pytest.importorskip("tideline.llm")


def brute(trusted, texts, order=5):
    """log perplexities under the model, from its textbook form."""
    marked = lambda t: "\r" + " ".join(t.split()) + "\n"
    each = lambda t: [s[max(0, i - order) : i] for s in [marked(t)] for i in range(2, len(s) + 1)] if t and t.split() else []
    c = {k: Counter() for k in range(1, order + 1)}
    for t in trusted:
        for g in each(t):
            c[len(g)][g] += 1
    for k in range(order - 1, 0, -1):
        for g in list(c[k + 1]):
            c[k][g[1:]] += 1
    d, hist = {}, {}
    for k in c:
        n = [sum(x == i for x in c[k].values()) for i in range(5)]
        d[k] = [0, 0.5, 1.0, 1.5]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            d[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) for i in (1, 2, 3)]
        for g, x in c[k].items():
            h = hist.setdefault(g[:-1], [0, 0.0])
            h[0] += x
            h[1] += min(d[k][min(x, 3)], x)

    def p(g):
        if not g:
            return 1 / (len(c[1]) + 1)
        total, left = hist.get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        x = c[len(g)][g]
        return (x - min(d[len(g)][min(x, 3)], x)) / total + left / total * p(g[1:])

    found = [each(t) for t in texts]
    return [-sum(math.log(p(g)) for g in gs) / len(gs) if gs else None for gs in found]


def test_perplexities(spark):
    from pyspark.sql import functions as F

    from tideline.llm.kneser_ney import classify, keep_documents

    docs = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    docs += [(9000, None, None), (9001, "en", " \n "), (9002, "xx", "zzz é漢\t\U0001f600 a\0b"), (8200, "en", "far range " * 50), (9003, "en", "w" * 3000)]
    labels = [(i, 1 if i % 3 else 0, int(i % 7 == 2)) for i, *_ in docs if i < 9000] + [(1, 1, None), (None, 1, 0), (5, None, 0)]
    good = {i for i, q, t in labels if q == 1 and not t}
    held = {r.i for r in spark.createDataFrame([(i,) for i in good if i is not None], "i long").where(F.pmod(F.xxhash64("i"), F.lit(10)) == 0).collect()}
    df = spark.createDataFrame([(*d, "clash") for d in docs] + [(None, "en", "no id here", "x")], "doc_id long, lang string, text string, kept string").repartition(3)
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(df, flags).collect()}
    want = brute([t for i, _, t in docs if i in good - held], [(t or "").replace("\0", "\ufffd") for *_, t in docs] + ["no id here"])
    for (i, _, t), x in zip([*docs, (None, "en", "no id here")], want):
        assert got[i].n_words == len((t or "").split())
        assert (got[i].log_ppl is None) if x is None else math.isclose(got[i].log_ppl, x, rel_tol=1e-6)
    by = {}
    for i, g, _ in docs:
        if i in held and got[i].log_ppl is not None:
            by.setdefault(g, []).append(got[i].log_ppl)
    def cut(x):  # fewer than 200: also a normal distribution's quantile
        bins = [math.floor(v / 0.001) for v in x]
        return 0.001 * max(max(bins) + 1, sum(bins) / len(bins) + 1 + 2.5758293 * math.sqrt(max(0, sum(b * b for b in bins) / len(bins) - (sum(bins) / len(bins)) ** 2)))

    whole = cut([x for v in by.values() for x in v])
    for g in {r.lang for r in got.values()}:
        own = max(cut(by[g]), whole) if g in by else whole
        assert all(math.isclose(r.threshold, own, rel_tol=1e-6) and r.kept == (r.log_ppl is not None and r.log_ppl <= r.threshold) for r in got.values() if r.lang == g)
    assert not got[9000].kept and not got[9001].kept and got[9002].threshold is not None
    assert {r.doc_id for r in keep_documents(df, flags).collect()} == {i for i, r in got.items() if r.kept}


def test_many_units_give_the_same(spark, monkeypatch):
    from tideline.llm import kneser_ney

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    docs = docs.unionByName(docs.limit(3).selectExpr("doc_id + 900000 AS doc_id", "concat_ws(' ', transform(sequence(0, 9000), x -> char(256 + x % 200))) AS text", "lang", "source", "n_chars")).coalesce(2)
    labels = docs.selectExpr("doc_id", "1 AS quality")
    key = lambda rows: sorted((r.doc_id, r.n_words, r.log_ppl, r.kept) for r in rows)
    want = key(kneser_ney.classify(docs, labels).collect())
    monkeypatch.setattr(kneser_ney, "UNIT_CHARS", 30_000)
    monkeypatch.setattr(kneser_ney, "CHUNK_CHARS", 7_000)
    got = key(kneser_ney.classify(docs, labels).collect())
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(got, want) if a[2] is not None)


def test_keys_of_large_alphabets():
    import numpy as np

    from tideline.llm.kneser_ney import Keys, as_texts, from_texts, marked

    for text in ("some plain words here", " ".join(chr(0x4E00 + k) for k in range(7000)), "a\U0010ffff\U0001f600"):
        t, n = marked(text, 5)
        k = Keys(t, 5)
        assert k.small == (len(set(t)) < 6208) and n == len(text.split())
        s = "\r" + " ".join(text.split()) + "\n"
        want = [s[max(0, i - 5) : i] for i in range(2, len(s) + 1)]
        keys = np.concatenate([key[one] for *_, key, one in k.chunks()])
        grams = k.grams(keys)
        assert as_texts(grams) == want
        assert (from_texts(want, 5) == grams).all()
        assert (k.keys([grams[:, j] for j in range(5)]) == keys).all()


def test_nothing_trusted_and_nothing_at_all(spark):
    from tideline.llm.kneser_ney import classify, keep_documents

    df = spark.createDataFrame([(1, "en", "some words"), (2, "en", None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted((r.doc_id, r.kept) for r in classify(df, labels).collect()) == [(1, True), (2, False)]
    assert classify(df.limit(0), labels).count() == 0
    assert [r.doc_id for r in keep_documents(df, labels).collect()] == [1]


def test_n_grams_cross_words(spark):
    from tideline.llm.kneser_ney import ModelParams, classify

    docs = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    long = next(t for i, _, t in docs if i % 3 and len((t or "").split()) > 50)
    docs += [(9000, None, None), (9001, "en", " \n "), (9002, "xx", "a é 漢\t\U0001f600 b"), (9003, "en", long), (9004, "en", " ".join(sorted(long.split())))]
    labels = [(i, 1 if i % 3 else 0, 0) for i, *_ in docs if i < 9000]
    good = {i for i, q, _ in labels if q}
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    got = {r.doc_id: r for r in classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ModelParams(held_out=10**9)).collect()}
    for (i, _, t), x in zip(docs, brute([t for i, _, t in docs if i in good], [t for *_, t in docs])):
        assert got[i].n_words == len((t or "").split())
        assert (got[i].log_ppl is None) if x is None else math.isclose(got[i].log_ppl, x, rel_tol=1e-6)
    assert got[9004].log_ppl > got[9003].log_ppl + 0.1  # the same words in another order
