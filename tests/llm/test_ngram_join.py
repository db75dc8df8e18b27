import random
import re

import numpy as np
import pytest

pytest.importorskip("tideline.llm")


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in by.values() for x, a in enumerate(ks) for b in ks[x + 1 :]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        inter = len(s & t)
        if 100 * inter >= 80 * (len(s) + len(t) - inter):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def family(rng, vocabulary, size, n_words, edits):
    base = [rng.choice(vocabulary) for _ in range(n_words)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        yield " ".join(words)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four five", "One two three four five", "one two three four six"]
    for size, n, edits in ((40, 60, 3), (30, 120, 8), (6, 40, 2), (25, 200, 16), (10, 12, 1), (5, 5, 1)):
        texts += family(rng, vocabulary, size, n, edits)
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))) for _ in range(40)]
    texts += [texts[12]] * 20 + ["line " * 500]
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for k in range(20):  # each links with the next few only
        texts.append(" ".join(chain[4 * k :] + [rng.choice(vocabulary) for _ in range(4 * k)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block, outside", [(2000, 4096), (7, 4096), (7, 0)])
def test_against_all_pairs(spark, monkeypatch, block, outside):
    from tideline.llm import ngram_join as module
    from tideline.llm.ngram_join import ngram_join

    monkeypatch.setattr(module, "MOST_OUTSIDE", outside)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(5)
    got = sorted(map(tuple, ngram_join(df, block=block).collect()))
    assert got == brute(rows)


def test_documents_and_odd_rows(spark):
    from tideline.llm.ngram_join import ngram_join, one_of_each

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, ngram_join(df).collect()))
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got == want
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == sorted(i for i, _, c in want if i == c)
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (9, "other words stand in this row"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, ngram_join(odd).collect())) == sorted(f"Row(doc_id={i}, n_shingles={n}, component_id={c})" for i, n, c in [(None, 2, None), (None, 0, None), (7, 2, 7), (7, 2, 7), (9, 2, 7), (9, 2, 9)])
    assert ngram_join(odd.limit(0)).count() == 0
    assert sorted(map(str, (r.doc_id for r in one_of_each(odd).collect()))) == ["7", "7", "9", "9", "None", "None"]
    assert sorted(r.doc_id for r in one_of_each(odd.where("text <> 'other words stand in this row'")).where("doc_id IS NOT NULL").collect()) == [7, 7]


def test_tree_finds_all_links():
    from tideline.llm.prefix_tree import PrefixTree, link

    rng = np.random.default_rng(3)
    for trial in range(30):
        base = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = {tuple(sorted({*rng.choice(base, rng.integers(1, 41), replace=False).tolist(), *rng.integers(0, 50, rng.integers(0, 5)).tolist()})) for _ in range(40)}
        sets = [np.array(s, np.uint64) for s in sets]
        tree = PrefixTree(sets)
        links = [{j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))} for s in sets]
        for i in range(len(sets)):
            assert set(tree.probe(i).tolist()) == links[i]
        label = link(sets)
        assert all((label[i] == label[j]) for i in range(len(sets)) for j in links[i])
