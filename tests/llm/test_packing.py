import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tideline.llm")


def test_tokens_and_packing(spark):
    from tokenizers import Tokenizer

    from tideline.llm.packing import pack_documents, tokenizer_file

    t = Tokenizer.from_file(tokenizer_file())
    odd = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "x\n\ny z", "It's we'll go 　 now", "end<|endoftext|> more<|endoftext|>x", "tab\t b\x1c c \x85d", "漢字 \U0001f600 é", "w " * 5000, "é" * 4000]
    rows = [(i, x, 1) for i, x in enumerate(odd)] + [(3, "again", 2), (None, "no id", 3)] + [(100 + i, "same text", i) for i in range(300)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, length long")
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (extra, sample):
        got = pack_documents(df, tokenizer_file()).collect()
        want = []
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
            first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids), 1024), len(ids)]
            want += [(r.doc_id or -1, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for x in by.values():
            x.sort()
            ends = np.cumsum([n for _, n in x])
            assert [o for o, _ in x] == [0, *ends[:-1]] and ends[-1] <= 1024
        tokens = sum(r.length for r in got)
        assert len(by) <= 1.02 * tokens / 1024 + 2
    assert pack_documents(extra.limit(0), tokenizer_file()).count() == 0


def best_fit_decreasing(lengths, cap):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(cap - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def swept(lengths, cap):
    """The supersteps one after the other, with a pile of gaps: how many sequences hold something."""
    docs, gaps, widest, some = sorted(n for n in lengths if n < cap), {}, 0, True
    docs.reverse()
    while docs:
        over = [n for n in docs if n > widest]
        for _ in range(max(sum(n > cap // 2 for n in over), -(-sum(over) // cap), 0 if some else 1)):
            gaps[len(gaps)] = cap
        slots = []
        for s, free in gaps.items():
            if free >= docs[-1]:
                many = max(1, free // docs[0])
                slots += [(free - (many - 1) * docs[0], s)] + [(docs[0], s)] * (many - 1)
        slots.sort(reverse=True)
        pile, rest, k = [], [], 0
        for n in docs:
            while k < len(slots) and slots[k][0] >= n:
                pile.append(slots[k][1])
                k += 1
            if pile:
                gaps[pile.pop()] -= n
            else:
                rest.append(n)
        some, docs, widest = len(rest) < len(docs), rest, max(gaps.values())
    return sum(free < cap for free in gaps.values()) + sum(n == cap for n in lengths)


@pytest.mark.parametrize("kind", ["any", "short", "one", "full"])
def test_supersteps_against_a_pile_of_gaps(spark, kind):
    from tideline.llm.packing import pack

    rng = random.Random(1)
    cap = 100
    lengths = {"any": [rng.randint(1, cap) for _ in range(700)] + [37] * 300, "short": [min(99, int(rng.expovariate(1 / 8)) + 1) for _ in range(1500)], "one": [34] * 500, "full": [cap] * 9}[kind]
    df = spark.createDataFrame([(k if k % 5 else None, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long").repartition(3)
    got = pack(df, cap).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= cap
    assert len(by) <= 1.02 * best_fit_decreasing(lengths, cap) + 1
    assert abs(len(by) - swept(lengths, cap)) <= 0.01 * len(by) + 1  # which of like gaps is taken may differ


def test_few_rows_take_few_tasks(spark):
    """However many shuffle partitions there are, supersteps over few rows run as one task, and pack as the others do."""
    from tideline.llm.packing import pack

    rng = random.Random(3)
    cap = 100
    lengths = [rng.randint(1, cap) for _ in range(500)] + [37] * 100
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long").coalesce(1)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    were = {k: spark.conf.get(k) for k in held}
    sc, found = spark.sparkContext, {}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name, more in (("as it comes", {}), ("apart", {"together_rows": 0}), ("mixed", {"together_rows": 300})):
            sc.setJobGroup(f"packing {name}", name)
            got = pack(df, cap, **more).collect()
            stages = {s for j in sc.statusTracker().getJobIdsForGroup(f"packing {name}") for s in sc.statusTracker().getJobInfo(j).stageIds}
            tasks = sum(i.numCompletedTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)))
            assert sorted(r.length for r in got) == sorted(lengths)
            by: dict = {}
            for r in got:
                by.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert all([o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= cap for x in by.values())
            found[name] = len(by), tasks
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(n for n, _ in found.values()) <= 1.01 * min(n for n, _ in found.values()) + 1
    assert found["as it comes"][1] < 200 < found["apart"][1], found
