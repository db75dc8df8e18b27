import random
import re

import pytest

pytest.importorskip("tideline.llm")


def brute(rows, min_chars=50):
    """doc_id -> text: for every two places with the same lines, the whole run that they share goes from the later one."""
    docs = []
    for i, t in sorted(rows):
        lines = t.split("\n")
        docs.append((i, lines, [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]))
    places = [(d, p) for d, (_, _, at) in enumerate(docs) for p in range(len(at))]
    line = {(d, p): docs[d][1][docs[d][2][p]] for d, p in places}
    by = {}
    for x in places:
        by.setdefault(line[x], []).append(x)
    gone = {i: set() for i, *_ in docs}
    for at in by.values():
        for n, (d, p) in enumerate(at):
            for e, q in at[:n]:
                if p and q and line[d, p - 1] == line[e, q - 1]:
                    continue  # the run starts before
                m = 0
                while (d, p + m) in line and line.get((e, q + m)) == line[d, p + m]:
                    m += 1
                if sum(len(line[d, p + k]) for k in range(m)) >= min_chars:
                    gone[docs[d][0]].update(docs[d][2][p : p + m])
    return {i: (len(at), len(gone[i]), "\n".join(x for k, x in enumerate(lines) if k not in gone[i])) for i, lines, at in docs}


def test_against_brute_force(spark):
    from tideline.llm.line_dedup import dedup_documents, dedup_lines

    rng = random.Random(4)
    pool = ["x" * rng.choice([1, 3, 10, 24, 49, 50, 80]) + str(k) for k in range(12)] + ["", "  "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for k in range(60)] + [(90, ""), (91, "\n\n"), (92, "a\n" * 200)]
    sample = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for data in (rows, sample):
        df = spark.createDataFrame([(i, t, 5) for i, t in data], "doc_id long, text string, pos int").repartition(4)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(df).collect()}
        want = brute(data)
        assert got == want
        assert sorted(r.doc_id for r in dedup_documents(df).collect()) == sorted(i for i, (n, g, _) in want.items() if g == 0 or g < n)


def test_odd_rows(spark):
    from tideline.llm.line_dedup import dedup_lines

    line = "a line that is long enough to count as a repeated run of lines"
    rows = [(1, line + "\nmine"), (1, line + "\nmine"), (2, None), (None, line), (3, line), (3, line + "\nother"), (None, None)]
    got = sorted(map(str, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", __import__("pyspark").sql.functions.lit("x"))).collect()))
    assert got == sorted(str(r) for r in [f"Row(doc_id=1, text={(line + chr(10) + 'mine')!r}, n_lines=2, n_removed=0)"] * 2 + ["Row(doc_id=2, text=None, n_lines=0, n_removed=0)", f"Row(doc_id=None, text={line!r}, n_lines=1, n_removed=0)", "Row(doc_id=3, text='', n_lines=1, n_removed=1)", "Row(doc_id=3, text='other', n_lines=2, n_removed=1)", "Row(doc_id=None, text=None, n_lines=0, n_removed=0)"])
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_maximal_runs_go(spark):
    from tideline.llm.line_dedup import dedup_lines

    rng = random.Random(5)
    pool = ["x" * rng.choice([1, 3, 10, 24, 49, 50, 80]) + str(k) for k in range(12)] + ["", "  "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for k in range(60)] + [(92, "a\n" * 200)]
    long, short = "a" * 60, "b" * 10
    rows += [(100, f"{long}\n{short}\nmine"), (101, f"{long}\n{short}\nother")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)
    assert got[101] == (3, 2, "other")


def test_ranks_are_places_in_the_suffix_array(spark):
    from tideline.llm.line_dedup import suffix_ranks

    rng = random.Random(6)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for k in range(40)]
    got = {(r.doc_id, r.pos): r for r in suffix_ranks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    text = {i: t.split("\n") for i, t in rows}
    order = sorted({(r.n0, text[i][p]) for (i, p), r in got.items()})
    line = {x: n for n, x in order}  # the order of line ids
    assert len(line) == len(order)
    for k in range(1, 6):
        runs = {(i, p): tuple(line[x] for x in text[i][p : p + 2**k]) for i, p in got if p + 2**k <= len(text[i])}
        many = {}
        for x in runs.values():
            many[x] = many.get(x, 0) + 1
        shared = {at: x for at, x in runs.items() if many[x] > 1}
        assert {at for at, r in got.items() if r[f"n{k}"] is not None} == set(shared)
        rank = {x: got[at][f"n{k}"] for at, x in shared.items()}
        assert all(got[at][f"n{k}"] == rank[x] for at, x in shared.items())
        assert sorted(rank, key=rank.get) == sorted(rank)


def test_a_hot_line_and_hot_runs(spark):
    from tideline.llm.line_dedup import dedup_lines

    hot = "a line that stands in very many of the documents, and counts by itself"
    rows = [(k, f"{hot}\nown {k}\nshort\nshort too\nthe run of these lines counts\nend {k % 7} of seven lines that count by themselves as they are long") for k in range(700)] + [(1000 + k, f"mine {k}") for k in range(300)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)
    assert got[1][1] == 1 and got[8][1] == 5 and got[699][2] == "own 699"


def test_time_grows_with_the_lines(spark):
    import time

    from tideline.llm.line_dedup import dedup_lines

    def seconds(n):
        text = "\n".join(f"line {k} of a long text that stands twice in the corpus" for k in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")
        began = time.perf_counter()
        got = {r.doc_id: r for r in dedup_lines(df).collect()}
        assert got[1].n_removed == 0 and (got[2].n_removed, got[2].text) == (n, "last")
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(32_000) < 4 * seconds(4_000) + 10
