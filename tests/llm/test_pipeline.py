import re

import pytest

pytest.importorskip("tideline.llm")


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_line_dedup import brute as brute_lines
    from tests.llm.test_ngram_join import brute as brute_groups

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if k < 4:
            assert docs.columns == want
    rows = [{r.doc_id: r.text for r in d.collect()} for d in seen[:4]]
    assert rows[0].keys() > rows[1].keys() >= rows[2].keys() >= rows[3].keys() > set()
    assert all(len(re.findall(r"\S+", t)) for t in rows[0].values())
    lines = brute_lines(list(rows[1].items()))
    assert rows[2] == {i: t for i, (n, g, t) in lines.items() if g == 0 or g < n}
    assert set(rows[3]) == {i for i, _, c in brute_groups(list(rows[2].items())) if i == c}
    assert {r.doc_id for r in seen[4].collect()} == set(rows[3])
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in seen[4].collect())


def test_odd_rows_and_empty_tables(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdefghiklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = "\n".join(" ".join(rng.choice(pool) for _ in range(12)).capitalize() + "." for _ in range(20_000))
    text = "\n".join(f"This is sentence number {k} of a text about nothing at all, with words in it." for k in range(12))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, text + " More.", None, "s", 1), (5, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS kept", "'y' AS hash")
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, d, m in (("odd", docs, labels), ("bare", docs, labels.limit(0)), ("none", docs.limit(0), labels)):
        folder = f"{tmp_path}/{name}"
        d.write.parquet(f"{folder}/documents.parquet")
        m.write.parquet(f"{folder}/labels.parquet")
        now = d
        for stage_name, stage in corpus_pipeline.STAGES[:4]:
            now = stage(spark, now, folder)
            assert now.columns == docs.columns, stage_name
        got = corpus_pipeline.run(spark, folder).collect()
        assert not got if name == "none" else {r.doc_id for r in got} <= {None, 1, 4, 5}
        assert name != "bare" or any(r.length == 1024 and r.doc_id == 5 for r in got)
