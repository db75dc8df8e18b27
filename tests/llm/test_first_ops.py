"""License scan, URL filter, SentencePiece and quality rules against plain versions."""

import hashlib
import re
from collections import Counter

import pytest

pytest.importorskip("tideline.llm")

TEXTS = [None, "", " ", "a", "x  y\n\nz ", " lead", "trail ", "\u2581mark \u2581\u2581two", "ﬁ é 漢字 \U0001f600\x00 end", "A" * 5000, "word " * 3000, "</s> <s> <unk> [PAD]", "tab\tand\u00a0nbsp\u3000wide", "MIT License. mit\nlicense; GNU General Public-License v3, CC-BY 4.0 cc by"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "again"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_pieces(spark, docs):
    import public_tokenizers
    import sentencepiece

    from tideline.llm.pieces import piece_ids

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, sample):
        got = sorted((str(r) for r in piece_ids(df, path, arrays=True).collect()))
        want = []
        for r in df.collect():
            ids = sp.encode(r.text or "") + [sp.eos_id()]
            text = sp.decode(ids)
            want.append(str([x for x in [r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text]]))
        strip = [re.sub(r"^Row\(|\)$|\b\w+=", "", x) for x in got]
        assert sorted(x[1:-1] for x in want) == sorted(strip)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality(spark, docs):
    from tideline.llm.quality_rules import clean_documents, failing, quality_rules

    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, sample):
        got = sorted((r.doc_id or -1, *list(r)[1:7]) for r in quality_rules(df).collect())
        assert got == sorted((r.doc_id or -1, *brute_quality(r.text)) for r in df.collect())
    assert failing("Home | News | Contact | About") == "navigation"
    assert failing("We use cookies on this site.") == "boilerplate"
    assert failing("An ordinary sentence stands here.") is None
    assert failing("") is None
    assert clean_documents(docs).columns == docs.columns
    assert quality_rules(docs.limit(0)).count() == 0


def test_licenses(spark, docs):
    from tideline.llm.license_scan import BASE, license_scan, rules, scan

    assert len(rules()) > 200
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (docs, sample):
        got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(df).collect()}
        want = set()
        for r in df.collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            at = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            want.add((r.doc_id, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
        assert got == want
    assert scan("Licensed under the Apache License, Version 2.0.")[5] == "apache,apache-2"
    assert scan("SPDX-License-Identifier: MIT")[5] == "mit"
    assert scan("under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc-4")
    assert scan("nothing here")[5:] == ("", 0.0, "")


def test_urls(spark):
    from tideline.llm.url_filter import filter_urls

    urls = [None, "", "no scheme/en/", "http://", "http://Example.COM/en/7x?q=1", "https://a.example.com/en/8", "http://example.net/de/81", "http://x.net/de/9#f", "http://notexample.com/EN/", "http://a.org/es/", "http://h?x=casino", "http://site.xyz/casino/", "http://en.wikipedia.org/wiki/Casino", "http://casinos.xyz/", "http://u.xyz/a.JPG", "ftp://a://com/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block")
    assert got[6][2:] == ("example.net/de/8", "block")
    assert got[7][2:] == ("net/de/", "allow")
    assert got[8][2:] == (None, "allow")
    assert got[9][2:] == ("org/es/", "block")
    assert got[10] == ("h", "", None, "block")
    assert [got[i][3] for i in (11, 12, 13, 14)] == ["block", "allow", "allow", "block"]
    assert got[15][:2] == ("a:", "//com/en/")
    assert filter_urls(df.limit(0)).count() == 0


def test_a_long_list_of_rules_is_joined(spark):
    from tideline.llm.url_filter import PatternRule, filter_urls, pattern_rules

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    df = df.unionByName(df.limit(20)).unionByName(spark.createDataFrame([(None, "http://a.org/es/x"), (-1, None), (-2, "")], "page_id long, url string"))
    key = lambda x: sorted(map(str, x.collect()))
    assert key(filter_urls(df)) == key(filter_urls(df, most_inline=0))
    many = [PatternRule("block", f"(^|[^a-z0-9])nosuchword{k}([^a-z0-9]|$)", (f"nosuchword{k}",)) for k in range(3000)]
    assert key(filter_urls(df, own_rules=pattern_rules() + many)) == key(filter_urls(df))


def test_license_rules_without_prefilter():
    """Every rule over every text, and each find against each that stays."""
    import random

    from tideline.llm.license_scan import FAMILIES, GATES, PASSAGES, detections, rules

    rng = random.Random(11)
    pool = [n for _, names, _, _ in FAMILIES for n in names] + [c for *_, c, _ in FAMILIES] + [p for _, p in PASSAGES] + [f"creative commons {x}" for x in ("attribution", "zero")] + [k.decode() for k in GATES]
    pool = [re.sub(r"\(\?:|\[.*?\]|[()?|.*+{}]", "", x) for x in pool] + "cc by nc sa nd version v 2 0 1 3 4 or later only spdx license identifier the of in under".split()
    for _ in range(1500):
        joined = (" " + " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) + " ").replace("  ", " ").encode()
        finds = sorted(((r.priority, m.start(), -m.end(), r.label, r) for r in rules() for m in r.pattern.finditer(joined)), key=lambda x: x[:4])
        stay = []
        for _, start, end, _, r in finds:
            if not any(s <= start and -end <= e for s, e, _ in stay):
                stay.append((start, -end, r))
        assert [(s, e, r.label) for s, e, r in detections(joined)] == sorted((s, e, r.label) for s, e, r in stay)


def test_license_scan_of_a_long_text_and_empty_tables(spark, docs):
    import public_tokenizers

    from tideline.llm import license_scan
    from tideline.llm.pieces import piece_ids

    n = 100_000
    got = license_scan.scan("Apache License\n" * n)
    assert got[:4] == (2 * n, n, 0, 2 * n - 2) and got[4] == "apache"
    assert license_scan.license_scan(docs.limit(0)).count() == 0
    assert piece_ids(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_each_chunk_is_segmented_once(spark, monkeypatch):
    import public_tokenizers

    from tideline.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(5)
    key = lambda x: sorted(map(str, x.collect()))
    want = key(pieces.piece_ids(sample, path))
    monkeypatch.setattr(pieces, "UNIT_CHARS", 50_000)  # many units ask for the same chunks
    assert key(pieces.piece_ids(sample, path)) == want
