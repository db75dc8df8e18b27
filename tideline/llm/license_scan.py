"""License scan: ordered signature rules behind a keyword prefilter; priority and containment decide between overlapping finds."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The base phrases and their labels, which always count.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Every byte that ends a word becomes a space: ASCII but digits and a-z (A-Z are lowered before).
TO_SPACE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Families of licenses: label, names in running text, short codes, versions.
FAMILIES = [
    ("gpl", ["gnu general public licen[cs]e", "gnu gpl"], "gpl", ["1", "2", "3"]),
    ("lgpl", ["gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl"], "lgpl", ["2", "2 1", "3"]),
    ("agpl", ["gnu affero general public licen[cs]e", "affero general public licen[cs]e"], "agpl", ["1", "3"]),
    ("fdl", ["gnu free documentation licen[cs]e"], "gfdl", ["1 1", "1 2", "1 3"]),
    ("apache", ["apache licen[cs]e", "apache software licen[cs]e"], "apache", ["1", "1 1", "2"]),
    ("mpl", ["mozilla public licen[cs]e"], "mpl", ["1", "1 1", "2"]),
    ("epl", ["eclipse public licen[cs]e"], "epl", ["1", "2"]),
    ("eupl", ["european union public licen[cs]e"], "eupl", ["1", "1 1", "1 2"]),
    ("cddl", ["common development and distribution licen[cs]e"], "cddl", ["1", "1 1"]),
    ("cpl", ["common public licen[cs]e"], "cpl", ["1"]),
    ("artistic", ["artistic licen[cs]e", "clarified artistic licen[cs]e"], "artistic", ["1", "2"]),
    ("osl", ["open software licen[cs]e"], "osl", ["1", "2", "2 1", "3"]),
    ("afl", ["academic free licen[cs]e"], "afl", ["1 1", "2", "2 1", "3"]),
    ("ofl", ["sil open font licen[cs]e", "open font licen[cs]e"], "ofl", ["1", "1 1"]),
    ("bsl", ["boost software licen[cs]e"], "bsl", ["1"]),
    ("psf", ["python software foundation licen[cs]e"], "psf", ["2"]),
    ("odbl", ["open database licen[cs]e", "open data commons open database licen[cs]e"], "odbl", ["1"]),
    ("mit", ["mit licen[cs]e", "expat licen[cs]e", "mit x11 licen[cs]e"], "mit", []),
    ("isc", ["isc licen[cs]e"], "isc", []),
    ("zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e"], "zlib", []),
    ("bsd-2", ["(?:2|two) clause bsd licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e"], "bsd 2 clause", []),
    ("bsd-3", ["(?:3|three) clause bsd licen[cs]e", "(?:new|revised|modified) bsd licen[cs]e"], "bsd 3 clause", []),
    ("bsd-4", ["(?:4|four) clause bsd licen[cs]e", "original bsd licen[cs]e"], "bsd 4 clause", []),
    ("bsd", ["bsd licen[cs]e", "bsd style licen[cs]e"], "bsd", []),
    ("unlicense", ["the unlicense", "released into the public domain", "dedicated to the public domain"], "unlicense", []),
    ("wtfpl", ["do what the fuck you want to public licen[cs]e"], "wtfpl", []),
    ("cc0", ["cc0", "cc zero", "creative commons zero", "creative commons cc0"], "cc0", ["1"]),
]
#: Creative Commons: label, codes, words in running text.
CC = [("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s(?: works)?"), ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?")]
CC_VERSIONS = ["1", "2", "2 5", "3", "4"]
#: Texts of licenses themselves: label and a telling passage, in words.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("all-rights-reserved", "all rights reserved"),
]


class Rule(NamedTuple):
    """priority: the smaller comes first; keyword: a literal without which the pattern cannot match."""

    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern
    confidence: float


def _version(v: str) -> str:
    return f"(?: (?:version|v))? ?v?{v}" + ("(?: 0)?" if " " not in v else "")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in their order: SPDX tags, license texts, names with a version, codes with a version, bare names.

    Patterns run over the normalised words joined by single spaces, with a space at each end.
    """
    out: list[Rule] = []

    def add(priority: int, label: str, keyword: str, pattern: str, confidence: float) -> None:
        out.append(Rule(priority, label, keyword.encode(), re.compile(f"(?<= ){pattern}(?= )".encode()), confidence))

    def literal(name: str) -> str:
        return max(re.split(r"\(\?:[^)]*\)\??|\[[^\]]*\]|.\?|[.{}|*+]", name), key=len).strip()

    for label, names, code, versions in FAMILIES:
        add(0, label, "spdx", f"spdx license identifier {code}(?: [0-9]+)*(?: only| or later)?", 1.0)
        for v in versions:
            full = f"{label}-{v.replace(' ', '.')}"
            for name in names:
                add(2, full, literal(name), name + _version(v) + "(?: or (?:any )?later(?: version)?)?", 0.95)
            add(3, full, code, f"{code} ?v?{v}(?: 0)?(?: only| or later)?", 0.9)
        for name in names:
            add(4, label, literal(name), name, 0.8)
    for label, code, words in CC:
        add(0, label, "spdx", f"spdx license identifier cc {code}(?: [0-9]+)*", 1.0)
        add(1, label, "creativecommons", f"creativecommons org licenses {code}(?: [0-9]+)*", 1.0)
        for v in CC_VERSIONS:
            full = f"{label}-{v.replace(' ', '.')}"
            add(2, full, "creative commons", f"creative commons {words}(?: international| unported| generic)?{_version(v)}", 0.95)
            add(2, full, f"cc {code}", f"cc {code}{_version(v)}", 0.95)
        add(4, label, "creative commons", f"creative commons {words}", 0.8)
        add(4, label, f"cc {code}", f"cc {code}", 0.8)
    for label, passage in PASSAGES:
        add(1 if label != "all-rights-reserved" else 5, label, literal(passage), passage, 1.0 if label != "all-rights-reserved" else 0.5)
    return tuple(sorted(out, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick automaton from each keyword to the rules that it opens."""
    import ahocorasick

    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword.decode(), []).append(i)
    a = ahocorasick.Automaton()
    for word, found in by.items():
        a.add_word(word, found)
    a.make_automaton()
    return a


def detections(joined: bytes) -> list[tuple[int, int, Rule]]:
    """Finds that stay, as (start, end, rule): in the order of priority, then length, a find within one that stays is suppressed.

    Of finds with the same span and priority the alphabetically first label stays.
    """
    opened: set[int] = set()
    for _, found in automaton().iter(joined.decode("utf-8", "replace")):
        opened.update(found)
    by_priority: dict[int, list[tuple[int, int, Rule]]] = {}
    for i in opened:
        r = rules()[i]
        by_priority.setdefault(r.priority, []).extend((m.start(), m.end(), r) for m in r.pattern.finditer(joined))
    stay: list[tuple[int, int, Rule]] = []
    for priority in sorted(by_priority):
        starts = [x[0] for x in stay]
        reach = list(accumulate((x[1] for x in stay), max))
        own, last = [], -1
        for x in sorted(by_priority[priority], key=lambda x: (x[0], -x[1], x[2].label)):
            k = bisect_right(starts, x[0])
            if x[1] > last and not (k and reach[k - 1] >= x[1]):
                own.append(x)
                last = x[1]
        stay = sorted(stay + own, key=lambda x: x[:2])
    return stay


#: A text without any of these holds no keyword of any rule, so nothing is run on it.
GATES = (b"licen", b"spdx", b"creative", b"copy", b"permission", b"unencumbered", b"rights", b"cc", b"gpl", b"gfdl", b"apache", b"mpl", b"epl", b"eupl", b"cddl", b"cpl", b"artistic", b"osl", b"afl", b"ofl", b"bsl", b"psf", b"odbl", b"public", b"redistribut", b"misrepresented", b"contributors")


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(TO_SPACE).split()
    joined = b" " + b" ".join(words) + b" "
    at, base = [], set()
    for phrase, label in BASE.items():
        p = b" " + phrase.encode() + b" "
        k = joined.find(p)
        while k >= 0:
            at.append(k)
            base.add(label)
            k = joined.find(p, k + 1)
    found = detections(joined) if any(g in joined for g in GATES) else []
    # the number of a word is that of the spaces before it, counted once for all places
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if at or found else np.zeros(0, np.int64)
    word = lambda x: np.searchsorted(spaces, x).tolist()
    places = word(at)
    labels = base | {r.label for _, _, r in found}
    score = max([1.0 if base else 0.0, *(r.confidence for *_, r in found)])
    spans = [f"{a - 1}:{b}:{r.label}" for a, b, (_, _, r) in zip(word([f[0] for f in found]), word([f[1] for f in found]), found)]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(spans)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels, places and spans of license notices in each document, in one pass without a shuffle.

    Null texts count as empty: 0 words, null places, empty labels, score 0. Rows with equal or null ids are scanned apart; an empty table gives an empty result;
    long texts are scanned whole; other columns are not read. `spans` lists first word, end word and label of each find.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(scan, batch.column(1).to_pylist()))) or [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS))], ["doc_id", *NAMES])

    return slim.mapInArrow(find, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES: dict[str, str] = {}
