"""Quality rules, line first: each line is judged on its own, failing lines go, and a text that loses too much goes whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WHITE = re.compile(r"[\x20\x09-\x0D]")
#: Ends of a sentence, closing quotes and brackets included.
TERMINAL = tuple(".!?:;…\"'”’»)]。！？：；")
#: Marks that separate the entries of a menu.
SEPARATORS = re.compile(r"[|»›·•→]|\s[-–/>]\s|::")
#: Entries of menus; a short line made of these only is navigation.
NAV_WORDS = frozenset("home about contact login logout register search menu help faq news blog shop cart checkout account profile settings next previous prev back top share tweet print email subscribe sitemap privacy terms archive archives categories tags comments reply more".split())
#: Phrases that belong to a site rather than to its text.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "click here to", "read more", "sign up for our newsletter", "subscribe to our newsletter", "follow us on", "share this", "lorem ipsum", "skip to content", "skip to main content", "powered by wordpress",
    "page not found", "leave a comment", "log in to", "you must be logged in", "add to cart",
)
SYMBOLS = re.compile(r"[#*$%&|<>]")
LINE_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]=~^_\\@+]")


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules on lines and on texts."""

    min_words: int = 50
    max_repeat_pct: int = 50
    unfinished_words: int = 4
    max_symbol_share: float = 0.1
    max_upper_share: float = 0.6
    max_digit_share: float = 0.5
    max_shout_share: float = 0.3
    min_separators: int = 3
    max_lost_share: float = 0.4


def failing(line: str, rules: Rules = Rules()) -> str | None:
    """The rule that a line breaks; None if it passes. A blank line passes."""
    line = line.strip()
    if not line:
        return None
    low, words = line.lower(), line.split()
    solid = len(line) - line.count(" ")
    if any(p in low for p in BOILERPLATE):
        return "boilerplate"
    if len(SEPARATORS.findall(line)) >= rules.min_separators and len(words) <= 6 * rules.min_separators or len(words) <= 8 and all(w.strip("|»›·•→-–/>,:").lower() in NAV_WORDS | {""} for w in words):
        return "navigation"
    if len(LINE_SYMBOLS.findall(line)) > rules.max_symbol_share * solid:
        return "symbols"
    upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
    if len(words) >= 4 and upper > rules.max_upper_share * (upper + lower):
        return "capitals"
    if sum(map(str.isdigit, line)) > rules.max_digit_share * solid and len(words) >= 3:
        return "digits"
    if len(words) >= 4 and line.count("!") + line.count("?") > rules.max_shout_share * len(words):
        return "shouting"
    if not line.endswith(TERMINAL) and len(words) < rules.unfinished_words:
        return "punctuation"
    return None


def repeat_words(words: list) -> int:
    """Words that lie in a window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    m = len(ids)
    if m < 2_000_000:
        keys = (a[:-2] * m + a[1:-1]) * m + a[2:]
    else:  # three numbers no longer fit into 63 bits
        pairs = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
        keys = np.unique(pairs[:-1] * m + a[2:], return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str | None, rules: Rules = Rules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_bad_lines, cleaned text)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = text.split("\n")
    seen: set = set()
    dup = bad = lost = 0
    good = []
    for line in lines:
        has_word = bool(line.strip(" \t\r\x0b\x0c"))
        again = has_word and line in seen
        if has_word:
            seen.add(line)
        dup += again
        if again or failing(line, rules):
            bad += 1
            lost += len(line) - line.count(" ")
        else:
            good.append(line)
    repeat = repeat_words(words)
    base = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
    return n, chars, len(SYMBOLS.findall(text)), dup, repeat, base, not base and lost <= rules.max_lost_share * chars, len(lines), bad, "\n".join(good) if bad else text


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "cleaned"]
TYPES = ["long"] * 5 + ["boolean"] * 2 + ["long"] * 2 + ["string"]
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """Counts, verdict and cleaned text of each document, in one pass without a shuffle.

    Null texts count as empty: no words, base_failed, not kept, cleaned text "". Rows with equal or null ids are judged
    apart. Long texts are judged whole. An empty table gives an empty result. Other columns of `docs` are not read.
    A line equal to an earlier one with a word fails, as do lines that `failing` names; blank lines neither fail nor count.
    """
    small_batches(docs.sparkSession)
    names = COLUMNS if cleaned else COLUMNS[:-1]
    kinds = TYPES[: len(names)]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, rules)[: len(names)] for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, ARROW[k]) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return slim.mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars set anew; columns as in `docs`.

    Each row is judged by its own text, read whole: repeated rows and equal or null ids share a verdict only if their texts
    are equal. Null and empty texts have under 50 words, so they go. An empty table gives an empty result; other columns stay.
    """
    small_batches(docs.sparkSession)
    names, kinds = docs.columns, docs.schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, rules) for t in batch.column(names.index("text")).to_pylist()]
            keep = pa.array([r[6] for r in rows], pa.bool_())
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            columns["text"] = pa.array([r[-1] for r in rows], pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(r[-1]) for r in rows], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(keep)

    return docs.mapInArrow(judge, kinds)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), cleaned=False)


def _oracle(r: Rules = Rules()) -> str:
    """The rules in SQL, line by line; letters by their Unicode class."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    phrase = " OR ".join(f"contains(low, {q(p)})" for p in BOILERPLATE)
    nav = ", ".join(q(w) for w in sorted(NAV_WORDS))
    ends = " OR ".join(f"ends_with(s, {q(t)})" for t in TERMINAL)
    return f"""
WITH lines AS (SELECT doc_id, i, x, trim(regexp_replace(x, '\\s', ' ', 'g')) AS s, regexp_matches(x, '[^\\x20\\x09-\\x0D]') AS has_word FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
m AS (SELECT *, lower(s) AS low, length(s) - length(replace(s, ' ', '')) AS blanks, length(s) AS chars, list_filter(string_split(s, ' '), lambda w: w <> '') AS ws, has_word AND row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again FROM lines),
f AS (SELECT *, again OR (s <> '' AND ({phrase}
    OR (len(regexp_extract_all(s, '[|»›·•→]|\\s[-–/>]\\s|::')) >= {r.min_separators} AND len(ws) <= {6 * r.min_separators})
    OR (len(ws) <= 8 AND len(list_filter(ws, lambda w: trim(w, '|»›·•→-–/>,:') <> '' AND lower(trim(w, '|»›·•→-–/>,:')) NOT IN ({nav}))) = 0)
    OR len(regexp_extract_all(s, '[#*$%&|<>{{}}\\[\\]=~^_\\\\@+]')) > CAST({r.max_symbol_share} AS DOUBLE) * (chars - blanks)
    OR (len(ws) >= 4 AND len(regexp_extract_all(s, '\\p{{Lu}}')) > CAST({r.max_upper_share} AS DOUBLE) * (len(regexp_extract_all(s, '\\p{{Lu}}')) + len(regexp_extract_all(s, '\\p{{Ll}}'))))
    OR (len(regexp_extract_all(s, '\\p{{Nd}}')) > CAST({r.max_digit_share} AS DOUBLE) * (chars - blanks) AND len(ws) >= 3)
    OR (len(ws) >= 4 AND len(regexp_extract_all(s, '[!?]')) > CAST({r.max_shout_share} AS DOUBLE) * len(ws))
    OR (NOT ({ends}) AND len(ws) < {r.unfinished_words}))) AS bad FROM m),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(length(x) - (length(x) - length(replace(x, ' ', '')))) FILTER (bad), 0) AS lost FROM f GROUP BY 1),
w AS (SELECT doc_id, {words.format("text")} AS ws, text FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS gram FROM w),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1) GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, l.n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, l.n_lines, l.n_bad_lines, l.lost FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= CAST({r.max_lost_share} AS DOUBLE) * word_chars AS kept, n_lines, n_bad_lines FROM v"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
