"""Text and URL expressions; built-in functions except where Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it; Java's plain \s is ASCII only.
SPACES = r"(?U)\s+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
#: English function words that tell an English text from another.
FUNCTION_WORDS = ("the", "and", "of", "to", "in", "for", "with", "is", "on", "its")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text: str | Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), SPACES, " "))


def title_and_summary(title: str | Column, summary: str | Column) -> Column:
    """Title, full stop and summary; the title alone where the summary is empty."""
    t, s = clean_text(title), clean_text(summary)
    return F.when(s == "", t).otherwise(F.concat(t, F.lit(". "), s))


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed; null becomes empty. Spark has neither NFKC nor case folding."""
    return text.fillna("").map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def text_id(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by a unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), 256)


def canonical_url(url: str | Column) -> Column:
    """Scheme and host in lower case, fragment dropped, path and query kept; without a host only trimmed."""
    u = F.trim(F.coalesce(_c(url), F.lit("")))
    scheme, host, rest = (F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^#]*)", i) for i in (1, 2, 3))
    return F.when(host != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(host), rest)).otherwise(u)


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(_c(url), F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)


def company_context(text: str | Column, aliases: Sequence[str]) -> Column:
    """The sentences that name one of the aliases as a word, each once, in order."""
    named = r"(?i)\b(" + "|".join(aliases) + r")\b"
    return F.array_join(F.array_distinct(F.filter(F.split(clean_text(text), SENTENCE_END), lambda s: F.regexp_like(s, F.lit(named)))), " ")


def word_count(text: str | Column, words: Sequence[str] = FUNCTION_WORDS) -> Column:
    """Occurrences of the given words, in either case."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"(?i)\b(" + "|".join(words) + r")\b"))


def case_map(column: str | Column, classes: dict[str, str], default: str) -> Column:
    """A mapping of labels to classes; whatever it lacks, null too, is `default`."""
    out = F.lit(default)
    for k, v in classes.items():
        out = F.when(_c(column) == k, F.lit(v)).otherwise(out)
    return out


def eligible(title: str | Column, url: str | Column, text: str | Column, relevance: str | Column, page_titles: str, page_path: str, least: float = 0.5) -> Column:
    """A text about its subject: no page that is generated anew all the time, some text, enough relevance."""
    page = F.regexp_like(F.coalesce(_c(title), F.lit("")), F.lit(page_titles)) | F.startswith(url_path(url), F.lit(page_path))
    return ~page & (clean_text(text) != "") & F.coalesce(_c(relevance) >= least, F.lit(False))
