"""The equity-news domain: its fixed values, and the pipelines over its own tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dedup
from ..operators import windows as w

# Fixed values, which results depend on.
TICKERS = ("AAPL", "MSFT", "NVDA", "TSLA")
ALIASES = {"AAPL": ("Apple", "AAPL"), "MSFT": ("Microsoft", "MSFT"), "NVDA": ("NVIDIA", "NVDA"), "TSLA": ("Tesla", "TSLA")}
CUTOFF = date(2023, 10, 16)
START = date(2021, 1, 1)
LABEL_CLASSES = {"Bullish": "positive", "Somewhat-Bullish": "positive", "Bearish": "negative", "Somewhat-Bearish": "negative", "Neutral": "neutral"}
ANNOTATION_LABELS = ("negative", "neutral", "positive", "insufficient")
DYNAMIC_TITLES = (
    r"(?i)\b(?:stock|share|etf|fund) price\s*(?:history|&|[|:]|$)|"
    r"\b(?:holdings list|interactive stock chart|stock quote|stock price and chart|stock fund price and chart)\b|"
    r"\betf\b.*\b(?:holdings|dividend yield)\b|\bcompany profile\s*(?:&|$)"
)
DYNAMIC_PATHS = ("/quote/", "/symbols/", "/etfs/")
GRIDS = {
    "logistic": [{"c": 0.1}, {"c": 10.0}],
    "forest": [{"trees": 100, "depth": 4, "leaf": 20}, {"trees": 100, "depth": 8, "leaf": 20}],
    "boosting": [{"rounds": 100, "depth": 2}, {"rounds": 100, "depth": 3}],
}
SPACES = {
    "forest": {"trees": [100, 200], "depth": [3, 4, 6, 8], "leaf": [5, 10, 20, 40]},
    "boosting": {"rounds": [100, 200], "depth": [2, 3, 4, 5], "rate": [0.025, 0.05, 0.1]},
}
WINDOW_YEARS = (None, 3, 5)
LAGGED_STEPS, ROLLING_SIZES = (1, 2, 3), (3, 5)


def _iso(at: Column) -> Column:
    """An instant in UTC as ISO 8601 with its offset; fractions of seconds only where there are any."""
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def company_context(title: str, summary: str, ticker: str) -> Column:
    """Title and sentences of the summary that name the company of each row, each once, in order."""
    pieces = F.concat(F.array(F.trim(F.coalesce(F.col(title), F.lit("")))), F.split(F.trim(F.coalesce(F.col(summary), F.lit(""))), t.SENTENCE_END))

    def naming(aliases: tuple[str, ...]) -> Column:
        pattern = F.lit(r"(?i)\b(?:" + "|".join(aliases) + r")\b")
        return F.array_join(F.array_distinct(F.filter(pieces, lambda p: (p != "") & F.regexp_like(p, pattern))), " ")

    out = F.lit("")
    for name, aliases in ALIASES.items():
        out = F.when(F.col(ticker) == name, naming(aliases)).otherwise(out)
    return out


def identify_news(news: DataFrame) -> DataFrame:
    """Adds news_id, over entity, instant, URL, title and text, and text_sha256; missing strings are empty."""
    strings = [f.name for f in news.schema if f.dataType.simpleString() == "string"]
    out = news.na.fill("", strings)
    ident = t.text_id("ticker", _iso(F.col("published_at")), "url", "title", "text")
    return out.withColumns({"news_id": ident, "text_sha256": F.sha2("text", 256)})


def eligible_news(news: DataFrame, start: date = START) -> DataFrame:
    """Flags: the company is named, the page is dynamic, it is recent enough; and eligible, which joins them with a text."""
    path = F.lower(t.url_path("url"))
    paged = F.lit(False)
    for p in DYNAMIC_PATHS:
        paged = paged | F.startswith(path, F.lit(p))
    out = identify_news(news).withColumns(
        {
            "explicit_company": company_context("title", "summary", "ticker") != "",
            "dynamic_page": F.regexp_like("title", F.lit(DYNAMIC_TITLES)) | paged,
            "post_checkpoint": F.col("published_at") >= F.lit(start).cast("timestamp"),
        }
    )
    return out.withColumn("eligible", F.col("explicit_company") & ~F.col("dynamic_page") & F.col("post_checkpoint") & (F.trim("text") != ""))


def prepare_news(news: DataFrame, cutoff: date = CUTOFF) -> DataFrame:
    """News of known entities with ids, duplicate groups across entities, partition by cutoff, context and language flags.

    Rows that share a canonical URL, a normalised title or a normalised text belong to one group, through others too; a
    group is named by the hash of its smallest key.
    """
    base = identify_news(news.where(F.col("ticker").isin(list(TICKERS)))).dropDuplicates(["news_id"])
    keyed = base.withColumns({"__url": t.canonical_url("url"), "__title": t.normalized("title"), "__text": t.normalized("text")})
    keys = {"url": F.col("__url"), "title": F.col("__title"), "text": F.col("__text")}
    parts = dedup.duplicate_components(keyed, "news_id", keys)
    named = F.array_min(F.filter(F.array(*(F.when(c != "", F.concat(F.lit(f"{k}:"), c)) for k, c in keys.items())), lambda x: x.isNotNull()))
    both = keyed.withColumn("__key", named).join(parts, "news_id")
    groups = both.groupBy("component").agg(F.sha2(F.min("__key"), 256).alias("group_id"))
    out = both.join(groups, "component").drop("component", "__key", "__url", "__title", "__text")
    out = out.withColumn("partition", F.when(F.col("published_at") < F.lit(cutoff).cast("timestamp"), "development").otherwise("evaluation"))
    return out.withColumns(
        {
            "multi_company": w.varies("group_id", "ticker"),
            "cross_boundary": w.varies("group_id", "partition"),
            "context": company_context("title", "summary", "ticker"),
            "english_function_words": t.word_count("text"),
            "language_review_flag": t.word_count("text") < 2,
        }
    )


def sample_news(prepared: DataFrame, per_cell: int = 50, seed: int = 50) -> DataFrame:
    """`per_cell` news of each partition and entity by hash priority, one of each group; none from groups across the cutoff."""
    pool = prepared.where(~F.col("cross_boundary") & (F.trim("title") != "") & (F.trim("text") != "")).withColumn("cell", F.concat_ws("/", "partition", "ticker"))
    cells = [f"{p}/{x}" for p in ("development", "evaluation") for x in TICKERS]
    return dedup.hash_sample(pool, "news_id", "group_id", "cell", cells, per_cell, seed).drop("cell")


def sentiment_class(label: str | Column) -> Column:
    """The class of a provider's label; unknown ones are neutral."""
    return t.case_map(label, LABEL_CLASSES, "neutral")

