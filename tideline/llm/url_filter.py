"""URL filter: pattern rules indexed by their rarest literal token; a URL's tokens fetch the rules whose patterns are run."""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class SiteRule(NamedTuple):
    """Fits `host` and its subdomains where the path starts with `path`; the longest rule wins."""

    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    """A regular expression over host, path and query in lower case; `tokens` are whole tokens that every match holds."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]


SITE_RULES = (SiteRule("block", "com", "/en/"), SiteRule("allow", "example.com", "/en/7"), SiteRule("allow", "net", "/de/"), SiteRule("block", "example.net", "/de/8"), SiteRule("block", "org", "/es/"))

#: Whole words of hosts or paths, by what they stand for.
BLOCKED_WORDS = {
    "adult": "porn xxx sex nude escort hentai camgirls milf erotic",
    "gambling": "casino poker betting slots roulette jackpot lottery bingo sportsbook",
    "drugs": "viagra cialis pharmacy steroids",
    "spam": "payday forex clickbait replica seo backlinks",
    "piracy": "warez torrent crack keygen nulled",
    "tracking": "doubleclick adserver popunder adclick",
}
#: Pages of a site rather than texts: a section of the path.
BLOCKED_SECTIONS = "login signin signup register cart checkout account password logout wishlist".split()
BLOCKED_FILES = "jpg jpeg png gif mp3 mp4 avi exe zip rar iso apk dmg".split()
ALLOWED_HOSTS = ("wikipedia.org", "wiktionary.org", "wikibooks.org", "arxiv.org", "gutenberg.org", "europa.eu", "un.org", "nih.gov", "nasa.gov", "mit.edu", "stanford.edu")


def pattern_rules() -> list[PatternRule]:
    """The method's own rules in their order; the first that matches decides."""
    out = [PatternRule("allow", rf"^([^/]*\.)?{re.escape(h)}(/|\?|$)", tuple(h.split("."))) for h in ALLOWED_HOSTS]
    out += [PatternRule("block", rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)", (w,)) for words in BLOCKED_WORDS.values() for w in words.split()]
    out += [PatternRule("block", rf"/{w}(/|\?|\.|$)", (w,)) for w in BLOCKED_SECTIONS]
    out += [PatternRule("block", rf"^[^/]*/[^?]*\.{w}(\?|$)", (w,)) for w in BLOCKED_FILES]
    out += [PatternRule("block", rf"^[^/]*/.*(^|[^a-z0-9]){a}[^a-z0-9]{b}([^a-z0-9]|$)", (a, b)) for a, b in (("add", "cart"), ("sign", "up"), ("log", "in"), ("wp", "admin"), ("free", "download"), ("cheap", "pills"))]
    return out


#: So many rules stand in the plan itself, and pages need no shuffle; more of them are a table that URLs' tokens are joined with.
MOST_INLINE = 500


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what of the URL the patterns see. A null URL or one without :// has all three empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({u}, instr({u}, '://') + 3)".replace("{u}", "__url"))).otherwise("")
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    seen = F.regexp_extract(rest, r"^[^#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(_lower(seen), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(text, "[^a-z0-9]+"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules=SITE_RULES, own_rules: list[PatternRule] | None = None, default: str = "allow", most_inline: int = MOST_INLINE) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_candidates) of each row; up to `most_inline` rules without a shuffle of pages.

    Every rule lies in the index under the one of its tokens that the fewest URLs hold; these counts (one for each token
    of a rule, however many pages there are) come from one aggregation over all pages. Null URLs and those without ://
    have empty host and path, fit no rule and get `default`. Equal or null ids are judged apart; other columns are not read.
    """
    own_rules = pattern_rules() if own_rules is None else own_rules
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path, seen = split_url(F.col("__url"))
    urls = slim.select("page_id", host.alias("host"), path.alias("path"), seen.alias("seen"))
    #: rule: (order, verdict, name, pattern, tokens); site rules come first, the longest of them foremost.
    sites = sorted(site_rules, key=lambda r: -len(r.host + r.path))
    rules = [(i, r.verdict, r.host + r.path, rf"^([^/]*\.)?{re.escape(r.host)}{re.escape(r.path)}", tuple(re.findall("[a-z0-9]+", r.host)), True) for i, r in enumerate(sites)]
    rules += [(len(sites) + i, r.verdict, None, r.pattern, r.tokens, False) for i, r in enumerate(own_rules)]
    words = sorted({t for r in rules for t in r[4]})
    if not words:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).cast("long").alias("n_candidates"))
    spark, inline = pages.sparkSession, len(rules) <= most_inline
    tokens = urls.select("host", "path", "seen", F.explode(_tokens(F.col("seen"))).alias("token"))
    if inline:
        counted = urls.select(F.explode(F.array_intersect(_tokens(F.col("seen")), F.array(*map(F.lit, words)))).alias("token")).groupBy("token").count()
    else:
        counted = tokens.join(spark.createDataFrame([(w,) for w in words], "token string"), "token").groupBy("token").count()
    count = {r["token"]: r["count"] for r in counted.collect()}  # as many rows as the rules have tokens at most
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(min(r[4], key=lambda t: (count.get(t, 0), t)), []).append(r)
    if not inline:
        listed = spark.createDataFrame([(t, r[0], r[1], r[2], r[3], r[5]) for t, found in index.items() for r in found], "token string, ord int, verdict string, name string, pattern string, site boolean")
        fits = F.when(F.col("site"), F.regexp_like(F.concat("host", "path"), F.col("pattern"))).otherwise(F.regexp_like("seen", F.col("pattern")))
        hits = tokens.join(listed, "token").groupBy("host", "path", "seen").agg(F.min(F.when(fits, F.struct("ord", "verdict", "name"))).alias("hit"), F.count_distinct("ord").alias("n"))
        out = urls.join(hits, ["host", "path", "seen"], "left")
        return out.select("page_id", "host", "path", F.col("hit.name").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"))

    def literal(r) -> Column:
        return F.struct(F.lit(r[0]).alias("ord"), F.lit(r[1]).alias("verdict"), F.lit(r[2]).cast("string").alias("name"), F.lit(r[3]).alias("pattern"), F.lit(r[5]).alias("site"))

    lookup = F.create_map(*(x for t, found in sorted(index.items()) for x in (F.lit(t), F.array(*map(literal, found)))))
    keys = F.array(*map(F.lit, sorted(index)))
    fetched = F.flatten(F.transform(F.array_intersect(_tokens(F.col("seen")), keys), lambda t: F.element_at(lookup, t)))
    full = F.concat("host", "path")  # the case of a path counts for site rules
    out = urls.withColumn("cands", fetched)
    out = out.withColumn("hit", F.array_min(F.filter("cands", lambda r: F.when(r["site"], F.regexp_like(full, r["pattern"])).otherwise(F.regexp_like(F.col("seen"), r["pattern"])))))
    return out.select("page_id", "host", "path", F.col("hit.name").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), F.size("cands").cast("long").alias("n_candidates"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sites = sorted(SITE_RULES, key=lambda r: -len(r.host + r.path))
    fits = lambda r: f"((host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}))"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {q(r.host + r.path)}" for r in sites) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN {q(r.verdict)}" for r in sites) + " " + " ".join(f"WHEN regexp_matches(seen, {q(r.pattern)}) THEN {q(r.verdict)}" for r in pattern_rules()) + " ELSE 'allow' END"
    low = lambda x: f"translate({x}, {q(string.ascii_uppercase)}, {q(string.ascii_lowercase)})"
    return rf"""
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {low("regexp_extract(rest, '^[^#]*')")} AS seen FROM r)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM s"""


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": _oracle()}
