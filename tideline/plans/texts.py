"""Queries on scalar functions: text, URLs, dates, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, math, text
from ..operators import scoring
from .catalog import query, table
from .substrate import news


@query("text_clean", "doc_id i, clean_md5 s, joined_md5 s", "SELECT doc_id, md5(c) AS clean_md5, md5(CASE WHEN lang = 'en' THEN lang || '. ' || c ELSE lang END) AS joined_md5 FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def _text_clean(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.clean_text("text")).alias("clean_md5"), F.md5(text.title_and_summary("lang", F.when(F.col("lang") == "en", F.col("text")))).alias("joined_md5"))


@query("string_fns", "o_orderkey i, starts b, ends b, year i, head s, tail s", "SELECT o_orderkey, starts_with(o_orderpriority, '1') AS starts, ends_with(o_orderpriority, 'M') AS ends, CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INTEGER) AS year, split_part(o_orderpriority, '-', 1) AS head, substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS tail FROM orders")
def _string_fns(spark, sf):
    o = table(spark, sf, "orders")
    parts = F.split("o_orderpriority", "-", 2)
    return o.select("o_orderkey", F.startswith("o_orderpriority", F.lit("1")).alias("starts"), F.endswith("o_orderpriority", F.lit("M")).alias("ends"), F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 1, 4).cast("int").alias("year"), parts[0].alias("head"), parts[1].alias("tail"))


@query("hash_ids", "doc_id i, text_sha s, news_id s", "SELECT doc_id, sha256(text) AS text_sha, sha256(lang || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || source || chr(31) || text) AS news_id FROM documents")
def _hash_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("text_sha"), text.text_id("lang", "doc_id", "source", "text").alias("news_id"))


@query("canonical_url", "page_id i, url s, path s", "SELECT page_id, CASE WHEN h <> '' THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) || '://' || lower(h) || regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^#]*)', 1) ELSE u END AS url, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1) AS path FROM (SELECT page_id, u, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]+)', 1) AS h FROM (SELECT page_id, trim(CASE WHEN page_id % 5 = 0 THEN upper(url) ELSE url END) AS u FROM pages))")
def _canonical_url(spark, sf):
    p = table(spark, sf, "pages").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.upper("url")).otherwise(F.col("url")))
    return p.select("page_id", text.canonical_url("url").alias("url"), text.url_path("url").alias("path"))


@query("context_extract", "doc_id i, context s", "SELECT doc_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(keep), lambda s: {'i': list_position(keep, s), 's': s})), lambda x: x.s), ' '), '') AS context FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(c, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda s: regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])(whether|then|reed|stand)([^\\p{L}\\p{N}_]|$)')) AS keep FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents))")
def _context(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.company_context("text", ["whether", "then", "reed", "stand"]).alias("context"))


@query("word_count", "doc_id i, function_words i, few b", "SELECT doc_id, n AS function_words, n < 2 AS few FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: lower(w) IN ('the', 'and', 'of', 'to', 'in', 'for', 'with', 'is', 'on', 'its'))) AS n FROM documents)")
def _word_count(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.word_count("text").alias("function_words"))
    return d.withColumn("few", F.col("function_words") < 2)


@query("case_map", "event_id i, label s", "SELECT event_id, label FROM news", "news")
def _case_map(spark, sf):
    return news(spark, sf)


@query("eligibility", "event_id i, eligible b", "SELECT event_id, NOT (regexp_matches(title, '(?i)^error [0-2]$') OR starts_with('/' || title, '/view')) AND trim(title) <> '' AND coalesce(relevance >= 0.5, false) AS eligible FROM news", "news")
def _eligibility(spark, sf):
    n = news(spark, sf).withColumn("url", F.concat(F.lit("https://example.test/"), "title", F.lit("?x=1")))
    return n.select("event_id", text.eligible("title", "url", "title", "relevance", r"(?i)^error [0-2]$", "/view").alias("eligible"))


@query("normalized_title", "c_custkey i, title s", "SELECT c_custkey, 'full ' || lower(c_name) || ' strasse fi ' || lower(c_mktsegment) || ' é' AS title FROM customer")
def _normalized(spark, sf):
    """Full-width letters, ligatures, sharp s, a combining accent and white space of several kinds."""
    c = table(spark, sf, "customer")
    title = F.concat(F.lit(" ＦＵＬＬ\u00a0"), "c_name", F.lit("\t\u3000Straße \n ﬁ "), "c_mktsegment", F.lit("  E\u0301 "))
    return c.select("c_custkey", text.normalized(title).alias("title"))


@query("date_fns", "o_orderkey i, stamp t, day d, year i, month s, middle d, three_back d", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%dT%H%M%S'), '%Y%m%dT%H%M%S') AS stamp, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate AS DATE) + CAST(floor((DATE '2001-12-31' - CAST(o_orderdate AS DATE)) / 2) AS INTEGER) AS middle, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR AS DATE) AS three_back FROM orders")
def _date_fns(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    compact = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")
    return o.select("o_orderkey", dates.parse_compact(compact).alias("stamp"), "day", F.year("day").alias("year"), dates.month("day").alias("month"), dates.midpoint("day", F.lit("2001-12-31").cast("date")).alias("middle"), dates.years_before("day", 3).alias("three_back"))


@query("tz_local_date", "event_id i, local_day d", "SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS local_day FROM events")
def _tz_local(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", dates.local_date(F.col("ts").cast("timestamp")).alias("local_day"))


@query("softmax", "vec_id i, top i, p_top f6, p_first f6, total f6", "SELECT vec_id, list_position(e, list_max(e)) - 1 AS top, list_max(x) / list_sum(x) AS p_top, x[1] / list_sum(x) AS p_first, 1 AS total FROM (SELECT vec_id, e, list_transform(e, lambda v: exp(v - list_max(e))) AS x FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings))")
def _softmax(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("p", math.softmax("embedding"))
    return e.select("vec_id", math.argmax("embedding").alias("top"), F.array_max("p").alias("p_top"), F.col("p")[0].alias("p_first"), F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("clip", "event_id i, clipped f6", "SELECT event_id, greatest(-0.4, least(0.4, score)) AS clipped FROM news", "news")
def _clip(spark, sf):
    return news(spark, sf).select("event_id", math.clip("score", -0.4, 0.4).alias("clipped"))


def _toy_model():
    """A stand-in for a neural model: counts letters, so that its scores can be checked in SQL."""

    def predict(texts: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for t in texts:
            a, b, n = t.count("a"), t.count("e"), max(1, len(t))
            out.append((a / n, b / n, 1 - a / n - b / n))
        return out

    return predict


@query("score_texts", "doc_id i, positive f6, negative f6, label s", "SELECT doc_id, a AS positive, b AS negative, CASE WHEN a >= b AND a >= 1 - a - b THEN 'positive' WHEN b >= 1 - a - b THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT doc_id, (length(text) - length(replace(text, 'a', ''))) / CAST(greatest(1, length(text)) AS DOUBLE) AS a, (length(text) - length(replace(text, 'e', ''))) / CAST(greatest(1, length(text)) AS DOUBLE) AS b FROM documents)")
def _score_texts(spark, sf):
    """Each distinct text scored once by an injected model, and joined back by its hash."""
    d = scoring.with_text_hash(table(spark, sf, "documents"))
    unique = d.groupBy("text_sha256").agg(F.first("text").alias("text"))
    return d.join(scoring.score_texts(unique, _toy_model), "text_sha256")


@query("truncation", "doc_id i, full_tokens i, used_tokens i, removed_tokens i, truncated b", "SELECT doc_id, n AS full_tokens, least(n, 512) AS used_tokens, greatest(n - 512, 0) AS removed_tokens, n > 512 AS truncated FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ ]+')) AS n FROM documents)")
def _truncation(spark, sf):
    return scoring.truncation(table(spark, sf, "documents"), "text", 512, lambda t: sum(map(bool, t.split(" "))))
