"""Quotation linking: quoted passages are parsed by level, normalised, hashed and joined to the messages that they quote;
messages then stand without quotes, in reply order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpointed, table

#: Quote marks at the start of a line, without a repeated group: the regular expressions of the JVM recurse into those.
MARKS = r"^[ \t>]*>"
#: A line that introduces a quotation.
INTRODUCES = r"^(?:On|Am|Le|El|Il)\b.{1,300}\b(?:wrote|schrieb[^:\n]{0,80}|a écrit|escribió|ha scritto) ?:[ \t]*$"
#: Turns in one bucket of a conversation: the part of it that one task sorts.
BUCKET = 1_024
#: Characters that part passages; neither is a letter or digit.
PART, TAG = "\x01", "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often inner lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _blank(text: Column) -> Column:
    return F.length(F.translate(text, " \t", "")) == 0


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """(level, body, intro) of each line: how many quote marks it has, what follows them, and whether it introduces a quotation."""

    def line(x: Column) -> Column:
        level = F.when(F.instr(x, ">") == 0, 0).otherwise(_level(x))
        opens = F.substring(x, 1, 2).isin("On", "Am", "Le", "El", "Il")
        return F.struct(level.alias("level"), F.when(level == 0, x).otherwise(F.regexp_replace(x, MARKS + "[ \t]?", "")).alias("body"), (opens & F.regexp_like(x, F.lit(INTRODUCES))).alias("intro"))

    return F.transform(F.split(text, "\n"), line)


def _passages(lines: Column) -> Column:
    """(level, p) of the normalised paragraphs and lines; a blank or introducing line, or one of another level, parts paragraphs.

    One pass over the lines: each line that begins a paragraph is marked, and the marked text is split again.
    """
    says = lambda s: ~s["intro"] & ~_blank(s["body"])

    def marked(s: Column, k: Column, all_: Column) -> Column:
        before = F.get(all_, k - 1)
        goes_on = (k > 0) & says(before) & (before["level"] == s["level"])
        body = F.translate(s["body"], PART + TAG, "  ")
        return F.when(~says(s), "").when(F.coalesce(goes_on, F.lit(False)), body).otherwise(F.concat(F.lit(PART), s["level"].cast("string"), F.lit(TAG), body))

    text = let(lines, lambda all_: F.array_join(F.transform(all_, lambda s, k: marked(s, k, all_)), "\n"))
    parts = F.filter(F.split(text, PART), lambda p: F.instr(p, TAG) > 0)
    return F.flatten(
        F.transform(
            F.transform(parts, lambda p: F.struct(F.substring_index(p, TAG, 1).cast("int").alias("level"), F.substring_index(p, TAG, -1).alias("body"))),
            lambda s: F.transform(F.concat(F.array(s["body"]), F.split(s["body"], "\n")), lambda p: F.struct(s["level"].alias("level"), _normal(p).alias("p"))),
        )
    )


def _own(lines: Column) -> Column:
    """What a message says itself: its lines without quotes and introductions, runs of blank lines as one, none at the ends."""
    kept = F.transform(F.filter(lines, lambda s: (s["level"] == 0) & ~s["intro"]), lambda s: s["body"])
    text = let(kept, lambda all_: F.array_join(F.transform(F.filter(F.transform(all_, lambda x, k: F.struct(x.alias("x"), (~_blank(x)).alias("says"), F.coalesce((k > 0) & ~_blank(F.get(all_, k - 1)), F.lit(False)).alias("after"))), lambda s: s["says"] | s["after"]), lambda s: F.when(s["says"], s["x"]).otherwise("")), "\n"))
    return F.regexp_replace(text, r"\n\z", "")


def _before(units: DataFrame, key: list[str]) -> DataFrame:
    """Of units (key, turn, level), the quoted ones (level >= 1) with `source`, the last earlier turn that has the same key at level 0.

    A window within a bucket of turns, and what earlier buckets carry over from an aggregation, so that no pair of
    messages is made and a frequent passage of a long conversation is split.
    """
    units = units.withColumn("bucket", F.floor(F.col("turn") / BUCKET)).withColumn("own", F.when(F.col("level") == 0, F.col("turn")))
    asked = units.where("level > 0").select(*key).distinct()
    units = units.join(asked, key, "left_semi")
    within = units.withColumn("near", F.max("own").over(W.Window.partitionBy(*key, "bucket").orderBy("turn").rangeBetween(W.Window.unboundedPreceding, -1)))
    carried = units.groupBy(*key, "bucket").agg(F.max("own").alias("own")).withColumn("far", F.max("own").over(W.Window.partitionBy(*key).orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1))).drop("own")
    return within.where("level > 0").join(carried, [*key, "bucket"]).withColumn("source", F.coalesce("near", "far")).where("source IS NOT NULL")


def reply_parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): the earlier message that most of what a message quotes stands in.

    The outermost quote level that links decides, then the quoted characters, then the later message.
    """
    quoting = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    # only conversations in which a line is quoted can have links; one row for each of them tells
    marked = quoting.where((F.instr("text", ">") > 0) & F.regexp_like("text", F.lit(r"(?m)^[ \t>]*>"))).select("conv_id").distinct()
    quoting = quoting.join(marked, "conv_id", "left_semi")
    units = quoting.select("conv_id", "turn", F.inline(_passages(parsed(F.col("text"))))).where("length(p) > 0")
    # two hashes, so that different passages of a conversation are told apart at any size
    units = units.select("conv_id", "turn", "level", F.xxhash64("p").alias("h"), F.xxhash64(F.lit(1), "p").alias("g"), F.length("p").alias("chars")).distinct()
    found = _before(units, ["conv_id", "h", "g"])
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "source")).getField("source").alias("parent_turn"), F.sum("n").alias("n_linked"))


def thread_roots(parents: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(conv_id, turn, root_turn) of each reply, by pointer doubling: the rounds are the logarithm of the longest chain."""
    roots = checkpointed(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn")))
    for _ in range(max_rounds):
        up = roots.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"))
        moved = checkpointed(roots.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), F.col("above").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return roots
    raise RuntimeError(f"chains of replies are longer than 2^{max_rounds}")


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent_turn, root_turn, position, n_quoted, n_linked, text) of each row of `messages`.

    text is the message without quoted lines and the lines that introduce them, its runs of blank lines as one; one without quotes is unchanged. A message
    that quotes nothing known starts a thread. position counts from 0 within a conversation: threads by their first turn,
    each thread by turn, which puts every reply after what it answers. Null texts stay null and quote nothing. Rows with
    a null conv_id or turn have no links and a null position. Rows that repeat a turn share its links; an empty table gives an empty
    result; other columns are not read. Texts are read whole, in time in proportion to their length, whatever they nest.
    """
    slim = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parents = checkpointed(reply_parents(slim))
    if parents.limit(1).count():
        parents = parents.join(thread_roots(parents), ["conv_id", "turn"])
    else:
        parents = parents.withColumn("root_turn", F.col("parent_turn"))
    out = slim.join(parents, ["conv_id", "turn"], "left").withColumn("__lines", F.when(F.instr("text", ">") > 0, parsed(F.col("text"))))
    out = out.withColumn("n_quoted", F.coalesce(F.size(F.filter("__lines", lambda s: s["level"] > 0)), F.lit(0)).cast("long")).withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    out = out.withColumn("text", F.when(F.col("n_quoted") > 0, _own(F.col("__lines"))).otherwise(F.col("text"))).withColumn("root_turn", F.coalesce("root_turn", "turn"))
    return with_positions(out.drop("__lines")).select("conv_id", "turn", "role", "parent_turn", "root_turn", "position", "n_quoted", "n_linked", "text")


def with_positions(messages: DataFrame) -> DataFrame:
    """Add `position`: how many rows of the conversation stand before, by (root_turn, turn, role, text).

    Rows are numbered in cells of a thread's turns; cells are added up within buckets of threads, and buckets within
    conversations, so that neither a long conversation nor a long thread is sorted by one task.
    """
    out = messages.withColumn("__c", F.floor(F.col("turn") / BUCKET))
    cells = out.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "root_turn", "__c").agg(F.count("*").alias("n"))
    cells = cells.withColumn("__b", F.floor(F.col("root_turn") / BUCKET))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    buckets = cells.groupBy("conv_id", "__b").agg(F.sum("n").alias("n"))
    buckets = buckets.select("conv_id", "__b", earlier(W.Window.partitionBy("conv_id").orderBy("__b")).alias("__base"))
    cells = cells.withColumn("__before", earlier(W.Window.partitionBy("conv_id", "__b").orderBy("root_turn", "__c"))).join(buckets, ["conv_id", "__b"])
    cells = cells.select("conv_id", "root_turn", "__c", (F.col("__base") + F.col("__before")).alias("__first"))
    here = F.row_number().over(W.Window.partitionBy("conv_id", "root_turn", "__c").orderBy("turn", "role", "text"))
    return out.withColumn("__own", here).join(cells, ["conv_id", "root_turn", "__c"], "left").withColumn("position", F.col("__first") + F.col("__own") - 1).drop("__c", "__own", "__first")


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotes(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "parent_turn", "root_turn", "position", "n_quoted", "n_linked", F.md5("text").alias("text_md5"))


def _oracle() -> str:
    """The same from lines, islands of lines, pairs of passages and chains of replies."""
    marks = r"'^[ \t>]*>'"
    normal = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, i, x, length(regexp_extract(x, {marks})) - length(replace(regexp_extract(x, {marks}), '>', '')) AS level, regexp_matches(x, '{INTRODUCES}') AS intro
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
b AS (SELECT *, CASE WHEN level > 0 THEN regexp_replace(x, '^[ \t>]*>[ \t]?', '') ELSE x END AS body FROM l WHERE NOT intro),
o AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS island FROM b WHERE trim(body, ' ' || chr(9)) <> ''),
u AS (SELECT DISTINCT * FROM (
  SELECT conv_id, turn, level, {normal.format("string_agg(body, ' ' ORDER BY i)")} AS p FROM o GROUP BY conv_id, turn, level, island
  UNION ALL SELECT conv_id, turn, level, {normal.format("body")} FROM o) WHERE length(p) > 0),
s AS (SELECT q.conv_id, q.turn, q.level, q.p, max(a.turn) AS source FROM u q JOIN u a ON a.conv_id = q.conv_id AND a.p = q.p AND a.level = 0 AND a.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
v AS (SELECT conv_id, turn, level, source, sum(length(p)) AS chars, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT conv_id, turn, source AS parent_turn, n_linked FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, source DESC) AS k FROM v) WHERE k = 1),
r AS (SELECT conv_id, turn, parent_turn AS above FROM p UNION SELECT r.conv_id, r.turn, p.parent_turn FROM r JOIN p ON p.conv_id = r.conv_id AND p.turn = r.above),
q AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted, string_agg(x, chr(10) ORDER BY i) FILTER (level = 0 AND NOT intro) AS own FROM l GROUP BY 1, 2),
t AS (SELECT c.conv_id, c.turn, c.role, p.parent_turn, coalesce(root.root_turn, c.turn) AS root_turn, coalesce(q.n_quoted, 0) AS n_quoted, CAST(coalesce(p.n_linked, 0) AS BIGINT) AS n_linked,
  CASE WHEN q.n_quoted > 0 THEN regexp_replace(regexp_replace(regexp_replace(coalesce(q.own, ''), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g'), '\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), '^[ \t]+$', '') ELSE c.text END AS text
  FROM conversations c LEFT JOIN q USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, min(above) AS root_turn FROM r GROUP BY 1, 2) root USING (conv_id, turn))
SELECT conv_id, turn, role, parent_turn, root_turn, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn, role, text) - 1 AS position, n_quoted, n_linked, md5(text) AS text_md5 FROM t"""


QUERIES = {"op3_quote_links": op3_quote_links}
ORACLES = {"op3_quote_links": _oracle()}
