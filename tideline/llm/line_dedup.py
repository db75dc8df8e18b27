"""Line dedup: a suffix array over line-id sequences, sorted by distributed prefix doubling, gives the repeated runs of lines;
later copies are deleted.

A document is the sequence of the ids of its non-blank lines, and a suffix starts at each line. Round 0 sorts the lines that
stand twice; round k + 1 sorts the suffixes that share 2^k lines with another by the ranks of both their halves, so that a
rank is the place in the suffix array of the interval whose common prefix holds 2^(k+1) lines. A suffix alone in its interval
is in its final place and leaves. The interval whose longest common prefix reaches m lines is found by two ranks of the
largest power of two in m, that of the first lines and that of the last ones.

Every line has a character, so a run that counts from `min_chars` characters holds a part of at most `min_chars` lines that
does. The doubling therefore ends at that depth, which no interval in question exceeds. Each line takes the shortest counting run from
it on and the shortest one up to it; where their interval has an earlier member, they are a later copy. Their union is exactly what lies in maximal repeated runs: each line of a maximal run is in a counting run from a
line of it on, or ends one. Ranks compare lines by two 64-bit hashes, everything after that by exact equality.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpointed, table

#: A repeated run counts from so many characters. Every line in a run has one at least, which bounds the doubling.
MIN_CHARS = 50
#: A key with more than this part of all rows is hot; so many keys can be hot at most.
HOT_KEYS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often inner lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    """(x, i) of each non-blank line: the line and its place among all lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.regexp_like(s["x"], F.lit(r"[^\x20\x09-\x0D]")))


def _counted(rows: DataFrame, by: list[str], value: Column | None = None) -> DataFrame:
    """Keys that stand twice, with their count `n`; with their place in the sorted order as `rank`, or with `value`, an aggregate of their rows."""
    twice = rows.groupBy(*by).agg(F.count("*").alias("n"), *([] if value is None else [value])).where("n > 1")
    if value is None:
        twice = twice.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    return checkpointed(twice)


def _attach(rows: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """`rows` whose key is in `found`, with its `value`.

    Hot keys, HOT_KEYS at most, are broadcast; their rows are dealt by their place instead of their key, so that a line or
    passage that a third of all documents share is spread like any other.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") * HOT_KEYS > total).select(*by, F.col(value).alias("__hot"))
    cold = found.where(F.col("n") * HOT_KEYS <= total).select(F.col(by[0]).alias("__k"), *by[1:], F.col(value).alias("__cold"))
    both = rows.join(F.broadcast(hot), by, "left").withColumn("__k", F.when(F.col("__hot").isNull(), F.col(by[0])).otherwise(F.xxhash64("doc_id", "th", "pos")))
    both = both.join(cold, ["__k", *by[1:]], "left").withColumn(value, F.coalesce("__hot", "__cold"))
    return both.where(F.col(value).isNotNull()).select(*rows.columns, value)


def suffix_ranks(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, chars, seg, before, n0, n1, ...): of each line that stands twice, the ranks of the suffix there by its
    first 2^k lines (null where no other has them), as deep as a shortest run of `min_chars` characters can reach.

    th tells apart the texts of one id; pos numbers the non-blank lines from 0. Lines without a line that stands only once
    between them form a segment; before counts the characters of a segment's earlier lines.
    """
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "th", "pos", F.xxhash64("line.x").alias("h"), F.xxhash64(F.lit(1), "line.x").alias("g"), F.length("line.x").cast("long").alias("chars"))
    kept = _attach(lines, _counted(lines, ["h", "g"]), ["h", "g"], "rank").select("doc_id", "th", "pos", "chars", F.col("rank").alias("n0"))
    doc = W.Window.partitionBy("doc_id", "th").orderBy("pos")
    kept = kept.repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "pos"]).withColumn("seg", F.col("pos") - F.row_number().over(doc))
    seg = W.Window.partitionBy("doc_id", "th", "seg").orderBy("pos")
    base = checkpointed(kept.withColumn("before", F.sum("chars").over(seg) - F.col("chars")))
    depth = max(0, min_chars.bit_length() - 1)
    levels, now = [], base.select("doc_id", "th", "pos", F.col("n0").alias("a"), F.col("chars").alias("sum"), F.col("chars").alias("first"), F.col("chars").alias("last"))
    for k in range(depth):
        ahead = doc.rangeBetween(1 << k, 1 << k)  # the half that begins 2^k lines on, if it stands twice too
        pairs = now.withColumns({"b": F.max("a").over(ahead), "sum": F.col("sum") + F.max("sum").over(ahead), "last": F.max("last").over(ahead)}).where("b IS NOT NULL")
        # a part of a shortest counting run falls short without its first or without its last line
        pairs = checkpointed(pairs.where(F.col("sum") - F.greatest("first", "last") < min_chars))
        found = _counted(pairs, ["a", "b"])
        now = checkpointed(_attach(pairs, found, ["a", "b"], "rank").select("doc_id", "th", "pos", F.col("rank").alias("a"), "sum", "first", "last"))
        if not now.limit(1).count():
            break
        levels.append(now.select("doc_id", "th", "pos", F.lit(k + 1).alias("k"), "a"))
    if not levels:
        return base.withColumns({f"n{k + 1}": F.lit(None).cast("long") for k in range(depth)})
    wide = reduce(DataFrame.unionByName, levels).groupBy("doc_id", "th", "pos").agg(*(F.max(F.when(F.col("k") == k + 1, F.col("a"))).alias(f"n{k + 1}") for k in range(depth)))
    return base.join(wide, ["doc_id", "th", "pos"], "left")


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, lines): the later copies among the shortest counting runs from and up to each line.

    Earlier means a smaller (doc_id, th, pos).
    """
    depth = max(0, min_chars.bit_length() - 1)
    now = suffix_ranks(docs, min_chars)
    w = W.Window.partitionBy("doc_id", "th", "seg").orderBy("pos")
    now = now.withColumn("ends", F.array("n0", *(F.lag(f"n{k}", (1 << k) - 1).over(w) for k in range(1, depth + 1))))  # the runs that end here
    names = F.array(*(f"n{k}" for k in range(depth + 1)))  # the runs that start here
    # each line has a character, so the lines with less than min_chars between here and them are the run, its last line included
    now = now.withColumn("end", F.col("before") + F.col("chars"))
    near = W.Window.partitionBy("doc_id", "th", "seg").orderBy("before").rangeBetween(0, min_chars - 1)
    now = now.withColumns({"lines": F.count("*").over(near), "last": F.last("ends").over(near), "reach": F.max("end").over(near) - F.col("before")})
    # and backward: the lines that end less than min_chars before the end of this one
    back = W.Window.partitionBy("doc_id", "th", "seg").orderBy("end").rangeBetween(1 - min_chars, 0)
    now = now.withColumns({"lines_up": F.count("*").over(back), "first": F.first(names).over(back), "reach_up": F.col("end") - F.min("before").over(back)})

    def run(pos: Column, lines: Column, first: Column, last: Column) -> Column:
        level = F.floor(F.log2(lines) + 1e-9).cast("int")
        return F.struct(pos.cast("int").alias("pos"), lines.cast("int").alias("lines"), F.get(first, level).alias("a"), F.get(last, level).alias("b"))

    onward = F.when(F.col("reach") >= min_chars, run(F.col("pos"), F.col("lines"), names, F.col("last")))
    # one that falls short without its last line is the shortest run from its first line on already
    upward = F.when(F.col("reach_up") - F.col("chars") >= min_chars, run(F.col("pos") - F.col("lines_up") + 1, F.col("lines_up"), F.col("first"), F.col("ends")))
    runs = now.select("doc_id", "th", F.inline(F.filter(F.array(onward, upward), lambda r: r.isNotNull() & r["a"].isNotNull() & r["b"].isNotNull())))
    runs = checkpointed(runs)
    place = F.struct("doc_id", "th", "pos")
    first = _counted(runs, ["a", "b", "lines"], F.min(place).alias("first"))
    return _attach(runs, first, ["a", "b", "lines"], "first").where(place > F.col("first")).select("doc_id", "th", "pos", "lines")


def removed_parts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, parts): per text the disjoint parts of its non-blank lines that are later copies, each from one line up to another."""
    runs = repeated_runs(docs, min_chars).withColumn("to", F.col("pos") + F.col("lines") - 1)
    w = W.Window.partitionBy("doc_id", "th").orderBy("pos", "to")
    runs = runs.withColumn("opens", F.col("pos") > F.coalesce(F.max("to").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(-1)))
    runs = runs.withColumn("part", F.count_if("opens").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    parts = runs.groupBy("doc_id", "th", "part").agg(F.min("pos").alias("pos"), F.max("to").alias("to"))
    return parts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "to")).alias("parts"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with their repeated runs of lines removed but for the first copy, and columns n_lines and n_removed.

    n_lines counts non-blank lines; blank lines stay. Null and empty texts, and rows with a null id, stay as they are. Of rows that repeat an id with the same text, each is treated as the one document they
    are, so none loses lines to the other. Texts are read whole, in time in proportion to their lines; an empty table gives an empty result; other columns of
    `docs` stay, and those named n_lines or n_removed are replaced.
    """
    gone = removed_parts(docs, min_chars).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("parts").alias("__parts"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    both = docs.select(*keep).join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    removed = F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["pos"] + 1)
    both = both.withColumn("n_lines", F.coalesce(F.size(_lines(F.col("text"))).cast("long"), F.lit(0).cast("long"))).withColumn("n_removed", F.coalesce(removed, F.lit(0).cast("long")))
    places = let(_lines(F.col("text")), lambda lines: F.flatten(F.transform("__parts", lambda p: F.transform(F.sequence(p["pos"], p["to"]), lambda k: F.get(lines, k)["i"]))))
    return both.withColumn("text", F.when(F.col("__parts").isNull(), F.col("text")).otherwise(without(F.col("text"), places))).select(*keep, "n_lines", "n_removed")


def without(text: Column, drop: Column) -> Column:
    """A text without the lines at the places in `drop`."""
    return let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i)), "\n"))


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents that keep a line, without repeated runs and with n_chars set anew; columns as in `docs`.

    A document all of whose lines stand earlier in the corpus goes; one that had no line to lose stays.
    """
    out = dedup_lines(docs, min_chars).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


#: For every two places with the same line, the whole run that they share, along the diagonal of the two documents.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, i, x FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
  WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
pairs AS (SELECT b.doc_id, b.pos, b.i, length(b.x) AS chars, a.doc_id AS source, b.pos - a.pos AS ahead FROM lines a JOIN lines b ON a.x = b.x AND (a.doc_id, a.pos) < (b.doc_id, b.pos)),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, source, ahead ORDER BY pos) AS run FROM pairs),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, sum(chars) OVER (PARTITION BY doc_id, source, ahead, run) AS chars FROM runs) WHERE chars >= {MIN_CHARS}),
left_ AS (
  SELECT a.doc_id, string_agg(a.x, chr(10) ORDER BY a.i) AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) a
  ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, CAST(length(coalesce(l.text, '')) AS BIGINT) AS kept_chars, md5(coalesce(l.text, '')) AS kept_md5
FROM documents d LEFT JOIN left_ l USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) n USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": ORACLE}
