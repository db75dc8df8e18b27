"""Best-fit packing of token sequences in supersteps: documents and gaps are sorted by size, a sweep gives each document its
successor, the smallest free gap that holds it, ranks resolve who comes first, gaps shrink, and the next superstep begins.

The sweep goes from the largest size down. Gaps that it passes pile up, and each document takes the gap on top, which is the
smallest that holds it and is not taken by a longer document, or by one of like length and smaller rank. How high the pile
is before each size follows from the counts of gaps and documents by size, so each row knows its level from its rank alone,
and a document and its gap are neighbours on one level: nothing is swept in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpointed, partitions, small_batches, table

CAPACITY = 1024
END_ID = 2
#: A space beside more white space: there a word with its space before it may not start a token of its own.
ODD_SPACE = re.compile(r" \s|\s ")
#: Entries after which a task's table of words starts anew, to bound its memory.
TABLE_ROWS = 400_000
GROUP_CHARS = 4_000_000
#: A superstep over so many documents and slots of gaps at most, as counted, runs as one task without shuffles.
TOGETHER_ROWS = 10_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenTable:
    """Ids, as little-endian unsigned 32-bit bytes, of distinct words with the space before them.

    The merges are run by tiktoken, whose ranks are the tokenizer's own ids; texts that hold a special token, or a space
    beside more white space, go to the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # tokens that start with a space
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.ids: dict[str, bytes] = {}

    def fill(self, words: list[str]) -> None:
        """Encode new words all in one text; where a token starts with a space, a word starts."""
        import numpy as np

        words = [w for w in words if w]
        self.ids[""] = np.array(self.fast.encode_ordinary(" "), "<u4").tobytes()
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)) if words else [], "<u4")
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words):
            raise ValueError("a token of this vocabulary crosses a space")
        data, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        self.ids.update(zip(words, map(data.__getitem__, map(slice, at, at[1:]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, exactly the tokenizer's.

        The tokenizer's pattern starts a token at each single space after a character that is no white space, and no
        merge crosses tokens; so words can be looked up apart.
        """
        import numpy as np

        out: list[bytes] = []
        for at in _groups(texts):
            group = texts[at]
            parts = [None if ODD_SPACE.search(t) or any(x in t for x in self.special) else t.split(" ") for t in group]
            words = set(chain.from_iterable(p[1:] for p in parts if p))
            if len(self.ids) + len(words) > TABLE_ROWS:
                self.ids.clear()
            self.fill([w for w in words if w not in self.ids])
            get = self.ids.__getitem__
            for t, p in zip(group, parts):
                if p is None:
                    out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                else:
                    out.append(b"".join([np.array(self.fast.encode_ordinary(p[0]), "<u4").tobytes(), *map(get, p[1:])]))
        return out


def _groups(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): only a document over `capacity` is cut, and only its first piece may be shorter."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    start, length, piece = 0, first, 0
    while start < n:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, length, piece = start + length, capacity, piece + 1


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with the end id after them."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TokenTable(tokenizer_file)
        for batch in batches:
            of, rows = [], []
            for i, ids in enumerate(t.encode([x or "" for x in batch.column(1).to_pylist()])):
                for p in pieces_of(ids + end, capacity):
                    of.append(i)
                    rows.append(p)
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def matched(docs: DataFrame, gaps: DataFrame, longest: int, shortest: int, together: bool = False) -> DataFrame:
    """(__k, length, seq, slot, free) of each document (__k, length): the gap (seq, free) that a sweep gives it, or nulls.

    A gap that holds several documents of the longest length has a slot for each, all but one of that size, so that one
    superstep fills it. Ranks within a size are numbered in salted groups, so a size that a third of all rows share is split;
    a level has two rows for each size at most. `together`, for few rows, runs the same sweep in one task: a single partition
    needs no shuffle for windows, and joins that would still have one are broadcast.
    """
    near = F.broadcast if together else (lambda df: df)
    salts = F.lit(max(8, partitions(docs.sparkSession)))
    several = F.greatest(F.floor(F.col("free") / longest), F.lit(1))
    slots = gaps.where(F.col("free") >= shortest).select("seq", "free", F.posexplode(F.sequence(F.lit(1).cast("long"), several)).alias("slot", "of"))
    slots = slots.select(F.when(F.col("slot") == 0, F.col("free") - (several - 1) * longest).otherwise(longest).cast("long").alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot", "free")
    rows = slots.unionByName(docs.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("__k").alias("id"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("free")))
    rows = (rows.coalesce(1) if together else rows).withColumn("salt", F.pmod(F.xxhash64("id", "slot"), salts))
    before = lambda w: w.rowsBetween(W.Window.unboundedPreceding, -1)
    groups = rows.groupBy("size", "kind", "salt").agg(F.count("*").alias("n"))
    base = groups.withColumn("base", F.coalesce(F.sum("n").over(before(W.Window.partitionBy("size", "kind").orderBy("salt"))), F.lit(0).cast("long")))
    sizes = groups.groupBy("size").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("open"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("asked"))
    down = W.Window.orderBy(F.desc("size"))  # over as many rows as there are sizes, which the capacity bounds
    up_to = down.rowsBetween(W.Window.unboundedPreceding, 0)
    piled = sizes.withColumn("sum", F.sum(F.col("open") - F.col("asked")).over(up_to))
    piled = piled.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(up_to)))
    piled = piled.select("size", (F.coalesce(F.lag("after").over(down), F.lit(0)) + F.col("open")).alias("top"), F.coalesce(F.lag("after").over(down), F.lit(0)).alias("under"))
    own = F.row_number().over(W.Window.partitionBy("size", "kind", "salt").orderBy("id", "slot"))
    rows = rows.withColumn("own", own).join(near(base.drop("n")), ["size", "kind", "salt"]).join(F.broadcast(piled), "size")  # as many rows as sizes
    rank = F.col("base") + F.col("own") - 1
    rows = rows.withColumn("level", F.when(F.col("kind") == 0, F.col("under") + 1 + rank).otherwise(F.col("top") - rank))
    none = F.col("level") < 1  # apart from each other, as many sizes may have some
    on = W.Window.partitionBy("level", F.when(none, F.col("id"))).orderBy(F.desc("size"), "kind")
    found = rows.select("kind", "id", "size", *(F.when(~none, F.lag(c).over(on)).alias(f"__{c}") for c in ("id", "slot", "free"))).where("kind = 1")
    return found.select(F.col("id").alias("__k"), F.col("size").alias("length"), F.col("__id").alias("seq"), F.col("__slot").alias("slot"), F.col("__free").alias("free"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, together_rows: int = TOGETHER_ROWS) -> DataFrame:
    """Add sequence_id and offset to pieces of (doc_id, piece, length, ...).

    Full pieces are sequences. A superstep opens sequences for documents that no gap will ever hold, the first one as many
    as all tokens need; then documents meet gaps, and gaps shrink by what they took. Only sums over documents and gaps reach
    the driver. Supersteps are few (5 to 10 as measured): in each, every gap is filled as far as the longest document left goes.
    The last ones have few rows left: once no more than `together_rows` meet, a superstep is one task instead of a dozen
    stages of as many tasks as there are shuffle partitions.
    """
    spark = pieces.sparkSession
    keyed = checkpointed(pieces.withColumn("__k", F.monotonically_increasing_id()))
    docs = keyed.where(F.col("length") < capacity).select("__k", F.col("length").cast("long").alias("length"))
    gaps = spark.createDataFrame([], "seq long, free long")
    steps: list[DataFrame] = []
    opened, widest, open_gaps, room, before = 0, 0, 0, 0, None
    while True:
        out = F.col("length") > widest  # no gap will hold these
        large = F.count_if(out & (F.col("length") > capacity // 2))
        left = docs.agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.sum(F.when(out, F.col("length"))).alias("tokens"), large.alias("large")).first()
        if left["longest"] is None:
            break
        more = max(left["large"], -(-(left["tokens"] or 0) // capacity), 1 if left["n"] == before else 0)
        new = spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("free"))
        opened += more
        most = left["n"] + open_gaps + more + (room + more * capacity) // max(left["longest"], 1)  # each slot but one of a gap takes the longest length
        together = most <= together_rows
        gaps = gaps.unionByName(new).coalesce(1) if together else gaps.unionByName(new)
        found = checkpointed(matched(docs, gaps, left["longest"], left["shortest"], together))
        took = (found.coalesce(1) if together else found).where("seq IS NOT NULL")
        steps.append(took.select("__k", "length", "seq", "slot", "free", F.lit(len(steps)).alias("step")))
        taken = took.groupBy("seq").agg(F.sum("length").alias("taken"))
        gaps = gaps.join(F.broadcast(taken) if together else taken, "seq", "left").select("seq", (F.col("free") - F.coalesce("taken", F.lit(0))).alias("free"))
        gaps = checkpointed(gaps.where(F.col("free") >= max(left["shortest"], 1)))  # documents left are no shorter later on
        docs, before = found.where("seq IS NULL").select("__k", "length"), left["n"]
        widest, open_gaps, room = gaps.agg(F.coalesce(F.max("free"), F.lit(0)), F.count("*"), F.coalesce(F.sum("free"), F.lit(0))).first()
    where = keyed.where(F.col("length") >= capacity).select("__k", (-1 - F.col("__k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if steps:
        w = W.Window.partitionBy("seq", "step").orderBy("slot").rowsBetween(W.Window.unboundedPreceding, 0)
        offset = capacity - F.col("free") + F.sum("length").over(w) - F.col("length")
        where = where.unionByName(reduce(DataFrame.unionByName, steps).select("__k", F.col("seq").alias("sequence_id"), offset.alias("offset")))
    return keyed.join(where, "__k").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence that holds them and their place in it.

    Null texts count as empty: one piece with only the end id. Equal or null ids are packed apart. Long texts are cut,
    never shortened. An empty table gives an empty result; other columns are not read.
    """
    return pack(token_pieces(docs, tokenizer_file, capacity, end_id), capacity)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
