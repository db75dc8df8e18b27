"""SentencePiece encoding and decoding by a table of distinct chunks: where no piece crosses a white-space mark, each distinct
marked word of the whole corpus is segmented once, by the shard that owns it, and its ids are joined back by position.

Documents are packed into units, compressed, in buckets that the answers meet without moving a text. A unit sends its distinct
chunks to their owners, packed; an owner segments each chunk once, however many units ask; its answers go to the unit, which
puts ids together in the order of its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, checkpointed, each_row, partitions, small_batches, table

MARK = "\u2581"
#: A run of marks with what follows it up to the next mark.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters at which a unit is written, to bound a task's memory and its table of chunks.
UNIT_CHARS = 8_000_000


def _pack(text: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(text.encode("utf-8", "surrogatepass"))


def _unpack(data: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def _owned(keys: set[str], owners: int) -> list[list[str]]:
    """Keys by their owner, sorted."""
    from zlib import crc32

    by: list[list[str]] = [[] for _ in range(owners)]
    for k in keys:
        by[crc32(k.encode("utf-8", "surrogatepass")) % owners].append(k)
    return [sorted(x) for x in by]


class Segmenter:
    """Ids and decoded text of chunks. A chunk's key is its text without its first mark, marks written as spaces, so no key holds a mark."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.check()
        self.alone = self.sp.piece_to_id(MARK)

    def check(self) -> None:
        """No piece may hold a mark after another character, and the model may not rewrite texts."""
        sp = self.sp
        if any(MARK in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.vocab_size()))):
            raise ValueError("a piece of this model crosses a white-space mark")
        for probe in ("a  b ", "\ufb01 \u00e9\n\tA"):
            if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("this model rewrites texts before it segments them")

    def segment(self, keys: list[str]) -> list[tuple[str, str]]:
        """(ids joined by spaces, decoded text) of each key."""
        found = [ids if k else [self.alone] for k, ids in zip(keys, self.sp.encode([k if k else MARK for k in keys], num_threads=1))]
        return [(" ".join(map(str, ids)), text) for ids, text in zip(found, self.sp.decode(found) if found else [])]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Keys of a text's chunks in their order; each stands for a mark and itself."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in CHUNK.findall(MARK + text.replace(" ", MARK))]


def piece_ids(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = False) -> DataFrame:
    """Per row: n_tokens, sha256 of the ids (end id last) and of the decoded text; with `arrays` the ids and the text too.

    Null texts count as empty: only the end id, decoded "". Texts are encoded whole, however long; equal or null ids
    are encoded apart; an empty table gives an empty result; other columns are not read. `model_file` must lie at the same path on every executor.
    """
    import sentencepiece

    small_batches(docs.sparkSession)
    owners = partitions(docs.sparkSession)
    end = str(sentencepiece.SentencePieceProcessor(model_file=model_file).eos_id())
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(slim.schema["doc_id"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            row = (number, ids, [len(t) for t in texts], _pack("".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, (pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary()))], ["unit", "docs", "sizes", "text"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= UNIT_CHARS or len(ids) >= UNIT_CHARS // 16:
                    yield out()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield out()

    units, drop = bucketed(slim.mapInArrow(pack, f"unit long, docs array<{kind}>, sizes array<int>, text binary"), "unit", owners)

    def split(r: dict) -> Iterator[list[str]]:
        whole, start = _unpack(r["text"]), 0
        for size in r["sizes"]:
            yield Segmenter.chunks(whole[start : start + size])
            start += size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            by = _owned(set(chain.from_iterable(split(r))), owners)
            at = [o for o in range(owners) if by[o]]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([r["unit"]] * len(at), pa.int64()), pa.array([_pack(MARK.join(by[o])) for o in at], pa.binary())], ["owner", "unit", "chunks"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Owners come one after the other; each segments a chunk when it is asked for it first. Decoded text goes along where it isn't the chunk."""
        s = Segmenter(model_file)
        now, known = None, {}
        for batch in batches:
            found = []
            for owner, asker, data in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != now:
                    now, known = owner, {}
                keys = _unpack(data).split(MARK)
                new = [k for k in keys if k not in known]
                known.update(zip(new, s.segment(new)))
                odd = [(i, known[k][1]) for i, k in enumerate(keys) if known[k][1] != k]
                found.append((asker, owner, _pack("\n".join(known[k][0] for k in keys)), [i for i, _ in odd], [t for _, t in odd]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())))], ["unit", "owner", "ids", "at", "odd"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            ids: dict[str, str] = {}
            text: dict[str, str] = {}
            asked = _owned(set(chain.from_iterable(split(r))), owners)  # as they were sent
            for x in r["answers"] or ():
                keys = asked[x["owner"]]
                ids.update(zip(keys, _unpack(x["ids"]).split("\n")))
                text.update(zip(keys, keys))
                text.update(zip(map(keys.__getitem__, x["at"]), x["odd"]))
            out = []
            for chunks in split(r):
                line = " ".join([*map(ids.__getitem__, chunks), end])
                decoded = " ".join(map(text.__getitem__, chunks))
                row = (line.count(" ") + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, list(map(int, line.split(" "))), decoded) if arrays else row)
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((r["docs"], *zip(*out)), kinds)], names[: len(out[0]) + 1])

    try:
        asked = units.select("unit", "sizes", "text").mapInArrow(ask, "owner int, unit long, chunks binary")
        answers = asked.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(answer, "unit long, owner int, ids binary, at array<int>, odd array<string>")
        answers = answers.groupBy("unit").agg(F.collect_list(F.struct("owner", "ids", "at", "odd")).alias("answers"))
        out = units.join(answers, "unit", "left").mapInArrow(join, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * arrays)
        return checkpointed(out)
    finally:
        drop()


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_pieces": op10_pieces}
ORACLES: dict[str, str] = {}
