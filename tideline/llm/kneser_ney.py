"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

A text is the sequence of its words, parted by single spaces, between a start and an end mark, and n-grams run across words.
Documents are packed into units, compressed, in buckets that later joins meet without moving a text. Units send their distinct n-grams,
with how often their trusted documents hold each, packed to the shards that own them, which add the counts up; joins of the
shards' tables level by level give each seen n-gram its probability, and what the model has not seen backs off by joins with
shorter ones. The shards' answers go back to the units, which score every character of every document. One trusted document
in `held_out` is not counted: a document passes if its perplexity is within its language's quantile among those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bucketed, checkpointed, each_row, mix, partitions, small_batches, table, trim

#: Marks of a text's end and start, and what fills an n-gram that reaches beyond the start; no word holds white space.
END, FIRST, PAD = "\n", "\r", "\v"
#: Characters at which a unit is written, and of which n-grams are computed at once: both bound a task's memory.
UNIT_CHARS, CHUNK_CHARS = 16_000_000, 2_000_000
#: Perplexities are compared by their logarithm in steps of this size, so that a histogram has a bounded number of bins.
STEP = 0.001
#: Discounts from counts of counts are kept from this up: short n-grams have few of them, and a discount of 0 would leave
#: nothing for what was not seen.
LEAST_DISCOUNT = 0.1
#: What a document is to the model.
UNTRUSTED, TRAINS, HELD_OUT = 0, 1, 2


@dataclass(frozen=True)
class ModelParams:
    """order: characters in an n-gram. quantile: of held-out trusted documents of a language that pass. held_out: one
    trusted document in so many sets the thresholds instead of being counted."""

    order: int = 5
    quantile: float = 0.995
    held_out: int = 10


def marked(text: str | None, order: int) -> tuple[str, int]:
    """A text's words between marks, and their number; nothing if there are none. U+0000 stands for no character, so it becomes U+FFFD."""
    words = (text or "").replace("\0", "\ufffd").split()
    return (PAD * (order - 1) + FIRST + " ".join(words) + END, len(words)) if words else ("", 0)


class Keys:
    """N-grams of a unit's text as numbers or bytes that sort, by the characters that the text has."""

    def __init__(self, text: str, order: int) -> None:
        self.order = order
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        there = np.zeros(0x110000, bool)
        for a in range(0, len(self.codes), CHUNK_CHARS):
            there[self.codes[a : a + CHUNK_CHARS]] = True
        there[0], there[ord(PAD)] = True, False
        self.alphabet = np.flatnonzero(there).astype("<u4")
        self.base = len(self.alphabet)
        self.number = np.zeros(int(self.alphabet[-1]) + 1, np.int64)
        self.number[self.alphabet] = np.arange(self.base)
        self.small = self.base**order < 2**63

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, keys, which count): the n-gram that ends at each character; marks of a start count for none."""
        for a in range(0, len(self.codes), CHUNK_CHARS):
            b = min(a + CHUNK_CHARS, len(self.codes))
            lead = min(a, self.order - 1)
            part = self.codes[a - lead : b]
            part = np.concatenate((np.full(self.order - 1 - lead, ord(PAD), "<u4"), part))
            part = np.where(part == ord(PAD), 0, part).astype("<u4")
            windows = [part[k : k + b - a] for k in range(self.order)]
            yield a, b, self.keys(windows), (windows[-1] != 0) & (windows[-1] != ord(FIRST))

    def keys(self, columns: list[np.ndarray]) -> np.ndarray:
        """Keys of n-grams given by their characters' columns; 0 where a short one has none."""
        if not self.small:
            return as_bytes(np.stack(columns, axis=1))
        out = self.number[columns[0]]
        for c in columns[1:]:
            out *= self.base
            out += self.number[c]
        return out

    def grams(self, keys: np.ndarray) -> np.ndarray:
        """The characters of keys, a row for each."""
        if not self.small:
            return keys.view(">u4").reshape(-1, self.order).astype("<u4")
        out = np.empty((len(keys), self.order), "<u4")
        for k in range(self.order - 1, -1, -1):
            keys, digit = np.divmod(keys, self.base)
            out[:, k] = self.alphabet[digit]
        return out


def as_bytes(grams: np.ndarray) -> np.ndarray:
    """Rows of characters as byte strings that sort like them."""
    return np.ascontiguousarray(grams.astype(">u4")).view(f"S{4 * grams.shape[1]}").ravel()


def from_bytes(keys: np.ndarray, order: int) -> np.ndarray:
    return np.ascontiguousarray(keys).view(">u4").reshape(-1, order).astype("<u4")


def owner_of(grams: np.ndarray, owners: int) -> np.ndarray:
    """The shard of each row of characters."""
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = mix(h + grams[:, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h % np.uint64(owners)).astype(np.int64)


def as_texts(grams: np.ndarray) -> list[str]:
    """Rows of characters as strings; a short n-gram has zeros before it."""
    out = np.zeros_like(grams)
    lead = (grams == 0).sum(1)
    for z in range(grams.shape[1]):
        at = lead == z
        out[at, : grams.shape[1] - z] = grams[at, z:]
    return np.ascontiguousarray(out.astype("<u4")).view(f"<U{grams.shape[1]}").ravel().tolist()


def from_texts(texts: list[str], order: int) -> np.ndarray:
    flat = np.array(texts, f"<U{order}").view("<u4").reshape(-1, order)
    out = np.zeros_like(flat)
    length = (flat != 0).sum(1)
    for n in range(1, order + 1):
        at = length == n
        out[at, order - n :] = flat[at, :n]
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order, and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at.ravel(), weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(data)


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers with their bytes of like weight side by side, which packs better."""
    flat = np.ascontiguousarray(x, kind).reshape(-1)
    return _pack(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unpack(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack_grams(grams: np.ndarray) -> bytes:
    return _planes(grams.T, "<u4")


def _unpack_grams(data: bytes, order: int) -> np.ndarray:
    return np.ascontiguousarray(_from_planes(data, "<u4").reshape(order, -1).T)


UNIT = "unit long, ids array<long>, langs array<string>, hashes array<long>, sizes array<int>, words array<int>, text binary"
UNIT_NAMES = [x.split()[0] for x in UNIT.split(", ")]
UNIT_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, pa.binary()]
MESSAGE = "owner int, unit long, grams binary, counts binary"


def text_units(docs: DataFrame, order: int) -> DataFrame:
    """Units of documents: their texts between marks, compressed together."""
    small_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64("text").alias("hash"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_, size = [], 0

        def out() -> pa.RecordBatch:
            ids, langs, hashes, texts, words = zip(*open_)
            row = (number, ids, langs, hashes, [len(t) for t in texts], words, _pack("".join(texts).encode("utf-8", "surrogatepass")))
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, UNIT_TYPES)], UNIT_NAMES)

        for batch in batches:
            for i, g, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                text, n = marked(t, order)
                open_.append((i, g, h, text, n))
                size += len(text)
                if size >= UNIT_CHARS or len(open_) >= UNIT_CHARS // 64:
                    yield out()
                    number, open_, size = number + 1, [], 0
        if open_:
            yield out()
        trim()

    return slim.mapInArrow(pack, UNIT)


def unit_states(units: DataFrame, trusted: DataFrame, held_out: int) -> DataFrame:
    """(unit, states): the places of a unit's trusted documents and what each is to the model; `trusted` has each doc_id once."""
    marks = trusted.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0, HELD_OUT).otherwise(TRAINS).alias("state"))
    placed = units.select("unit", F.posexplode("ids").alias("pos", "doc_id")).join(marks, "doc_id")
    return placed.groupBy("unit").agg(F.collect_list(F.struct("pos", "state")).alias("states"))


def _states(r: dict) -> np.ndarray:
    out = np.full(len(r["sizes"]), UNTRUSTED)
    for x in r["states"] or ():
        out[x["pos"]] = x["state"]
    return out


def _text(r: dict) -> str:
    return _unpack(r["text"]).decode("utf-8", "surrogatepass")


def unit_grams(units: DataFrame, order: int, owners: int) -> DataFrame:
    """(owner, unit, grams, counts): the distinct n-grams of each unit, by owner, and how often its training documents hold them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            text = _text(r)
            if not text:
                continue
            k, keys, many = Keys(text, order), [], []
            trains = np.repeat(_states(r) == TRAINS, r["sizes"])
            for a, b, key, is_one in k.chunks():
                for x, n in (np.unique(key[is_one & trains[a:b]], return_counts=True), (np.unique(key[is_one & ~trains[a:b]]), None)):
                    keys.append(x)
                    many.append(np.zeros(len(x), np.int64) if n is None else n)
            found, counts = _summed(keys, many)
            grams = k.grams(found)
            owner = owner_of(grams, owners)
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(owners + 1))
            at = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
            part = [by[cuts[o] : cuts[o + 1]] for o in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([r["unit"]] * len(at), pa.int64()), pa.array([_pack_grams(grams[p]) for p in part], pa.binary()), pa.array([_planes(counts[p], "<i8") for p in part], pa.binary())], ["owner", "unit", "grams", "counts"])
        trim()

    return units.select("unit", "sizes", "text", "states").mapInArrow(ask, MESSAGE)


def model_tables(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame, float]:
    """((gram, value) of seen n-grams, (h, left) of their histories, probability of an unseen character).

    value is the interpolated probability of the last character: the discounted share of the gram in its history, and what
    the history leaves times the value of the gram without its first character. Levels are joined from the shortest up.
    """
    tables = [counts.where(F.length("gram") == order).select("gram", "c")]
    for k in range(order - 1, 0, -1):  # below the order, grams count the characters seen before them, or themselves after a start mark
        seen = tables[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        tables.append(checkpointed(seen.unionByName(counts.where(F.length("gram") == k).select("gram", "c"))))
    values: DataFrame | None = None
    histories: DataFrame | None = None
    below: DataFrame | None = None
    unseen = 1.0
    for k, level in zip(range(1, order + 1), reversed(tables)):
        n = level.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)), F.count("*").alias("n")).first()
        d = [0.5, 1.0, 1.5]
        if all(n[f"n{i}"] for i in range(1, 5)):
            y = n["n1"] / (n["n1"] + 2 * n["n2"])
            d = [min(max(i - (i + 1) * y * n[f"n{i + 1}"] / n[f"n{i}"], LEAST_DISCOUNT), float(i)) for i in (1, 2, 3)]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        own = level.select("gram", "c", F.expr(f"left(gram, {k - 1})").alias("h"), F.least(off, F.col("c")).alias("d"))
        sums = own.groupBy("h").agg(F.sum("c").alias("total"), F.sum("d").alias("d")).select("h", "total", (F.col("d") / F.col("total")).alias("left"))
        if k == 1:
            top = sums.first()  # one history, the empty one
            uniform = 1.0 / (n["n"] + 1)
            unseen = top["left"] * uniform if top else uniform
            now = own.select("gram", ((F.col("c") - F.col("d")) / F.lit(top["total"] if top else 1) + F.lit(unseen)).alias("value"))
        else:
            both = own.join(sums, "h").withColumn("s", F.expr("substring(gram, 2)")).join(below.withColumnsRenamed({"gram": "s", "value": "v"}), "s")
            now = both.select("gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("left") * F.col("v")).alias("value"))
            sums = checkpointed(sums.select("h", "left"))
            histories = sums if histories is None else histories.unionByName(sums)
        below = checkpointed(now)
        values = below if values is None else values.unionByName(below)
    return values, histories, unseen


def backed_off(asked: DataFrame, values: DataFrame, histories: DataFrame, unseen: float, order: int) -> DataFrame:
    """(gram, value) of distinct n-grams: seen ones have theirs; others take that of the gram without its first
    character, times what their history leaves if it was seen. Only what was not seen goes on to the next level."""
    found = checkpointed(asked.join(values, "gram", "left"))
    seen, rest = found.where("value IS NOT NULL"), found.where("value IS NULL").select("gram")
    single = rest.where("length(gram) <= 1").select("gram", F.lit(unseen).alias("value"))
    if order == 1:
        return seen.unionByName(single)
    longer = rest.where("length(gram) > 1").select("gram", F.expr("substring(gram, 2)").alias("s"), F.expr("left(gram, length(gram) - 1)").alias("h"))
    below = backed_off(longer.select(F.col("s").alias("gram")).distinct(), values, histories, unseen, order - 1)
    both = longer.join(below.withColumnsRenamed({"gram": "s", "value": "v"}), "s").join(histories, "h", "left")
    return seen.unionByName(single).unionByName(both.select("gram", (F.coalesce("left", F.lit(1.0)) * F.col("v")).alias("value")))


def perplexities(docs: DataFrame, trusted: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """(doc_id, lang, hash, state, n_words, log_ppl) of each row: natural logarithm of the perplexity for a character; null without words."""
    order, owners = params.order, partitions(docs.sparkSession)
    units, drop = bucketed(text_units(docs, order), "unit", owners)
    try:
        return _perplexities(units, trusted, params, order, owners)
    finally:
        drop()


def _perplexities(units: DataFrame, trusted: DataFrame, params: ModelParams, order: int, owners: int) -> DataFrame:
    states = checkpointed(unit_states(units, trusted, params.held_out))
    messages = checkpointed(unit_grams(units.join(states, "unit", "left"), order, owners))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each owner's n-grams, with the sums of their counts; owners come one after the other."""
        now, keys, counts = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                found, many = _summed(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(as_texts(from_bytes(found, order)), pa.string()), pa.array(many, pa.int64())], ["gram", "c"])

        for batch in batches:
            for owner, _, g, c in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != now:
                    yield from out()
                    now, keys, counts = owner, [], []
                keys.append(as_bytes(_unpack_grams(g, order)))
                counts.append(_from_planes(c, "<i8"))
                if len(keys) >= 64:  # merged now and then, so that memory follows what is distinct
                    merged = _summed(keys, counts)
                    keys, counts = [merged[0]], [merged[1]]
        yield from out()

    counted = checkpointed(messages.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(add, "gram string, c long"))
    values, histories, unseen = model_tables(counted.where("c > 0"), order)
    scored = checkpointed(backed_off(counted.select("gram"), values, histories, unseen, order))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, logs = from_texts(batch.column(0).to_pylist(), order), np.log(np.array(batch.column(1).to_pylist(), np.float64))
            owner = owner_of(grams, owners)
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(owners + 1))
            at = [k for k in range(owners) if cuts[k] < cuts[k + 1]]
            part = [by[cuts[k] : cuts[k + 1]] for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([None] * len(at), pa.int64()), pa.array([_pack_grams(grams[p]) for p in part], pa.binary()), pa.array([logs[p].astype("<f4").tobytes() for p in part], pa.binary())], ["owner", "unit", "grams", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An owner's values come first, then the units that ask; an answer has its questions with it."""
        now, keys, logs, ready = None, [], [], False
        for batch in batches:
            found = []
            for owner, unit, g, c in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != now:
                    now, keys, logs, ready = owner, [], [], False
                if unit is None:
                    keys.append(as_bytes(_unpack_grams(g, order)))
                    logs.append(np.frombuffer(c, "<f4"))
                    continue
                if not ready:
                    all_, value = np.concatenate(keys), np.concatenate(logs)
                    by = np.argsort(all_)
                    keys, logs, ready = all_[by], value[by], True
                found.append((unit, g, logs[np.searchsorted(keys, as_bytes(_unpack_grams(g, order)))].tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary()))], ["unit", "grams", "logs"])

    both = scored.mapInArrow(shard, MESSAGE).unionByName(messages.withColumn("counts", F.lit(None).cast("binary")))
    answers = both.repartition(owners, "owner").sortWithinPartitions(F.col("owner"), F.col("unit").asc_nulls_first()).mapInArrow(answer, "unit long, grams binary, logs binary")
    answers = answers.groupBy("unit").agg(F.collect_list(F.struct("grams", "logs")).alias("answers"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            sizes = np.array(r["sizes"], np.int64)
            sums, text = np.zeros(len(sizes)), _text(r)
            if text:
                k = Keys(text, order)
                key = np.concatenate([k.keys(list(_unpack_grams(x["grams"], order).T)) for x in r["answers"]])
                by = np.argsort(key)
                key, value = key[by], np.concatenate([np.frombuffer(x["logs"], "<f4") for x in r["answers"]]).astype(np.float64)[by]
                has = np.flatnonzero(sizes)
                starts = np.cumsum(sizes)[has] - sizes[has]
                for a, b, at, is_one in k.chunks():
                    each = np.zeros(b - a)
                    each[is_one] = value[np.searchsorted(key, at[is_one])]
                    lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)  # the documents in this chunk
                    sums[has[lo:hi]] += np.add.reduceat(each, np.maximum(starts[lo:hi] - a, 0))
            ppl = [None if not n else float(-s / (n - order)) for s, n in zip(sums, r["sizes"])]
            columns = [pa.array(r["ids"], pa.int64()), pa.array(r["langs"], pa.string()), pa.array(r["hashes"], pa.int64()), pa.array(_states(r), pa.int32()), pa.array(r["words"], pa.int64()), pa.array(ppl, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "hash", "state", "n_words", "log_ppl"])
        trim()

    met = units.join(answers, "unit", "left").join(states, "unit", "left")
    return checkpointed(met.mapInArrow(score, "doc_id long, lang string, hash long, state int, n_words long, log_ppl double"))


def _classified(docs: DataFrame, labels: DataFrame, params: ModelParams) -> DataFrame:
    clean = "coalesce(toxic, 0) = 0" if "toxic" in labels.columns else "true"
    trusted = labels.where(f"quality = 1 AND {clean} AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    scores = perplexities(docs, trusted, params)
    bins = scores.where(f"state = {HELD_OUT} AND log_ppl IS NOT NULL").groupBy("lang", F.floor(F.col("log_ppl") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    bins = checkpointed(bins)  # bounded for each language by the steps between the smallest and the largest perplexity

    def threshold(by: list[str]) -> DataFrame:
        w = W.Window.partitionBy(*by)
        low = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n")).withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        reached = F.min(F.when(F.col("below") >= F.col("all") * params.quantile, F.col("bin") + 1))
        mean = F.sum(F.col("n") * F.col("bin")) / F.max("all")
        spread = F.sqrt(F.greatest(F.sum(F.col("n") * F.col("bin") * F.col("bin")) / F.max("all") - mean * mean, F.lit(0.0)))
        # too few documents to have so rare a one among them: the quantile of a normal distribution like theirs, if it is larger
        tail = F.when(F.max("all") * (1 - params.quantile) < 1, mean + 1 + NormalDist().inv_cdf(params.quantile) * spread)
        return low.groupBy(*by).agg((F.greatest(reached.cast("double"), tail) * F.lit(STEP)).alias("threshold"), tail.isNotNull().alias("few"))

    whole = threshold([]).first()
    whole = whole["threshold"] if whole else None
    own = threshold(["lang"]).select(F.col("lang").alias("__lang"), F.when(F.col("few"), F.greatest("threshold", F.lit(whole).cast("double"))).otherwise(F.col("threshold")).alias("threshold"))
    out = scores.join(own, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(whole).cast("double")))
    return out.withColumn("kept", F.coalesce(F.col("log_ppl").isNotNull() & (F.col("log_ppl") <= F.coalesce("threshold", F.lit(float("inf")))), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """(doc_id, lang, n_words, log_ppl, threshold, kept) of each row of `docs`; `labels` says what is trusted: quality 1, not toxic.

    Of the trusted documents, one in `held_out` by a hash of its id sets its language's threshold, and the others are counted.
    Texts null, empty or without words have no perplexity and are not kept. A null language is a language of its own. A
    language without held-out documents takes the threshold over all of them; where there are none at all, every text with
    words is kept. A language with fewer of them than its quantile needs (200 for 0.995) has the quantile of a normal
    distribution like theirs, and no less than the threshold over all languages. Rows with a null id are scored but never trusted; repeated rows are scored apart. Long texts are read
    whole; an empty table gives an empty result; other columns are not read. Logarithms of n-grams travel in single precision.
    """
    return _classified(docs, labels, params).select("doc_id", "lang", "n_words", "log_ppl", "threshold", "kept")


def keep_documents(docs: DataFrame, labels: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """The rows that pass, each judged by its own text and language, also where ids are null or repeated; columns as in `docs`."""
    bad = _classified(docs, labels, params).where("NOT kept").select(F.col("doc_id").alias("__i"), F.col("lang").alias("__g"), F.col("hash").alias("__h")).distinct()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__i")) & lang.eqNullSafe(F.col("__g")) & (F.xxhash64("text") == F.col("__h"))
    return docs.join(checkpointed(bad), same, "left_anti").select(*docs.columns)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_kneser_ney": op4_kneser_ney}
ORACLES: dict[str, str] = {}
