"""N-gram Jaccard join: globally ordered shingle sets in a trie, with exact filters that decide which sets have to meet.

1. Equal sets become one class. Chunks of documents send the first members of each set, in the order of their hashes, to
   the owner of each member. A set of n members with a partner has k = ceil(0.08 n) of its first 0.28 n members in the
   first members of another set (pigeonhole); sets that miss this bound have no partner and leave.
2. What stays is ordered anew, rare members first, and tied together by members of prefixes: two linked sets share a
   member of their prefixes, so they lie in one cluster.
3. Each cluster is joined by a trie. Clusters of more than `block` sets are cut into blocks that share leaders, which links
   what is alike already; then the sets outside of the largest linked part are probed against every block. Where these are
   many, sets meet by the members of their prefixes instead, and only where a member's sets are not all linked yet. Both
   find every link. No pair list is made anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import checkpointed, hash_words, mix, partitions, runs_of, small_batches, table
from .prefix_tree import DEN, NUM, components, link

WIDTH = 5
#: Members in one chunk, and documents at most: the memory of a task's buffer.
CHUNK_MEMBERS, CHUNK_DOCS = 2_000_000, 60_000
#: Sets in one trie.
BLOCK = 512
LEADERS = 4
#: Up to so many sets outside of the largest part of a cluster are probed against all its blocks: at most 16 copies of a set.
MOST_OUTSIDE = 4_096
NOBODY = 0xFFFF
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one n-gram, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z and splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)
    n = min(width, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * MULTIPLIER + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out + np.uint64(n)))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a, b = mix(s ^ MULTIPLIER), mix(s + MULTIPLIER)
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def least(n):
    """Members that a set of n shares with any partner at least: ceil(0.8 n)."""
    return -(-NUM * n // DEN)


def extra(n):
    """How many members of the extended prefix have to be shared: ceil(n / 10), 1 at least."""
    return np.maximum(1, -(-n // 10))


def _by_owner(members: np.ndarray, keys: int) -> np.ndarray:
    """Owner of each member: its top bits, scaled to `keys`."""
    return (((members >> np.uint64(32)) * np.uint64(keys)) >> np.uint64(32)).astype(np.int64)


def _five(members: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(members.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, sets, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            sets.append(shingles(t, width))
            size += len(sets[-1])
            if size >= CHUNK_MEMBERS or len(ids) >= CHUNK_DOCS:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and their lengths."""
    start = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_values)))


SENT = "key long, chunk long, members binary, docs binary, ids array<long>, n array<long>, first array<long>, second array<long>, shared array<long>"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]
SENT_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 5]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), SENT_TYPES)], SENT_NAMES)


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, first, second, active) of each row: size and fingerprint of its set; a set that isn't active has no partner.

    Two shuffles of packed bytes, no row for a member: chunks to the owners of their first members, and the owners'
    answers, which of them another chunk or set holds too, back to the chunks. A chunk sends each member once, however
    many of its sets hold it, so a member that all documents share costs an owner one entry for each chunk.
    """
    small_batches(docs.sparkSession)
    keys = 4 * partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        for number, (ids, sets) in enumerate(_chunks(batches, width)):
            chunk = base + number
            n = np.array([len(s) for s in sets], np.int64)
            prints = [fingerprint(s) for s in sets]
            seen: dict = {}
            same = np.array([seen.setdefault(p, k) for k, p in enumerate(prints)], np.int64)
            own = np.flatnonzero((same == np.arange(len(sets))) & (n > 0))
            sends = n[own] - least(n[own]) + extra(n[own])
            heard = n[own] - least(n[own]) + extra(least(n[own]))
            members = np.concatenate([sets[k][:m] for k, m in zip(own, sends)]) if len(own) else np.zeros(0, np.uint64)
            doc = np.repeat(own, sends)
            listens = np.arange(len(members)) - np.repeat(np.cumsum(sends) - sends, sends) < np.repeat(heard, sends)
            order = np.argsort(members, kind="stable")
            members, doc, listens = members[order], doc[order], listens[order]
            start, many = _runs(members)
            several = np.repeat(many > 1, many)
            shared = np.bincount(doc[several & listens], minlength=len(sets))
            to = np.where((many == 1) & listens[start], doc[start], NOBODY).astype("<u2")
            members = members[start]
            cut = np.searchsorted(_by_owner(members, keys), np.arange(keys + 1))
            packed = _five(members)
            rows = [(k, chunk, packed[cut[k] : cut[k + 1]].tobytes(), to[cut[k] : cut[k + 1]].tobytes(), None, None, None, None, None) for k in range(keys) if cut[k] < cut[k + 1]]
            rows.append((-1 - chunk, chunk, None, None, ids, n.tolist(), [p[0] for p in prints], [p[1] for p in prints], (shared[same] + (same << 32)).tolist()))
            yield _sent(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in runs_of(batches, "key"):
            if key < 0:
                yield _sent([tuple(r.values()) for r in rows])
                continue
            got = [(r["chunk"], r["members"], r["docs"]) for r in rows]
            members = np.concatenate([_from_five(m) for _, m, _ in got])
            doc = np.concatenate([np.frombuffer(d, "<u2") for *_, d in got])
            which = np.repeat(np.arange(len(got)), [len(d) // 2 for *_, d in got])
            order = np.argsort(members, kind="stable")
            _, many = _runs(members[order])
            hit = order[np.repeat(many > 1, many)]
            hit = hit[doc[hit] != NOBODY]
            hit = hit[np.argsort(which[hit], kind="stable")]
            cut = np.searchsorted(which[hit], np.arange(len(got) + 1))
            rows = [(key, got[k][0], None, doc[hit[cut[k] : cut[k + 1]]].astype("<u2").tobytes(), None, None, None, None, None) for k in range(len(got)) if cut[k] < cut[k + 1]]
            if rows:
                yield _sent(rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, "chunk"):
            about, *answers = sorted(rows, key=lambda r: r["key"])
            ids, n, first, second, shared = (about[c] for c in ("ids", "n", "first", "second", "shared"))
            n, shared = np.array(n, np.int64), np.array(shared, np.int64)
            same, count = shared >> 32, shared & 0xFFFFFFFF
            heard = np.zeros(NOBODY, np.int64)
            for r in answers:
                heard += np.bincount(np.frombuffer(r["docs"], "<u2"), minlength=NOBODY)
            count = count + heard[same]
            active = (count >= extra(least(n))) & (n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(active)], ["doc_id", "n", "first", "second", "active"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = slim.mapInArrow(send, SENT).repartition(keys // 4, "key").sortWithinPartitions("key")
    back = sent.mapInArrow(answer, SENT).repartition(keys // 4, "chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(judge, "doc_id long, n long, first long, second long, active boolean")


def active_sets(docs: DataFrame, sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rep, chunk, members) of the class representatives that may have partners; members are packed, in the order of hashes.

    A chunk is what one task has computed, of bounded size; it stays with the rows once they are written.
    """
    reps = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("first", "second").agg(F.min("doc_id").alias("rep"), F.max("active").alias("active")).where("active")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps.select("rep", "first", "second"), "rep")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s = shingles(r["text"], width)
                if fingerprint(s) == (r["first"], r["second"]):  # ids that stand for several texts
                    rows.append((r["rep"], chunk, s.tobytes()))
                    size += len(s)
                    if size >= CHUNK_MEMBERS:
                        chunk, size = chunk + 1, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["rep", "chunk", "members"])

    return texts.mapInArrow(compute, "rep long, chunk long, members binary")


COUNTED = "key long, chunk long, rep long, members binary, counts binary"
COUNTED_NAMES = [x.split()[0] for x in COUNTED.split(", ")]
COUNTED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), COUNTED_TYPES)], COUNTED_NAMES)


def _prefixes(held: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set of a chunk the members of its prefix that another set holds, rarest first; `counts` has how many sets hold each of the chunk's members.

    A set of n needs ceil(0.8 n) members that another holds too, else it has no partner and no prefix.
    """
    members, count = np.unique(np.concatenate(held)), np.concatenate(counts)
    firsts = []
    for s in held:
        c = count[np.searchsorted(members, s)]
        p = np.zeros(0, np.uint64)
        if np.count_nonzero(c > 1) >= least(len(s)):
            order = np.lexsort((s, c))[: len(s) - least(len(s)) + 1]
            p = s[order[c[order] > 1]]
        firsts.append(p)
    return firsts


def _with_counts(sets: DataFrame) -> DataFrame:
    """Chunk by chunk the sets (key -1) and then, in the order of members, how many sets hold each member of the chunk.

    Chunks, each in one piece, ask the owners of their members; a chunk sends each member once, and an owner holds one key at a time.
    """
    keys = 4 * partitions(sets.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in runs_of(batches, "chunk"):
            members, many = np.unique(np.concatenate([np.frombuffer(r["members"], np.uint64) for r in held]), return_counts=True)
            cut = np.searchsorted(_by_owner(members, keys), np.arange(keys + 1))
            packed, many = _five(members), many.astype("<u4")
            yield _counted([(k, chunk, None, packed[cut[k] : cut[k + 1]].tobytes(), many[cut[k] : cut[k + 1]].tobytes()) for k in range(keys) if cut[k] < cut[k + 1]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in runs_of(batches, "key"):
            _, where = np.unique(np.concatenate([_from_five(r["members"]) for r in rows]), return_inverse=True)
            many = [np.frombuffer(r["counts"], "<u4") for r in rows]
            total = np.bincount(where, weights=np.concatenate(many)).astype("<u4")[where]
            cut = np.cumsum([0, *map(len, many)])
            yield _counted([(key, r["chunk"], None, None, total[cut[k] : cut[k + 1]].tobytes()) for k, r in enumerate(rows)])

    told = sets.select("chunk", "members").mapInArrow(ask, COUNTED).repartition(keys // 4, "key").sortWithinPartitions("key").mapInArrow(answer, COUNTED)
    own = sets.select(F.lit(-1).cast("long").alias("key"), "chunk", "rep", "members", F.lit(None).cast("binary").alias("counts"))
    return own.unionByName(told).repartition(keys // 4, "chunk").sortWithinPartitions("chunk", "key")


def _chunk_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(chunk, its representatives, their prefixes) from `_with_counts`."""
    for chunk, rows in runs_of(batches, "chunk"):
        own = [r for r in rows if r["key"] < 0]
        firsts = _prefixes([np.frombuffer(r["members"], np.uint64) for r in own], [np.frombuffer(r["counts"], "<u4") for r in rows if r["key"] >= 0])
        yield chunk, np.array([r["rep"] for r in own], np.int64), firsts


def cluster_edges(sets: DataFrame) -> DataFrame:
    """Edges (src, dst) of a forest that ties sets whose prefixes share a member.

    Sets stand rarest member first, by exact counts; what a set has for itself, or in a passage common to many, comes
    before or after the members of its prefix that tie it.
    """
    keys = 4 * partitions(sets.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, firsts in _chunk_prefixes(batches):
            doc = np.repeat(np.arange(len(ids)), [len(f) for f in firsts])
            first = np.concatenate(firsts)
            order = np.argsort(first, kind="stable")
            first, doc = first[order], doc[order]
            start, many = _runs(first)
            label = components(len(ids), np.repeat(doc[start], many), doc)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            rows = [(-1 - chunk, chunk, None, ids[tied].tobytes(), ids[label[tied]].tobytes())] if len(tied) else []
            first, one = first[start], ids[doc[start]]
            cut = np.searchsorted(_by_owner(first, keys), np.arange(keys + 1))
            packed = _five(first)
            rows += [(k, chunk, None, packed[cut[k] : cut[k + 1]].tobytes(), one[cut[k] : cut[k + 1]].tobytes()) for k in range(keys) if cut[k] < cut[k + 1]]
            if rows:
                yield _counted(rows)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def forest() -> tuple[np.ndarray, np.ndarray]:
            a, b = np.concatenate(heads), np.concatenate(tails)
            nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = components(len(nodes), at[: len(a)], at[len(a) :])
            tied = label != np.arange(len(nodes))
            return nodes[tied], nodes[label[tied]]

        for key, rows in runs_of(batches, "key"):
            if key < 0:
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("members", "counts")], ["src", "dst"])
                continue
            members = np.concatenate([_from_five(r["members"]) for r in rows])
            doc = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
            order = np.argsort(members, kind="stable")
            doc = doc[order]
            start, many = _runs(members[order])
            head = np.repeat(doc[start], many)
            heads.append(head[head != doc])
            tails.append(doc[head != doc])
            if sum(map(len, heads)) >= CHUNK_MEMBERS:  # what is tied already is held as a forest
                a, b = forest()
                heads, tails = [a], [b]
                if len(a) >= CHUNK_MEMBERS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])
                    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest()], ["src", "dst"])

    return _with_counts(sets).mapInArrow(send, COUNTED).repartition(keys // 4, "key").sortWithinPartitions("key").mapInArrow(tie, "src long, dst long")


def prefix_members(sets: DataFrame) -> DataFrame:
    """(rep, member) of each member of a prefix that another of these sets holds: two linked sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, firsts in _chunk_prefixes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f) for f in firsts])), pa.array(np.concatenate(firsts).astype(np.uint64).view(np.int64))], ["rep", "member"])

    return _with_counts(sets).mapInArrow(run, "rep long, member long")


def _link_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges found by a trie in each group of (keys, rep, members, must); groups stream one after the other."""

    def solve(group: list[dict]) -> list[tuple[int, int]]:
        group = list({r["rep"]: r for r in sorted(group, key=lambda r: (r["rep"], bool(r["must"])))}.values())
        if len(group) < 2:
            return []
        must = np.array([bool(r["must"]) for r in group])
        label = link([np.frombuffer(r["members"], np.uint64) for r in group], must if must.any() else None)
        return [(r["rep"], group[k]["rep"]) for r, k in zip(group, label.tolist()) if group[k] is not r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, found = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    found += solve(group)
                    now, group = key, []
                group.append(r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["src", "dst"])
                found = []
        found = solve(group)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["src", "dst"])

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "src long, dst long")


def join_clusters(sets: DataFrame, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component) of the sets that link with another."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    place = clusters.join(sizes, "component").withColumnRenamed("node", "rep").withColumn("blocks", F.ceil(F.col("size") / block))
    place = checkpointed(place.select("rep", "component", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(False).alias("must")))
    columns = ["component", "block", "rep", "members", "must"]
    own = sets.select("rep", "members").join(place, "rep")
    if not place.where("blocks > 1").limit(1).count():
        return connected_components(_link_groups(own.select(columns), ["component", "block"]))
    split = place.where("blocks > 1")
    picks = [F.min(F.struct(F.xxhash64("rep", F.lit(j)).alias("h"), "rep")).alias(f"p{j}") for j in range(LEADERS)]
    leaders = split.groupBy("component").agg(*picks).select(F.explode(F.array_distinct(F.array(*(F.col(f"p{j}.rep") for j in range(LEADERS))))).alias("rep"))
    big = sets.select("chunk", "rep", "members").join(split, "rep")
    shared = big.join(leaders, "rep").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = checkpointed(_link_groups(own.select(columns).unionByName(shared.select(columns)), ["component", "block"]))
    found = connected_components(first)
    # what is linked now need not meet again: only sets outside of a group's largest part are probed
    parts = split.select("component", "rep").join(found.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    parts = checkpointed(parts)
    mains = _main_parts(parts, "component")
    meet = _meetings(parts, mains.where(F.col("outside") <= MOST_OUTSIDE), "component", block)
    lots = mains.where(F.col("outside") > MOST_OUTSIDE)
    if lots.limit(1).count():  # many parts that a chain of common members ties: they meet by the members of their prefixes
        loose = parts.join(lots.select("component"), "component", "left_semi").select("rep", "part")
        chunks = big.select("chunk", "rep", "members").join(loose.select("rep"), "rep", "left_semi").repartition("chunk").sortWithinPartitions("chunk")
        sharing = checkpointed(prefix_members(checkpointed(chunks)).join(loose, "rep"))
        meet = meet.unionByName(_meetings(sharing, _main_parts(sharing, "member"), "member", block))
    second = _link_groups(meet.join(sets.select("rep", "members"), "rep"), ["kind", "group", "block", "turn"])
    return connected_components(first.unionByName(second))


def _main_parts(rows: DataFrame, group: str) -> DataFrame:
    """(group, main, size, outside) of each group of (group, rep, part) with several parts: its largest one, its sets, and those of them in other parts."""
    many = rows.groupBy(group, "part").agg(F.count("*").alias("many"))
    top = many.groupBy(group).agg(F.max(F.struct("many", "part")).alias("top"), F.sum("many").alias("size"))
    return checkpointed(top.select(group, F.col("top.part").alias("main"), "size", (F.col("size") - F.col("top.many")).alias("outside")).where("outside > 0"))


def _meetings(rows: DataFrame, mains: DataFrame, group: str, block: int) -> DataFrame:
    """(kind, group, block, turn, rep, must): in which tries the sets of a group meet, so that each outside of its largest part meets all."""
    zero = F.lit(0).cast("long")
    dealt = rows.join(mains, group).withColumns({"kind": F.lit(group), "group": F.col(group), "must": F.col("part") != F.col("main"), "blocks": F.ceil(F.col("size") / block), "turns": F.ceil(F.col("outside") / block)})
    dealt = dealt.withColumns({"own": F.pmod(F.xxhash64("rep"), F.col("blocks")), "mine": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("turns"))})
    whole = dealt.where("blocks = 1").select("kind", "group", zero.alias("block"), zero.alias("turn"), "rep", "must")
    cut = dealt.where("blocks > 1")
    probes = cut.where("must").select("kind", "group", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.col("mine").alias("turn"), "rep", "must")
    against = cut.select("kind", "group", F.col("own").alias("block"), F.explode(F.sequence(zero, F.col("turns") - 1)).alias("turn"), "rep", F.lit(False).alias("must"))
    return whole.unionByName(probes).unionByName(against)


def ngram_join(docs: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    Texts null, empty or without words have no shingles and link with nothing. Of an id with several texts, each row has
    the class of its own text (classes whose smallest ids are equal are one). Rows with a null id are returned with a null component and link with nothing. Texts are read whole; an
    empty table gives an empty result; other columns are not read.
    """
    sets = checkpointed(set_table(docs, width))
    active = checkpointed(active_sets(docs, sets, width))
    clusters = connected_components(cluster_edges(active))
    linked = join_clusters(active, clusters, block)
    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    reps = known.groupBy("first", "second").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")).where("many > 1").drop("many")
    reps = checkpointed(reps)  # written first, so that both sides of the join are shuffles, which can be split where a class is hot
    tied = sets.join(reps, (sets["first"] == reps["first"]) & (sets["second"] == reps["second"]) & (sets["n"] > 0), "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    out = tied.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The document with the smallest id of each group; columns as in `docs`. Rows with a null id stay, and so do all rows
    of an id with several texts if one of these is not in the group of a smaller id."""
    found = ngram_join(docs.select("doc_id", "text"), width).where("doc_id IS NOT NULL")
    leave = found.groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("leaves")).where("leaves").select("doc_id")
    return docs.join(leave, "doc_id", "left_anti").select(docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: The same links from all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES = {"op9_ngram_join": ORACLE}
