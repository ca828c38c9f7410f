"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is the set of its 5-word shingles. Two sets with overlap o link when o is at least
0.8 of their union, so each must then hold a token of the other among its first
n - ceil(0.8 n) + 1 tokens under any order of all tokens. The first order is by the number of different sets that
hold a token, counted over the whole corpus, so that common passages come last; two more orders are
hashes. Equal sets become one node first, so copies cost one row each.

1. Every task sorts the tokens of its documents, block by block, and sends them in packed form to the shard
   of their first bits, which counts them; only tokens of several sets come back to the block, where each
   node's prefix under the first order is cut. Very common tokens are not sent: a fixed-size count sketch of
   the whole corpus tells them, and its counters rank them behind all others, so that no token floods a shard.
   A node whose prefix has only tokens of its own is done: it links with none.
2. Every node is verified against at most PIVOTS pivots, those that stand out in most of its tokens'
   groups: above all the node with the fewest tokens of its own, which the base of a crowd of near
   copies is. Connected nodes form components. A crowd takes a few pairs for each of its nodes.
3. Only pairs of nodes from different components that share a token are left. The overlap is at
   most what either set holds from their first common token on, so only tokens whose places leave
   room for a link make pairs: own tokens are rare and come first, which keeps apart the members of
   a crowd that link to its base alone. Within a token's group the pairs have one side outside its
   largest component.

Before a whole set moves, a pair must also share prefix tokens under the second and under the third order
(each node carries those prefixes as 16-bit hashes), and pass the parities of its tokens' counts in 512
buckets: two sets differ in at least as many tokens as parities. What is left is verified on whole sets.

Every link between nodes of different components is found in step 3, so components are exact, but for
64-bit hashes: of tokens, and of sets, which are the nodes' ids.

Cases: null texts and texts without words have no set, n_shingles 0, and are their own component;
under five words the whole sequence is the one shingle; repeated rows and doc_ids each get a row;
a null doc_id joins like any other and shows as null only where it is alone; other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import Scratch, occupy, only, unused

WORDS = 5
SHARE = 80  # percent
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # of the two plain hash orders
PARITIES = 512  # bits of a node
PIVOTS = 3  # of a node, in the second step
BROADCAST = 2_000_000  # ids; beyond it they are joined by a shuffle
SIGNED = 500_000  # ids with node and signature, which take ten times the memory of the driver
SKETCH = 1 << 20  # counters, at any size of the corpus
CHUNK = 1 << 12  # counters to a row
COMMON = 4  # times the usual counter: from there on tokens are very common
SHARDS = 1 << 12  # of the tokens by their first bits
BLOCK = 1_000_000  # tokens of the sets that are sent together
SETTLE = 1_000_000  # tokens that a shard's task counts at once
ROWS = 1000  # documents that leave Python together
KNOWN = 200_000  # words whose hash a Python worker remembers
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = _Hashes()


def forget() -> None:
    HASHES.clear()


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(HASHES.__getitem__, found)), np.uint64)
    if len(w) < WORDS:
        return mix((w * FACTORS[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
    n = len(w) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += w[k : n + k] * FACTORS[k]
    return np.unique(mix(total + np.uint64(WORDS)))


def least_overlap(n):
    """The overlap that a set of n needs with any partner."""
    return -(-SHARE * n // 100)


def prefix(tokens: np.ndarray) -> np.ndarray:
    """The first tokens under the order of their numbers, of which linked sets share one."""
    return np.sort(tokens)[: len(tokens) - least_overlap(len(tokens)) + 1]


def other_prefixes(tokens: np.ndarray) -> list[np.ndarray]:
    """The prefixes under the second and third order, as 16-bit hashes."""
    return [np.unique((prefix(mix(tokens ^ np.uint64(seed))) >> np.uint64(7)).astype(np.uint16)) for seed in SEEDS]


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two token sets link."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < SHARE * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SHARE * (n + m - both)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig, parities and the prefixes under the other orders of each document; the last three are null where the task has given them for an equal set before.

    Each task ends with its counters of the sketch, as rows with a chunk.
    """
    longs, shorts = pa.list_(pa.int64()), pa.list_(pa.int16())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("parities", longs), ("second", shorts), ("third", shorts), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        occupy("near join", forget)
        seen: set[bytes] = set()
        counts = np.zeros(SKETCH, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns: list[list] = [[] for _ in schema.names[1:6]]
                for t in batch["text"].to_pylist():
                    s = shingles(t)
                    sig = signature(s)
                    if new := len(s) > 0 and sig not in seen:
                        seen.add(sig)
                        np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
                    more = [parities(s), *(x.view(np.int16) for x in other_prefixes(s))] if new else [None] * 3
                    for column, value in zip(columns, [len(s), sig, *more], strict=True):
                        column.append(value)
                if len(seen) > KNOWN:
                    seen.clear()
                none = [pa.nulls(batch.num_rows, schema.field(c).type) for c in ("chunk", "counts")]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns)), *none], schema=schema)
        held = [(k, c.tobytes()) for k, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
        none = [pa.nulls(len(held), f.type) for f in list(schema)[:6]]
        yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in held], pa.int32()), pa.array([c for _, c in held], pa.binary())], schema=schema)

    kinds = "doc_id long, n int, sig binary, parities array<long>, second array<short>, third array<short>, chunk int, counts binary"
    return only(docs, doc_id="long", text="string").mapInArrow(run, kinds)


def _levels(sets: DataFrame) -> np.ndarray:
    """For each counter of the sketch 0, or by how much it is over the usual: its tokens are very common."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"], strict=True):
                new = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
                sums[chunk] = sums[chunk] + new if chunk in sums else new
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    rows = sets.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()  # SKETCH counters, whatever the corpus
    total = np.zeros(SKETCH, np.int64)
    for r in rows:
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    usual = COMMON * max(8.0, float(total.mean()))
    return np.where(total > usual, np.clip(np.log2(np.maximum(total, 1) / usual) * 4 + 1, 1, 255), 0).astype(np.uint8)


MESSAGE = "kind int, shard int, block long, tokens binary, high binary, at binary"


def _packed(docs: DataFrame, levels) -> DataFrame:
    """Blocks of sets, as rows (kind, shard, block, tokens, high, at).

    kind 0: tokens for a shard (of their 52 leading bits the last 32, and in high the eight before) and at, the places of their sets in the block;
    kind 1: very common tokens, with their levels in high; kind 2: the block's nodes, in tokens, and their sizes, in at.
    """
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("high", pa.binary()), ("at", pa.binary())])

    def row(kind, shard, block, tokens, high, at):
        return [pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (tokens, high, at))]

    def flush(block: int, nodes: list[int], sets: list[np.ndarray], level: np.ndarray):
        sizes = np.array([len(s) for s in sets], np.int32)
        tokens = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        common = level[(tokens >> np.uint64(44)).astype(np.int64)]
        mine = int(mix(np.array([block], np.uint64))[0] % np.uint64(SHARDS))
        hot = np.flatnonzero(common)
        yield pa.RecordBatch.from_arrays(row(1, mine, block, tokens[hot] >> np.uint64(12), common[hot], at[hot]), schema=schema)
        yield pa.RecordBatch.from_arrays(row(2, mine, block, np.array(nodes, np.int64), np.zeros(0, np.uint8), sizes), schema=schema)
        cold = np.flatnonzero(common == 0)
        cold = cold[np.argsort(tokens[cold])]
        tokens, at = tokens[cold], at[cold]
        cuts = np.searchsorted(tokens >> np.uint64(52), np.arange(SHARDS + 1, dtype=np.uint64))
        held = np.flatnonzero(np.diff(cuts))
        ends = np.append(cuts[held], len(tokens))
        low, high = (tokens >> np.uint64(12)).astype(np.uint32), (tokens >> np.uint64(44)).astype(np.uint8)
        pack = lambda x: pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(held), np.int32)), pa.array(held.astype(np.int32)), pa.array(np.full(len(held), block)), pack(low), pack(high), pack(at)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        occupy("near join", forget)
        block = TaskContext.get().partitionId() << 24
        seen: set[int] = set()
        nodes, sets, held = [], [], 0
        for batch in batches:
            for t in batch["text"]:
                s = shingles(t.as_py())
                node = int.from_bytes(signature(s)[:8], "big", signed=True)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sets.append(s)
                held += len(s)
                if held >= BLOCK or len(nodes) == 1 << 16:
                    yield from flush(block, nodes, sets, levels.value)
                    nodes, sets, held, block = [], [], 0, block + 1
                    if len(seen) > KNOWN:
                        seen.clear()
        if nodes:
            yield from flush(block, nodes, sets, levels.value)

    return only(docs, text="string").mapInArrow(run, MESSAGE)


def _answered(packed: DataFrame) -> DataFrame:
    """What the shards send back to the blocks: rows of kind 0 with the 52-bit tokens that several sets hold, their numbers of sets in high, and at; the other kinds as they are."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("high", pa.binary()), ("at", pa.binary())])

    def settle(rows: list[tuple]):
        key = np.concatenate([np.frombuffer(low, np.uint32) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32) | np.uint64(shard << 40) for shard, _, low, high, _ in rows])
        at = np.concatenate([np.frombuffer(r[4], np.uint16) for r in rows])
        block = np.repeat(np.array([r[1] for r in rows]), [len(r[4]) // 2 for r in rows])
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        n = np.diff(np.append(new, len(key)))
        keep = np.repeat(n > 1, n)
        order, n = order[keep], np.repeat(n, n)[keep].astype(np.uint32)
        by_block = np.argsort(block[order], kind="stable")
        order, n = order[by_block], n[by_block]
        if not len(order):
            return
        cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
        for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([int(block[own[0]])]), *(pa.array([x.tobytes()], pa.binary()) for x in (key[own], n[i:j], at[own]))], schema=schema)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            other = pa.array(kinds != 0)
            if (kinds != 0).any():
                yield pa.RecordBatch.from_arrays([batch[c].filter(other) for c in schema.names], schema=schema)
            for i in np.flatnonzero(kinds == 0):
                shard, block, low, high, at = (batch[c][int(i)].as_py() for c in ("shard", "block", "tokens", "high", "at"))
                if size > SETTLE and shard != rows[-1][0]:
                    yield from settle(rows)
                    rows, size = [], 0
                rows.append((shard, block, low, high, at))
                size += len(at) // 2
        if rows:
            yield from settle(rows)

    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "kind int, block long, tokens binary, high binary, at binary")


def _shared(answered: DataFrame) -> DataFrame:
    """token (52 bits), node, n and place of the tokens in prefixes under the first order, but for those of one set alone."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def cut(group: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple]] = {0: [], 1: [], 2: []}
        for kind, *more in zip(group["kind"].to_pylist(), *(group[c].to_pylist() for c in ("tokens", "high", "at")), strict=True):
            parts[kind].append(more)
        if not parts[2]:
            return schema.empty_table()
        nodes, n = np.frombuffer(parts[2][0][0], np.int64), np.frombuffer(parts[2][0][2], np.int32).astype(np.int64)
        known = parts[0] + parts[1]
        token = np.concatenate([np.frombuffer(x[0], np.uint64) for x in known] or [np.zeros(0, np.uint64)])
        rank = np.concatenate([np.frombuffer(x[1], np.uint32).astype(np.int64) for x in parts[0]] + [np.frombuffer(x[1], np.uint8).astype(np.int64) + (1 << 40) for x in parts[1]] or [np.zeros(0, np.int64)])
        at = np.concatenate([np.frombuffer(x[2], np.uint16) for x in known] or [np.zeros(0, np.uint16)]).astype(np.int64)
        several = np.bincount(at, minlength=len(n))
        own = n - several
        length = n - least_overlap(n) + 1
        order = np.lexsort((token, rank, at))
        token, at = token[order], at[order]
        place = own[at] + np.arange(len(at)) - (np.cumsum(several) - several)[at]
        keep = place < length[at]
        return pa.table([pa.array(token[keep].astype(np.int64)), pa.array(nodes[at[keep]]), pa.array(n[at[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))], schema=schema)

    return answered.groupBy("block").applyInArrow(cut, "token long, node long, n int, place int").distinct()


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bits: whether a bucket has an odd number of the tokens."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _whole(docs: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """node and its whole token set, for the given (doc_id, node, sig); few: their ids may be broadcast."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            out = [(node, s) for node, sig, text in zip(batch["node"].to_pylist(), batch["sig"].to_pylist(), batch["text"], strict=True) if signature(s := shingles(text.as_py())) == sig]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1].tobytes() for x in out], pa.binary())], schema=schema)

    texts = only(docs, doc_id="long", text="string")
    if few and nodes.count() <= SIGNED:
        nodes = F.broadcast(nodes)
    elif few:  # only texts of these ids are shuffled
        ids = nodes.where("doc_id is not null").select("doc_id").distinct()
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    return texts.join(nodes, texts["doc_id"].eqNullSafe(nodes["doc_id"])).select("node", "sig", "text").mapInArrow(run, "node long, tokens binary")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that link; only their nodes' texts are taken apart again."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            own = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], schema=schema).filter(pa.array(own, pa.bool_()))

    pairs = scratch.keep(_close(pairs, nodes), f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = scratch.keep(ends.join(nodes.select("node", "doc_id", "sig"), "node"), f"{name}-ends")
    whole = scratch.keep(_whole(docs, ends, ends.count() <= BROADCAST), f"{name}-whole")
    left = whole.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = whole.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    found = scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{name}-links")
    for part in ("pairs", "ends", "whole"):
        scratch.drop(f"{name}-{part}")
    return found


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under the second and the third order and whose parities differ in no more places than the tokens of a link can."""
    left = nodes.select(F.col("node").alias("a"), "n", F.col("parities").alias("x"), F.col("second").alias("x2"), F.col("third").alias("x3"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parities").alias("y"), F.col("second").alias("y2"), F.col("third").alias("y3"))
    differing = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(PARITIES // 64)), F.lit(0))
    near = pairs.join(left, "a").join(right, "b").where(_fitting()).where(differing <= F.col("n") + F.col("m") - 2 * _needed())
    return near.where(F.arrays_overlap("x2", "y2") & F.arrays_overlap("x3", "y3")).select("a", "b")


def _fitting():
    return (100 * F.col("n") >= SHARE * F.col("m")) & (100 * F.col("m") >= SHARE * F.col("n"))


def _needed():
    """The overlap that a link between sets of n and m tokens needs."""
    return F.ceil(F.lit(SHARE) * (F.col("n") + F.col("m")) / (100 + SHARE))


def _roomy():
    """From places i and j of a first common token on, both sets hold the overlap that a link needs."""
    return F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _needed()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and comp, the least node it is connected with; least labels spread and jump until none changes."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        closer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = closer.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old")
        after = scratch.keep(after, f"{name}-{step}")
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            return labels


def near_groups(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession)
    sets = scratch.keep(_sets(docs), "sets")
    own = scratch.keep(sets.where("chunk is null").select("doc_id", "n", "sig"), "own")
    node = F.expr("cast(conv(hex(substring(sig, 1, 8)), 16, -10) as long)")
    firsts = (F.first(c, ignorenulls=True).alias(c) for c in ("parities", "second", "third"))
    nodes = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *firsts)
    nodes = scratch.keep(nodes.withColumn("node", F.expr("cast(conv(hex(substring(sig, 1, 8)), 16, -10) as long)")), "nodes")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(sets))
    scratch.drop("sets")
    shared = scratch.keep(_shared(_answered(_packed(docs, levels))), "shared")

    length = F.col("n") - F.ceil(F.lit(SHARE) * F.col("n") / 100) + 1  # of the prefix
    weak = shared.groupBy("node").agg((1000 - F.floor(1000 * F.count(F.lit(1)) / F.first(length))).alias("weak"))
    marked = shared.select("token", "node").join(weak, "node")
    leads = marked.groupBy("token").agg(F.array_distinct(F.array(F.min(F.struct("weak", "node")).getField("node"), F.min("node"), F.max("node"))).alias("leads"))
    chosen = shared.select("token", "node").join(leads, "token").select("node", F.explode("leads").alias("pivot")).where("node <> pivot").groupBy("node", "pivot").count()
    order = Window.partitionBy("node").orderBy(F.desc("count"), "pivot")  # at most three rows for each prefix token of a document
    pivots = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    first = _verified(pivots, nodes, docs, scratch, "first")
    comps = components(first, scratch, "comps-1")

    tagged = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    largest = tagged.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", "largest")
    open_groups = scratch.keep(tagged.join(largest, "token"), "open")
    minor = open_groups.where("comp <> largest").select("token", F.col("node").alias("a"), F.col("place").alias("i"), F.col("n").alias("n"), F.col("comp").alias("comp_a"))
    other = open_groups.select("token", F.col("node").alias("b"), F.col("place").alias("j"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), (F.col("comp") == F.col("largest")).alias("major"))
    # a pair of two minor nodes comes up from both sides and is taken once
    met = minor.join(other, "token").where((F.col("comp_a") != F.col("comp_b")) & (F.col("major") | (F.col("a") < F.col("b"))) & _fitting() & _roomy())
    passed = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = _verified(passed, nodes, docs, scratch, "second")
    if not second.isEmpty():
        comps = components(first.union(second), scratch, "comps-2")

    named = nodes.select("node", "sig", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(smallest, "comp").select("sig", "component_id")
    found = own.where("n > 0").join(classes, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return found.unionByName(own.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, with the smallest doc_id of each group.

    Rows of one doc_id stand or fall together; rows without words or without a doc_id stay.
    """
    groups = near_groups(docs).where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    copies = Scratch(docs.sparkSession).keep(groups, "copies")
    few = copies.count() <= BROADCAST
    name = unused(docs, "copy_id")
    copies = copies.select(F.col("copy_id").alias(name))
    return docs.join(F.broadcast(copies) if few else copies, docs["doc_id"] == copies[name], "left_anti")
