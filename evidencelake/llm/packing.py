"""Packing along a space-filling curve.

Each document becomes a hashed vector of its token counts, projected to three fixed random
directions; the three coordinates give a Hilbert key. Documents are range-sorted by that key
and laid end to end, so a sequence holds neighbours on the curve, and only the last sequence
of all has padding. Token ids are computed once and kept beside a row number; the sort and
the running totals move only keys and lengths.

Cases: a null text counts as empty and has the end id alone; a text that exceeds a sequence is
cut as often as needed; repeated rows and repeated doc_ids are packed separately; other columns
are left out; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.bpe import Chunks, Irregular
from evidencelake.llm.common import Scratch, occupy, only, partitions

LENGTH = 2048
END = 1
FEATURES = 64
BITS = 10  # of each of three coordinates


class Ids:
    """Ids of a byte-level BPE of the tokenizers library, as little-endian 32-bit numbers.

    Chunks between spaces are remembered; a new one is encoded by the same vocabulary's ranks, which
    give the same ids at an eighth of the cost for so short a text. A text whose white space isn't
    regular, or with an added token in it, is encoded whole by the tokenizers library.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.spaced = Chunks(self._short)

    def _short(self, text: str) -> bytes:
        return array("I", self.short(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(x in text for x in self.added):
            head, *rest = text.split(" ")
            if not (head and head[-1].isspace()):
                try:
                    return self._short(head) + b"".join(map(self.spaced.__getitem__, rest))
                except Irregular:
                    pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str, pattern: str) -> Ids:
    return Ids(path, ranks, pattern)


@lru_cache(maxsize=1)
def codes() -> np.ndarray:
    """For each id its hashed feature, and FEATURES more where its sign is negative."""
    mixed = np.arange(1 << 20, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(58)) + ((mixed >> np.uint64(40)) & np.uint64(1)) * np.uint64(FEATURES)).astype(np.int64)


def features(ids: np.ndarray) -> np.ndarray:
    """Counts of hashed ids, with random signs, scaled to length 1."""
    both = np.bincount(codes()[ids], minlength=2 * FEATURES).astype(float)
    counts = both[:FEATURES] - both[FEATURES:]
    return counts / max(1e-9, float(np.sqrt(counts @ counts)))


@lru_cache(maxsize=1)
def directions() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, 3))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points with `bits` bits a coordinate, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def tokenized(docs: DataFrame, *vocabulary: str) -> DataFrame:
    """doc_id, key (on the curve), doc_tokens and ids (binary, the end id included)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        occupy("packing", tokenizer.cache_clear)
        own = tokenizer(*vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = [own.encode(t.as_py() or "") + end for t in batch["text"]]
                vectors = np.array([features(np.frombuffer(x, "<u4")) for x in ids]) @ directions()
                points = np.clip(((np.tanh(1.2 * vectors) + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(hilbert(points)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, key long, doc_tokens long, ids binary")


def placed(sizes: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """row_id and first: where each row's tokens begin when all rows lie end to end along the curve.

    Range partitions end on (key, row_id), so a crowd of equal keys is spread over several. What
    comes to the driver is one total for each partition.
    """
    schema = pa.schema([("part", pa.int32()), ("row_id", pa.int64()), ("doc_tokens", pa.int64()), ("before", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["doc_tokens"].to_numpy()
            sums = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch["row_id"], batch["doc_tokens"], pa.array(sums - n)], schema=schema)
            total = int(sums[-1]) if len(n) else total

    ordered = sizes.select("row_id", "key", "doc_tokens").repartitionByRange(parts, "key", "row_id").sortWithinPartitions("key", "row_id").select("row_id", "doc_tokens")
    laid = scratch.keep(ordered.mapInArrow(run, "part int, row_id long, doc_tokens long, before long"), "laid")
    totals = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    base, bases = 0, {}
    for part in sorted(totals):
        bases[part] = base
        base += totals[part]
    starts = [bases.get(part, 0) for part in range(max(bases, default=0) + 1)]
    return laid.select("row_id", (F.col("before") + F.get(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("part"))).alias("first"))


def pack(docs: DataFrame, path: str, ranks: str, pattern: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Packs docs by the tokenizers file at path, whose merges are the ranks and pattern given beside it.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(tokenized(docs, path, ranks, pattern).withColumn("row_id", F.monotonically_increasing_id()), "tokens")
    first = placed(rows, scratch, partitions(docs.sparkSession))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, ids, at in zip(batch["doc_id"].to_pylist(), batch["ids"], batch["first"].to_pylist(), strict=True):
                ids = memoryview(ids.as_buffer())
                total = len(ids) // 4
                start = 0
                while start < total:
                    offset = (at + start) % length
                    n = min(length - offset, total - start)
                    piece = ids[4 * start : 4 * (start + n)]
                    row = [doc_id, start, n, zlib.crc32(piece), total, (at + start) // length, offset]
                    for column, value in zip(out, row + [np.frombuffer(piece, "<i4")] * keep_ids, strict=True):
                        column.append(value)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return rows.select("row_id", "doc_id", "ids").join(first, "row_id").select("doc_id", "ids", "first").mapInArrow(cut, kinds)
