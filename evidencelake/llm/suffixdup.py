"""Removal of repeated passages by ranks of sampled positions at growing lengths; this is no prefix doubling.

A task ranks a position's first 16, 42 and 50 bytes by hashes of them, from the ranks of its halves at
growing offsets; Spark groups equal ranks but sorts no pairs of them. Sorting every position of a corpus at every length would move many times
its size, so only sampled positions are sorted: of each 50-byte window the 16-byte gram with the
least hash (leftmost of equals). The choice depends on the window's bytes alone, so equal windows
choose equal grams at equal places, and one position in about 20 stands for all windows.

1. Length 16: ranks that occur once drop out; the rest pass a bit filter in the next scan.
2. A sampled position stands for a run of windows; the rank of the run's 50 to 84 bytes gives its
   class. In documents after a class's first every byte of the run goes.
3. Length 42, in four places around the gram: a quarter of a run's windows whose rank occurs in
   one class drops out. What is left, edges of passages mostly, is ranked by quarters as whole runs
   were, and only quarters of one rank at length 42 that differ beyond it are ranked at length 50.
   Only the first document of a class goes on to the next step: in the others all bytes go already.

Ranks that decide are 96-bit hashes. Each batch of texts settles what it holds twice by itself.
The bit filters have a bounded size; beyond it more positions pass, with the same result. Groups are aggregated before they are shuffled, and no step holds a
group, so a passage may occur in any share of all documents.

Cases: a null text counts as empty; texts under 50 bytes keep all; rows of the same doc_id never
remove from each other; rows of null doc_id keep all and remove nothing; other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidencelake.llm.common import Scratch, occupy, only
from evidencelake.llm.nearjoin import mix

WINDOW = 50
GRAM = 16
RUN = WINDOW - GRAM + 1
#: Places of the gram in a window, by four; the windows of each four share all but their ends.
QUARTERS = [(q * RUN // 4, (q + 1) * RUN // 4 - 1) for q in range(4)]
SCAN = 1 << 18  # bytes that are ranked together
STEP = 1 << 15  # rows that leave Python together
MOST_BITS = 1 << 31  # of the bit filter
PAGE = 1 << 15  # bits to a row of it
BROADCAST = 4_000_000  # spans; beyond it the texts are shuffled to them
CORES = [f"core{q}" for q in range(4)]
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Ranks:
    """Ranks of the positions of several texts that lie end to end."""

    def __init__(self, data: np.ndarray):
        v = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
        v = v[:-1] | v[1:] << np.uint64(8)
        v = v[:-2] | v[2:] << np.uint64(16)
        self.first = mix(v[:-4] | v[4:] << np.uint64(32))  # of 8 bytes

    def grams(self) -> np.ndarray:
        return mix(self.first[:-8] * A + self.first[8:])

    def span(self, start: np.ndarray, length: int, by: np.uint64 = A) -> np.ndarray:
        """Ranks of the given length from each start, out of the ranks of 8 bytes."""
        total = np.zeros(len(start), np.uint64)
        for at in [*range(0, length - 8, 8), length - 8]:
            total = total * by + self.first[start + at]
        return mix(total)


def sampled(texts: pa.Array):
    """For stretches of a batch: (ranks, row, start, a, lo, hi, end) of the sampled positions.

    Row and start of the text, the gram's place, the first and last window of its run, and the
    text's end, in the stretch.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SCAN)) - 1)
        base, cuts = int(offsets[row]), offsets[row : last + 1].astype(np.int64)
        own = data[base : int(cuts[-1])]
        cuts = cuts - base
        if len(own) >= WINDOW:
            ranks = Ranks(own)
            key = ranks.grams()[: len(own) - GRAM + 1] & np.uint64(0xFFFFFFFF00000000) | np.arange(len(own) - GRAM + 1, dtype=np.uint64)
            width = 1
            while 2 * width <= RUN:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if RUN > width:
                key = np.minimum(key[: len(key) - (RUN - width)], key[RUN - width :])
            place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window's gram
            text_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[: len(place)]
            valid = np.arange(len(place)) + WINDOW <= cuts[text_of + 1]
            windows = np.flatnonzero(valid)
            if len(windows):
                place, text_of = place[windows], text_of[windows]
                new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text_of, prepend=-1) != 0))
                lo = windows[new]
                hi = windows[np.append(new[1:], len(windows)) - 1]
                t = text_of[new]
                yield ranks, row + t, cuts[t], place[new], lo, hi, cuts[t + 1]
        row = last


def classes(ranks: Ranks, a, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each run, out of its first and last window."""
    shape = (((a - lo) << 8) + hi - lo).astype(np.uint64)
    return tuple(mix(mix(ranks.span(lo, WINDOW, by) * by + shape) * by + ranks.span(hi, WINDOW, by)) for by in (A, B))


def cores(ranks: Ranks, a, lo, hi) -> list[np.ndarray]:
    """For each quarter, the rank of the bytes that its windows share; 0 where a run has none of them."""
    out = []
    for q, (first, last) in enumerate(QUARTERS):
        held = (a - lo >= first) & (a - hi <= last)
        rank = np.zeros(len(a), np.uint64)
        rank[held] = mix(ranks.span(a[held] - first, WINDOW - last + first) + np.uint64(q)) | np.uint64(1)
        out.append(rank)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class BitFilter:
    """A Bloom filter of two bits a value, built in pages by Spark and read in every task."""

    def __init__(self, values: DataFrame, name: str, n: int):
        bits = PAGE
        while bits < 16 * n and bits < MOST_BITS:
            bits *= 2
        schema = pa.schema([("page", pa.int32()), ("bits", pa.binary())])

        def mark(batches):
            pages: dict[int, np.ndarray] = {}
            for batch in batches:
                at = np.unique(np.concatenate(BitFilter.places(batch[name].to_numpy().view(np.uint64), bits)))
                page = at // PAGE
                for p in np.unique(page):
                    own = at[np.searchsorted(page, p) : np.searchsorted(page, p, "right")] - p * PAGE
                    if p not in pages:
                        pages[p] = np.zeros(PAGE, bool)
                    pages[p][own] = True
            if pages:
                yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in pages.values()], pa.binary())], schema=schema)

        def join(batches):
            pages: dict[int, np.ndarray] = {}
            for batch in batches:
                for p, x in zip(batch["page"].to_pylist(), batch["bits"], strict=True):
                    new = np.frombuffer(x.as_py(), np.uint8)
                    pages[p] = pages[p] | new if p in pages else new
            if pages:
                yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], schema=schema)

        kinds = "page int, bits binary"
        table = np.zeros(bits // 8, np.uint8)
        for r in values.select(name).mapInArrow(mark, kinds).repartition("page").mapInArrow(join, kinds).toLocalIterator():
            table[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
        self.table = values.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def places(x: np.ndarray, bits: int) -> list[np.ndarray]:
        x = x * A
        return [(x >> np.uint64(32)).astype(np.int64) & (bits - 1), (mix(x) >> np.uint64(16)).astype(np.int64) & (bits - 1)]

    @staticmethod
    def has(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        one, two = BitFilter.places(x, 8 * len(table))
        return ((table[one >> 3] >> (one & 7)) & (table[two >> 3] >> (two & 7)) & 1).astype(bool)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, a hash of the text that tells rows of one doc_id apart."""
    return only(docs, doc_id="long", text="string").withColumn("th", F.hash("text"))


def _repeated(docs: DataFrame) -> DataFrame:
    """gram: the 16-byte ranks that are sampled in two documents at least."""

    def run(batches):
        occupy("suffix dedup")
        for batch in batches:
            for ranks, row, _, a, *_ in sampled(batch["text"]):
                g = ranks.grams()[a]
                order = np.lexsort((g, row))
                own = np.flatnonzero((np.diff(g[order], prepend=g[order][:1] + np.uint64(1)) != 0) | (np.diff(row[order], prepend=-1) != 0))
                g, n = np.unique(g[order][own], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(g), pa.array(n.astype(np.int32))], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def _settled(batch: pa.RecordBatch, row, lo, hi, key, key2, *more) -> tuple[list, list]:
    """What a batch settles by itself: columns of the occurrences to compare with other batches, and of spans to remove.

    Of equal keys those in the batch's smallest doc_id stay open; the others are removed, joined to long spans.
    """
    ids, th = batch["doc_id"].to_numpy(), batch["th"].to_numpy()
    doc = ids[row]
    order = np.lexsort((doc, key2, key))
    k, k2 = key[order], key2[order]
    new = np.append(True, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))[: len(k)]
    first = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(row), bool)
    later[order] = doc[order] > first
    del order, k, k2, new, first
    open_ = ~later
    kept = [doc[open_], th[row[open_]], lo[open_].astype(np.int32), hi[open_].astype(np.int32), key[open_].view(np.int64), (key2[open_] >> np.uint64(32)).astype(np.uint32).view(np.int32), *(m[open_].view(np.int64) for m in more)]
    at = np.flatnonzero(later)
    at = at[np.lexsort((lo[at], row[at]))]
    r, begin, end = row[at], lo[at], hi[at]
    # within a text both ends of sampled runs and of windows only grow
    fresh = np.append(True, (r[1:] != r[:-1]) | (begin[1:] > end[:-1]))[: len(at)]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(at))[: len(heads)] - 1
    spans = [ids[r[heads]], th[r[heads]], begin[heads].astype(np.int32), end[tails].astype(np.int32)]
    return kept, spans


def _both(kept: list, spans: list, names: list[str]):
    """Batches of both, none of more than STEP rows; spans have no key."""
    for own in (kept, spans):
        for at in range(0, len(own[0]), STEP):
            columns = [pa.array(c[at : at + STEP]) for c in own]
            columns += [pa.nulls(len(columns[0]), pa.array(c[:0]).type) for c in kept[len(own) :]]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _gathered(parts: list[tuple]) -> list[np.ndarray]:
    """The columns of all parts, which are let go one by one, so that little is held twice."""
    columns = [list(c) for c in zip(*parts, strict=True)]
    parts.clear()
    out = []
    for column in columns:
        out.append(np.concatenate(column))
        column.clear()
    return out


def _short(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows and places in a text, in half the memory."""
    return [c.astype(np.int32) for c in columns]


def _runs(docs: DataFrame, grams: BitFilter) -> DataFrame:
    """The sampled positions with a repeated gram: doc_id, th, lo, hi (bytes), class (s, s2) and cores; or a settled span, s null."""
    table = grams.table
    names = ["doc_id", "th", "lo", "hi", "s", "s2", *CORES]

    def run(batches):
        occupy("suffix dedup")
        bits = table.value
        for batch in batches:
            parts = []
            for ranks, row, start, a, lo, hi, _ in sampled(batch["text"]):
                keep = np.flatnonzero(BitFilter.has(bits, ranks.grams()[a]))
                row, start, a, lo, hi = (x[keep] for x in (row, start, a, lo, hi))
                parts.append((*_short(row, lo - start, hi - start + WINDOW), *classes(ranks, a, lo, hi), *cores(ranks, a, lo, hi)))
            if parts:
                yield from _both(*_settled(batch, *_gathered(parts)), names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th int, lo int, hi int, s long, s2 int, " + ", ".join(f"{c} long" for c in CORES))


def _open(firsts: DataFrame, chosen: BitFilter) -> DataFrame:
    """key: class and first document of the classes with a chosen core."""
    table = chosen.table

    def run(batches):
        occupy("suffix dedup")
        bits = table.value
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            for c in CORES:
                rank = batch[c].to_numpy().view(np.uint64)
                found |= (rank != 0) & BitFilter.has(bits, rank)
            yield pa.RecordBatch.from_arrays([batch["key"].filter(pa.array(found))], names=["key"])

    return firsts.select(F.col("s").bitwiseXOR(F.col("first")).alias("key"), *CORES).mapInArrow(run, "key long")


def _opened(batch: pa.RecordBatch, bits: np.ndarray):
    """What sampled gives, for the runs of a batch that come first in an open class."""
    ids = batch["doc_id"].to_numpy().view(np.uint64)
    for ranks, row, start, a, lo, hi, _ in sampled(batch["text"]):
        keep = np.flatnonzero(BitFilter.has(bits, classes(ranks, a, lo, hi)[0] ^ ids[row]))
        yield ranks, ids, *(x[keep] for x in (row, start, a, lo, hi))


def _pieces(docs: DataFrame, opens: BitFilter, chosen: BitFilter) -> DataFrame:
    """The quarters with a chosen core of each open run: doc_id, th, lo, hi (bytes), class (s, s2) and core; or a settled span, s null."""
    open_table, core_table = opens.table, chosen.table

    def run(batches):
        for batch in batches:
            parts = []
            for ranks, _, row, start, a, lo, hi in _opened(batch, open_table.value):
                for rank, (first, last) in zip(cores(ranks, a, lo, hi), QUARTERS, strict=True):
                    k = np.flatnonzero((rank != 0) & BitFilter.has(core_table.value, rank))
                    begin, end = np.maximum(lo[k], a[k] - last), np.minimum(hi[k], a[k] - first)
                    parts.append((*_short(row[k], begin - start[k], end - start[k] + WINDOW), *classes(ranks, a[k], begin, end), rank[k]))
            if parts:
                yield from _both(*_settled(batch, *_gathered(parts)), ["doc_id", "th", "lo", "hi", "s", "s2", "core"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th int, lo int, hi int, s long, s2 int, core long")


def _windows(docs: DataFrame, opens: BitFilter, split: BitFilter) -> DataFrame:
    """Each window of the quarters to split: doc_id, th, lo, hi (bytes) and its rank (s, s2); or a settled span, s null."""
    open_table, split_table = opens.table, split.table

    def run(batches):
        for batch in batches:
            parts = []
            for ranks, ids, row, start, a, lo, hi in _opened(batch, open_table.value):
                for first, last in QUARTERS:
                    k = np.flatnonzero((a - lo >= first) & (a - hi <= last))
                    begin, end = np.maximum(lo[k], a[k] - last), np.minimum(hi[k], a[k] - first)
                    found = BitFilter.has(split_table.value, classes(ranks, a[k], begin, end)[0] ^ ids[row[k]])
                    k, begin, n = k[found], begin[found], (end - begin + 1)[found]
                    at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                    own = at - np.repeat(start[k], n)
                    parts.append((*_short(np.repeat(row[k], n), own, own + WINDOW), ranks.span(at, WINDOW, A), ranks.span(at, WINDOW, B)))
            if parts:
                yield from _both(*_settled(batch, *_gathered(parts)), ["doc_id", "th", "lo", "hi", "s", "s2"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th int, lo int, hi int, s long, s2 int")


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, th and the joined spans of each text as two arrays."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            found = []
            for own in batch["spans"]:
                s = own.values.flatten()
                lo, hi = (x.to_numpy() for x in s)
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
                found.append((lo[new], reach[np.append(new[1:], len(lo)) - 1]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int32()))], schema=schema)

    gathered = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return gathered.mapInArrow(run, "doc_id long, th int, starts array<int>, ends array<int>")


def _first(found: DataFrame, *more: str) -> DataFrame:
    """s, s2 and the first and last document of each class, with what all its members share."""
    return found.where("s is not null").groupBy("s", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *(F.first(c).alias(c) for c in more))


def _later(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """The spans of a class's members in documents after its first, and the settled ones."""
    place = ["doc_id", "th", "lo", "hi"]
    later = found.join(firsts.where("first < last").select("s", "s2", "first"), ["s", "s2"]).where("doc_id > first").select(*place)
    return later.union(found.where("s is null").select(*place))


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, th, starts, ends: the maximal byte spans to remove, for the texts that have any."""
    rows = _rows(docs).where("doc_id is not null and octet_length(text) >= 50")
    grams = scratch.keep(_repeated(rows), "grams")
    runs = scratch.keep(_runs(rows, BitFilter(grams, "gram", grams.count())), "runs")
    scratch.drop("grams")
    firsts = scratch.keep(_first(runs, *CORES), "classes")
    chosen = firsts.select(F.explode(F.array(*CORES)).alias("core")).where("core <> 0").groupBy("core").count().where("count > 1").select("core")
    chosen = scratch.keep(chosen, "chosen")
    whole = scratch.keep(_later(runs, firsts), "whole")
    scratch.drop("runs")

    held = BitFilter(chosen, "core", chosen.count())
    keys = scratch.keep(_open(firsts, held), "open")
    scratch.drop("classes")
    opens = BitFilter(keys, "key", keys.count())
    pieces = scratch.keep(_pieces(rows, opens, held), "pieces")
    firsts = scratch.keep(_first(pieces, "core"), "piece-classes")
    quarters = scratch.keep(_later(pieces, firsts), "quarters")
    scratch.drop("pieces")

    several = firsts.groupBy("core").count().where("count > 1").select("core")
    keys = scratch.keep(firsts.join(several, "core").select(F.col("s").bitwiseXOR(F.col("first")).alias("key")), "split")
    scratch.drop("piece-classes")
    windows = scratch.keep(_windows(rows, opens, BitFilter(keys, "key", keys.count())), "windows")
    edges = _later(windows, _first(windows))
    return scratch.keep(_merged(whole.union(quarters).union(edges)), "spans")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (binary)."""
    spans = repeated_spans(docs, Scratch(docs.sparkSession))
    return cut(docs, spans, with_text)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what repeats taken out of text, and n_chars, where there is one, to match.

    A character of which only some bytes go is dropped whole; a document stays even if nothing of it does.
    """
    spans = repeated_spans(docs, Scratch(docs.sparkSession))
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.hash("text"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, starts, ends in zip(batch["text"], batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if starts:
                    data = text.as_buffer().to_pybytes()
                    texts.append(b"".join(data[i:j] for i, j in zip([0, *ends], [*starts, len(data)], strict=True)).decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch["own"], pa.array(texts, pa.string())], names=["own", "new"])

    joined = plain.join(_small(spans), ["doc_id", "th"], "left").select("own", "text", "starts", "ends")
    done = joined.mapInArrow(run, T.StructType([plain.schema["own"], T.StructField("new", T.StringType())]))
    fresh = {"text": F.col("new"), "n_chars": F.when(F.col("new").isNull(), F.col("own").getField("n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return done.select(*((fresh[c] if c in fresh else F.col("own").getField(c)).alias(c) for c in docs.columns))


def _small(spans: DataFrame) -> DataFrame:
    """A broadcast hint if the spans are few."""
    n = spans.agg(F.coalesce(F.sum(F.size("starts") + 3), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(spans) if n <= BROADCAST else spans


def cut(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text, starts, ends in zip(batch["doc_id"].to_pylist(), batch["text"], batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                starts, ends = starts or [], ends or []
                kept = b"".join(data[i:j] for i, j in zip([0, *ends], [*starts, len(data)], strict=True)) if starts else data
                row = [doc_id, len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()]
                for column, value in zip(out, row + [kept] * with_text, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    joined = _rows(docs).join(_small(spans), ["doc_id", "th"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
