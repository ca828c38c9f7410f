"""Quality classifier over code points: interpolated modified Kneser-Ney of order 5, with no classes of characters.

Counts grow with the corpus and its scripts. The texts of a batch that share a model are a block, whose distinct 5-grams
are found in linear time, order by order. A 5-gram abcdw belongs to the shard of its pair cd, so that a shard has every
count that its orders 3 to 5 need; orders 1 and 2 are summed by Spark and sent to the shards of their d. Spark groups by
shard twice: to sum the blocks' counts of trusted text and take the counts of counts (the discounts need them from all
shards), then to give each block the log probabilities of its 5-grams. They meet the block's texts in a cogroup, where
the texts are scored. What is sent is packed (columns of numbers, zstd). No step holds a model; a shard holds about SHARD
code points' distinct grams, a block those of one Arrow batch.

The thresholds are knclassify's. Cases: texts of less than ORDER code points have no grams and stand at their language's
median; the rest as in knclassify.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import Scratch, occupy, only
from evidencelake.llm.knclassify import MIN_DOCS, OTHER, judged, trusted_rows, unjudged

ORDER = 5
BLOCK = 1 << 23  # code points to a block, unless one text has more
SHARD = 1 << 28  # code points of the corpus to a shard
BUCKETS = 8  # of the d of abcdw
LEAST_SPLITS = 4  # of a bucket, by c
DENSE = 1 << 25  # entries of a table by which grams are numbered; more are sorted
SLICE = 1 << 16
BITS, MASK = 21, (1 << 21) - 1  # a code point


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and where each text ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def numbered(head: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each pair (head, last) among the distinct ones in order, and these; width is over every last."""
    size = (int(head.max()) + 1) * width
    at = lambda i, n: head[i : i + n].astype(np.int64) * width + last[i : i + n]
    if size <= DENSE:
        seen, number = np.zeros(size, bool), np.empty(len(head), np.int32)
        for i in range(0, len(head), SLICE):
            seen[at(i, SLICE)] = True
        held, place = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32)
        place -= 1
        for i in range(0, len(head), SLICE):
            number[i : i + SLICE] = place.take(at(i, SLICE))
    else:
        held, number = np.unique(at(0, len(head)), return_inverse=True)
        number = number.astype(np.int32)
    return number, held // width, held % width


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """The number of each gram among the distinct ones, text after text; these, a row for each place in them; and where each text's are."""
    data, ends = points(texts)
    n = np.diff(ends, prepend=0)
    if not len(n) or n.max() < ORDER:
        return np.zeros(0, np.int32), np.zeros((ORDER, 0), np.int32), [slice(0, 0)] * len(n)
    inside = np.ones(len(data) - ORDER + 1, bool)
    for e in ends:
        inside[max(0, e - ORDER + 1) : e] = False
    number, _, letters = numbered(np.broadcast_to(np.int32(0), len(data)), data.view(np.int32), int(data.max()) + 1)
    del data
    width, letters = len(letters), letters.astype(np.int32)
    last = number.astype(np.uint16) if width <= 1 << 16 else number
    grams = letters[None]
    for k in range(1, ORDER):
        head, tail = number[:-1], last[k:]
        if k == ORDER - 1:
            head, tail = head[inside], tail[inside]
        number, heads, lasts = numbered(head, tail, width)
        grams = np.concatenate([grams[:, heads], letters[lasts][None]])
    to = np.cumsum(np.maximum(n - ORDER + 1, 0))
    return number, grams, [slice(int(e - max(0, k - ORDER + 1)), int(e)) for e, k in zip(to, n, strict=True)]


def spread(x: np.ndarray) -> np.ndarray:
    return x * 2654435761 % 4294967296 >> 16


def bucket(d: Column) -> Column:
    """As spread gives it."""
    return F.shiftright(d.cast("long") * F.lit(2654435761) % F.lit(4294967296), 16) % BUCKETS


def dealt(grams: np.ndarray, splits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of grams by shard, then by cd, and where each shard's grams are in it."""
    c, d = grams[2:4].astype(np.int64)
    shard = spread(d) % BUCKETS * splits + spread(c) % splits
    order = np.argsort(shard << 2 * BITS | c << BITS | d, kind="stable")
    held, at = np.unique(shard[order], return_index=True)
    return order, list(zip(held.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True))


def pack(rows: np.ndarray) -> bytes:
    """Rows of whole numbers by planes of bytes, as most planes hold one value."""
    planes = np.ascontiguousarray(rows, "<i8").view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1)
    return pa.Codec("zstd", 3).compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(body: bytes, n_rows: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, n_rows * size * 8, "zstd", asbytes=True), np.uint8).reshape(n_rows, 8, size)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(n_rows, size)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """Grams and counts in order of c, d, b, a, w; equal grams' counts are added."""
    a, b, c, d, w, n = rows = np.concatenate(parts, axis=1)
    high, low = c << BITS | d, b << 2 * BITS | a << BITS | w
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return np.concatenate([rows[:-1, order[first]], np.add.reduceat(n[order], first)[None]])


def orders(rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order 3 to 5: the contexts' keys, then the grams' keys (their context's number, w) and counts, each in order."""
    a, b, c, d, w, n = rows
    three, at = np.unique(c << BITS | d, return_inverse=True)
    four, at = np.unique(at << BITS | b, return_inverse=True)
    five, top = np.unique(at << BITS | a, return_inverse=True)
    under, kinds = np.unique(at << BITS | w, return_counts=True)
    third, pairs = np.unique((four >> BITS)[under >> BITS] << BITS | under & MASK, return_counts=True)
    return {3: (three, third, pairs), 4: (four, under, kinds), 5: (five, top << BITS | w, n)}


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    y = ones / (ones + 2 * twos) if ones else 0.5
    return (
        min(0.95, max(0.1, 1 - 2 * y * twos / ones)) if ones else 0.5,
        min(1.9, max(0.1, 2 - 3 * y * threes / twos)) if twos else 0.7,
        min(2.9, max(0.1, 3 - 4 * y * fours / threes)) if threes else 0.9,
    )


def sought(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in known, which is in order, and whether they are."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def log_probabilities(grams: np.ndarray, levels: dict, off: dict, size: int) -> np.ndarray:
    """Of each gram's last code point after the others: from the uniform distribution over size and one up, order by order."""
    a, b, c, d, w = grams
    p, above = np.full(len(w), 1 / (size + 1)), np.full(len(w), -1)
    for k, head in enumerate((np.zeros(len(w), np.int64), d, c << BITS | d, b, a), 1):
        heads, keys, n = levels[k]
        above, known = sought(heads, above << BITS | head if k > 3 else head)
        if known.any():
            cut = np.select([n == 1, n == 2], off[k][:2], off[k][2])
            total, left = (np.bincount(keys >> BITS, x, len(heads)) for x in (n, cut))
            at, held = sought(keys, np.where(known, above << BITS | w, -1))
            p = np.where(known, (np.where(held, (n - cut)[at], 0.0) + left[above] * p) / total[above], p)
        above = np.where(known, above, -1)
    return np.log(p)


def _by_lang(batch: pa.RecordBatch, lang_of) -> dict[str | None, list[int]]:
    rows: dict[str | None, list[int]] = {}
    for i, lang in enumerate(batch["lang"].to_pylist()):
        rows.setdefault(lang_of(lang), []).append(i)
    return rows


def blocks(batch: pa.RecordBatch, lang_of):
    """lang, rows and texts, of at most BLOCK code points unless it is one text: the same in every scan of the same rows."""
    texts = batch["text"].to_pylist()
    for lang, rows in _by_lang(batch, lang_of).items():
        own, held = [], 0
        for i in rows:
            if own and held + len(texts[i] or "") > BLOCK:
                yield lang, own, [texts[j] or "" for j in own]
                own, held = [], 0
            own.append(i)
            held += len(texts[i] or "")
        yield lang, own, [texts[j] or "" for j in own]


def train(trusted: DataFrame, own: set[str], splits: int, scratch: Scratch) -> DataFrame:
    """A row for each shard and model (the languages of own, and OTHER): its grams and counts (size, body), the counts of
    counts of the orders 3 to 5, and pairs (d, w, n: the c before them in this shard). Empty without trusted text.
    """

    def count(batches):
        occupy("classifier")
        for batch in batches:
            for lang, _, texts in blocks(batch, lambda x: x if x in own else None):
                number, grams, _ = distinct(texts)
                n = np.bincount(number, minlength=grams.shape[1])
                order, shards = dealt(grams, splits)
                for shard, i, j in shards:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "lang": pa.array([lang], pa.string()), "size": [j - i], "body": [pack(np.concatenate([grams[:, order[i:j]], n[order[i:j]][None]]))]})

    kinds = "shard int, lang string, size long, body binary, counts array<long>, pairs array<struct<d: int, w: int, n: long>>"

    def merge(group: pa.Table) -> pa.Table:
        parts: dict[str | None, list[np.ndarray]] = {}
        for r in group.select(["lang", "size", "body"]).to_pylist():
            parts.setdefault(r["lang"], []).append(unpack(r["body"], ORDER + 1, r["size"]))
        each = {lang: summed(x) for lang, x in parts.items()}
        models = {lang: x for lang, x in each.items() if lang is not None} | {OTHER: summed([*each.values()])}
        out = []
        for lang, rows in models.items():
            levels = orders(rows)
            heads, keys, _ = levels[3]
            pair, n = np.unique((heads[keys >> BITS] & MASK) << BITS | keys & MASK, return_counts=True)
            counts = [int((levels[k][2] == i).sum()) for k in (3, 4, 5) for i in (1, 2, 3, 4)]
            out.append({"shard": group["shard"][0].as_py(), "lang": lang, "size": rows.shape[1], "body": pack(rows), "counts": counts, "pairs": cells(pair >> BITS, pair & MASK, n)})
        columns = {"shard": pa.int32(), "lang": pa.string(), "size": pa.int64(), "body": pa.binary(), "counts": pa.list_(pa.int64()), "pairs": CELLS}
        return pa.table({c: pa.chunked_array([x[c] for x in out]) if c == "pairs" else pa.array([x[c] for x in out], kind) for c, kind in columns.items()})

    counted = trusted.select("lang", "text").mapInArrow(count, "shard int, lang string, size long, body binary")
    return scratch.keep(counted.groupBy("shard").applyInArrow(merge, kinds), "grams")


CELLS = pa.list_(pa.struct([("d", pa.int32()), ("w", pa.int32()), ("n", pa.int64())]))


def cells(d: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.Array:
    """One list of all of them."""
    held = pa.StructArray.from_arrays([pa.array(d, pa.int32()), pa.array(w, pa.int32()), pa.array(n, pa.int64())], fields=list(CELLS.value_type))
    return pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held).cast(CELLS)


def uncelled(column: pa.ChunkedArray) -> list[np.ndarray]:
    held = pc.list_flatten(column.combine_chunks()) if len(column) else pa.array([], CELLS.value_type)
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return [held.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]


def scores(docs: DataFrame, grams: DataFrame, own: set[str], splits: int, scratch: Scratch) -> DataFrame:
    """uid, doc_id, lang (of the model), n_grams and log_prob of each document."""
    pairs = scratch.keep(grams.select("lang", F.inline("pairs")).groupBy("lang", "d", "w").agg(F.sum("n").alias("n")), "pairs")
    singles = scratch.keep(pairs.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), "singles")
    kinds = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    higher = grams.groupBy("lang").agg(*(F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(12)))
    off: dict[str, dict] = {}  # a few numbers for each language
    for r in higher.collect():
        off[r["lang"]] = {k: discounts(*r[1 + 4 * (k - 3) : 5 + 4 * (k - 3)]) for k in (3, 4, 5)}
    for k, level in ((2, pairs), (1, singles)):
        for r in level.groupBy("lang").agg(*kinds).collect():
            off[r["lang"]][k] = discounts(*r[1:])
    lang_of = lambda x: x if x in own else OTHER

    def wanted(batches):
        occupy("classifier")
        for batch in batches:
            for lang, rows, texts in blocks(batch, lang_of):
                _, found, _ = distinct(texts)
                order, shards = dealt(found, splits)
                for shard, i, j in shards:
                    part = np.ascontiguousarray(found[:, order[i:j]])
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": [batch["uid"][rows[0]].as_py()], "lang": [lang], "size": [j - i], "body": [pack(part)], "check": [zlib.crc32(part)]})

    def look_up(group: pa.Table) -> pa.Table:
        own_rows = group.filter(pc.equal(group["kind"], 0)).select(["lang", "block", "size", "body", "check"]).to_pylist()
        out = []
        for lang in {r["lang"] for r in own_rows}:
            rows = [r for r in own_rows if r["lang"] == lang]
            of = lambda kind: group.filter(pc.and_(pc.equal(group["kind"], kind), pc.equal(group["lang"], lang)))  # noqa: B023, E731
            held = [unpack(r["body"], ORDER + 1, r["size"]) for r in of(5).select(["size", "body"]).to_pylist()]
            levels = orders(held[0] if held else np.zeros((ORDER + 1, 0), np.int64))
            d, w, n = uncelled(of(2)["pairs"])
            order = np.argsort(d << BITS | w)
            heads, at = np.unique(d[order], return_inverse=True)
            levels[2] = heads, at << BITS | w[order], n[order]
            _, w, n = uncelled(of(1)["pairs"])
            order = np.argsort(w)
            levels[1] = np.zeros(1, np.int64), w[order], n[order]
            lp = log_probabilities(np.concatenate([unpack(r["body"], ORDER, r["size"]) for r in rows], axis=1), levels, off[lang], len(w))
            ends = np.cumsum([r["size"] for r in rows])
            out += [(r["block"], group["shard"][0].as_py(), r["check"], x.tobytes()) for r, x in zip(rows, np.split(lp, ends[:-1]), strict=True)]
        return pa.table({c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate((("block", pa.int64()), ("shard", pa.int32()), ("check", pa.int64()), ("lp", pa.binary())))})

    def packed(batches):
        for batch in batches:
            for lang, rows, texts in blocks(batch, lang_of):
                take = lambda c: pa.array([[batch[c][i].as_py() for i in rows]], pa.list_(pa.int64()))  # noqa: B023, E731
                body = "".join(texts).encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([batch["uid"][rows[0]].as_py()], pa.int64()), pa.array([lang]), take("uid"), take("doc_id"), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pa.Codec("zstd", 3).compress(body, asbytes=True)], pa.binary()), pa.array([len(body)], pa.int64())], names=["block", "lang", "uids", "docs", "sizes", "body", "bytes"])

    shard = F.col("shard").cast("int").alias("shard")
    to = lambda first, n: F.explode(F.sequence(first, first + n - 1)).alias("shard")
    listed = F.collect_list(F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in (("d", "int"), ("w", "int"), ("n", "long"))))).alias("pairs")
    none = lambda **kinds: [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    order = ["kind", "shard", "lang", "block", "size", "body", "check", "pairs"]
    lists = "array<struct<d: int, w: int, n: long>>"
    sent = [
        docs.mapInArrow(wanted, "shard int, block long, lang string, size long, body binary, check long").select("*", F.lit(0).alias("kind"), *none(pairs=lists)),
        grams.select("shard", "lang", "size", "body", F.lit(5).alias("kind"), *none(block="long", check="long", pairs=lists)),
        pairs.groupBy("lang", bucket(F.col("d")).alias("bucket")).agg(listed).select(to(F.col("bucket") * splits, splits), "lang", "pairs", F.lit(2).alias("kind"), *none(block="long", size="long", body="binary", check="long")),
        singles.withColumn("d", F.lit(-1)).groupBy("lang").agg(listed).select(to(F.lit(0), BUCKETS * splits), "lang", "pairs", F.lit(1).alias("kind"), *none(block="long", size="long", body="binary", check="long")),
    ]
    met = sent[0].select(order)
    for x in sent[1:]:
        met = met.unionByName(x.withColumn("shard", shard).select(order))
    answers = met.groupBy("shard").applyInArrow(look_up, "block long, shard int, check long, lp binary")
    texts = docs.mapInArrow(packed, "block long, lang string, uids array<long>, docs array<long>, sizes array<long>, body binary, bytes long")
    out = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_grams", pa.int64()), ("log_prob", pa.float64())])

    def score(whole: pa.Table, answered: pa.Table) -> pa.Table:
        occupy("classifier")
        given, parts = {r["shard"]: r for r in answered.to_pylist()}, []
        for r in whole.to_pylist():
            text, at, texts = pa.decompress(r["body"], r["bytes"], "zstd", asbytes=True).decode("utf-8", "surrogatepass"), 0, []
            for size in r["sizes"]:
                texts.append(text[at : at + size])
                at += size
            number, found, places = distinct(texts)
            order, shards = dealt(found, splits)
            lp = np.empty(len(order))
            for shard, i, j in shards:
                if shard not in given or given[shard]["check"] != zlib.crc32(np.ascontiguousarray(found[:, order[i:j]])):
                    raise ValueError("a block's texts differ from those of its grams")
                lp[order[i:j]] = np.frombuffer(given[shard]["lp"])
            parts += [(uid, doc_id, r["lang"], s.stop - s.start, float(lp[number[s]].sum())) for uid, doc_id, s in zip(r["uids"], r["docs"], places, strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts, strict=True), out, strict=True)] if parts else [pa.array([], f.type) for f in out], schema=out)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "uid long, doc_id long, lang string, n_grams long, log_prob double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document with the columns of knclassify.classify."""
    scratch = Scratch(docs.sparkSession)
    rows = only(docs, doc_id="long", lang="string", text="string").withColumn("uid", F.monotonically_increasing_id())
    splits = max(LEAST_SPLITS, -(-(rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // (SHARD * BUCKETS)))
    trusted = trusted_rows(rows.drop("uid"), labels)
    named = trusted.where(F.col("lang").isNotNull() & (F.col("lang") != OTHER)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("text")).alias("longest"))
    own = {r["lang"] for r in named.where((F.col("n") >= MIN_DOCS) & (F.col("longest") >= ORDER)).collect()}  # names of languages
    grams = train(trusted, own, splits, scratch)
    if grams.isEmpty():
        return unjudged(rows)
    found = scratch.keep(scores(rows.select("uid", "doc_id", "lang", "text"), grams, own, splits, scratch), "scores")
    for name in ("grams", "pairs", "singles"):
        scratch.drop(name)
    return judged(found, labels)
