"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Characters fall into 64 classes (letters of the Latin scripts apart, capitals together, digits,
spaces, punctuation, symbols), so a language's trigram table has 64 ** 3 entries at any size of the
corpus. Trigrams of trusted documents are counted in every partition and summed; three discounts
from the counts of counts, continuation counts below the top order and interpolation down to the
uniform distribution give the probabilities. The table is cut into shards by the first class of a
trigram. Blocks of documents send each shard the trigrams they hold; a join on (language, shard,
salt) brings tables and blocks together, and partial sums are added per document. A document is
kept if its perplexity, drawn towards its language's for short texts, is at most a threshold set by
quantiles of trusted documents of that language.

Cases: null texts and texts under three characters have no trigrams and stand at their language's
median; a null or rare language (less than MIN_DOCS trusted documents) counts as OTHER, which is
modelled on all trusted text; without trusted text every document is kept; repeated rows each get a
row; null labels and labels of no document teach nothing; other columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import Scratch, occupy, only, unused

CLASSES = 64
TABLE = CLASSES**3
SHARDS = 8
BLOCK = 500  # documents
SALTED = 20_000  # documents to a salt
LANGS = 32  # tables that a task adds up at a time
MIN_DOCS = 20  # trusted documents that a language needs for a model of its own
OTHER = "(other)"
PRIOR = 60.0  # trigrams' worth of weight towards the language's median
BROADCAST = 4_000_000  # labels; beyond it they are joined by a shuffle
QUANTILES = (0.5, 0.98)
SLACK = 1.0  # threshold: the upper quantile and this much of its distance from the median
LEAST_SLACK = 0.1  # nats a trigram


def _codes() -> np.ndarray:
    """The class of each code point under 256; any other counts as a letter of its own class."""
    code = np.full(257, 61, np.uint8)  # symbols
    code[256] = 59  # other letters
    code[[9, 10, 11, 12, 13, 32, 160]] = 62
    code[48:58] = 60
    code[65:91] = 63
    code[192:223] = 63
    for c in ".,;:?'\"()-":
        code[ord(c)] = 58
    code[97:123] = np.arange(26)
    code[223:255] = 26 + np.arange(32)
    return code


CODES = _codes()


def grams(text: str) -> np.ndarray:
    c = CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)].astype(np.int64)
    return c[:-2] << 12 | c[1:-1] << 6 | c[2:] if len(c) >= 3 else np.zeros(0, np.int64)


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log probabilities p(c | ab) of all trigrams, out of counts of shape (64, 64, 64)."""

    def step(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Discounted n over its last axis, interpolated with the lower order."""
        ones, twos, threes, fours = (float((n == k).sum()) for k in (1, 2, 3, 4))
        y = ones / (ones + 2 * twos) if ones else 0.5
        d = [0.0, max(0.1, 1 - 2 * y * twos / ones) if ones else 0.5, max(0.1, 2 - 3 * y * threes / twos) if twos else 0.7, max(0.1, 3 - 4 * y * fours / threes) if threes else 0.9]
        off = np.select([n >= 3, n == 2, n == 1], [min(d[3], 2.9), min(d[2], 1.9), min(d[1], 0.95)], 0.0)
        total = n.sum(-1, keepdims=True)
        left = off.sum(-1, keepdims=True)
        return np.where(total > 0, (n - off + left * lower) / np.maximum(total, 1), lower)

    after = (counts > 0).sum(0).astype(float)  # kinds of trigram that end in bc
    first = (after > 0).sum(0).astype(float)
    one = step(first, np.full(CLASSES, 1 / CLASSES))
    two = step(after, one[None, :])
    return np.log(step(counts.astype(float), two[None, :, :]))


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = only(labels, doc_id="long", quality="int").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(F.broadcast(good) if good.count() <= BROADCAST else good, "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, shard and table (packed log probabilities) for every language that has enough trusted text, and for OTHER; empty without trusted text.

    A language's probabilities are made in one group of at most TABLE counts, however much text there is.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
    trusted = trusted_rows(only(docs, doc_id="long", lang="string", text="string"), labels)
    enough = trusted.groupBy("lang").count().where(F.col("lang").isNotNull() & (F.col("lang") != OTHER) & (F.col("count") >= MIN_DOCS)).select("lang")

    def run(batches):
        occupy("classifier")
        counts: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                if lang not in counts:
                    if len(counts) >= LANGS:
                        yield from sent(counts)
                    counts[lang] = np.zeros(TABLE, np.int64)
                counts[lang] += np.bincount(grams(text.as_py() or ""), minlength=TABLE)
        yield from sent(counts)

    def sent(counts):
        for lang, n in counts.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(n[held])], schema=schema)
        counts.clear()

    counted = trusted.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = counted.join(enough, "lang", "left_semi")
    everything = counted.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(OTHER).alias("lang"), "gram", "n")
    cut = TABLE // SHARDS

    def model(group: pa.Table) -> pa.Table:
        n = np.zeros(TABLE, np.int64)
        n[group["gram"].to_numpy()] = group["n"].to_numpy()
        p = kneser_ney(n.reshape(CLASSES, CLASSES, CLASSES)).reshape(-1).astype("<f4")
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * SHARDS, pa.string()), "shard": pa.array(range(SHARDS), pa.int32()), "table": pa.array([p[s * cut : (s + 1) * cut].tobytes() for s in range(SHARDS)], pa.binary())})

    return own.unionByName(everything).groupBy("lang").applyInArrow(model, "lang string, shard int, table binary")


def scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """uid, doc_id, lang (of the model), n_grams and log_prob of each document."""
    salts = max(1, -(-docs.count() // SALTED))  # the tables are sent once for each
    known = {r["lang"] for r in model.select("lang").distinct().collect()}  # names of languages
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("salt", pa.int32()), ("uids", pa.binary()), ("docs", pa.list_(pa.int64())), ("at", pa.binary()), ("grams", pa.binary()), ("times", pa.binary())])

    def blocks(batches):
        occupy("classifier")
        for batch in batches:
            langs = [x if x in known else OTHER for x in batch["lang"].to_pylist()]
            uids, ids = batch["uid"].to_numpy(), batch["doc_id"].to_pylist()
            for lang in sorted(set(langs)):
                rows = [i for i, x in enumerate(langs) if x == lang]
                for begin in range(0, len(rows), BLOCK):
                    own = rows[begin : begin + BLOCK]
                    found = [np.unique(grams(batch["text"][i].as_py() or ""), return_counts=True) for i in own]
                    at = np.repeat(np.arange(len(own), dtype=np.uint16), [len(x[0]) for x in found])
                    g, n = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).astype(np.uint32)
                    shard = g // (TABLE // SHARDS)
                    salt = int(uids[own[0]] % 1_000_003 % salts)
                    for s in range(SHARDS):
                        held = shard == s
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([s], pa.int32()), pa.array([salt], pa.int32()), pa.array([uids[own].tobytes()], pa.binary()), pa.array([[ids[i] for i in own]], pa.list_(pa.int64())), pa.array([at[held].tobytes()], pa.binary()), pa.array([(g[held] % (TABLE // SHARDS)).astype(np.uint16).tobytes()], pa.binary()), pa.array([n[held].tobytes()], pa.binary())], schema=schema)

    packed = docs.mapInArrow(blocks, "lang string, shard int, salt int, uids binary, docs array<long>, at binary, grams binary, times binary")
    tables = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("lp", pa.float64())])

    def partial(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                uids = np.frombuffer(batch["uids"][i].as_buffer(), np.int64)
                at, g, n, table = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (("at", np.uint16), ("grams", np.uint16), ("times", np.uint32), ("table", np.float32)))
                lp = np.bincount(at, table[g].astype(float) * n, len(uids))
                yield pa.RecordBatch.from_arrays([pa.array(uids), batch["docs"][i].values, pa.array([batch["lang"][i].as_py()] * len(uids), pa.string()), pa.array(np.bincount(at, n, len(uids)).astype(np.int64)), pa.array(lp)], schema=out)

    joined = packed.join(tables, ["lang", "shard", "salt"]).select("lang", "uids", "docs", "at", "grams", "times", "table")
    return joined.mapInArrow(partial, "uid long, doc_id long, lang string, n long, lp double").groupBy("uid", "doc_id", "lang").agg(F.sum("n").alias("n_grams"), F.sum("lp").alias("log_prob"))


def row_key():
    """A key of a row's content, the same in every scan."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))


def unjudged(rows: DataFrame) -> DataFrame:
    """What classify gives without trusted text."""
    return rows.select("doc_id", F.lit(OTHER).alias("model_lang"), F.lit(0).cast("long").alias("n_grams"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("smoothed"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"), "uid")


def judged(found: DataFrame, labels: DataFrame) -> DataFrame:
    """What classify gives, out of the scores."""
    # kept, as four jobs read it, each of which would bring the ids of trusted documents to the driver
    trusted = Scratch(found.sparkSession).keep(trusted_rows(found.where("n_grams > 0").select("doc_id", "lang", "n_grams", "log_prob"), labels), "trusted")
    middle = trusted.groupBy("lang").agg(F.percentile_approx(-F.col("log_prob") / F.col("n_grams"), 0.5, 10_000).alias("middle"))
    overall = trusted.agg(F.percentile_approx(-F.col("log_prob") / F.col("n_grams"), 0.5, 10_000)).first()[0]
    drawn = (PRIOR * F.col("middle") - F.col("log_prob")) / (PRIOR + F.col("n_grams"))
    with_rate = lambda df: df.join(F.broadcast(middle), "lang", "left").withColumn("middle", F.coalesce("middle", F.lit(overall))).withColumn("rate", drawn)
    low, high = (F.percentile_approx("rate", q, 10_000) for q in QUANTILES)
    bars = with_rate(trusted).groupBy("lang").agg((high + SLACK * F.greatest(high - low, F.lit(LEAST_SLACK))).alias("bar"))
    top = with_rate(trusted).agg((high + SLACK * F.greatest(high - low, F.lit(LEAST_SLACK))).alias("bar")).first()["bar"]
    rated = with_rate(found).join(F.broadcast(bars), "lang", "left").withColumn("bar", F.coalesce("bar", F.lit(top)))
    return rated.select("doc_id", F.col("lang").alias("model_lang"), "n_grams", F.exp(-F.col("log_prob") / F.nullif("n_grams", F.lit(0))).alias("perplexity"), F.exp("rate").alias("smoothed"), F.exp("bar").alias("threshold"), (F.col("rate") <= F.col("bar")).alias("kept"), "uid")


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that the classifier keeps."""
    rejected = Scratch(docs.sparkSession).keep(classify(docs, labels, row_key()).where("not kept").select("uid").distinct(), "rejected")
    few = rejected.count() <= BROADCAST
    name = unused(docs, "rejected_key")
    keyed = docs.select("*", row_key().alias(name))
    left = keyed.join(F.broadcast(rejected) if few else rejected, keyed[name] == rejected["uid"], "left_anti")
    return left.drop(name)


def classify(docs: DataFrame, labels: DataFrame, uid: Column | None = None) -> DataFrame:
    """A row per document: doc_id, model_lang, n_grams, perplexity (null without trigrams), smoothed (drawn towards the language's), threshold, kept, uid.

    uid tells rows apart; equal ones, if given, are judged once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = only(docs, doc_id="long", lang="string", text="string").withColumn("uid", F.monotonically_increasing_id() if uid is None else uid)
    model = scratch.keep(train(docs, labels), "model")
    if model.isEmpty():
        return unjudged(rows)
    return judged(scratch.keep(scores(rows.select("uid", "doc_id", "lang", "text"), model), "scores"), labels)
