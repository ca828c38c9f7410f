"""Stupid-backoff language-model scores, computed relationally.

Characters are the tokens. Count tables of the corpus's trigrams, and of the bigrams and characters
within them, are partitioned by hash of the gram and joined into one score for each trigram that
occurs; each document's exploded trigrams are joined to it by the same partitioning and summed.

    S(c | ab) = n(abc) / n(ab.)  if n(abc) >= MIN_COUNT, else 0.4 S(c | b)
    S(c | b)  = n(bc) / n(b.)    if n(bc) >= MIN_COUNT,  else 0.4 n(c) / N

The counts cover all documents, so a gram seen MIN_COUNT - 1 times or less backs off.

Cases: rows of one doc_id are scored together, null doc_ids likewise; a text that is null or under
three characters has no trigrams and a null score; other columns are left out; an empty table gives
an empty result.

score_words does the same with words (runs outside the six white space characters) as tokens and
counts n(a), n(ab), n(abc) of its own for each order. With L(.) the logarithm, a document's total is

    sum of L(0.16 n(c) / N) over its words from the third on
    + sum over its bigrams bc seen MIN_COUNT times of L(0.4 n(bc) / n(b)) - L(0.16 n(c) / N)
    + sum over its trigrams abc seen MIN_COUNT times of L(n(abc) / n(ab)) - L(0.4 n(bc) / n(b)),

so each n-gram adds a term of its own, one left join serves all orders, and an n-gram that the table
lacks adds nothing: it backs off. Only n-grams seen MIN_COUNT times are kept. An n-gram is known by a
64-bit hash; among n distinct ones two meet with probability n * n / 2 ** 65, and would be counted as
one. Counting and scoring go over the documents PASSES times, each time with the n-grams of one
residue of the hash, so that only that part lies on disk at once.

Cases of score_words: as above, with words for characters; n_grams is the number of word trigrams.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import Scratch, only, words

MIN_COUNT = 2
BACKOFF = 0.4
SHIFT = 21  # bits of a code point
ONE = (1 << SHIFT) - 1
PASSES = 3  # over the documents, for word n-grams
KNOWN = 500_000  # words whose hash a task remembers
DOCS = 500  # documents whose n-grams are added up before they are sent


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams, three code points in a number, and their counts."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(c[:-2] << 2 * SHIFT | c[1:-1] << SHIFT | c[2:], return_counts=True)


def _corpus_counts(docs: DataFrame) -> DataFrame:
    """gram and its count, added up within each batch first."""

    def run(batches):
        for batch in batches:
            own = [trigrams(t.as_py() or "") for t in batch["text"]]
            grams, at = np.unique(np.concatenate([x[0] for x in own] or [np.zeros(0, np.int64)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x[1] for x in own] or [np.zeros(0)]), len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return only(docs, text="string").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _exploded(docs: DataFrame) -> DataFrame:
    """doc_id, gram and its count in the document; a row with gram -1 and count 0 stands for the document itself."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                own = [trigrams(t.as_py() or "") for t in batch["text"]]
                sizes = np.array([len(x[0]) + 1 for x in own])
                gram = np.concatenate([y for x in own for y in ([-1], x[0])])
                n = np.concatenate([y for x in own for y in ([0], x[1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.repeat(np.arange(len(own)), sizes))), pa.array(gram), pa.array(n)], names=["doc_id", "gram", "n"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, gram long, n int")


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram and the logarithm of its stupid-backoff score, out of the trigram counts."""
    head, tail = F.shiftright("gram", SHIFT), F.col("gram").bitwiseAND(F.lit(ONE << SHIFT | ONE))
    first, middle, last = F.shiftright("gram", 2 * SHIFT), F.shiftright("gram", SHIFT).bitwiseAND(F.lit(ONE)), F.col("gram").bitwiseAND(F.lit(ONE))
    total = lambda key, name: counts.groupBy(key.alias(f"k_{name}")).agg(F.sum("n").alias(name))
    n_ab, n_bc, n_b, n_c = total(head, "n_ab"), total(tail, "n_bc"), total(middle, "n_b"), total(last, "n_c")
    everything = counts.agg(F.sum("n").alias("n_all"))
    wide = counts.select("gram", "n", head.alias("k_n_ab"), tail.alias("k_n_bc"), middle.alias("k_n_b"), last.alias("k_n_c"))
    for small in ("n_ab", "n_bc", "n_b", "n_c"):
        wide = wide.join({"n_ab": n_ab, "n_bc": n_bc, "n_b": n_b, "n_c": n_c}[small], f"k_{small}")
    wide = wide.crossJoin(F.broadcast(everything))  # one row
    unigram = F.lit(BACKOFF) * F.col("n_c") / F.col("n_all")
    bigram = F.when(F.col("n_bc") >= MIN_COUNT, F.col("n_bc") / F.col("n_b")).otherwise(unigram)
    trigram = F.when(F.col("n") >= MIN_COUNT, F.col("n") / F.col("n_ab")).otherwise(F.lit(BACKOFF) * bigram)
    return wide.select("gram", F.log(trigram).alias("log_score"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_grams, score: the mean logarithm over the document's trigrams, to six places."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(_corpus_counts(docs), "counts")  # read five times
    scores = scratch.keep(gram_scores(counts), "scores").hint("shuffle_hash")
    joined = _exploded(docs).join(scores, "gram", "left")
    sums = joined.groupBy("doc_id").agg(F.sum("n").alias("n_grams"), F.sum(F.col("n") * F.col("log_score")).alias("total"))
    return sums.select("doc_id", "n_grams", F.round(F.col("total") / F.nullif("n_grams", F.lit(0)), 6).alias("score"))


class Hashes(dict):
    """64-bit hashes of words, computed where they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def of(self, text: str | None) -> np.ndarray:
        found = words(text)
        if len(self) > KNOWN:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram out of that of its head and that of its last word."""
    x = head * np.uint64(0x9E3779B97F4A7C15) + (word ^ np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _added_up(keys: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, how often each occurs, and the others where it first does."""
    distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
    return distinct, n, *(x[first] for x in others)


def _word_counts(docs: DataFrame, part: int) -> DataFrame:
    """The n-grams of one residue seen MIN_COUNT times, and all words of it: key, size, n, head (without the last word) and tail (without the first)."""

    def run(batches):
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                own = [hashes.of(t.as_py()) for t in whole["text"].slice(at, DOCS)]
                for size in (1, 2, 3):
                    cut: list[tuple[np.ndarray, ...]] = []
                    for w in own:
                        two = longer(w[:-1], w[1:])
                        key = w if size == 1 else two if size == 2 else longer(two[:-1], w[2:])
                        head, tail = (key, key) if size == 1 else (w[:-1], w[1:]) if size == 2 else (two[:-1], two[1:])
                        mine = key % np.uint64(PASSES) == part
                        cut.append((key[mine], head[mine], tail[mine]))
                    key, n, head, tail = _added_up(*(np.concatenate([x[i] for x in cut]) for i in range(3)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), size, np.int8)), pa.array(n.astype(np.int64)), pa.array(head.view(np.int64)), pa.array(tail.view(np.int64))], names=["key", "size", "n", "head", "tail"])

    rows = only(docs, text="string").mapInArrow(run, "key long, size byte, n long, head long, tail long")
    return rows.groupBy("key", "size").agg(F.sum("n").alias("n"), F.first("head").alias("head"), F.first("tail").alias("tail")).where(f"size = 1 or n >= {MIN_COUNT}")


def word_terms(counts: DataFrame, n_all: int) -> DataFrame:
    """key, size and the term that each occurrence of the n-gram adds to a total."""
    of = lambda k: counts.where(f"size = {k}")
    one = of(1).select("key", "n", F.log(F.lit(BACKOFF * BACKOFF) * F.col("n") / F.lit(n_all)).alias("alone"))
    two = (
        of(2).join(one.select(F.col("key").alias("head"), F.col("n").alias("n_head")), "head").join(one.select(F.col("key").alias("tail"), "alone"), "tail")
        .select("key", "n", F.log(F.lit(BACKOFF) * F.col("n") / F.col("n_head")).alias("backed"), "alone")
    )
    three = of(3).join(two.select(F.col("key").alias("head"), F.col("n").alias("n_head")), "head").join(two.select(F.col("key").alias("tail"), "backed"), "tail")
    kinds = lambda k: F.lit(k).cast("byte").alias("size")
    return (
        one.where(f"n >= {MIN_COUNT}").select("key", kinds(1), F.col("alone").alias("term"))
        .unionByName(two.select("key", kinds(2), (F.col("backed") - F.col("alone")).alias("term")))
        .unionByName(three.select("key", kinds(3), (F.log(F.col("n") / F.col("n_head")) - F.col("backed")).alias("term")))
    )


def _word_rows(docs: DataFrame, part: int) -> DataFrame:
    """doc_id, key, size and the count of each n-gram of one residue that ends at a word from the third on; a row of size 0 stands for the document itself."""

    def run(batches):
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                sizes = []
                for t in batch["text"]:
                    w = hashes.of(t.as_py())
                    two = longer(w[:-1], w[1:])
                    held = [(np.zeros(1, np.uint64), np.zeros(1, np.int8), np.zeros(1, np.int32))]
                    for size, key in ((1, w[2:]), (2, two[1:]), (3, longer(two[:-1], w[2:]))):
                        key, n = _added_up(key[key % np.uint64(PASSES) == part])
                        held.append((key, np.full(len(key), size, np.int8), n.astype(np.int32)))
                    rows += held
                    sizes.append(sum(len(x[0]) for x in held))
                key, size, n = (np.concatenate([x[i] for x in rows]) for i in range(3))
                ids = batch["doc_id"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.view(np.int64)), pa.array(size), pa.array(n)], names=["doc_id", "key", "size", "n"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, key long, size byte, n int")


def score_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_grams, score: the mean logarithm over the document's word trigrams, to six places."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = [scratch.keep(_word_counts(docs, part), f"counts-{part}") for part in range(PASSES)]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    n_all = every.where("size = 1").agg(F.sum("n")).first()[0] or 1
    terms = scratch.keep(word_terms(every, n_all), "terms")
    for part in range(PASSES):
        scratch.drop(f"counts-{part}")
    once = math.log(BACKOFF * BACKOFF / n_all)  # of a word that only occurs once
    totals = None
    for part in range(PASSES):
        mine = terms.where(F.pmod(F.expr(f"key % {PASSES} + IF(key < 0, {2**64 % PASSES}, 0)"), F.lit(PASSES)) == part).hint("shuffle_hash")
        joined = _word_rows(docs, part).join(mine, ["key", "size"], "left")
        term = F.coalesce("term", F.when(F.col("size") == 1, once).otherwise(0.0))
        sums = joined.groupBy("doc_id").agg(F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("n_grams"), F.sum(F.col("n") * term).alias("total"))
        kept = scratch.keep(sums, f"totals-{part}")
        totals = kept if totals is None else totals.unionByName(kept)
    sums = totals.groupBy("doc_id").agg(F.sum("n_grams").alias("n_grams"), F.sum("total").alias("total"))
    return sums.select("doc_id", "n_grams", F.round(F.col("total") / F.nullif("n_grams", F.lit(0)), 6).alias("score"))
