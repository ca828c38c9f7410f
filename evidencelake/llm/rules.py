"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps a bit for each failed rule
beside the measurements that decided it. A policy is a named, versioned mask over those bits,
so new policies, and the effect of leaving one rule out, need no second look at the texts.

Cases: a null or empty text has no words and fails the length rule; repeated rows are judged
alike; other columns are left out of the ledger; an empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidencelake.llm.common import occupy, only

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Measurements, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_shout_words", "n_letter_words")

#: Rule name to the condition under which a document fails it; the position is the bit.
RULES = {
    "too_short": "n_words < 50",
    "repeats_itself": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "upper_case": "100 * n_upper_words > 60 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars > 20 * n_words",
    "shouting": "100 * n_shout_words > 40 * n_words",
    "few_letters": "100 * n_letter_words < 60 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that count.
POLICIES = {
    "base": ("too_short", "repeats_itself"),
    "2024-1": ("too_short", "repeats_itself", "symbols", "upper_case", "repeated_lines"),
    "2024-2": tuple(RULES),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(text: str) -> list[int]:
    """The measurements of one text."""
    found = text.encode("utf-8", "surrogatepass").split()
    n = len(found)
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(SPACES)]
    number = {w: i for i, w in enumerate(dict.fromkeys(found))}
    repeats = 0
    if n >= 3:
        ids = np.fromiter(map(number.__getitem__, found), np.uint64, n)
        # exact: as a pair's number is dense, a triple's key stays under 2 ** 64
        pairs = np.unique(ids[:-1] * np.uint64(len(number)) + ids[1:], return_inverse=True)[1].astype(np.uint64)
        key = pairs[:-1] * np.uint64(len(number)) + ids[2:]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeats = int(covered.sum())
    shout = upper = letter = 0
    for w, times in _counts(found):
        if w[-2:] == b"!!":
            shout += times
        if w.isupper() and len(w) > 1:
            upper += times
        if w.isalpha() or any(c > 127 or chr(c).isalpha() for c in w):
            letter += times
    return [n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), repeats, len(worded), upper, shout, letter]


def _counts(found: list[bytes]):
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    return counts.items()


def _bits():
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return failed


def measured(text: Column) -> Column:
    """The measurements of a text as a struct; only the text goes to Python."""

    def run(texts: pa.Array) -> pa.Array:
        occupy("rules")
        columns: list[np.ndarray] = [np.zeros(len(texts), np.int64) for _ in MEASURES]
        for i, text in enumerate(texts):
            for column, value in zip(columns, measure(text.as_py() or ""), strict=True):
                column[i] = value
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=MEASURES)

    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return F.arrow_udf(run, kind).asNondeterministic()(text.cast("string"))  # so that it isn't run twice a text


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: the bits of the rules that the document fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured(F.col("text")).alias("measures"))
    return rows.select("doc_id", "measures.*").withColumn("failed", _bits())


def passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs, all columns as they are, that a policy keeps; nothing is shuffled."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), measured(F.col("text")).alias("measures"))
    kept = judge(rows.select("own", "measures.*").withColumn("failed", _bits()), policy).where("kept")
    return kept.select(*(F.col("own").getField(c).alias(c) for c in docs.columns))


def judge(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy; the base rules always count."""
    return entries.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)
    )


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many fail it, and how many would be kept without it.

    One pass of bitwise tests over the ledger; the texts aren't read.
    """
    held = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    counts = [F.struct(F.lit(name).alias("rule"), F.count_if(held.bitwiseAND(F.lit(BIT[name])) != 0).alias("n_failed"), F.count_if(held == BIT[name]).alias("n_failed_alone")) for name in POLICIES[policy]]
    summary = entries.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.bit_or(held), F.lit(0)).alias("seen"), F.array(*counts).alias("rules"))
    return summary.select("n_docs", F.inline("rules"))
