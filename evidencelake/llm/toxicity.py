"""Toxicity by Levenshtein automata intersected with a lexicon trie, scored over context windows.

The lexicon is learned from labelled documents: whole words and word beginnings that toxic
documents hold far more often than others. Its entries form a trie. The Levenshtein automaton
of every entry runs over that trie at once; the sets of (node, edits) that occur are remembered,
so scanning is one table look-up for each character and most words die after three. A hit counts
by the learned weight of its entry, less if it was misspelled; hits inside quotation marks are
measured apart from bare ones, and the heaviest window of words, one over bare hits and one over
quoted ones, shows whether hits cluster, as they do in abuse. A logistic fit over these measurements
gives the score.

Fitting takes at most `max_rows` labelled rows of each class, the first by a hash of their id,
each weighted by how many of its class it stands for, so that the share of toxic rows is that of all
labelled rows whatever their number; scoring takes whole texts and only texts.

Cases: null and empty texts have no hits and get the score of that; labels without a document, null
labels and null ids teach nothing; with no label of either class every score is 0; repeated rows
each get a row; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import occupy, only

MAX_ROWS = 10_000  # labelled rows of each class that a fit takes
MAX_TERMS = 400  # entries of the lexicon
WINDOW = 40  # words
FOLD = 5
STEM = (4, 9)  # lengths of word beginnings that are tried
WORD = re.compile(r"[^\W\d_]+(?:[@$*0-9][^\W\d_]+)*")
QUOTES = re.compile(r"[\"“„«][^\"“”„«»\n]*[\"”“»]")


def edits(term: str) -> int:
    """Edits that still count as the term: none for short terms and word beginnings."""
    return 0 if term.endswith("*") or len(term) < 4 else 1 if len(term) < 8 else 2


class Lexicon:
    """Weighted terms; `scum` is a whole word, `scum*` every word that begins so."""

    def __init__(self, weights: dict[str, float]):
        self.terms = sorted(weights)
        self.weights = [weights[t] for t in self.terms]
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]  # most edits of any term below a node
        for k, term in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], edits(term))
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.child[node][c]
                self.reach[node] = max(self.reach[node], edits(term))
            self.ends[node].append(k)
        self.start = self._closed({(0, 0, "")})
        self.states = {self.start: 0}
        self.sets = [self.start]
        self.steps: list[dict[str, int]] = [{}]
        self.hits = [self._best(self.start)]
        self.words: dict[str, tuple[int, int] | None] = {}

    def _closed(self, positions) -> frozenset:
        """With the terms' letters that a text may leave out, the fewest edits for each place."""
        best: dict[tuple[int, str], int] = {}
        todo = list(positions)
        while todo:
            node, e, awaited = todo.pop()
            if e > self.reach[node] and not (e == 0) or best.get((node, awaited), 99) <= e:
                continue
            best[node, awaited] = e
            if not awaited:
                todo += [(below, e + 1, "") for below in self.child[node].values()]
        return frozenset((node, e, awaited) for (node, awaited), e in best.items())

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int, str]] = set()
        for node, e, awaited in self.sets[state]:
            if awaited:  # the second letter of a swapped pair
                if c == awaited:
                    after.add((node, e, ""))
                continue
            if node < 0 or any(self.terms[k].endswith("*") and e == 0 for k in self.ends[node]):
                after.add((node, e, ""))  # a beginning was met; whatever follows belongs to the word
            for letter, below in self.child[node].items():
                after.add((below, e + (letter != c), ""))
                if letter != c and (swapped := self.child[below].get(c)) is not None:
                    after.add((swapped, e + 1, letter))
            after.add((node, e + 1, ""))
        found = self._closed(after)
        if found not in self.states:
            self.states[found] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            self.hits.append(self._best(found))
        return self.states[found]

    def _best(self, positions: frozenset) -> tuple[int, int] | None:
        """(edits, term) of the closest term that ends here."""
        return min(((e, k) for node, e, awaited in positions if not awaited for k in self.ends[node] if e <= edits(self.terms[k])), default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) for a lower-case word."""
        if word in self.words:
            return self.words[word]
        state, steps = 0, self.steps
        for c in word:
            after = steps[state].get(c)
            if after is None:
                after = steps[state][c] = self._step(state, c)
            state = after
            if not self.sets[state]:
                break
        if len(self.words) > 300_000:
            self.words.clear()
        self.words[word] = self.hits[state]
        return self.hits[state]


def heaviest(hits: list[tuple[int, float]]) -> float:
    """The largest total weight of hits within WINDOW words; hits are (place, weight) in order of place."""
    best = total = 0.0
    first = 0
    for place, weight in hits:
        total += weight
        while hits[first][0] <= place - WINDOW:
            total -= hits[first][1]
            first += 1
        best = max(best, total)
    return best


#: What `measurements` gives, in this order.
MEASURED = ("exact", "fuzzy", "stems", "cited", "bare_window", "cited_window", "terms", "density", "any_exact")


def measurements(text: str, lexicon: Lexicon) -> list[float]:
    """What the score rests on; the same for a text of any length.

    A hit is quoted if it stands between quotation marks, whatever else the text says elsewhere;
    quoted hits have a window of their own and never add to the window of bare ones.
    """
    low = text.lower()
    match, known, weights = lexicon.match, lexicon.words, lexicon.weights
    found = WORD.findall(low)
    hits = [(i, h) for i, w in enumerate(found) if (h := known[w] if w in known else match(w)) is not None]
    if not hits:
        return [0.0] * len(MEASURED)
    quotes = [m.span() for m in QUOTES.finditer(low)]
    starts = [m.start() for m in WORD.finditer(low)] if quotes else []
    totals = {"exact": 0.0, "fuzzy": 0.0, "stems": 0.0, "cited": 0.0}
    bare: list[tuple[int, float]] = []
    cited: list[tuple[int, float]] = []
    quote = 0  # the first that doesn't end before the hit
    for i, (e, k) in hits:
        weight = weights[k] * 0.5**e
        while quote < len(quotes) and quotes[quote][1] <= starts[i]:
            quote += 1
        if quote < len(quotes) and quotes[quote][0] < starts[i]:
            totals["cited"] += weight
            cited.append((i, weight))
        else:
            totals["stems" if lexicon.terms[k].endswith("*") else "fuzzy" if e else "exact"] += weight
            bare.append((i, weight))
    all_bare = totals["exact"] + totals["fuzzy"] + totals["stems"]
    amounts = [*totals.values(), heaviest(bare), heaviest(cited), len({k for _, (_, k) in hits}), 100 * all_bare / len(found)]
    return [*map(math.log1p, amounts), float(totals["exact"] > 0)]


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels outside the held-out fold."""
    return only(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % FOLD != 0)


def by_class(rows: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text, toxic of a bounded sample of labelled rows outside the held-out fold."""
    usable = usable_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [r for c in (0, 1) for r in usable.where(F.col("toxic") == c).orderBy(*order).limit(max_rows).collect()]
    spark = docs.sparkSession
    sample = spark.createDataFrame(picked, "doc_id long, toxic int")
    return only(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id")


def learn_lexicon(rows: DataFrame, n_toxic: int, n_other: int, max_terms: int) -> dict[str, float]:
    """Terms by the log-odds of a toxic document, word beginnings where they cover many words."""
    schema = pa.schema([("term", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])

    def run(batches):
        bad: Counter[str] = Counter()
        good: Counter[str] = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                seen = set(WORD.findall((text.as_py() or "").lower()))
                seen |= {w[:n] + "*" for w in seen for n in range(STEM[0], min(STEM[1], len(w)))}
                (bad if toxic else good).update(seen)
            if len(bad) + len(good) > 400_000:
                yield flush(bad, good)
        yield flush(bad, good)

    def flush(bad, good):
        terms = list(bad.keys() | good.keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())], schema=schema)
        bad.clear()
        good.clear()
        return out

    counts = rows.select("text", "toxic").mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    least = max(4, n_toxic // 250)
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("good") + 0.5) / (n_other + 1.0))
    # a score that asks for both: far more likely in toxic documents, and in many of them
    best = counts.where(f"bad >= {least}").withColumn("odds", odds).where("odds > 1.8").withColumn("worth", F.col("odds") * F.sqrt("bad")).orderBy(F.desc("worth"), "term").limit(20 * max_terms).collect()
    chosen: dict[str, float] = {}
    for r in best:
        term = r["term"]
        stem = term.rstrip("*")
        beginnings = [stem[:n] + "*" for n in range(STEM[0], len(stem) + 1)]
        if any(b in chosen for b in beginnings):
            continue  # a shorter beginning says as much
        if term.endswith("*") and any(c.rstrip("*").startswith(stem) and c != term and chosen[c] >= r["odds"] - 0.7 and not c.endswith("*") for c in chosen) and r["odds"] < 4:
            continue
        chosen[term] = r["odds"]
        if len(chosen) == max_terms:
            break
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge; the last coefficient is constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(len(beta))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


@lru_cache(maxsize=4)
def _lexicon(items: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(dict(items))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, and n_terms: the entries that it holds."""
    rows = training_rows(docs, labels, max_rows)
    sizes = by_class(rows)
    base = only(docs, doc_id="long", text="string")
    held = (F.crc32(F.col("doc_id").cast("string")) % FOLD == 0).alias("held_out")
    if not (sizes.get(0) and sizes.get(1)):
        return base.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_terms"))
    terms = tuple(sorted(learn_lexicon(rows, sizes[1], sizes[0], max_terms).items()))
    kinds = "array<double>"
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measured(batches):
        lexicon = _lexicon(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([measurements(t.as_py() or "", lexicon) for t in batch["text"]], pa.list_(pa.float64()))], schema=schema)

    seen = rows.select("text", "toxic").mapInArrow(measured, f"toxic int, x {kinds}").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["toxic"]) for r in seen])
    totals = by_class(only(docs, doc_id="long").join(usable_labels(labels), "doc_id"))
    beta = logistic(x, y, np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0]))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_terms", pa.int32())])

    def scored(batches):
        occupy("toxicity", _lexicon.cache_clear)
        lexicon = _lexicon(terms)
        for batch in batches:
            found = np.array([measurements(t.as_py() or "", lexicon) for t in batch["text"]]).reshape(-1, len(beta) - 1)
            p = 1 / (1 + np.exp(-np.clip(found @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p), pa.array(np.rint(np.expm1(found[:, MEASURED.index("terms")])).astype(np.int32))], schema=out)

    return base.mapInArrow(scored, "doc_id long, score double, n_terms int").select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_terms")
