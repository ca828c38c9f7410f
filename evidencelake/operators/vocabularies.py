"""Canonical labels from vocabularies of any number of patterns, looked up once for each distinct token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import patterns as P
from evidencelake.functions import text as T
from evidencelake.functions.automaton import Automaton, folded

#: What a task may hold of patterns; beyond it, a vocabulary is an error rather than a strain on every worker.
MOST_CHARACTERS = 20_000_000


class Matcher:
    """The labels, in order, of which a pattern hits a token: as whole words within its key, or as an expression in the token.

    Keys and literal expressions go into one automaton each; only what is no literal is tried as an expression.
    """

    def __init__(self, vocabulary: dict[str, list[str]]):
        keys, literals, self.expressions = [], [], []
        for i, patterns in enumerate(vocabulary.values()):
            keys += [(f" {k} ", i) for p in patterns if (k := T.plain_key(p))]
            for p in filter(P.valid, patterns):
                if re.escape(p).replace("\\ ", " ").replace("\\-", "-") == p:
                    literals.append((folded(p), i))
                else:
                    self.expressions.append((re.compile(p, re.IGNORECASE), i))
        if sum(len(p) for p, _ in keys + literals) > MOST_CHARACTERS:
            raise ValueError(f"a vocabulary may have {MOST_CHARACTERS} characters of patterns at most")
        self.labels = list(vocabulary)
        self.keys, self.literals = Automaton(keys), Automaton(literals)

    def __call__(self, token: str, key: str) -> list[str]:
        hits = self.keys.found(f" {key} ") | self.literals.found(folded(token))
        hits |= {i for expression, i in self.expressions if i not in hits and expression.search(token)}
        return [self.labels[i] for i in sorted(hits)]


def labelled(tokens: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """tokens (with a column token) and labels: all that a token has, in the vocabulary's order; null for a null token.

    Distinct tokens are looked up by Arrow batches and joined back; Spark splits the rows of a frequent token. The automata
    are made once in each task, from the vocabulary that comes with it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Matcher(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"token": batch["token"], "labels": [find(t, k) for t, k in zip(batch["token"], batch["key"], strict=True)]})

    Matcher({k: v for k, v in vocabulary.items()})  # a vocabulary that is too large is told here
    distinct = tokens.select("token").where("token is not null").distinct()
    found = distinct.select("token", T.token_key(F.col("token")).alias("key")).mapInPandas(run, "token string, labels array<string>")
    return tokens.join(found, "token", "left")
