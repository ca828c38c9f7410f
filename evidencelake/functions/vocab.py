"""Multi-value cells and vocabularies: a cell becomes tokens, a token its canonical labels."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidencelake.functions import patterns as P
from evidencelake.functions import text as T
from evidencelake.functions.literals import with_items

Vocabulary = dict[str, list[str]]


#: Cells that the simpler reading takes for missing (fixed values).
MISSING_CELLS = ("", "nan", "none", "n/a", "na", "not applicable")
SPLIT = f"(?U){T.WS}*[,;|\n]{T.WS}*"


def cell_tokens(c: Column, missing: Iterable[str] = T.MISSING_VALUES) -> Column:
    """Tokens of a delimited, bracketed or quoted cell, or of the values of a written list; missing ones are left out."""
    bare = lambda x: T.strip(T.strip_chars(T.strip_chars(T.strip(x), "'"), '"'))

    def plain(text: Column) -> Column:
        return F.transform(F.split(T.strip_chars(text, "[]"), SPLIT), bare)

    tokens = with_items(T.strip(c), lambda items: F.flatten(F.transform(items, lambda x: plain(T.strip(x)))), plain)
    return F.when(T.is_missing(c, missing), F.array().cast("array<string>")).otherwise(F.filter(tokens, lambda x: ~T.is_missing(x, missing)))


def listed(c: Column) -> Column:
    """The simpler reading of a list cell: only the whole cell can be missing, so 'not specified' stays a value, and a written list's values are not cut."""
    none = F.array().cast("array<string>")

    def filled(parts: Column) -> Column:
        return F.transform(F.filter(F.transform(parts, T.strip), lambda x: x != ""), lambda x: T.strip_chars(T.strip_chars(x, "'"), '"'))

    def items(text: Column) -> Column:
        read = with_items(text, filled, lambda x: filled(F.split(T.strip_chars(x, "[]"), SPLIT)))
        return F.when(F.lower(text).isin(*MISSING_CELLS), none).otherwise(read)

    return F.coalesce(T.let(T.strip(c), items), none)


def _either(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _hits(text: Column, patterns: Iterable[str]) -> Column | None:
    """Whether any of the valid patterns is found in a text, in any case."""
    known = [P.java(p) for p in patterns if P.valid(p)]
    return text.rlike(P.ANY_CASE + _either(known)) if known else None


def labels_of(token: Column, vocabulary: Vocabulary) -> Column:
    """Every label, in the vocabulary's order, one of whose patterns hits the token.

    A pattern hits as whole words within the token's key, or as a regular expression in the token itself;
    patterns that aren't valid expressions count as words alone. One alternation a side and label.
    """
    def found(key: Column) -> Column:
        hits = []
        for label, patterns in vocabulary.items():
            keys = [re.escape(k) for p in patterns if (k := T.plain_key(p))]
            tests = [t for t in (key.rlike(r"\b(?:" + _either(keys) + r")\b") if keys else None, _hits(token, patterns)) if t is not None]
            if tests:
                hits.append(F.when(tests[0] | tests[1] if len(tests) > 1 else tests[0], F.lit(label)))
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    return T.let(T.token_key(token), found)


def unmatched_label(token: Column) -> Column:
    """The token without brackets, then quotation marks, at its ends."""
    return F.regexp_replace(T.strip_chars(T.strip_chars(T.strip_chars(T.strip(token), "[]"), "'"), '"'), f"(?U){T.WS}+", " ")


def group_of(value: Column, groups: Vocabulary, prefix: str | None = None) -> Column:
    """The first group that hits the first of a cell's values that any does; values without the wanted prefix, in any case, don't count."""
    def hit(x: Column) -> Column:
        hits = [F.when(test, F.lit(name)) for name, patterns in groups.items() if (test := _hits(x, patterns)) is not None]
        found = F.coalesce(*hits) if hits else F.lit(None).cast("string")
        return F.when(F.lower(x).startswith(prefix.lower()), found) if prefix else found

    items = T.let(listed(value), lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(T.strip(value))))
    return F.get(F.filter(F.transform(items, hit), lambda x: x.isNotNull()), F.lit(0))


def free_text_label(value: Column, vocabulary: Vocabulary) -> Column:
    """The first label, in order, one of whose patterns hits the cell's text, or whose words are within its key; else the text."""
    def label(text: Column) -> Column:
        def found(key: Column) -> Column:
            hits = []
            for name, patterns in vocabulary.items():
                test = _hits(text, patterns)
                test = F.lit(False) if test is None else test
                for k in filter(None, map(T.plain_key, patterns)):
                    test = test | key.contains(k)
                hits.append(F.when(test, F.lit(name)))
            return F.when(text == "", text).otherwise(F.coalesce(*hits, text))

        return T.let(T.token_key(text), found)

    return T.let(T.display(value), label)
