"""Written lists, patterns and large vocabularies against Python's own reading."""

import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import patterns as P
from evidencelake.functions import text as T
from evidencelake.functions import vocab as V
from evidencelake.functions.literals import written_items
from evidencelake.operators import vocabularies


def column(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def leaves(value):
    return [x for v in value for x in (leaves(v) if isinstance(v, (list, tuple, set)) else [str(v)])]


CELLS = [
    "['A', 'B']", "120, 85", "('A', 'N/A')", "('A')", "('A',)", "()", "[]", "{}", "{'a'}", "{1, 2.50, -3}", "[1, [2, ('x', \"y\")], []]", "[1 2]", "[,]", "[1,,2]", "[1,]", "1,", ",", "'a', 'b'", "'a'", "12", "[1, 2", "1, 2]", "(1, 2]",
    "([1])", "((1))", "((1,))", "[(1)]", "['it\\'s', \"\\\"q\\\"\", 'a\\\\nb', 'c\\nd']", "['a\\qb', 1]", "[None, True, False]", "[Nones]", "[A, B]", "08, 1", "[.5, 5., 0.0, 10.0]", "{'a': 1}", "a, b", "", " [ 'x' , 'y' ] ", "['a' 'b']", "1, 2.5.1",
]


def expected(text):
    if "\\q" in text or "'a' 'b'" in text:  # outside the stated grammar
        return None
    try:
        value = ast.literal_eval(text.strip())
    except Exception:
        return None
    return leaves(value) if isinstance(value, (list, tuple)) or (isinstance(value, set) and len(value) < 2) else leaves([1, 2.5, -3]) if isinstance(value, set) else None


def test_written_lists_equal_literal_evaluation(spark):
    found = column(spark, CELLS, written_items)
    assert {c: f for c, f in zip(CELLS, found, strict=True)} == {c: expected(c) for c in CELLS}


def test_generated_lists(spark):
    rng = random.Random(2)

    def value(depth):
        if depth and rng.random() < 0.4:
            items = [value(depth - 1) for _ in range(rng.randint(0, 3))]
            return rng.choice([items, tuple(items)])
        return rng.choice([1, -2.5, 0, "a", "it's", 'say "x"', "b;c, d", None, True, "\\", "l\nm"])

    values = [[value(3) for _ in range(rng.randint(0, 4))] for _ in range(300)]
    assert column(spark, list(map(repr, values)), written_items) == list(map(leaves, values))


def test_cells_by_both_readings(spark):
    assert column(spark, ["['A, B', 'C']", "120, 85", "[A, B]", "['x', None, 'not specified']", "[['a'], 'b']"], V.cell_tokens) == [["A", "B", "C"], ["120", "85"], ["A", "B"], ["x"], ["a", "b"]]
    assert column(spark, ["['A, B', 'C']", "[A, B]", "['not specified']", "none", "'x'; y"], V.listed) == [["A, B", "C"], ["A", "B"], ["not specified"], [], ["x", "y"]]
    assert column(spark, ["['A', 'B']", "120, 85", "('A', 'N/A')", "['Graph']", "plain", "[]"], T.display) == ["A; B", "120; 85", "A", "Graph", "plain", ""]


@pytest.mark.parametrize("pattern,new,text", [("us ?dollars?", "US$", "5 us dollars"), (r"(?P<a>\w+)-(?P<b>\w+)", r"\g<b> \g<a>", "é-x y"), (r"(a)(b)?c", r"[\1]", "ABC abc"), ("[[(]x", r"\\", "[x (x"), (r"[]a&&]+\Z", "!", "x]a&"), (r"(?P<q>['\"]).(?P=q)", r"\n", "'a' \"b\"")])
def test_fixes_are_written_as_in_python(spark, pattern, new, text):
    assert column(spark, [text], lambda c: T.apply_fixes(c, {pattern: new})) == [re.sub(pattern, new, text, flags=re.I)]


def test_patterns_know_all_letters(spark):
    words = {"word": [r"^\w+$"], "named": [r"(?P<x>\d)\.(?P=x)"], "broken": ["(a"]}
    assert column(spark, ["modèle", "b c", "3.3", "(a"], lambda c: V.labels_of(c, words)) == [["word"], [], ["named"], ["broken"]]
    assert column(spark, ["modèle", "['3.3', 'x']"], lambda c: V.group_of(c, words)) == ["word", "named"]
    assert column(spark, ["modèle", "a b"], lambda c: V.free_text_label(c, {"word": [r"^\w+$"]})) == ["word", "a b"]
    assert P.valid("a") and not P.valid("(a")


def test_ten_thousand_patterns_in_one_pass(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    vocabulary = {f"label{i}": [" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(20)] for i in range(500)} | {"odd": [r"\bx+y$", "(b"], "none": []}
    tokens = [None, "", "xxy", *(" ".join(word() for _ in range(rng.randint(1, 4))).title() for _ in range(400))]
    found = vocabularies.labelled(spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, token string"), vocabulary)

    known = {label: [(re.compile(rf"\b{T.plain_key(p)}\b") if T.plain_key(p) else None, re.compile(p, re.I) if P.valid(p) else None) for p in patterns] for label, patterns in vocabulary.items()}

    def brute(token):
        key = T.plain_key(token)
        return [label for label, pairs in known.items() if any((k and k.search(key)) or (p and p.search(token)) for k, p in pairs)]

    assert {r["i"]: r["labels"] for r in found.collect()} == {i: None if t is None else brute(t) for i, t in enumerate(tokens)}
