"""Manuscript tables and audits: what moves and is kept, and the ways that give the same rows."""

import pytest

from evidencelake.operators import paper

COLOURS = (("warm", ("red", "^orange$")), ("cold", ("blue",)))
SPECS = [
    paper.Spec("kinds", ("kind", "place"), most_items=2),
    paper.Spec("names", ("names",), "vocab", COLOURS, None, 20),
    paper.Spec("some", ("names",), "every", COLOURS, 1, 30, "names"),
    paper.Spec("others", ("names",), "vocab", COLOURS, 8, 30, "names", "some"),
    paper.Spec("figures", ("figures",), "metric", (("accuracy", ("Acc",)),)),
]
NAMES = ["red; blue", "Red, large|tiny", "N/A", "", None, "blue", "größe; GRÖSSE; red", "tiny; tiny"]


def rows(spark, n=400):
    made = [
        (f"p{i % 37}", f"s{i % 3}", i, ["a", "b", None, "A ", "c"][i % 5], ["x", "", "a"][i % 3], NAMES[i % 8], f"accuracy: 0.{i % 4} - m{i % 5}, recall: 1" if i % 4 else None)
        for i in range(n)
    ]
    return spark.createDataFrame(made, "paper_id string, signature string, ordinal long, kind string, place string, names string, figures string")


@pytest.mark.parametrize("make", [paper.paper_table, paper.paper_audit])
def test_the_ways_agree(spark, monkeypatch, make):
    """Values looked up, taken apart row by row, and rows that all go as claims."""
    out = lambda: sorted(map(repr, make(rows(spark), SPECS).collect()))
    looked_up = out()
    for name in ("KNOWN", "SIGNED"):
        monkeypatch.setattr(paper, name, 0)
    assert out() == looked_up
    monkeypatch.setattr(paper, "MANY", -2 * paper.BUCKET)
    assert out() == looked_up


def test_only_rows_are_kept(spark, monkeypatch):
    """No table of claims, which are several times the rows, is written."""
    sizes = []

    def noted(df, keep=paper.kept):
        held = keep(df)
        sizes.append(held.count())
        return held

    monkeypatch.setattr(paper, "kept", noted)
    assert paper.paper_audit(rows(spark, 1200), SPECS).count() > 1200
    assert all(n <= 1200 for n in sizes)
