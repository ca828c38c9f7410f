"""Worked examples of the column expressions and operators."""

import random
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.functions import vocab as V
from evidencelake.operators import decode, linkage, tables
from evidencelake.sources import bundles


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("machine learning AND deep learning", '"deep learning" AND "machine learning"'), ('"B" OR "A"', '"A" OR "B"'), ('""Knowledge Tracing""', "Knowledge Tracing"), ("“Knowledge Tracing”", "Knowledge Tracing")],
)
def test_search_string(spark, value, want):
    assert one(spark, value, T.search_string) == want


@pytest.mark.parametrize(("value", "want"), [("Useful sentence. incomplete fragment...", "Useful sentence."), ("incomplete fragment...", "incomplete fragment"), ("values 1, 2, ..., 10", "values 1, 2, …, 10")])
def test_drop_fragments(spark, value, want):
    assert one(spark, value, T.drop_fragments) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("A AND A", '"A"'), ("B\nor a", '"a" OR "B"'), ('"a', '"a'), ("  x ; y ", "x ; y".replace(" ;", ";"))],
)
def test_search_string_keeps_its_marks(spark, value, want):
    assert one(spark, value, T.search_string) == want


@pytest.mark.parametrize(("value", "want"), [("½ cup", "12 cup"), ("XP™", "xptm"), ("№5", "no5"), ("𝐀b", "ab"), ("Ĳssel ﬁn", "ijssel fin")])
def test_token_key_spells_symbols_out(spark, value, want):
    assert one(spark, value, T.token_key) == want


@pytest.mark.parametrize(("value", "want"), [("a\n|\nb", "a | b"), ("x\t\n;\n y", "x; y"), ("p\r\n\r\n\r\nq", "p\n\nq")])
def test_clean_whitespace(spark, value, want):
    assert one(spark, value, T.clean_whitespace) == want


@pytest.mark.parametrize(("value", "want"), [("Foo (bar) [x]", "Foo (bar) [x"), ("[Foo]", "Foo"), ("'a  b'", "a b")])
def test_unmatched_label(spark, value, want):
    assert one(spark, value, V.unmatched_label) == want


@pytest.mark.parametrize(("value", "want"), [("(x)", ["(x)"]), ("('x', 1)", ["x", "1"]), ("[a, none specified]", ["a"]), ("not reported", ["not reported"]), ("['A, B', 'C']", ["A", "B", "C"])])
def test_cell_tokens(spark, value, want):
    assert one(spark, value, V.cell_tokens) == want


def test_patterns_are_whole_words(spark):
    assert one(spark, "pre testing", lambda c: V.labels_of(c, {"Gains": ["pre-test"]})) == []


def test_shorten_like_the_rule(spark):
    text = "word " * 100
    clean = text.strip()
    cut = clean[:121]
    want = clean[: cut.rfind(" ")].rstrip(" ;,.") + "..."
    assert one(spark, text, lambda c: T.shorten(c, 120)) == want
    assert one(spark, "x" * 200, lambda c: T.shorten(c, 120)) == "x" * 120 + "..."


@pytest.mark.parametrize(("value", "want"), [("one\n two...\nthree. four...", "one two… three."), ("a...; b", "a…; b")])
def test_drop_fragments_joins_lines(spark, value, want):
    assert one(spark, value, T.drop_fragments) == want


@pytest.mark.parametrize(("value", "want"), [("['A', 'B']", ["A", "B"]), ("A; B", ["A", "B"]), (None, []), ("Not Applicable", [])])
def test_cells(spark, value, want):
    assert one(spark, value, V.listed) == want
    assert one(spark, value, V.cell_tokens) == want


def test_keys_and_groups(spark):
    assert one(spark, "Crème & Brûlée ﬁn", T.token_key) == "creme and brulee fin"
    assert one(spark, "Pre-Test", lambda c: V.labels_of(c, {"Learning Gains": ["pre test"], "Other": ["(bad"]})) == ["Learning Gains"]
    assert one(spark, "Accepted Beta", lambda c: V.group_of(c, {"G1": ["alpha"], "G2": ["beta"]}, "Accepted")) == "G2"
    assert one(spark, "Rejected Beta", lambda c: V.group_of(c, {"G2": ["beta"]}, "Accepted")) is None
    assert one(spark, "{Accuracy: 0.91 - RF, F1-Score: 0.88 - SVM}", lambda c: T.metric_snippets(c, {"f1 score": "F1"})) == ["Accuracy=0.91 (RF)", "F1=0.88 (SVM)"]
    assert one(spark, "https://doi.org/10.1/X", T.doi_key) == "10.1/x"


def test_short_id(spark):
    want = "p_" + str(uuid.uuid5(uuid.NAMESPACE_URL, "é|b"))[:8]
    assert one(spark, "é", lambda c: T.short_id("p", c, F.lit("b"))) == want


def test_headings_and_records(spark):
    rows = [("p", 0, "heading_2", "One"), ("p", 1, "heading_2", "Two"), ("p", 2, "table", None)]
    blocks = spark.createDataFrame(rows, "page_id string, pos int, type string, text string")
    assert decode.carry_heading(blocks).where("pos = 2").first()["heading"] == "Two"
    assert decode.near_heading(blocks).where("pos = 2").first()["heading"] == "One"
    table = spark.createDataFrame([([["a", "b", "a"], ["1"], ["1", "2", "3", "4"]],), ([],)], "rows array<array<string>>")
    assert [r["y"] for r in table.select(decode.table_records(F.col("rows")).alias("y")).collect()][0] == [{"b": "", "a": ""}, {"b": "2", "a": "3"}]
    assert one(spark, "Knowledge Tracing Results", lambda c: decode.task_of(c, [("kt", ["tracing"]), ("pred", ["prediction"])])) == "kt"


def test_trend_and_pivot(spark):
    rows = [("p1", 2024, "A"), ("p2", 2024, "B"), ("p2", 2024, "B"), ("p3", 2022, "A")]
    long = spark.createDataFrame(rows, "page_id string, year int, value string")
    assert {(r["year"], r["value"]): r["n"] for r in tables.trend(long, "page_id", "year").collect()} == {(2022, "A"): 1, (2022, "B"): 0, (2023, "A"): 0, (2023, "B"): 0, (2024, "A"): 1, (2024, "B"): 1}


def test_diff_of_itself_is_empty_and_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([Row(k=1, a=" x ; y"), Row(k=2, a=None)])
    assert linkage.field_diff(df, df, "k", ["a"]).isEmpty()
    clean = tables.clean(df, {}, {})
    assert tables.cleaning_log(clean, {}, {}).first()["changed_cells"] == 0


def test_bundles(spark, tmp_path):
    (tmp_path / "a.canonical.json").write_text('{"references": [{"id": "r1", "title": "T", "authors": ["A"], "year": 2020}], "tasks": [{"id": "t1", "name": "Pred"}], "reference_tasks": [{"id": "rt", "reference_id": "r1", "task_id": "t1"}], "task_extractions": [{"id": "x", "reference_task_id": "rt", "extracted": [{"M": "1"}, {"M": "2"}]}]}')
    (tmp_path / "b.canonical.json").write_text("{broken")
    (tmp_path / "c.canonical.json").write_text("[]")
    found = bundles.read_bundles(spark, str(tmp_path))
    assert [r["bundle_id"] for r in found.collect()] == ["a"]
    parts = {e: decode.flatten(found, e) for e in decode.ENTITIES}
    rows = decode.task_rows(parts["task_extractions"], parts["reference_tasks"], parts["tasks"], parts["references"]).orderBy("row_pos").collect()
    assert [(r["task_label"], r["source_title"], r["row"]) for r in rows] == [("Pred", "T", {"M": "1"}), ("Pred", "T", {"M": "2"})]
    assert {r["file_name"][0]: r["status"] for r in bundles.file_status(spark, str(tmp_path)).collect()} == {"a": "OK", "b": "ERROR", "c": "WARN"}


def test_tidy_texts_are_shown_as_they_are(spark):
    """What display takes for tidy is what its full reading would leave alone; display_key is the key of what is shown."""
    rng = random.Random(5)
    bits = ["a", "None", "True", "F", "N/A", " ", " ", "; ", ";", ", ", ",", ".", "...", "1", "2.5", "-", "|", "'", "[", "]", "(", "\n", "é", "…", "Zed"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(4000)] + ["w, x " * 20000 + "end"]
    x = F.col("x")
    full = F.coalesce(T.with_items(T.clean_whitespace(x), lambda own: F.array_join(F.transform(F.filter(own, lambda i: ~T.is_missing(i)), T.plain_display), "; "), T.plain_display), F.lit(""))
    shown = spark.createDataFrame([(t,) for t in texts], "x string")
    keyed = F.when(~T.is_missing(x), T.blank_to_null(T.token_key(full)))
    assert shown.where(x.rlike(T.TIDY)).count() > 300
    assert not shown.where((T.display(x) != full) | ~T.display_key(x).eqNullSafe(keyed)).count()
