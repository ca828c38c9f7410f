"""Registered queries over manuscript tables, with DuckDB SQL generated column by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import paper
from evidencelake.plans.catalog import COLOURS, HITS, query, shorten_sql, t

#: The demo vocabularies: one for every vocabulary column.
WORDS = {name: COLOURS for name in ("context", "teaching", "data_source", "algorithm", "recommender_algorithm", "recommender_type", "assessment", "analytic_task", "theory", "feature")}
WORDS |= {"metric": {"accuracy": ["Acc"]}, "recommendation_target": {"Big": ["large"]}, "prediction_target": {"Big": ["large"]}, "kt_target": {"Big": ["large"]}}

SOURCE_SQL = """WITH src AS (SELECT l_orderkey AS pid, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 10 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS ord,
        l_returnflag AS flag, l_linestatus AS status, p_name AS name, string_split(p_name, ' ') AS words, p_type AS type, p_brand AS brand, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def rows_of(spark, sf_dir):
    """Lines as extraction records of their orders, with a running number."""
    line = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    at = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return line.select(at.alias("at"), F.col("l_orderkey").cast("string").alias("source_page_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.regexp_replace("p_name", " ", "; ").alias("names"), "p_name", F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"))


def _reading(spark, sf_dir):
    orders, k = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    return orders.select(k.cast("string").alias("page_id"), F.concat(F.lit("Title "), (k % 7).cast("string")).alias("title"), F.when(k % 3 > 0, F.concat("o_orderpriority", F.lit(", J.; Other"))).alias("authors"), F.year("o_orderdate").cast("string").alias("year"), F.lit("['Graph']").alias("Learner Representation"), F.col("o_orderstatus").alias("Work Nature"), k.alias("at"))


READING_SQL = "rd AS (SELECT o_orderkey AS pid, 'Title ' || CAST(o_orderkey % 7 AS VARCHAR) AS title, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'Title ' || CAST(o_orderkey % 7 AS VARCHAR) END || ' (' || CAST(year(o_orderdate) AS VARCHAR) || ')' AS study, o_orderstatus AS nature FROM orders)"


def raw_sql(column: str, *values: str) -> str:
    """Items of a raw column: whole values, sources in order."""
    return " UNION ALL ".join(f"SELECT pid, sig, '{column}' AS col, ord::HUGEINT * 1000 + {rank} * 100000000000000000000::HUGEINT AS seq, {v} AS item FROM grp WHERE coalesce({v}, '') NOT IN ('', 'N/A')" for rank, v in enumerate(values))


def vocab_sql(column: str, words: str, labels_only: bool = False, rank: int = 0) -> str:
    """Items of a vocabulary column: the labels of each word, or the word itself."""
    cases = ", ".join(rf"CASE WHEN regexp_matches(lower(w), '\b({k})\b') OR regexp_matches(w, '(?i){r}') THEN '{n}' END" for n, (k, r) in HITS.items())
    labels = f"list_filter([{cases}], lambda x: x IS NOT NULL)"
    found = labels if labels_only else f"CASE WHEN len({labels}) > 0 THEN {labels} ELSE [w] END"
    return f"SELECT pid, sig, '{column}' AS col, ord::HUGEINT * 1000 + {rank} * 100000000000000000000::HUGEINT + pos AS seq, unnest({found}) AS item FROM (SELECT pid, sig, ord, unnest({words}) AS w, generate_subscripts({words}, 1) AS pos FROM grp)"


def cells_sql(parts: list[str], limits: dict[str, tuple[int | None, int]]) -> str:
    """it, once, ag and cl: items, their first places, and the cell of each contribution and column."""
    cell = " ".join(
        f"WHEN '{c}' THEN " + shorten_sql("joined" if most is None else f"(array_to_string(items[:{most}], '; ') || CASE WHEN n > {most} THEN '; +' || CAST(n - {most} AS VARCHAR) || ' more' ELSE '' END)", chars)
        for c, (most, chars) in limits.items()
    )
    return (
        "it AS (" + " UNION ALL ".join(parts) + "), once AS (SELECT pid, sig, col, lower(item) AS key, min(seq) AS seq, arg_min(item, seq) AS item FROM it GROUP BY ALL), "
        "ag AS (SELECT pid, sig, col, count(*) AS n, list(item ORDER BY seq) AS items, array_to_string(list(item ORDER BY seq), '; ') AS joined FROM once GROUP BY ALL), "
        f"cl AS (SELECT pid, sig, col, n, joined, items, CASE col {cell} END AS cell FROM ag)"
    )


SPECS = [
    paper.Spec("flags", ("flag", "status"), most_items=2),
    paper.Spec("sizes", ("size",), most_items=3),
    paper.Spec("names", ("names",), "vocab", tuple((k, tuple(v)) for k, v in COLOURS.items()), None, 80),
]
PLAIN_SQL = SOURCE_SQL + ", grp AS (SELECT *, flag AS sig, words AS ws FROM src), " + cells_sql(
    [raw_sql("flags", "flag", "status"), raw_sql("sizes", "CAST(size AS VARCHAR)"), vocab_sql("names", "ws")],
    {"flags": (2, paper.NARRATIVE), "sizes": (3, paper.NARRATIVE), "names": (None, 80)},
)


def _plain(spark, sf_dir):
    return rows_of(spark, sf_dir).withColumnsRenamed({"source_page_id": "paper_id", "at": "ordinal"}).withColumn("signature", F.col("flag"))


@query(PLAIN_SQL + " SELECT CAST(g.pid AS VARCHAR) AS paper_id, g.sig AS signature, " + ", ".join(f"coalesce(max(cell) FILTER (col = '{c}'), '') AS {c}" for c in ("flags", "sizes", "names")) + " FROM (SELECT DISTINCT pid, sig FROM grp) g LEFT JOIN cl ON cl.pid = g.pid AND cl.sig = g.sig GROUP BY ALL")
def contribution_table(spark, sf_dir):
    return paper.paper_table(_plain(spark, sf_dir), SPECS)


UNMATCHED_SQL = " AND ".join(rf"NOT regexp_matches(lower(w), '\b({k})\b') AND NOT regexp_matches(w, '(?i){r}')" for k, r in HITS.values())


@query(PLAIN_SQL + """, gr AS (SELECT pid, sig, count(*) AS n FROM grp GROUP BY ALL), au AS (
    SELECT pid, sig, '__row__' AS col, 'preserved_distinct_paper_contribution' AS action, sig AS detail FROM gr WHERE pid IN (SELECT pid FROM gr GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT pid, sig, '__row__', 'merged_duplicate_extraction_rows', CAST(n AS VARCHAR) FROM gr WHERE n > 1
    UNION ALL SELECT pid, sig, 'names', 'unmatched_token', w FROM (SELECT pid, sig, unnest(ws) AS w FROM grp) WHERE """ + UNMATCHED_SQL + """
    UNION ALL SELECT pid, sig, col, 'limited_display_items', CAST(n - CASE col WHEN 'flags' THEN 2 ELSE 3 END AS VARCHAR) FROM cl WHERE n > CASE col WHEN 'flags' THEN 2 WHEN 'sizes' THEN 3 ELSE 1000000 END
    UNION ALL SELECT pid, sig, col, 'merged_values', CAST(n AS VARCHAR) FROM cl WHERE col = 'names' AND n > 1
    UNION ALL SELECT pid, sig, col, 'shortened_cell', CAST(length(joined) AS VARCHAR) FROM cl WHERE col = 'names' AND length(joined) > 80)
    SELECT CAST(pid AS VARCHAR) AS paper_id, sig AS signature, col AS output_column, action, detail FROM au""")
def contribution_audit(spark, sf_dir):
    return paper.paper_audit(_plain(spark, sf_dir), SPECS)


def _shared_sql() -> tuple[list[str], dict[str, tuple[int | None, int]]]:
    parts = [raw_sql("_students", "status"), raw_sql("_courses", "CAST(size AS VARCHAR)"), vocab_sql("Context", "[type]"), vocab_sql("Data sources", "words")]
    return parts, {"_students": (None, 90), "_courses": (None, 90), "Context": (None, 80), "Data sources": (None, 150)}


def _task_sql(signature: str, parts: list[str], limits: dict[str, tuple[int | None, int]], columns: dict[str, str]) -> str:
    """The SQL of one task's table: signature, own items and limits, and the output columns over cells named by c('column')."""
    shared, known = _shared_sql()
    of = lambda c: f"coalesce(max(cell) FILTER (col = '{c}'), '')"
    needed = {**known, **limits}
    wide = ", ".join(f'{of(c)} AS "{c}"' for c in needed)
    sample = "CASE WHEN \"_students\" = '' THEN \"_courses\" WHEN \"_courses\" = '' OR lower(\"_courses\") = lower(\"_students\") THEN \"_students\" ELSE \"_students\" || ' - ' || \"_courses\" END"
    out = {"Context": '"Context"', "Teaching modality": "''", "Data sources": '"Data sources"'} | columns
    return (
        SOURCE_SQL + ", " + READING_SQL + f", grp AS (SELECT *, {signature} AS sig FROM src), " + cells_sql(shared + parts, needed)
        + f", wd AS (SELECT g.pid, g.sig, {wide} FROM (SELECT DISTINCT pid, sig FROM grp) g LEFT JOIN cl ON cl.pid = g.pid AND cl.sig = g.sig GROUP BY ALL), "
        + f"sm AS (SELECT *, {sample} AS sample FROM wd) SELECT CAST(sm.pid AS VARCHAR) AS paper_id, sig AS signature, coalesce(study, 'Unknown study') AS \"Study\", coalesce(title, '') AS \"Paper title\", CASE WHEN study IS NULL THEN '' ELSE 'Graph' END AS \"Learner representation\", coalesce(nature, '') AS \"Work nature\", "
        + shorten_sql("sample", 150) + ' AS "Sample / setting", ' + ", ".join(f'{v} AS "{k}"' for k, v in out.items()) + " FROM sm LEFT JOIN rd ON rd.pid = sm.pid"
    )


def _task_rows(spark, sf_dir, names: dict[str, str]):
    common = {"status": "Students", "size": "Courses", "type": "Context", "names": "Dataset"}
    rows = rows_of(spark, sf_dir)
    made = {new: F.col(old) for old, new in common.items()} | {new: F.col(old) if old in rows.columns else F.expr(old) for new, old in names.items()}
    return rows.select("at", "source_page_id", *(c.alias(n) for n, c in made.items()))


def _table(spark, sf_dir, task):
    return paper.manuscript(_task_rows(spark, sf_dir, FIELDS[task]), _reading(spark, sf_dir), task, WORDS, F.col("at"), F.col("at"))


def _key(*parts: str) -> str:
    """A signature in SQL out of texts that are never missing."""
    return " || ' | ' || ".join(f"trim(regexp_replace(lower({p}), '[^a-z0-9]+', ' ', 'g'))" for p in parts)


_RESULT = "'accuracy: ' || CAST(size AS VARCHAR) || ' - ' || brand"
_LABEL = "CASE WHEN regexp_matches({x}, '(?i)large') THEN 'Big' ELSE {x} END"
_RESULTS = "array_to_string(list_transform(string_split(\"Results\", '; ')[:4], lambda x: regexp_replace(x, 'accuracy: (\\d+) - (.*)', 'Acc=\\1 (\\2)')), '; ') || CASE WHEN len(string_split(\"Results\", '; ')) > 4 THEN '; +' || CAST(len(string_split(\"Results\", '; ')) - 4 AS VARCHAR) || ' more' ELSE '' END"
_both = lambda a, b: f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' OR lower({a}) = lower({b}) THEN {a} ELSE {a} || ' - ' || {b} END"


def _words(column: str) -> str:
    return vocab_sql(column, "words")


#: Of each task: its signature, items, and the limits of their columns, in SQL; the vocabulary columns that the audit reads, and what parts count as.
PARTS = {
    "PRED": (
        _key("type", "flag", "name", "name", "name"),
        [
            _words("Algorithms / models"), _words("Assessment strategy"), raw_sql("Results", _RESULT), raw_sql("Limitations", "brand"),
            raw_sql("_definition", "flag"), raw_sql("_target", "name"), vocab_sql("Prediction task type", "[type]"),
        ],
        {
            "Algorithms / models": (8, 150), "Assessment strategy": (None, 100), "Results": (None, paper.NARRATIVE), "Limitations": (None, paper.NARRATIVE),
            "_definition": (None, 110), "_target": (None, 100), "Prediction task type": (None, 80),
        },
        {"Algorithms / models": "words", "Assessment strategy": "words", "Prediction task type": "[type]"},
        {"_definition": "Prediction target / timing", "_target": "Prediction target / timing"},
    ),
    "KT": (
        _key("name", "name", "flag", "brand"),
        [_words("Algorithms / models"), raw_sql("Results", _RESULT), raw_sql("Prior-model limitations", "brand"), raw_sql("New contribution", "flag", "type"), raw_sql("_target", "name")],
        {"Algorithms / models": (8, 150), "Results": (None, paper.NARRATIVE), "Prior-model limitations": (None, 500), "New contribution": (None, 500), "_target": (None, 100)},
        {"Algorithms / models": "words"},
        {"_target": "KT target"},
    ),
    "DESC": (
        _key("flag", "name", "status", "brand", "type"),
        [_words("Algorithms / models"), raw_sql("Results / patterns", "status", "brand"), vocab_sql("Theoretical grounding", "[type]"), raw_sql("Main result / implication", "brand"), vocab_sql("Analytic task", "[flag]")],
        {
            "Algorithms / models": (8, 150), "Results / patterns": (None, 400), "Theoretical grounding": (None, 120),
            "Main result / implication": (None, paper.NARRATIVE), "Analytic task": (None, 100),
        },
        {"Algorithms / models": "words", "Theoretical grounding": "[type]", "Analytic task": "[flag]"},
        {},
    ),
    "ERS": (
        _key("name", "flag", "flag"),
        [
            vocab_sql("Recommender type", "[flag]"), vocab_sql("_algorithms", "[flag]", True), vocab_sql("_algorithms", "words", True, 5), vocab_sql("_other", "[flag]"),
            raw_sql("_target", "name"), raw_sql("Key implementation note", "name"), raw_sql("Limitations", "brand"), raw_sql("Recommendation output", "flag"),
        ],
        {
            "Recommender type": (None, 110), "_algorithms": (8, 170), "_other": (8, 150), "_target": (None, 120), "Key implementation note": (None, 500),
            "Limitations": (None, paper.NARRATIVE), "Recommendation output": (None, 140),
        },
        {"Recommender type": "[flag]", "_other": "[flag]"},
        {"_algorithms": "Algorithms / models", "_other": "Algorithms / models", "_target": "Recommendation target"},
    ),
}
#: The source columns of each task's rows, beside those of every task.
FIELDS = {
    "PRED": {
        "Task": "type", "Student Performance Definition": "flag", "Target": "p_name", "Models": "names", "Assessment Strategy": "names",
        "Performance Metric: Best Model": "concat('accuracy: ', size, ' - ', brand)", "Limitations": "brand",
    },
    "KT": {
        "Target": "p_name", "Models": "names", "Evaluation": "concat('accuracy: ', size, ' - ', brand)", "Flaw of Previous Models": "brand",
        "Novelty of Model": "flag", "Comments": "type",
    },
    "DESC": {"Task": "flag", "Models": "names", "Groups Created": "status", "Cluster Description": "brand", "Thereotical Model": "type", "Implications": "brand"},
    "ERS": {"Target of Recommendation": "p_name", "Recommender System Type": "flag", "Recommendation types": "flag", "Initialization Method": "p_name", "Limitations": "brand"},
}


@query(_task_sql(*PARTS["PRED"][:3], {
    "Prediction task type": '"Prediction task type"', "Prediction target / timing": _LABEL.format(x="(" + _both('"_definition"', '"_target"') + ")"),
    "Algorithms / models": '"Algorithms / models"', "Assessment strategy": '"Assessment strategy"', "Results": _RESULTS, "Limitations": '"Limitations"',
}))
def manuscript_prediction(spark, sf_dir):
    return _table(spark, sf_dir, "PRED")


@query(_task_sql(*PARTS["KT"][:3], {
    "KT target": _LABEL.format(x='"_target"'), "Algorithms / models": '"Algorithms / models"', "Assessment strategy": "''", "Results": _RESULTS,
    "Prior-model limitations": '"Prior-model limitations"', "New contribution": '"New contribution"', "Study limitations": "''",
}))
def manuscript_tracing(spark, sf_dir):
    return _table(spark, sf_dir, "KT")


@query(_task_sql(*PARTS["DESC"][:3], {
    "Analytic task": '"Analytic task"', "Algorithms / models": '"Algorithms / models"', "Results / patterns": '"Results / patterns"',
    "Theoretical grounding": '"Theoretical grounding"', "Main result / implication": '"Main result / implication"', "Limitations": "''",
}))
def manuscript_descriptive(spark, sf_dir):
    return _table(spark, sf_dir, "DESC")


@query(_task_sql(*PARTS["ERS"][:3], {
    "Recommendation target": _LABEL.format(x='"_target"'), "Recommender type": '"Recommender type"', "Recommendation output": '"Recommendation output"',
    "Algorithms / models": "CASE WHEN \"_algorithms\" <> '' THEN \"_algorithms\" ELSE \"_other\" END", "Results": "''", "Limitations": '"Limitations"',
    "Key implementation note": '"Key implementation note"',
}))
def manuscript_recommender(spark, sf_dir):
    return _table(spark, sf_dir, "ERS")


def _audit_sql(signature, parts, limits, vocabularies, counted_as) -> str:
    """The audit of one task's table; the fall-back algorithms count only where a contribution has no others."""
    shared, known = _shared_sql()
    limits, names = {**known, **limits}, {"_students": "Sample / setting", "_courses": "Sample / setting", **counted_as}
    labelled = {"Context": "[type]", "Data sources": "words", **vocabularies}
    per_column = lambda f: "CASE col " + " ".join(f"WHEN '{c}' THEN {f(c)}" for c in limits) + " END"
    most = per_column(lambda c: limits[c][0] or "NULL")
    named = "coalesce(" + (per_column(lambda c: f"'{names[c]}'" if c in names else "NULL")) + ", col)"
    tokens = " UNION ALL ".join(f"SELECT pid, sig, '{c}' AS col, unnest({w}) AS w FROM grp" for c, w in labelled.items())
    row = lambda action, detail, test: f"SELECT pid, sig, {named}, '{action}', CAST({detail} AS VARCHAR) FROM us WHERE {test}"
    used = "(col <> '_other' OR NOT EXISTS (FROM cl c WHERE c.col = '_algorithms' AND c.pid = x.pid AND c.sig = x.sig))"
    actions = [
        "SELECT pid, sig, '__row__', 'preserved_distinct_paper_contribution', sig FROM gr WHERE pid IN (SELECT pid FROM gr GROUP BY 1 HAVING count(*) > 1)",
        "SELECT pid, sig, '__row__', 'merged_duplicate_extraction_rows', CAST(n AS VARCHAR) FROM gr WHERE n > 1",
        f"SELECT pid, sig, {named}, 'unmatched_token', w FROM tk x WHERE {UNMATCHED_SQL} AND {used}",
        row("limited_display_items", "n - most", "n > most"),
        row("limited_display_items", f"n - {paper.RESULTS}", f"col = 'Results' AND n > {paper.RESULTS}"),
        row("merged_values", "n", "most IS NULL AND n > 1"),
        row("shortened_cell", "length(shown)", "length(shown) > chars"),
    ]
    shown = "CASE WHEN n > most THEN array_to_string(items[:most], '; ') || '; +' || CAST(n - most AS VARCHAR) || ' more' ELSE joined END"
    return (
        SOURCE_SQL + f", grp AS (SELECT *, {signature} AS sig FROM src), " + cells_sql(shared + parts, limits)
        + f", gr AS (SELECT pid, sig, count(*) AS n FROM grp GROUP BY ALL), tk AS ({tokens})"
        + f", us AS (SELECT *, {shown} AS shown FROM (SELECT *, {most} AS most, {per_column(lambda c: limits[c][1])} AS chars FROM cl x WHERE {used}))"
        + ", au(pid, sig, col, action, detail) AS (" + " UNION ALL ".join(actions) + ")"
        + " SELECT CAST(pid AS VARCHAR) AS paper_id, sig AS signature, col AS output_column, action, detail FROM au"
    )


def _audit(spark, sf_dir, task):
    return paper.paper_audit(paper.contributions(_task_rows(spark, sf_dir, FIELDS[task]), task, F.col("at")), paper.specs_of(task, WORDS))


@query(_audit_sql(*PARTS["ERS"]))
def audit_recommender(spark, sf_dir):
    return _audit(spark, sf_dir, "ERS")


@query(_audit_sql(*PARTS["DESC"]))
def audit_descriptive(spark, sf_dir):
    return _audit(spark, sf_dir, "DESC")


@query(_audit_sql(*PARTS["PRED"]))
def audit_prediction(spark, sf_dir):
    return _audit(spark, sf_dir, "PRED")


@query(_audit_sql(*PARTS["KT"]))
def audit_tracing(spark, sf_dir):
    return _audit(spark, sf_dir, "KT")
