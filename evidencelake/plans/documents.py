"""Registered queries over whole documents, each with the DuckDB SQL that it must equal.

A customer is a bundle: it has a reference, and its orders are tasks. The second snapshot changes, drops and adds some.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidencelake.functions import literals, vocab
from evidencelake.functions import text as T
from evidencelake.operators import bundle_diff, chain, paper, summary, vocabularies
from evidencelake.plans.catalog import COLOURS, query, t
from evidencelake.plans.library import LABELS, PACK, PAGES_SQL, _pages
from evidencelake.sources import bundles
from evidencelake.sources.scratch import shared_dir


def _bundles(spark, sf_dir, new: bool):
    """One snapshot: file_name and doc."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    keep = F.expr("o_orderkey % 10 <> 0") if new else F.expr("o_orderkey % 13 <> 0 or o_orderkey % 10 = 0")
    name = F.when(o % 8 == 0, "X").otherwise(F.col("o_orderstatus")) if new else F.col("o_orderstatus")
    own = F.struct(F.concat(F.lit("t"), o).alias("id"), name.alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    twice = F.when(o % 9 == 0, F.array(F.struct(own["id"].alias("id"), F.lit("dup").alias("name"), F.lit(0).cast("long").alias("cents")), own)).otherwise(F.array(own)) if new else F.array(own)
    tasks = t(spark, sf_dir, "orders").where(keep).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", twice.alias("x")))), lambda s: s["x"])).alias("tasks"))
    year = F.col("c_nationkey") + F.when(k % 3 == 0, 1).otherwise(0) if new else F.col("c_nationkey")
    parts = [F.to_json(F.struct(F.concat(F.lit("r"), k).alias("id"), F.col("c_name").alias("title"), year.alias("year"), F.array("c_mktsegment", F.lit("x")).alias("tags")))]
    extra = F.to_json(F.struct(F.struct(F.round(F.col("c_acctbal") * 100).cast("long").alias("balance")).alias("extra")))
    parts.append(F.when(k % 4 != 0, extra) if new else extra)
    parts += [F.when(k % 5 == 0, F.lit('{"note":"n"}')), F.when(k % 6 == 0, F.lit('{"journal":null}'))] if new else []
    reference = F.concat(F.lit("{"), F.concat_ws(",", *(F.regexp_replace(p, r"^\{|\}$", "") for p in parts)), F.lit("}"))
    whole = t(spark, sf_dir, "customer").where("c_custkey % 7 <> 0" if new else "c_custkey % 11 <> 0 or c_custkey % 7 = 0").join(tasks, "c_custkey", "left")
    named = F.when(k % 2 == 0, F.concat(F.lit('"bundle_id":"b'), k, F.lit('",'))).otherwise("")
    doc = F.concat(F.lit("{"), named, F.lit('"references":['), reference, F.lit(', "no object"],"tasks":'), F.coalesce(F.to_json("tasks"), F.lit("null")), F.lit("}"))
    return whole.select(F.concat(F.lit("c"), k, F.lit(".json")).alias("file_name"), F.parse_json(doc).alias("doc"))


CHANGES_SQL = """c AS (SELECT *, c_custkey % 7 <> 0 AS is_new, c_custkey % 7 = 0 OR c_custkey % 11 <> 0 AS is_old FROM customer),
    field AS (
        SELECT c_custkey AS k, 'references' AS entity_type, 'r' || c_custkey AS entity_id, is_old AS e_old, is_new AS e_new,
            unnest(['title', 'year', 'tags', 'extra', 'note', 'journal']) AS field,
            unnest(['"' || c_name || '"', CAST(c_nationkey AS VARCHAR), '["' || c_mktsegment || '","x"]', '{"balance":' || CAST(round(c_acctbal * 100) AS BIGINT) || '}', NULL, NULL]) AS old_value,
            unnest(['"' || c_name || '"', CAST(c_nationkey + (c_custkey % 3 = 0)::INT AS VARCHAR), '["' || c_mktsegment || '","x"]', CASE WHEN c_custkey % 4 <> 0 THEN '{"balance":' || CAST(round(c_acctbal * 100) AS BIGINT) || '}' END, CASE WHEN c_custkey % 5 = 0 THEN '"n"' END, NULL]) AS new_value,
            unnest([true, true, true, true, false, false]) AS in_old, unnest([true, true, true, c_custkey % 4 <> 0, c_custkey % 5 = 0, c_custkey % 6 = 0]) AS in_new
        FROM c WHERE is_new
        UNION ALL
        SELECT o_custkey, 'tasks', 't' || o_orderkey, is_old AND (o_orderkey % 13 <> 0 OR o_orderkey % 10 = 0), o_orderkey % 10 <> 0, unnest(['name', 'cents']),
            unnest(['"' || o_orderstatus || '"', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)]),
            unnest(['"' || CASE WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END || '"', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)]), true, true
        FROM orders JOIN c ON c_custkey = o_custkey WHERE is_new),
    d AS (
        SELECT CASE WHEN k % 2 = 0 THEN 'b' || k ELSE 'c' || k END AS bundle_id, 'c' || k || '.json' AS file_name, entity_type, entity_id, field,
            CASE WHEN e_old THEN old_value END AS old_value, CASE WHEN e_new THEN new_value END AS new_value, CASE WHEN NOT e_old THEN 'added' WHEN NOT e_new THEN 'removed' ELSE 'changed' END AS change_type
        FROM field WHERE (e_old AND e_new AND old_value IS DISTINCT FROM new_value) OR (e_old AND NOT e_new AND in_old) OR (e_new AND NOT e_old AND in_new))"""


@query(f"WITH {CHANGES_SQL} SELECT * FROM d")
def documents_diff(spark, sf_dir):
    """All differences between two snapshots of whole documents, of fields that nobody listed."""
    return bundle_diff.diff_bundles(_bundles(spark, sf_dir, False), _bundles(spark, sf_dir, True))


@query(f"""WITH {CHANGES_SQL},
    n AS (SELECT file_name, count(*) FILTER (change_type = 'added') AS a, count(*) FILTER (change_type = 'removed') AS r, count(*) FILTER (change_type = 'changed') AS c FROM d GROUP BY 1)
    SELECT 'c' || c_custkey || '.json' AS file_name, '[' || CASE WHEN c_custkey % 2 = 0 THEN 'b' || c_custkey ELSE 'c' || c_custkey END || '] ' ||
        CASE WHEN coalesce(a + r + n.c, 0) = 0 THEN 'No differences.' ELSE (a + r + n.c) || ' diff(s): ' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' added' END, CASE WHEN r > 0 THEN r || ' removed' END, CASE WHEN n.c > 0 THEN n.c || ' changed' END) END AS line
    FROM c LEFT JOIN n ON n.file_name = 'c' || c_custkey || '.json' WHERE is_new""")
def documents_diff_lines(spark, sf_dir):
    """A line for each compared bundle."""
    old, new = _bundles(spark, sf_dir, False), _bundles(spark, sf_dir, True)
    return bundle_diff.summary_lines(bundle_diff.diff_bundles(old, new), bundle_diff.bundle_ids(old, new))


def _folder(spark, name):
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/evidencelake-{name}-{uuid.uuid4().hex}"


def _written(spark, sf_dir):
    """A bundle for each customer, its orders as linked extractions and its segment's as unlinked ones, merged into lines and read again."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    row = F.create_map(F.lit("Model"), F.concat(F.lit(" MAchine "), "o_orderpriority"), F.when(o % 2 == 0, "Even").otherwise("Odd"), F.lit("n/a"))
    linked = F.struct(F.concat(F.lit("e"), o).alias("id"), F.when(o % 3 > 0, F.concat(F.lit("rt"), o % 2)).alias("reference_task_id"), F.when(o % 3 == 0, "free_form").alias("schema_name"), F.array(row, row).alias("extracted"))
    per = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.to_json(linked).alias("x")))), lambda s: s["x"]).alias("parts"))
    reference = F.to_json(F.struct(F.concat(F.lit("r"), k).alias("id"), F.col("c_name").alias("title"), F.array("c_mktsegment", F.lit("B")).alias("authors"), F.col("c_nationkey").alias("year"), F.struct(F.create_map(F.lit("Status"), F.lit("a | b")).alias("notion_properties")).alias("sync_metadata")))
    doc = F.concat(
        F.lit('{"bundle_id":"b'), k, F.lit('","provenance":{"source_id":"p'), k, F.lit('"},"references":['), reference,
        F.lit('],"tasks":[{"id":"t0","name":"performance_prediction"},{"id":"t1","name":"knowledge_tracing"}],"reference_tasks":[{"id":"rt0","task_id":"t0"},{"id":"rt1","task_id":"t1"}],"task_extractions":['), F.coalesce(F.array_join("parts", ","), F.lit("")), F.lit("]}"),
    )
    docs = t(spark, sf_dir, "customer").join(per, "c_custkey", "left").select(F.parse_json(doc).alias("doc"))
    path = _folder(spark, "bundles")
    bundles.write_bundles(docs, path)
    return bundles.read_bundle_lines(spark, path)


ROWS_SQL = """r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'free_form' WHEN o_orderkey % 2 = 0 THEN 'PRED' ELSE 'KT' END AS table_name, o_custkey AS k, o_orderkey AS o, o_orderpriority AS p, unnest([0, 1]) AS row_pos FROM orders)"""


@query(f"""WITH {ROWS_SQL}
    SELECT table_name, count(*) AS n_rows, 2 * count(*) AS changed_cells, 0::BIGINT AS changed_search_cells FROM r GROUP BY 1
    UNION ALL SELECT 'Reading List', count(*), 0, 0 FROM customer""")
def folder_log(spark, sf_dir):
    """The cleaning log of all tables that merged bundles give."""
    rows = chain.document_rows(_written(spark, sf_dir), lambda name: summary.task_label(name, LABELS))
    return chain.cleaning_log(chain.cleaned(rows, summary.STANDARD_FIXES, summary.STANDARD_VALUES))


@query(f"""WITH {ROWS_SQL}
    SELECT 'b' || k AS file_name, row_pos, 'Machine ' || p AS "Model", CASE WHEN o % 2 = 0 THEN 'Not Applicable' ELSE '' END AS "Even", CASE WHEN o % 2 = 1 THEN 'Not Applicable' ELSE '' END AS "Odd", 'free_form' AS schema_name, 'p' || k AS source_page_id, c_name AS source_title
    FROM r JOIN customer ON c_custkey = k WHERE table_name = 'free_form'""")
def folder_table(spark, sf_dir):
    """One of the clean tables."""
    rows = chain.document_rows(_written(spark, sf_dir), lambda name: summary.task_label(name, LABELS))
    return chain.run(rows, summary.STANDARD_FIXES, summary.STANDARD_VALUES)[1]["free_form"].drop("ex_pos")


@query("""SELECT 'b' || c_custkey AS file_name, 'p' || c_custkey AS page_id, 'r' || c_custkey AS id, c_name AS title, c_mktsegment || '; B' AS authors, CAST(c_nationkey AS VARCHAR) AS year, 'a | b' AS "Status" FROM customer""")
def folder_reading_list(spark, sf_dir):
    """The reading list of the same documents, laid over by their page's properties."""
    rows = chain.document_rows(_written(spark, sf_dir))
    return chain.table(rows, chain.READING_LIST, ["page_id", "id", "title", "authors", "year", "Status"]).drop("ex_pos", "row_pos")


@query(PAGES_SQL + """ SELECT coalesce(CASE task_id WHEN 'performance_prediction' THEN 'PRED' WHEN 'knowledge_tracing' THEN 'KT' END, 'Misc') AS table_name, tb.page_id AS source_page_id, CASE WHEN k % 10 = 0 THEN tb.page_id ELSE c_name END AS source_title, coalesce(template_id, 'Misc') AS schema_name,
    unnest(['', st]) AS "Model", unnest(['', 'y']) AS "Price" FROM tb JOIN pg USING (page_id)""")
def pages_to_tables(spark, sf_dir):
    """Raw pages to the records of all their tables, by way of bundles."""
    rows = chain.page_rows(_pages(spark, sf_dir), PACK, lambda name: summary.task_label(name, LABELS)).where(F.col("table_name") != chain.READING_LIST)
    return rows.select("table_name", *(F.coalesce(F.try_element_at("row", F.lit(c)), F.lit("")).alias(c) for c in ("source_page_id", "source_title", "schema_name", "Model", "Price")))


@query("""SELECT p_partkey, [string_split(p_name, ' ')[1] || '; ' || p_type, CAST(p_size AS VARCHAR), 'it''s'] AS simple, ['it''s', p_type, CAST(p_size AS VARCHAR)] AS tokens,
    string_split(p_name, ' ')[1] || '; ' || p_type || '; ' || CAST(p_size AS VARCHAR) || '; it''s' AS shown, CAST(p_size AS VARCHAR) || '; 85.5' AS pair FROM part""")
def written_lists(spark, sf_dir):
    """Cells that hold lists as a program writes them, with quotes, escapes, inner lists and missing values, by the three readings."""
    word, size = F.element_at(F.split("p_name", " "), 1), F.col("p_size").cast("string")
    cell = F.concat(F.lit("['"), word, F.lit("; "), "p_type", F.lit("', ("), size, F.lit(", 'it\\'s'), ]"))
    other = F.concat(F.lit("{\"it's\", None, ['"), "p_type", F.lit("', 'N/A'], "), size, F.lit("}"))
    pair = F.concat(size, F.lit(", 85.50"))
    return t(spark, sf_dir, "part").select("p_partkey", literals.written_items(cell).alias("simple"), vocab.cell_tokens(other).alias("tokens"), T.display(cell).alias("shown"), T.display(pair).alias("pair"))


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority, '^(\d)-(.*)$', '\2 US$\1'), 'low', 'Tief', 'i') AS fixed FROM orders""")
def fixes_as_written(spark, sf_dir):
    """Corrections with named groups and a dollar sign."""
    return t(spark, sf_dir, "orders").select("o_orderkey", T.apply_fixes(F.col("o_orderpriority"), {r"^(?P<n>\d)-(?P<what>.*)$": r"\g<what> US$\g<n>", "LOW": "Tief"}).alias("fixed"))


#: As many patterns as there are three-letter words that begin with a vowel, by label.
THREE_LETTERS = {v: [f"{v}{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] for v in "aeiou"} | {"ends": ["^[aeiou].*[aeiou]$"]}


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS token FROM documents),
    l AS (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(token, '(?i)a[a-z][a-z]') THEN 'a' END, CASE WHEN regexp_matches(token, '(?i)e[a-z][a-z]') THEN 'e' END, CASE WHEN regexp_matches(token, '(?i)i[a-z][a-z]') THEN 'i' END, CASE WHEN regexp_matches(token, '(?i)o[a-z][a-z]') THEN 'o' END, CASE WHEN regexp_matches(token, '(?i)u[a-z][a-z]') THEN 'u' END, CASE WHEN regexp_matches(token, '(?i)^[aeiou].*[aeiou]$') THEN 'ends' END], lambda x: x IS NOT NULL)) AS label FROM w)
    SELECT doc_id, label, count(*) AS n FROM l GROUP BY ALL""")
def large_vocabulary(spark, sf_dir):
    """Labels of every word of every text by 3,380 literal patterns and an expression."""
    words = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("token"))
    counted = words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("times"))
    found = vocabularies.labelled(counted, THREE_LETTERS)
    return found.select("doc_id", F.explode("labels").alias("label"), "times").groupBy("doc_id", "label").agg(F.sum("times").alias("n"))
