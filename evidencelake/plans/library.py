"""Registered queries over raw pages, update plans, summaries and audits, each with the DuckDB SQL that it must equal.

Pages, bundles and snapshots are derived from the given tables: a customer is a page, its orders are tables of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import decode, linkage, pages, paper, plan, quality, summary, tables
from evidencelake.plans.catalog import COLOURS, SHORT_ID_SQL, _cell, _tokens_sql, query, t
from evidencelake.sources import bundles

PACK = pages.Pack(
    "demo", "1.1", (("performance_prediction", ("prediction", "pred"), "prediction_modeling"), ("knowledge_tracing", ("knowledge tracing", "tracing"), "sequence_tracing")),
    ("Completed", "Work Nature", "Absent"), {"done": "done", "in progress": "in_progress", "not started": "todo"},
)


def _docs(spark, sf_dir):
    """A page export for each customer, as JSON documents."""
    k = F.col("c_custkey")
    rich = lambda c: F.struct(F.lit("rich_text").alias("type"), F.array(F.struct(c.alias("plain_text"))).alias("rich_text"))
    orders = t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.struct(
            F.expr("CASE o_orderstatus WHEN 'F' THEN 'Prediction Results' WHEN 'O' THEN 'Knowledge Tracing' ELSE 'Misc' END").alias("heading"), F.concat(F.lit("b"), "o_orderkey").alias("block_id"), F.col("o_orderkey").cast("string").alias("index"),
            F.array(F.array(F.lit("Model"), F.lit("Price"), F.lit("Model")), F.array("o_orderpriority"), F.array(F.lit("x"), F.lit("y"), F.col("o_orderstatus"), F.lit("z"))).alias("rows")).alias("table"),
    )
    per_page = orders.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "table"))), lambda x: x["table"]).alias("tables"))
    properties = F.struct(
        F.when(k % 3 == 0, F.struct(F.lit("people").alias("type"), F.array(F.struct(F.col("c_name").alias("name")), F.struct(F.lit("B. Other").alias("name"))).alias("people"))).alias("Author"),
        F.when(k % 3 != 0, rich(F.concat("c_name", F.lit(" ; C. Third;")))).alias("Authors"),
        rich(F.when(k % 2 == 0, F.concat(F.lit(" "), (F.lit(1990) + F.col("c_nationkey")).cast("string"))).otherwise(F.lit("n.d."))).alias("Publication Year"),
        rich(F.when(k % 4 > 0, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise(F.lit(""))).alias("DOI"),
        F.struct(F.lit("select").alias("type"), F.struct(F.col("c_mktsegment").alias("name")).alias("select")).alias("journal"),
        F.struct(F.lit("multi_select").alias("type"), F.array(F.struct(F.lit("Q1").alias("name")), F.struct(F.lit("Q2").alias("name"))).alias("multi_select")).alias("Article Type"),
        F.struct(F.lit("status").alias("type"), F.struct(F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'Done' WHEN 1 THEN ' In Progress' ELSE 'Odd' END").alias("name")).alias("status")).alias("Status"),
        F.when(k % 5 == 0, rich(F.lit("Not started"))).alias("Status_1"),
        F.struct(F.lit("checkbox").alias("type"), F.lit(False).alias("checkbox")).alias("Completed"),
        F.struct(F.lit("formula").alias("type"), F.array(F.struct(F.col("c_mktsegment").alias("plain_text"))).alias("rich_text")).alias("Work Nature"),
        F.struct(F.lit("formula").alias("type"), F.lit("v").alias("formula")).alias("Absent"),
    )
    blocks = F.array(F.struct(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.lit("paragraph").alias("type"), F.col("c_mktsegment").alias("text")), F.struct(F.lit(None).cast("string").alias("id"), F.lit("paragraph").alias("type"), F.lit("").alias("text")), F.struct(F.lit(None).cast("string").alias("id"), F.lit("paragraph").alias("type"), F.col("c_name").alias("text")), F.struct(F.lit("q").alias("id"), F.lit("quote").alias("type"), F.lit("no").alias("text")))
    page = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("page_id"), F.when(k % 10 != 0, F.col("c_name")).alias("title"), properties.alias("properties"), F.col("tables"), blocks.alias("blocks"))
    return t(spark, sf_dir, "customer").join(per_page, "c_custkey", "left").select(F.parse_json(F.to_json(page)).alias("doc"))


def _pages(spark, sf_dir):
    return pages.pages_of(_docs(spark, sf_dir))


PAGES_SQL = """WITH pg AS (SELECT c_custkey AS k, 'p' || CAST(c_custkey AS VARCHAR) AS page_id, c_name, c_mktsegment AS seg, c_nationkey AS nk FROM customer),
    tb AS (SELECT page_id, o_orderkey AS ok, o_orderpriority AS prio, o_orderstatus AS st, CASE o_orderstatus WHEN 'F' THEN 'performance_prediction' WHEN 'O' THEN 'knowledge_tracing' END AS task_id,
        CASE o_orderstatus WHEN 'F' THEN 'prediction_modeling' WHEN 'O' THEN 'sequence_tracing' END AS template_id FROM pg JOIN orders ON o_custkey = k)"""


@query(PAGES_SQL + """ SELECT page_id AS id, CASE WHEN k % 10 = 0 THEN page_id ELSE c_name END AS title, CASE WHEN k % 3 = 0 THEN [c_name, 'B. Other'] ELSE [c_name, 'C. Third'] END AS authors,
    CASE WHEN k % 2 = 0 THEN CAST(1990 + nk AS VARCHAR) END AS year, CASE WHEN k % 4 > 0 THEN '10.1/' || CAST(k AS VARCHAR) END AS doi, seg AS journal, 'Q1' AS journal_quartile,
    'Completed=false;Work Nature=' || seg AS domain, page_id || '|demo|1.1' AS stamp FROM pg""")
def page_references(spark, sf_dir):
    refs = pages.references(_pages(spark, sf_dir), PACK)
    domain = F.array_join(F.transform(F.array_sort(F.map_entries("domain_properties")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    stamp = F.concat_ws("|", *(F.try_element_at("provenance", F.lit(c)) for c in quality.PROVENANCE))
    return refs.select("id", "title", "authors", F.col("year").cast("string").alias("year"), "doi", "journal", "journal_quartile", domain.alias("domain"), stamp.alias("stamp"))


@query(PAGES_SQL + " SELECT " + SHORT_ID_SQL.format(prefix="ex", key="page_id || '|' || coalesce(task_id, 'Misc') || '|' || CAST(ok AS VARCHAR)") + """ AS id, page_id, CASE WHEN task_id IS NOT NULL THEN """ + SHORT_ID_SQL.format(prefix="rt", key="page_id || '|' || task_id") + """ END AS reference_task_id,
    template_id, coalesce(template_id, 'Misc') AS schema_name, 'Model=,Price=;Model=' || st || ',Price=y' AS rows, CAST(ok AS VARCHAR) AS block_index FROM tb""")
def page_extractions(spark, sf_dir):
    found = pages.extractions(pages.page_tables(_pages(spark, sf_dir), PACK), PACK)
    rows = F.array_join(F.transform("extracted", lambda r: F.array_join(F.transform(F.array_sort(F.map_entries(r)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")), ";")
    return found.select("id", "page_id", "reference_task_id", "template_id", "schema_name", rows.alias("rows"), F.try_element_at("provenance", F.lit("block_index")).alias("block_index"))


@query(PAGES_SQL + " SELECT DISTINCT page_id, task_id AS id, 1::BIGINT AS kind, CAST(NULL AS VARCHAR) AS block FROM tb WHERE task_id IS NOT NULL UNION ALL SELECT page_id, " + SHORT_ID_SQL.format(prefix="rt", key="page_id || '|' || task_id") + ", 2, 'b' || CAST(ok AS VARCHAR) FROM tb WHERE task_id IS NOT NULL")
def page_tasks(spark, sf_dir):
    """The tasks of pages (kind 1) and their links (kind 2)."""
    found = pages.page_tables(_pages(spark, sf_dir), PACK)
    links = pages.reference_tasks(found, PACK).select(F.col("reference_id").alias("page_id"), "id", F.lit(2).cast("long").alias("kind"), F.try_element_at("provenance", F.lit("table_block_id")).alias("block"))
    return pages.tasks(found, PACK).select("page_id", "id", F.lit(1).cast("long").alias("kind"), F.lit(None).cast("string").alias("block")).unionByName(links)


@query(PAGES_SQL + " SELECT " + SHORT_ID_SQL.format(prefix="an", key="page_id || '|n' || CAST(k AS VARCHAR)") + " AS id, page_id AS reference_id, 'note' AS kind, seg AS text FROM pg UNION ALL SELECT " + SHORT_ID_SQL.format(prefix="an", key="page_id || '|' || c_name[:40]") + ", page_id, 'note', c_name FROM pg")
def page_annotations(spark, sf_dir):
    return pages.annotations(_pages(spark, sf_dir), PACK).select("id", "reference_id", "kind", "text")


@query(PAGES_SQL + ", s AS (SELECT page_id, 'Status' AS source_field, CASE nk % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'in_progress' ELSE 'odd' END AS state FROM pg UNION ALL SELECT page_id, 'Status_1', 'todo' FROM pg WHERE k % 5 = 0) SELECT " + SHORT_ID_SQL.format(prefix="ws", key="page_id || '|' || source_field || '|' || state") + " AS id, page_id AS reference_id, source_field, state FROM s")
def page_states(spark, sf_dir):
    return pages.workflow_states(_pages(spark, sf_dir), PACK).select("id", "reference_id", "source_field", "state")


def _database_pages(spark, sf_dir):
    """A database page for each part: a list of named properties in order."""
    k = F.col("p_partkey")
    rich = lambda c: F.struct(F.lit("rich_text").alias("type"), F.array(F.struct(c.cast("string").alias("plain_text"))).alias("rich_text"))
    named = lambda name, value: F.struct(F.lit(name).alias("name"), F.parse_json(F.to_json(value)).alias("value"))
    select = lambda c: F.struct(F.lit("select").alias("type"), F.struct(c.alias("name")).alias("select"))
    properties = F.array(
        named("Name", F.struct(F.lit("title").alias("type"), F.array(F.struct(F.col("p_name").alias("plain_text"))).alias("title"))), named("Title", rich(F.lit("second"))), named("AUTHORS", rich(F.concat("p_brand", F.lit("; "), "p_type"))),
        named("Year", F.struct(F.lit("number").alias("type"), (2000 + F.col("p_size")).alias("number"))), named("Zotero Key", rich(F.when(k % 2 == 0, F.concat(F.lit("K"), k.cast("string"))).otherwise(F.lit("")))),
        named("Keywords", F.struct(F.lit("multi_select").alias("type"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("t").alias("name"))).alias("multi_select"))),
        named("Platform", select(F.col("p_brand"))), named("SJR Quartile", rich(F.lit("Q3"))), named("Odd", rich(F.col("p_type"))),
    )
    return t(spark, sf_dir, "part").select(F.concat(F.lit("d"), k.cast("string")).alias("page_id"), properties.alias("properties"))


DATABASE_SQL = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'K' ELSE 'd' END || CAST(p_partkey AS VARCHAR) AS id, {title} AS title, [p_brand, p_type] AS authors, CAST(2000 + p_size AS INTEGER) AS year, [p_type, 't'] AS tags, p_brand AS database, 'Q3' AS journal_quartile{more} FROM part"


@query(DATABASE_SQL.format(title="p_name", more=", 'Odd=' || p_type AS extras"))
def schema_references(spark, sf_dir):
    found = pages.database_references(_database_pages(spark, sf_dir))
    extras = F.array_join(F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return found.select("id", "title", "authors", "year", "tags", "database", "journal_quartile", extras.alias("extras"))


@query(DATABASE_SQL.format(title="'second'", more=""))
def plain_references(spark, sf_dir):
    return pages.plain_references(_database_pages(spark, sf_dir)).select("id", "title", "authors", "year", "tags", "database", "journal_quartile")


@query("""WITH h AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM conversations)
    SELECT h.conv_id AS page_id, turn AS pos, coalesce(md5(heading), '') AS heading, (SELECT string_agg(md5(r.text), ',' ORDER BY r.turn) FROM conversations r WHERE r.conv_id = h.conv_id AND r.role = 'assistant' AND r.turn = h.turn + 1) AS rows FROM h WHERE role = 'user'""")
def block_tables(spark, sf_dir):
    """Conversations as blocks: system turns are headings, a user's turn is a table, the assistant's answer to it a row."""
    turns = t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("id"), (F.col("turn") - 1).cast("string").alias("parent_id"), "text", F.array(F.md5("text")).alias("cells"),
        F.expr("CASE role WHEN 'system' THEN 'heading_2' WHEN 'user' THEN 'table' ELSE 'table_row' END").alias("type"),
    )
    found = pages.block_tables(turns)
    return found.select("page_id", "pos", F.when(F.col("heading") != "", F.md5("heading")).otherwise(F.lit("")).alias("heading"), T.blank_to_null(F.array_join(F.flatten("rows"), ",")).alias("rows"))


OWNED = ["title", "year", "journal", "doi"]
KINDS = {"title": "title", "year": "number", "journal": "select", "doi": "rich_text"}


def _records(spark, sf_dir):
    """Customers as two snapshots of references; each is in one of them at least."""
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    common = [F.concat(F.lit("b"), k.cast("string")).alias("bundle_id"), F.array("c_mktsegment").alias("authors"), k.alias("at"), F.lit("7").alias("version")]
    doi = F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), (k - k % 6).cast("string")))
    target = c.where("c_custkey % 7 <> 0").select(F.concat(F.lit("t"), k.cast("string")).alias("id"), *common, F.when(k % 5 == 0, F.concat(F.lit("K"), k.cast("string"))).alias("record_key"), doi.alias("doi"), F.concat("c_name", F.lit("  x")).alias("title"), F.lit(2000).alias("year"), F.lit("J").alias("journal"))
    source = c.where("c_custkey % 11 <> 0 or c_custkey % 7 = 0").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), *common, F.concat(F.lit(" k"), k.cast("string")).alias("record_key"), F.regexp_replace(doi, "https://doi.org/", "").alias("doi"), F.when(k % 2 == 0, F.upper(F.concat("c_name", F.lit(" X")))).otherwise(F.concat("c_name", F.lit("'s"))).alias("title"), (F.lit(2000) + k % 2).cast("int").alias("year"), F.lit("J").alias("journal"))
    return target, source


PLAN_SQL = """WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN '10.1/' || CAST(c_custkey - c_custkey % 6 AS VARCHAR) END AS d FROM customer),
    tg AS (SELECT 't' || CAST(k AS VARCHAR) AS id, k, CASE WHEN k % 5 = 0 THEN 'k' || CAST(k AS VARCHAR) END AS rk, d, lower(c_name) || ' x|' || lower(seg) AS ta, c_name || '  x' AS title, 'https://doi.org/' || d AS doi FROM c WHERE k % 7 <> 0),
    sc AS (SELECT 's' || CAST(k AS VARCHAR) AS id, k, 'k' || CAST(k AS VARCHAR) AS rk, d, CASE WHEN k % 2 = 0 THEN lower(c_name) || ' x' ELSE lower(c_name) || '''s' END || '|' || lower(seg) AS ta, CASE WHEN k % 2 = 0 THEN upper(c_name || ' X') ELSE c_name || '''s' END AS title, d AS doi, CAST(2000 + k % 2 AS VARCHAR) AS year FROM c WHERE k % 11 <> 0 OR k % 7 = 0),
    pr AS (SELECT tg.id AS left_id, sc.id AS right_id, sc.k AS pos, CASE WHEN tg.rk = sc.rk THEN 'record_key' WHEN tg.d = sc.d THEN 'doi' ELSE 'title_authors' END AS key_type, CASE WHEN tg.rk = sc.rk THEN sc.rk WHEN tg.d = sc.d THEN sc.d ELSE sc.ta END AS key_value,
        tg.title AS old_title, tg.doi AS old_doi, sc.title AS new_title, sc.doi AS new_doi, sc.year AS new_year FROM tg JOIN sc ON tg.rk = sc.rk OR tg.d = sc.d OR tg.ta = sc.ta),
    mt AS (SELECT *, 'match-' || CASE WHEN row_number() OVER (ORDER BY pos) < 10000 THEN lpad(CAST(row_number() OVER (ORDER BY pos) AS VARCHAR), 4, '0') ELSE CAST(row_number() OVER (ORDER BY pos) AS VARCHAR) END AS match_id FROM pr
        WHERE left_id IN (SELECT left_id FROM pr GROUP BY 1 HAVING count(*) = 1) AND right_id IN (SELECT right_id FROM pr GROUP BY 1 HAVING count(*) = 1)),
    op AS (SELECT match_id, left_id, right_id, unnest(['title', 'doi', 'year']) AS field, unnest([old_title, old_doi, '2000']) AS old_value, unnest([new_title, new_doi, new_year]) AS new_value FROM mt),
    od AS (SELECT * FROM op WHERE old_value IS DISTINCT FROM new_value),
    am AS (SELECT right_id, count(*) AS n_candidates FROM pr WHERE right_id NOT IN (SELECT right_id FROM mt) GROUP BY 1),
    os AS (SELECT * FROM sc WHERE id NOT IN (SELECT right_id FROM pr)), ot AS (SELECT * FROM tg WHERE id NOT IN (SELECT left_id FROM pr))"""


def _plan(spark, sf_dir):
    target, source = _records(spark, sf_dir)
    return plan.sync_plan(target, source, OWNED, "at")


@query(PLAN_SQL + " SELECT match_id, left_id, right_id, key_type, key_value FROM mt")
def plan_matches(spark, sf_dir):
    return _plan(spark, sf_dir)["matches"]


@query(PLAN_SQL + """ SELECT 'update_reference_field' AS operation, match_id || '-' || field AS operation_id, match_id, 'pages' AS target, 'library' AS source, field, old_value, new_value, left_id AS target_reference_id, right_id AS source_reference_id,
    ' k' || right_id[2:] AS record_key, 'source_owned_field' AS reason FROM od""")
def plan_field_updates(spark, sf_dir):
    return _plan(spark, sf_dir)["operations"]


@query(PLAN_SQL + " SELECT right_id, n_candidates, CASE WHEN n_candidates > 1 THEN 'multiple_candidates' ELSE 'no_available_candidate' END AS reason FROM am")
def plan_ambiguous(spark, sf_dir):
    return _plan(spark, sf_dir)["ambiguous"]


@query(PLAN_SQL + """ SELECT 'review' AS part, id, title, 'create_page_from_record' AS operation FROM os UNION ALL SELECT 'only_source', id, title, NULL FROM os UNION ALL SELECT 'only_target', id, title, NULL FROM ot""")
def plan_unmatched(spark, sf_dir):
    """What only one side has, and the review rows that this makes."""
    found = _plan(spark, sf_dir)
    lone = lambda part: found[part].select(F.lit(part).alias("part"), "id", "title", F.lit(None).cast("string").alias("operation"))
    review = found["review_actions"].select(F.lit("review").alias("part"), F.col("source_reference_id").alias("id"), "title", "operation")
    return review.unionByName(lone("only_source")).unionByName(lone("only_target"))


@query(PLAN_SQL + """ SELECT 'target_records' AS counter, count(*) AS n FROM tg UNION ALL SELECT 'source_records', count(*) FROM sc UNION ALL SELECT 'matches', count(*) FROM mt UNION ALL SELECT 'operations', count(*) FROM od UNION ALL SELECT 'only_source', count(*) FROM os
    UNION ALL SELECT 'only_target', count(*) FROM ot UNION ALL SELECT 'ambiguous', count(*) FROM am UNION ALL SELECT 'review_actions', count(*) FROM os""")
def plan_summary(spark, sf_dir):
    return _plan(spark, sf_dir)["summary"]


QUOTED_SQL = "CASE WHEN {v} IS NULL THEN 'None' WHEN contains({v}, '''') THEN '\"' || {v} || '\"' ELSE '''' || {v} || '''' END"


@query(PLAN_SQL + " SELECT match_id || '-' || field AS operation_id, '[DRY-RUN] pages.update [' || left_id || '] ' || field || ': ' || " + QUOTED_SQL.format(v="old_value") + " || ' -> ' || " + QUOTED_SQL.format(v="new_value") + """ AS line,
    CASE field WHEN 'title' THEN '{"title":[{"text":{"content":"' || new_value || '"}}]}' WHEN 'year' THEN '{"number":' || new_value || '.0}' ELSE '{"rich_text":[{"text":{"content":"' || new_value || '"}}]}' END AS payload FROM od WHERE field <> 'journal'""")
def plan_dry_run(spark, sf_dir):
    return plan.rendered(_plan(spark, sf_dir)["operations"], OWNED, KINDS)


@query(PLAN_SQL + """ SELECT match_id || '-' || field AS operation_id, 's1' AS session_id, '2024-01-01' AS timestamp, 'references' AS entity_type, left_id AS entity_id, field, old_value, new_value, 'plan' AS actor, 'planned' AS status, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS VARCHAR) AS rollback_ref FROM od""")
def plan_log_rows(spark, sf_dir):
    return plan.log_rows(_plan(spark, sf_dir)["operations"], "planned", "s1", F.lit("2024-01-01"), "plan")


def _edits(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    new = part.where("p_partkey % 6 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return part.where("p_partkey % 9 <> 0 or p_partkey % 6 = 0"), new


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 9 <> 0 OR p_partkey % 6 = 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 6 <> 0),
    d AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS k, a.p_name AS o, b.p_name AS n, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS c FROM a FULL JOIN b ON a.p_partkey = b.p_partkey)
    SELECT CAST(k AS VARCHAR) AS entity_id, 'p_name' AS field, 'library.' || c || ' [parts/' || CAST(k AS VARCHAR) || '] p_name: ' || CASE WHEN o IS NULL THEN 'None' ELSE '''' || o || '''' END || ' -> ' || CASE WHEN n IS NULL THEN 'None' ELSE '''' || n || '''' END AS line FROM d WHERE c <> 'changed' OR o <> n""")
def writer_lines(spark, sf_dir):
    """What the library's writer would do: its own field's changes alone."""
    old, new = _edits(spark, sf_dir)
    return plan.change_lines(linkage.field_diff(old, new, "p_partkey", ["p_name", "p_type"]), {"p_name": "library", "p_type": "pages"}, "library", "parts")


@query("""WITH o AS (SELECT 'f' || CAST(l_orderkey % 50 AS VARCHAR) AS f, CAST(l_orderkey AS VARCHAR) AS k, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT f, k, n FROM o WHERE CAST(k AS BIGINT) % 50 <> 7 AND CAST(k AS BIGINT) % 3 <> 0), a AS (SELECT f, k, CASE WHEN CAST(k AS BIGINT) % 4 = 0 THEN n + 1 ELSE n END AS n FROM o WHERE CAST(k AS BIGINT) % 50 <> 9)
    SELECT coalesce(a.f, b.f) AS file_name, coalesce(a.k, b.k) AS entity_id, 'n' AS field, CAST(b.n AS VARCHAR) AS old_value, CAST(a.n AS VARCHAR) AS new_value, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change_type
    FROM (SELECT * FROM b WHERE f IN (SELECT f FROM a)) b FULL JOIN a ON a.k = b.k AND a.f = b.f WHERE a.n IS DISTINCT FROM b.n""")
def files_diff(spark, sf_dir):
    """Orders in fifty files; one is new, one is gone, some entities of the others are new or changed."""
    k = F.col("l_orderkey")
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("file_name", F.concat(F.lit("f"), (k % 50).cast("string")))
    new = rows.where(k % 50 != 9).withColumn("n", F.when(k % 4 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return summary.diff_files(rows.where((k % 50 != 7) & (k % 3 != 0)), new, "l_orderkey", ["n"])


@query("""SELECT page_id, lower(trim(url)) = lower(trim(upper(url))) AS title_match, page_id % 2 = 0 AS authors_match, page_id % 4 AS n_extractions FROM pages WHERE page_id % 3 > 0""")
def pages_compared(spark, sf_dir):
    return summary.compared_pages(*_compared(spark, sf_dir))


def _compared(spark, sf_dir):
    p, k = t(spark, sf_dir, "pages"), F.col("page_id")
    old = p.select("page_id", F.concat(F.lit(" "), "url").alias("title"), F.lit("A  B").alias("authors"), F.lit(0).alias("n_extractions"))
    return old, p.where(k % 3 > 0).select("page_id", F.upper("url").alias("title"), F.when(k % 2 == 0, "a b").otherwise("a c").alias("authors"), (k % 4).alias("n_extractions"))


@query("""SELECT count(*) AS total_pages, count(*) AS title_matches, count(*) FILTER (page_id % 4 > 0) AS pages_with_extractions, min(page_id % 4) AS min_extractions, max(page_id % 4) AS max_extractions, avg(page_id % 4) AS mean_extractions FROM pages WHERE page_id % 3 > 0""")
def pages_compared_summary(spark, sf_dir):
    return summary.comparison_summary(summary.compared_pages(*_compared(spark, sf_dir)))


@query("""WITH r AS (SELECT 'p' || CAST(o_custkey % 40 AS VARCHAR) || '.json' AS f, CAST(o_custkey AS VARCHAR) AS id FROM orders) SELECT id, max(f) AS file_name FROM (SELECT id, f FROM r UNION ALL SELECT f[:-6], f FROM r) GROUP BY id""")
def bundle_index(spark, sf_dir):
    refs = t(spark, sf_dir, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string"), F.lit(".json")).alias("file_name"), F.col("o_custkey").cast("string").alias("id"))
    return summary.bundle_index(refs)


@query("""WITH p AS (SELECT doc_id, doc_id % 3 AS n_tables, CASE doc_id % 4 WHEN 0 THEN 'Done' WHEN 1 THEN 'To do' ELSE 'Other' END AS status, lang FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN lang END AS lang, source FROM documents SEMI JOIN labels USING (doc_id))
    SELECT 'missing_reference' AS check_name, CAST(doc_id AS VARCHAR) AS page_id, CAST(NULL AS VARCHAR) AS detail FROM p WHERE doc_id NOT IN (SELECT doc_id FROM r)
    UNION ALL SELECT 'missing_extractions', CAST(doc_id AS VARCHAR), CAST(n_tables AS VARCHAR) FROM p WHERE doc_id IN (SELECT doc_id FROM r) AND n_tables > 0 AND doc_id % 5 > 0
    UNION ALL SELECT 'field_loss', CAST(doc_id AS VARCHAR), 'lang' FROM r WHERE lang IS NULL
    UNION ALL SELECT 'provenance_loss', CAST(doc_id AS VARCHAR), 'domain_pack_id' FROM r WHERE lang IS NULL
    UNION ALL SELECT 'provenance_loss', CAST(doc_id AS VARCHAR), 'domain_pack_version' FROM r WHERE doc_id % 5 = 0
    UNION ALL SELECT 'state_mismatch', CAST(doc_id AS VARCHAR), 'todo / done' FROM p WHERE doc_id IN (SELECT doc_id FROM r) AND doc_id % 4 = 1""")
def bundle_audit(spark, sf_dir):
    """Documents as old pages, the labelled ones as bundles; a third of their languages is lost, every fifth has an extraction."""
    d, k = t(spark, sf_dir, "documents").withColumn("page_id", F.col("doc_id")), F.col("doc_id")
    old = d.select("page_id", (k % 3).alias("n_tables"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'Done' WHEN 1 THEN 'To do' ELSE 'Other' END").alias("status"), "lang")
    kept = d.join(t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    stamp = lambda lang, version: F.create_map(F.lit("source_id"), "source", F.lit("domain_pack_id"), lang, F.lit("domain_pack_version"), version)
    lang = F.when(k % 6 > 0, F.col("lang"))
    refs = kept.select("page_id", lang.alias("lang"), stamp(lang, F.lit("1")).alias("provenance"))
    found = kept.where(k % 5 == 0).select("page_id", stamp(F.col("lang"), F.lit("")).alias("provenance"))
    return summary.audit(old, refs, found, kept.select("page_id", F.lit("done").alias("state")), ["lang"], {"Done": "done", "To do": "todo"})


@query("""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '10.5/' || CAST(p_partkey // 4 AS VARCHAR) END AS d, lower(p_name) || '|' || lower(p_brand) || CAST(p_partkey // 10 AS VARCHAR) AS ta FROM part),
    p AS (SELECT a.k AS left_id, b.k AS right_id, CASE WHEN a.d = b.d THEN 'doi' ELSE 'title_author' END AS key_type FROM a JOIN a b ON a.d = b.d OR a.ta = b.ta) SELECT * FROM p WHERE key_type = 'doi' OR left_id NOT IN (SELECT left_id FROM p WHERE key_type = 'doi')""")
def pages_matched(spark, sf_dir):
    """Parts against themselves by DOI, or else by title and first author."""
    k = F.col("p_partkey")
    doi = F.when(k % 2 == 0, F.concat(F.lit("10.5/"), F.floor(k / 4).cast("string")))
    side = lambda title, d: t(spark, sf_dir, "part").select(k.alias("id"), d.alias("doi"), title.alias("title"), F.concat("p_brand", F.floor(k / 10).cast("string")).alias("first_author"))
    return summary.matched_pages(side(F.col("p_name"), doi), side(F.concat(F.upper("p_name"), F.lit(" ")), F.concat(F.lit("http://dx.doi.org/"), doi)))


def _refs(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit(" 10.2/X"), (k % 100).cast("string"))).alias("doi"), F.when(k % 3 > 0, F.concat(F.lit("T"), (k % 30).cast("string"))).alias("title"), F.when(k % 3 == 1, F.array(F.lit("A"), F.lit("B"))).alias("authors"), "o_totalprice", F.lit("keep").alias("score"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'd' || CAST(o_orderkey % 100 AS VARCHAR) WHEN o_orderkey % 3 > 0 THEN 't' || CAST(o_orderkey % 30 AS VARCHAR) || '|' || CASE WHEN o_orderkey % 3 = 1 THEN 'AB' ELSE '' END END AS key, o_totalprice,
    CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS s FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, id) AS n FROM r) SELECT id, o_totalprice, 'keep' AS score FROM k WHERE key IS NULL OR n = 1""")
def dedupe_references(spark, sf_dir):
    refs = _refs(spark, sf_dir)
    return summary.deduped(refs, F.col("id"), tables.completeness(F.col("doi"), F.col("title"))).select("id", "o_totalprice", "score")


@query("""SELECT 'references' AS kind, '' AS name, count(*) AS n FROM customer UNION ALL SELECT 'reference_tasks', '', count(*) FROM orders UNION ALL SELECT 'extractions', CASE WHEN l_returnflag = 'N' THEN '(none)' ELSE l_returnflag END, count(*) FROM lineitem GROUP BY 2""")
def task_counts(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("template_id"))
    return summary.task_counts(t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders"), lines)


@query("""WITH r AS (SELECT p_partkey AS k, p_name, p_brand, p_type FROM part) SELECT 'p' || CAST(k AS VARCHAR) AS page_id, p_brand AS authors, CASE WHEN k % 2 = 0 THEN 'done' ELSE p_name END AS title, CASE WHEN k % 2 = 0 THEN 'X' ELSE '' END AS "Status", CASE WHEN k % 3 = 0 THEN p_type ELSE '' END AS "Work Nature" FROM r""")
def reading_list(spark, sf_dir):
    """References laid over by their status fields, one of which hides the title, and their domain's."""
    k = F.col("p_partkey")
    refs = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.lit(None).cast("int").alias("year"), F.when(k % 2 == 0, F.create_map(F.lit("Status"), F.lit("X"), F.lit("title"), F.lit("done"))).alias("status"), F.when(k % 3 == 0, F.create_map(F.lit("Work Nature"), "p_type")).alias("domain"))
    return summary.wide(summary.reading_list(refs, F.col("id"), F.col("status"), F.col("domain")), "row", ["page_id"]).drop("id")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS b, p_name AS c FROM part""")
def wide_rows(spark, sf_dir):
    k = F.col("p_partkey")
    row = summary.overlay(F.create_map(F.lit("c"), "p_name"), F.when(k % 2 == 0, F.create_map(F.lit("a"), "p_brand")), F.when(k % 3 == 0, F.create_map(F.lit("b"), "p_type")))
    return summary.wide(t(spark, sf_dir, "part").select("p_partkey", row.alias("row")), "row", ["p_partkey"])


@query("""SELECT c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS status FROM customer UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders""")
def stacked_rows(spark, sf_dir):
    return summary.stacked([t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))])


LABELS = {"performance_prediction": "PRED", "knowledge_tracing": "KT"}


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'PRED' WHEN 'click' THEN 'KT' WHEN 'purchase' THEN 'PRED' ELSE event_type END AS label, CASE event_type WHEN 'view' THEN 'PRED' WHEN 'click' THEN 'KT' WHEN 'purchase' THEN 'PRED' WHEN 'error' THEN 'ERRO' ELSE 'SIGN' END AS short FROM events""")
def task_labels(spark, sf_dir):
    name = F.expr("CASE event_type WHEN 'view' THEN 'Performance-Prediction' WHEN 'click' THEN 'my knowledge tracing' WHEN 'purchase' THEN 'Prediction' ELSE event_type END")
    return t(spark, sf_dir, "events").select("event_id", summary.task_label(name, LABELS).alias("label"), summary.short_task_label(name).alias("short"))


def _raw_tables(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("p_name"), F.when(F.col("p_partkey") % 2 == 0, "n/a").otherwise(F.col("p_type")).alias("p_type"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("MAchine "), "o_orderpriority").alias("o_orderpriority"))
    return {"parts": part, "orders": orders}


@query("""SELECT 'parts' AS "table", count(*) AS n_rows, count(*) + count(*) FILTER (p_partkey % 2 = 0) AS changed_cells, 0::BIGINT AS changed_search_cells FROM part UNION ALL SELECT 'orders', count(*), count(*), 0 FROM orders""")
def analysis_log(spark, sf_dir):
    return summary.run_analysis(_raw_tables(spark, sf_dir), summary.STANDARD_FIXES, summary.STANDARD_VALUES)[1]


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'Not Applicable' ELSE p_type END AS p_type FROM part""")
def standard_cleaned(spark, sf_dir):
    return summary.standard_clean(_raw_tables(spark, sf_dir)["parts"], "parts")[0]


@query("WITH " + _tokens_sql() + " SELECT 'P' AS task, CAST(p_partkey AS VARCHAR) AS paper_id, raw_token, value, matched FROM long UNION ALL SELECT 'Q', CAST(p_partkey AS VARCHAR), raw_token, value, matched FROM long WHERE p_partkey % 5 = 0")
def task_tables_normalized(spark, sf_dir):
    """Two task tables with the wanted column under two names, and one without it."""
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_page_id"), _cell().alias("Data Sources"))
    sources = {"P": part, "Q": part.where("source_page_id % 5 = 0").withColumnRenamed("Data Sources", "dataset"), "R": t(spark, sf_dir, "region")}
    return summary.normalized_tables(sources, ("Data sources", "Dataset"), COLOURS, paper.detect_column)


@query("SELECT l_returnflag AS header, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 'Alpha' WHEN 'R' THEN 'Return' END AS name FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def matching_columns(spark, sf_dir):
    names = spark.createDataFrame([("Alpha", "a"), ("Return", "r"), ("Return", "R"), ("Other", None)], "name string, alias string")
    headers = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("header")).agg(F.count(F.lit(1)).alias("n"))
    return quality.matching_columns(headers, names)


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'error')")
def accepted_by_map(spark, sf_dir):
    """Statuses read through a value map: views are accepted by it, purchases by name, signups have none."""
    status = F.expr("CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'Not Accepted' WHEN 'signup' THEN '' ELSE event_type END")
    return t(spark, sf_dir, "events").where(decode.accepted(T.map_value(status, {"ok": "Accepted For Prediction"}))).select("event_id")


@query("""SELECT 'incomplete_reference' AS check_name, o_custkey AS bundle_id, o_orderkey AS object_id FROM orders WHERE o_orderkey % 4 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 3 = 0)
    UNION ALL SELECT 'ambiguous_status', o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 7 = 0
    UNION ALL SELECT 'unlinked_extraction', o_custkey, o_orderkey FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'malformed_extraction', o_custkey, o_orderkey FROM orders WHERE o_orderkey % 9 < 2
    UNION ALL SELECT 'missing_columns', o_custkey, o_orderkey FROM orders WHERE o_orderkey % 9 = 2""")
def run_qa(spark, sf_dir):
    """Orders as references, states and extractions; a blank year is no finding, an empty list and a null state are."""
    o, k = t(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "bundle_id", "o_orderkey": "id"}), F.col("id")
    refs = o.select("bundle_id", "id", F.when(k % 4 > 0, "T").alias("title"), F.when(k % 5 > 0, "d").otherwise("").alias("doi"), F.when(k % 3 > 0, "z").alias("zotero_key"), F.lit(None).cast("int").alias("year"))
    states = o.select("bundle_id", "id", F.when(k % 7 > 0, F.col("o_orderstatus")).alias("state"))
    row = lambda name: F.array(F.create_map(F.lit(name), F.lit("1")))
    rows = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.array().cast("array<map<string,string>>")).when(k % 9 == 2, row("other")).when(k % 9 == 3, row("Alias")).otherwise(row("Metric"))
    found = o.select("bundle_id", "id", F.when(k % 6 > 0, "rt").alias("reference_task_id"), F.lit("g").alias("template_id"), rows.alias("extracted"))
    return quality.run_qa(refs, states, found, ["F", "O"], {"g": {"Metric": ["Alias"]}}).select("check_name", "bundle_id", "object_id")


@query("SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'OK' ELSE 'done ' || lang END AS status, count(*) AS n FROM documents GROUP BY ALL")
def cleaned_states(spark, sf_dir):
    status = F.when(F.col("doc_id") % 3 == 0, " ok").otherwise(F.concat(F.lit(" DONE "), "lang"))
    return tables.group_counts(t(spark, sf_dir, "documents").select("lang", T.workflow_state(status, {"ok": "OK"}).alias("status")), "lang", "status")


@query("SELECT event_id FROM events WHERE ts >= (SELECT CAST(max(ts) AS DATE) - 10 FROM events)")
def pruned_log(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    today = events.agg(F.to_date(F.max("ts")).alias("today"))
    log = events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")).crossJoin(F.broadcast(today))  # one row
    return bundles.kept_log(log, 10, F.col("today")).select("event_id")
