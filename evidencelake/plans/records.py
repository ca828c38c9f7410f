"""Registered queries over the write log, block trees, distinct counts, audits and files, each with the DuckDB SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import blocks, distinct, paper, plan, quality, summary, tables
from evidencelake.plans.catalog import COLOURS, HITS, query, t
from evidencelake.plans.documents import _folder
from evidencelake.sources import bundles


def _log(spark, sf_dir):
    """Events as write-log records, appended in two parts to a new log in the shared folder."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    records = t(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("operation_id"), at.alias("timestamp"), F.lit("references").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("field"),
        F.lit(None).cast("string").alias("old_value"), F.col("value").cast("string").alias("new_value"), F.get_json_object("props", "$.k").alias("actor"), F.when(F.col("event_id") % 4 == 0, "planned").otherwise("applied").alias("status"),
    )
    path = _folder(spark, "log")
    half = F.col("operation_id") < F.lpad(F.lit("500"), 12, "0")
    bundles.append_log(records.where(half), path, "s1")
    bundles.append_log(records.where(~half), path, "s2")
    return path


LOG_SQL = "WITH l AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS said_at, CAST(user_id AS VARCHAR) AS entity_id, event_type AS field, CAST(value AS VARCHAR) AS v, json_extract_string(props, '$.k') AS actor, CASE WHEN event_id % 4 = 0 THEN 'planned' ELSE 'applied' END AS status FROM events)"
MOMENT = "2024-01-21T13:30:00.000000"


@query(f"{LOG_SQL} SELECT entity_id, field, arg_max(v, said_at || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS new_value, arg_max(actor, said_at || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS actor, max(said_at) AS said_at FROM l WHERE status = 'applied' AND said_at <= '{MOMENT}' GROUP BY ALL")
def log_state_as_of(spark, sf_dir):
    """Every field's value at a moment, from the snapshot of the 18th, made on that of the 9th, and the days after it."""
    path, snapshots = _log(spark, sf_dir), _folder(spark, "snapshots")
    for day in ("2024-01-09", "2024-01-18"):
        bundles.snapshot_states(spark, path, snapshots, day)
    return bundles.state_as_of(spark, path, snapshots, MOMENT).select("entity_id", "field", "new_value", "actor", F.col("timestamp").alias("said_at"))


@query(f"{LOG_SQL} SELECT said_at[:10] AS day, CASE WHEN event_id < 500 THEN 's1' ELSE 's2' END AS session_id, status, count(*) AS n FROM l WHERE said_at >= '2024-01-12' GROUP BY ALL")
def log_kept_days(spark, sf_dir):
    """What is left once the days before the 12th are deleted from the log."""
    path = _log(spark, sf_dir)
    bundles.prune_log(spark, path, "2024-01-12")
    return bundles.read_log(spark, path).groupBy(F.substring("timestamp", 1, 10).alias("day"), "session_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', "quoted"' AS title, '["' || c_mktsegment || '","x"]' AS authors, '{"n":' || c_nationkey || '}' AS sync_metadata FROM customer""")
def csv_round_trip(spark, sf_dir):
    """An entity table with a list and a document, written as csv and read again."""
    df = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.lit(', "quoted"')).alias("title"), F.array("c_mktsegment", F.lit("x")).alias("authors"), F.parse_json(F.concat(F.lit('{"n": '), "c_nationkey", F.lit("}"))).alias("sync_metadata"),
    )
    path = _folder(spark, "csv")
    bundles.write_table(df, path, "csv")
    return spark.read.schema("id string, title string, authors string, sync_metadata string").csv(path, header=True, escape='"')


@query("""WITH RECURSIVE b AS (SELECT p_brand AS page, p_partkey AS id, p_partkey // 3 AS parent, p_name AS text FROM part),
    up AS (SELECT page, id, id AS top, 0 AS depth, [id] AS path, text FROM b WHERE id = 0 OR NOT EXISTS (SELECT 1 FROM b p WHERE p.page = b.page AND p.id = b.parent)
        UNION ALL SELECT b.page, b.id, top, depth + 1, list_append(path, b.id), b.text FROM up JOIN b ON b.page = up.page AND b.parent = up.id AND b.id <> 0)
    SELECT page AS page_id, top, max(depth) AS deepest, string_agg(text, chr(10) ORDER BY path) AS text FROM up GROUP BY ALL""")
def nested_blocks(spark, sf_dir):
    """Parts as blocks that nest within their brand's page: the depth and the text of every page-level block."""
    k = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("page_id"), k.alias("id"), F.when(k > 0, F.expr("p_partkey div 3")).alias("parent_id"), k.alias("pos"), F.col("p_name").alias("text"))
    depths = blocks.closure(rows).groupBy("page_id", "top").agg(F.max("depth").alias("deepest"))
    return blocks.texts(rows).join(depths, ["page_id", "top"]).select("page_id", "top", "deepest", "text")


@query("""WITH h AS (SELECT conv_id, turn, role, text, first_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS heading FROM conversations)
    SELECT h.conv_id AS page_id, turn AS pos, CASE WHEN heading IS NULL THEN '' ELSE md5(heading) END AS heading, (SELECT string_agg(md5(r.text), ',' ORDER BY r.turn) FROM conversations r WHERE r.conv_id = h.conv_id AND r.role = 'assistant' AND r.turn = h.turn + 1) AS rows FROM h WHERE role = 'user'""")
def exported_tables(spark, sf_dir):
    """Conversations as blocks, by the page export's rule for headings."""
    turns = t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("id"), (F.col("turn") - 1).cast("string").alias("parent_id"), "text", F.array(F.md5("text")).alias("cells"),
        F.expr("CASE role WHEN 'system' THEN 'heading_2' WHEN 'user' THEN 'table' ELSE 'table_row' END").alias("type"),
    )
    found = blocks.exported_tables(turns)
    return found.select("page_id", "pos", F.when(F.col("heading") != "", F.md5("heading")).otherwise(F.lit("")).alias("heading"), T.blank_to_null(F.array_join(F.flatten("rows"), ",")).alias("rows"))


def _uses(spark, sf_dir):
    """Which part types each order's lines have, by return flag and year."""
    lines = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("task"), F.col("p_brand").alias("value"), F.year("l_shipdate").alias("year"))


@query("""SELECT p_brand AS value, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A') AS "A", count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS "R",
    count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A') + count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS total, count(DISTINCT l_orderkey) AS anywhere FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def bitmap_pivot(spark, sf_dir):
    """Distinct orders by brand and return flag, with totals."""
    return distinct.pivoted(distinct.entity_bitmaps(_uses(spark, sf_dir), ["task", "value", "year"], "paper"), "value", "task", ["A", "R"])


@query("""WITH c AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_brand AS value, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    g AS (SELECT value, CAST(unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS INTEGER) AS year FROM (SELECT DISTINCT value FROM c))
    SELECT year, value, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (year, value)""")
def bitmap_trend(spark, sf_dir):
    """Distinct orders by year and brand from the same kind of aggregate."""
    return distinct.trend(distinct.entity_bitmaps(_uses(spark, sf_dir), ["task", "value", "year"], "paper"), "year", "value")


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS paper, p_type AS sig, string_split(p_name, ' ') AS ws FROM part),
    w AS (SELECT k, paper, sig, unnest(ws) AS w FROM p), hit AS (SELECT DISTINCT paper, sig FROM w WHERE regexp_matches(w, '(?i)black|navy') OR regexp_matches(w, '(?i)red|^orange$')),
    n AS (SELECT paper, sig, count(*) AS n FROM p GROUP BY ALL)
    SELECT paper AS paper_id, sig AS signature, '__row__' AS output_column, 'preserved_distinct_paper_contribution' AS action, sig AS detail FROM n WHERE paper IN (SELECT paper FROM n GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT paper, sig, '__row__', 'merged_duplicate_extraction_rows', CAST(n AS VARCHAR) FROM n WHERE n > 1
    UNION ALL SELECT paper, sig, 'models', 'unmatched_token', w FROM w ANTI JOIN hit USING (paper, sig) WHERE """ + " AND ".join(rf"NOT regexp_matches(lower(w), '\b({k})\b') AND NOT regexp_matches(w, '(?i){r}')" for k, r in HITS.values()) + """
    UNION ALL SELECT paper, sig, 'models', 'limited_display_items', CAST(n - 1 AS VARCHAR) FROM (
        SELECT paper, sig, count(DISTINCT x) AS n FROM (SELECT paper, sig, unnest(list_filter([""" + ", ".join(rf"CASE WHEN regexp_matches(lower(w), '\b({k})\b') OR regexp_matches(w, '(?i){r}') THEN '{n}' END" for n, (k, r) in HITS.items()) + """], lambda x: x IS NOT NULL)) AS x FROM w ANTI JOIN hit USING (paper, sig)
        UNION ALL SELECT paper, sig, lower(w) FROM w ANTI JOIN hit USING (paper, sig) WHERE """ + " AND ".join(rf"NOT regexp_matches(lower(w), '\b({k})\b') AND NOT regexp_matches(w, '(?i){r}')" for k, r in HITS.values()) + """) GROUP BY ALL) WHERE n > 1""")
def fallback_audit(spark, sf_dir):
    """A column that serves where the first choice has nothing: it is audited there alone."""
    words = lambda *names: tuple((n, tuple(COLOURS[n])) for n in names)
    specs = [paper.Spec("first", ("names",), "every", words("dark", "warm"), 8, 170, "models"), paper.Spec("second", ("names",), "vocab", words(*COLOURS), 1, 170, "models", instead_of="first")]
    rows = t(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("paper_id"), F.col("p_type").alias("signature"), F.col("p_partkey").alias("ordinal"), F.regexp_replace("p_name", " ", "; ").alias("names"))
    return paper.paper_audit(rows, specs)


@query("""SELECT 'provenance_loss' AS check_name, CAST(c_custkey AS VARCHAR) AS page_id, 'domain_pack_id' AS detail FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 = 0
    UNION ALL SELECT 'missing_extractions', CAST(c_custkey AS VARCHAR), '2' FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 = 0
    UNION ALL SELECT 'state_mismatch', CAST(c_custkey AS VARCHAR), 'todo / done' FROM customer WHERE c_acctbal > 0 AND c_nationkey % 5 = 1""")
def states_audit(spark, sf_dir):
    """States without provenance of old pages' bundles; customers in debt have bundles that no old page has."""
    n, pages = F.col("c_nationkey"), t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), "c_nationkey", "c_acctbal", F.lit("x").alias("title"))
    stamp = lambda pack: F.create_map(F.lit("source_id"), F.lit("s"), F.lit("domain_pack_id"), pack, F.lit("domain_pack_version"), F.lit("1"))
    whole = stamp(F.lit("p"))
    old = pages.where("c_acctbal > 0").select("page_id", F.lit(2).alias("n_tables"), F.when(n % 5 == 1, "To do").otherwise("Done").alias("status"), "title")
    states = pages.select("page_id", F.lit("done").alias("state"), stamp(F.when(n % 3 != 0, "p")).alias("provenance"))
    return summary.audit(old, pages.select("page_id", "title", whole.alias("provenance")), pages.where(n % 2 == 1).select("page_id", whole.alias("provenance")), states, ["title"], {"To do": "todo", "Done": "done"})


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'Title ' || o_orderkey % 7 END || CASE WHEN o_orderkey % 5 > 0 THEN ' (' || year(o_orderdate) || ')' ELSE '' END AS study, 'Title ' || o_orderkey % 7 AS title, CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) ELSE 9999 END AS y FROM orders)
    SELECT o_orderkey, study, row_number() OVER (ORDER BY y, lower(study), lower(title), o_orderkey) AS place FROM s""")
def study_order(spark, sf_dir):
    """The places of studies in a manuscript's order."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Title "), k % 7)
    rows = t(spark, sf_dir, "orders").select("o_orderkey", T.paper_study(F.when(k % 3 > 0, F.concat("o_orderpriority", F.lit(", J.; Other"))), F.when(k % 5 > 0, F.year("o_orderdate").cast("string")), title).alias("study"), title.alias("title"))
    keyed = rows.select("o_orderkey", "study", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(paper.sort_key(F.col("study"), F.col("title")))), "o_orderkey").alias("key"))
    return plan.numbered(keyed, "key", "place").drop("key")


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND props LIKE '%k%'")
def template_matches(spark, sf_dir):
    """Headers that hold at least two of a template's words."""
    headers = F.array(F.concat(F.lit("My "), F.upper("event_type")), "props")
    return t(spark, sf_dir, "events").where(quality.template_matches(headers, ["click", '"k"', "view"], 2)).select("event_id")


@query("""WITH c AS (SELECT l_returnflag AS task, CAST(year(l_shipdate) AS INTEGER) AS year, p_brand AS value, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    g AS (SELECT task, value, CAST(unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS INTEGER) AS year FROM (SELECT DISTINCT task, value FROM c))
    SELECT task, year, value, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (task, year, value)""")
def trend_by_group(spark, sf_dir):
    """Distinct orders by return flag, year and brand."""
    return tables.trend(_uses(spark, sf_dir), "paper", "year", ["task"])


@query("""WITH n AS (SELECT p_brand AS value, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A') AS a, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT value, a AS "A", r AS "R", a + r AS total, row_number() OVER (ORDER BY a + r DESC, value) AS place FROM n""")
def pivot_by_total(spark, sf_dir):
    """Brands by the total of their orders, with their places in that order."""
    table = tables.task_value_pivot(_uses(spark, sf_dir), "task", "paper", ["A", "R"], by_total=True)
    ordered = table.withColumn("key", F.struct((-F.col("total")).alias("total"), "value"))
    return plan.numbered(ordered, "key", "place").select("value", "A", "R", "total", "place")
