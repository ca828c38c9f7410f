"""Registered queries over the given tables, each with the DuckDB SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.functions import vocab as V
from evidencelake.operators import decode, linkage, quality, summary, tables
from evidencelake.sources import bundles

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

COLOURS = {"dark": ["black", "navy"], "warm": ["red", "^orange$"], "cold": ["blue", r"\bgreen\b"], "size": ["small", "large", "tiny"], "round": ["ring", "widget"]}
OWNERS = {"o_totalprice": "library", "o_orderstatus": "pages", "o_orderpriority": "system"}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For each label of COLOURS what its patterns match in a token's key, and in the token.
HITS = {"dark": ("black|navy", "black|navy"), "warm": ("red|orange", "red|^orange$"), "cold": ("blue|bgreen b", r"blue|\bgreen\b"), "size": ("small|large|tiny", "small|large|tiny"), "round": ("ring|widget", "ring|widget")}


def _tokens_sql() -> str:
    """Token rows of part names with the demo vocabulary, as SQL; every fourth name repeats its first word in capitals."""
    labels = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(tok), '\b({k})\b') OR regexp_matches(tok, '(?i){r}') THEN '{n}' END" for n, (k, r) in HITS.items()) + "], lambda x: x IS NOT NULL)"
    return f"""w AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN list_append(string_split(p_name, ' '), upper(string_split(p_name, ' ')[1])) ELSE string_split(p_name, ' ') END AS w FROM part),
        tok AS (SELECT p_partkey, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM w),
        lab AS (SELECT p_partkey, tok, pos, {labels} AS labels FROM tok),
        wide AS (SELECT p_partkey, pos, tok AS raw_token, unnest(CASE WHEN len(labels) > 0 THEN labels ELSE [tok] END) AS value, len(labels) > 0 AS matched FROM lab),
        long AS (SELECT p_partkey, arg_min(raw_token, pos) AS raw_token, value, arg_min(matched, pos) AS matched FROM wide GROUP BY p_partkey, lower(raw_token), value)"""


def _cell():
    """Part names as cells of four kinds: a written list, a list without quotation marks, a list with a repeated word, lines."""
    words = F.split("p_name", " ")
    joined = lambda by: F.array_join(words, by)
    kind = F.col("p_partkey") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("['"), joined("', '"), F.lit("']"))).when(kind == 1, F.concat(F.lit("["), joined(" | "), F.lit("]")))
        .when(kind == 2, F.concat(joined(" ; "), F.lit(";'"), F.upper(F.get(words, F.lit(0))), F.lit("'; n/a"))).otherwise(joined("\n"))
    )


def _long(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return tables.long_values(part, _cell(), COLOURS, ["p_partkey"])


def _facts(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.year("o_orderdate").alias("year"))
    return lines.join(orders, "l_orderkey").join(_long(spark, sf_dir), "p_partkey")


FACTS_SQL = "WITH " + _tokens_sql() + ", facts AS (SELECT DISTINCT l_orderkey, o_orderpriority, year(o_orderdate) AS year, value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN long ON l_partkey = p_partkey)"


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def value_counts_by_year(spark, sf_dir):
    return tables.value_counts(t(spark, sf_dir, "orders"), F.year("o_orderdate"), "year").orderBy(F.desc("year"))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type <> '' GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def value_counts_top(spark, sf_dir):
    return tables.value_counts(t(spark, sf_dir, "part"), F.col("p_type"), "p_type", drop_blank=True, top=10)


@query("SELECT lang, count(*) AS n, count(quality) AS n_with, round(100.0::DOUBLE * count(quality) / count(*), 2) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage_rate(spark, sf_dir):
    return tables.coverage(t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left"), ["lang"], F.col("quality").isNotNull())


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def two_key_counts(spark, sf_dir):
    return tables.group_counts(t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("WITH " + _tokens_sql() + " SELECT p_partkey, raw_token, value, matched FROM long")
def multivalue_normalize(spark, sf_dir):
    return _long(spark, sf_dir)


@query("WITH " + _tokens_sql() + " SELECT p_brand, raw_token, value, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_papers FROM long JOIN part USING (p_partkey) WHERE NOT matched GROUP BY ALL")
def unmatched_audit(spark, sf_dir):
    return tables.unmatched_audit(_long(spark, sf_dir).join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey"), "p_brand", "p_partkey")


@query(FACTS_SQL + " SELECT value, " + ", ".join(f"""count(DISTINCT l_orderkey) FILTER (o_orderpriority = '{p}') AS "{p}" """ for p in PRIORITIES) + ", count(DISTINCT l_orderkey) AS total FROM facts GROUP BY value")
def task_value_pivot(spark, sf_dir):
    return tables.task_value_pivot(_facts(spark, sf_dir), "o_orderpriority", "l_orderkey", PRIORITIES)


@query(FACTS_SQL + """, n AS (SELECT year, value, count(DISTINCT l_orderkey) AS n FROM facts GROUP BY ALL),
    y AS (SELECT CAST(unnest(range((SELECT min(year) FROM n), (SELECT max(year) FROM n) + 1)) AS INTEGER) AS year), v AS (SELECT DISTINCT value FROM n)
    SELECT y.year, v.value, coalesce(n.n, 0) AS n FROM y CROSS JOIN v LEFT JOIN n ON n.year = y.year AND n.value = v.value""")
def multivalue_trend(spark, sf_dir):
    return tables.trend(_facts(spark, sf_dir), "l_orderkey", "year")


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(lower(replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))) AS key_sha256 FROM documents""")
def token_key(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.token_key(F.col("text")), 256).alias("key_sha256"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\s*\|\s*', ' | ', 'g'), '\s*;\s*', '; ', 'g') AS x FROM documents)
    SELECT doc_id, sha256(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS clean_sha256, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS n_chars FROM a""")
def clean_whitespace(spark, sf_dir):
    x = T.clean_whitespace(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(x, 256).alias("clean_sha256"), F.length(x).cast("long").alias("n_chars"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS title_md5 FROM documents")
def normalize_title(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("title_md5"))


@query(r"SELECT page_id, regexp_replace(lower(trim(url)), '^https?://(dx\.)?doi\.org/', '') AS doi, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM pages")
def doi_key(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", T.doi_key(F.col("url")).alias("doi"), T.slugify(F.col("url")).alias("slug"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '5-LOW' THEN 'last' ELSE replace(o_orderpriority, 'NOT SPECIFIED', 'OPEN') END AS priority FROM orders""")
def regex_fixes_value_map(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", T.normalize_cell(F.col("o_orderpriority"), {"not (spec)ified": "OPEN"}, {"1 urgent": "first", "5 low": "last"}).alias("priority"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), d AS (SELECT p_partkey, len(w) AS n, w[1] AS first, list_sort(list_distinct(w)) AS w FROM w)
    SELECT p_partkey, CASE WHEN n = 1 THEN first WHEN p_partkey % 3 = 0 THEN '"' || array_to_string(w, '" OR "') || '"' ELSE '"' || array_to_string(w, '" AND "') || '"' END AS search FROM d""")
def search_string_canonical(spark, sf_dir):
    words = F.split("p_name", " ")
    mixed = F.concat(F.lit("“"), F.array_join(words, "” and “"), F.lit("”"))
    either = F.concat(F.lit('"'), F.array_join(words, '" OR "'), F.lit('"'))
    name = F.when(F.col("p_partkey") % 3 == 0, either).when(F.size(words) == 1, F.concat(F.lit('""'), F.col("p_name"), F.lit('""'))).otherwise(mixed)
    return t(spark, sf_dir, "part").select("p_partkey", T.search_string(name).alias("search"))


CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\s*\|\s*', ' | ', 'g'), '\s*;\s*', '; ', 'g'), '^\s+|\s+$', '', 'g')"


def shorten_sql(x: str, most: int) -> str:
    """An SQL expression for a text cut at its last space before a limit."""
    at = f"length({x}[:{most + 1}]) - strpos(reverse({x}[:{most + 1}]), ' ')"
    end = f"CASE WHEN strpos({x}[:{most + 1}], ' ') > 0 AND {at} >= {max(60, int(most * 0.55))} THEN {at} ELSE {most} END"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(substr({x}, 1, CAST({end} AS INTEGER)), '[ ;,.]+$', '') || '...' END"


@query(r"""WITH a AS (SELECT doc_id, replace(text, '. ', '... ') AS x FROM documents),
    b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(x, '...', '…'), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> ''), ' ') AS x FROM a),
    c AS (SELECT doc_id, x, list_filter(string_split(regexp_replace(x, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '' AND NOT (suffix(p, '…') AND NOT regexp_matches(p, '\d\s*,\s*\d\s*,?\s*…\s*,?\s*\d'))) AS p FROM b),
    d AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN """ + CLEAN_SQL.format(x="array_to_string(p, ' ')") + r""" ELSE trim(regexp_replace(""" + CLEAN_SQL.format(x="x") + r""", '…+$', '')) END AS x FROM c) SELECT doc_id, md5(x) AS text_md5 FROM d""")
def ellipsis_cleanup(spark, sf_dir):
    """Over texts all of whose inner sentence ends are made ellipses."""
    text = F.replace("text", F.lit(". "), F.lit("... "))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_fragments(text)).alias("text_md5"))


@query("WITH a AS (SELECT doc_id, " + CLEAN_SQL.format(x="text") + " AS x FROM documents) SELECT doc_id, " + shorten_sql("x", 120) + " AS short FROM a")
def shorten_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text"), 120).alias("short"))


@query("""SELECT event_id, ['Kind ' || event_type || '=' || CAST(user_id AS VARCHAR) || ' (' || event_type || ')', CASE WHEN event_id % 2 = 0 THEN 'F1' ELSE 'auc' END || '=0.5%'] AS snippets FROM events""")
def metric_snippets(spark, sf_dir):
    name = F.when(F.col("event_id") % 2 == 0, "F1-Score").otherwise("auc")
    cell = F.concat(F.lit("{Kind "), "event_type", F.lit(" = "), F.col("user_id").cast("string"), F.lit(" - "), "event_type", F.lit(", "), name, F.lit(":0.5%}"))
    return t(spark, sf_dir, "events").select("event_id", T.metric_snippets(cell, {"f1 score": "F1"}).alias("snippets"))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM conversations""")
def heading_carry_forward(spark, sf_dir):
    turns = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text"), F.when(F.col("role") == "user", "heading_1").otherwise("paragraph").alias("type"))
    return decode.carry_heading(turns, "conv_id", "turn").select("conv_id", "turn", "role", "heading")


@query("""SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY n_chars DESC, doc_id) = 1""")
def dedupe_best(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    return tables.keep_best(docs, F.col("key"), F.col("n_chars"), F.col("doc_id")).select("doc_id", "n_chars")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) HAVING count(*) > 0
    UNION ALL SELECT 'only_left', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) HAVING count(*) > 0
    UNION ALL SELECT 'only_right', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders) HAVING count(*) > 0""")
def key_set_status(spark, sf_dir):
    """Customers with orders against customers in credit."""
    a = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return summary.key_sets(a, t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


def _keys(spark, sf_dir):
    """Two snapshots of customers, each customer in one at least: odd keys lose their name on the left, every third key on the right."""
    c = t(spark, sf_dir, "customer")
    left = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.round("c_acctbal", 0).cast("long").alias("balance"), "c_nationkey")
    right = c.where("c_custkey % 5 <> 0 or c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.round("c_acctbal", 0).cast("long").alias("balance"), "c_nationkey")
    keys = lambda df: linkage.match_keys(df, name=T.casefold(F.col("name")), balance=F.concat_ws("|", "balance", "c_nationkey"))
    return left, right, keys(left), keys(right)


KEYS_SQL = """WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) END AS name, CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS VARCHAR) || '|' || CAST(c_nationkey AS VARCHAR) AS bal FROM customer WHERE c_custkey % 7 <> 0),
    r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN lower(c_name) END AS name, CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS VARCHAR) || '|' || CAST(c_nationkey AS VARCHAR) AS bal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 = 0),
    p AS (SELECT l.id AS left_id, r.id AS right_id, CASE WHEN l.name = r.name THEN 'name' ELSE 'balance' END AS key_type FROM l JOIN r ON l.name = r.name OR l.bal = r.bal),
    one AS (SELECT * FROM p WHERE left_id IN (SELECT left_id FROM p GROUP BY 1 HAVING count(*) = 1) AND right_id IN (SELECT right_id FROM p GROUP BY 1 HAVING count(*) = 1))"""


@query(KEYS_SQL + " SELECT * FROM p")
def match_candidates(spark, sf_dir):
    _, _, a, b = _keys(spark, sf_dir)
    return linkage.candidates(a, b)


@query(KEYS_SQL + " SELECT * FROM one")
def match_one_to_one(spark, sf_dir):
    _, _, a, b = _keys(spark, sf_dir)
    return linkage.one_to_one(linkage.candidates(a, b)).select("left_id", "right_id", "key_type")


@query(KEYS_SQL + " SELECT left_id, count(*) AS n_candidates FROM p WHERE left_id NOT IN (SELECT left_id FROM one) GROUP BY 1")
def match_ambiguous(spark, sf_dir):
    _, _, a, b = _keys(spark, sf_dir)
    return linkage.ambiguous(linkage.candidates(a, b))


@query(KEYS_SQL + " SELECT id AS left_id FROM l WHERE id NOT IN (SELECT left_id FROM p)")
def only_left(spark, sf_dir):
    left, _, a, b = _keys(spark, sf_dir)
    return linkage.unmatched(left, linkage.candidates(a, b), "left_id")


@query(KEYS_SQL + " SELECT id AS right_id FROM r WHERE id NOT IN (SELECT right_id FROM p)")
def only_right(spark, sf_dir):
    _, right, a, b = _keys(spark, sf_dir)
    return linkage.unmatched(right, linkage.candidates(a, b), "right_id")


def _snapshots(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    new = o.where("o_orderkey % 11 <> 0 or o_orderkey % 19 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    return o.where("o_orderkey % 19 <> 0"), new, ["o_orderstatus", "o_orderpriority", "o_totalprice"]


DIFF_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders),
    a AS (SELECT k, unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']) AS field, unnest([s, p, CAST(t AS VARCHAR)]) AS v FROM o WHERE k % 19 <> 0),
    b AS (SELECT k, unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']) AS field, unnest([CASE WHEN k % 13 = 0 THEN 'X' ELSE s END, p, CAST(CASE WHEN k % 17 = 0 THEN CAST(t + 1 AS DECIMAL(18,2)) ELSE t END AS VARCHAR)]) AS v FROM o WHERE k % 11 <> 0 OR k % 19 = 0),
    d AS (SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS entity_id, coalesce(a.field, b.field) AS field, a.v AS old_value, b.v AS new_value, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change_type
        FROM a FULL OUTER JOIN b ON a.k = b.k AND a.field = b.field)"""


def _diff(spark, sf_dir):
    old, new, fields = _snapshots(spark, sf_dir)
    return linkage.field_diff(old, new, "o_orderkey", fields)


@query(DIFF_SQL + " SELECT * FROM d WHERE change_type IS NOT NULL")
def entity_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(DIFF_SQL + " SELECT change_type, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM d WHERE change_type IS NOT NULL GROUP BY 1")
def diff_summary(spark, sf_dir):
    return linkage.diff_summary(_diff(spark, sf_dir))


OWNER_SQL = "CASE field WHEN 'o_totalprice' THEN 'library' WHEN 'o_orderstatus' THEN 'pages' ELSE 'system' END"


@query(DIFF_SQL + f" SELECT entity_id, field, old_value, new_value, change_type, {OWNER_SQL} AS owner FROM d WHERE change_type IS NOT NULL AND {OWNER_SQL} <> 'library'")
def ownership_filter(spark, sf_dir):
    return linkage.violations(_diff(spark, sf_dir), OWNERS, "library")


@query(DIFF_SQL + f" SELECT {OWNER_SQL} AS owner, CASE {OWNER_SQL} WHEN 'library' THEN 'push' WHEN 'system' THEN 'skip' ELSE 'preserve' END AS action, count(*) AS n FROM d WHERE change_type IS NOT NULL GROUP BY ALL")
def conflict_routing(spark, sf_dir):
    return linkage.routed(_diff(spark, sf_dir), OWNERS, "library").groupBy("owner", "action").agg(F.count(F.lit(1)).alias("n"))


SHORT_ID_SQL = "'{prefix}_' || substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({key})), 1, 8)"


@query(DIFF_SQL + " SELECT 'update_field' AS operation, " + SHORT_ID_SQL.format(prefix="op", key="entity_id || '|' || field") + " AS operation_id, 'pages' AS target, 'library' AS source, entity_id, field, old_value, new_value FROM d WHERE change_type = 'changed' AND field = 'o_totalprice'")
def plan_operations(spark, sf_dir):
    return linkage.operations(_diff(spark, sf_dir), OWNERS, "library", "pages")


@query(DIFF_SQL + " SELECT entity_id FROM d WHERE change_type IS NOT NULL GROUP BY 1 HAVING bool_and(change_type = 'removed')")
def quarantine_candidates(spark, sf_dir):
    return linkage.quarantined(_diff(spark, sf_dir))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)) AS content_hash FROM part")
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", T.content_hash(*(F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))).alias("content_hash"))


@query("SELECT event_id, " + SHORT_ID_SQL.format(prefix="ev", key="CAST(event_id AS VARCHAR) || '|' || event_type") + " AS short_id FROM events")
def short_id(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", T.short_id("ev", F.col("event_id"), F.col("event_type")).alias("short_id"))


@query("""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || ', ' || c_mktsegment ELSE c_name || ' et al.' END AS names, CASE WHEN o_orderkey % 5 > 0 THEN ' (' || CAST(year(o_orderdate) AS VARCHAR) || ')' ELSE '' END AS y, * EXCLUDE (o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, names || y || ' ' || o_orderpriority || '. ' || c_mktsegment AS citation, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE o_orderpriority END || y AS study FROM a""")
def citation_label(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    names = F.when(key % 3 == 0, F.array("c_name")).when(key % 3 == 1, F.array("c_name", "c_mktsegment")).otherwise(F.array("c_name", "c_mktsegment", "c_name", "c_mktsegment"))
    year = F.when(key % 5 > 0, F.year("o_orderdate"))
    authors = F.when(key % 2 == 0, F.concat("c_name", F.lit(", J.; Other, A.")))
    return rows.select("o_orderkey", T.citation(names, year, F.col("o_orderpriority"), F.col("c_mktsegment")).alias("citation"), T.paper_study(authors, year.cast("string"), F.col("o_orderpriority")).alias("study"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'schema-A' ELSE c_name END AS task_label, c_name IS NOT NULL AS known FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def three_way_lookup(spark, sf_dir):
    """Lines as extractions, their orders as links, customers in credit as tasks; lines returned aren't linked."""
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = t(spark, sf_dir, "lineitem").select(F.lit("f").alias("file_name"), F.when(F.col("l_returnflag") != "A", F.col("l_orderkey").cast("string")).alias("reference_task_id"), F.concat(F.lit("schema-"), "l_returnflag").alias("schema_name"), F.lit(None).cast("string").alias("template_id"), F.lit(0).alias("pos"), F.array(F.create_map(F.lit("order"), F.col("l_orderkey").cast("string"))).alias("extracted"), line.alias("line"))
    links = t(spark, sf_dir, "orders").select(F.lit("f").alias("file_name"), F.col("o_orderkey").cast("string").alias("id"), F.lit("r").alias("reference_id"), F.col("o_custkey").cast("string").alias("task_id"))
    tasks = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit("f").alias("file_name"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    titles = t(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("f").alias("file_name"), F.lit(0).alias("pos"), F.lit("r").alias("id"), F.lit("T").alias("title"))
    found = decode.task_rows(lines, links, tasks, titles, ["line"])
    # a returned line has a customer too, which the link would have given
    named = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    return found.select("line.*", "task_label").join(named, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "task_label", F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS object_id, unnest(list_filter([CASE WHEN length(text) < 100 THEN 'short_text' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'other_language' END, CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 'wrong_length' END], lambda x: x IS NOT NULL)) AS check_name FROM documents""")
def qa_findings(spark, sf_dir):
    checks = {"short_text": F.length("text") < 100, "other_language": ~F.col("lang").isin("en", "de"), "wrong_length": ~F.col("n_chars").eqNullSafe(F.length("text"))}
    return quality.findings(t(spark, sf_dir, "documents"), F.col("doc_id"), checks)


@query("""SELECT event_id, CASE WHEN props LIKE '%"k"%' THEN '' ELSE 'k' END AS missing FROM events""")
def required_columns(spark, sf_dir):
    row = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return t(spark, sf_dir, "events").select("event_id", F.array_join(quality.missing_columns(row, {"k": []}), ",").alias("missing"))


@query("SELECT source, count(*) AS n, count(*) FILTER (lang <> '' AND source <> '' AND text <> '') AS n_with, round(100.0::DOUBLE * count(*) FILTER (lang <> '' AND source <> '' AND text <> '') / count(*), 2) AS pct FROM documents GROUP BY 1")
def provenance_complete(spark, sf_dir):
    provenance = F.create_map(F.lit("source_id"), "source", F.lit("domain_pack_id"), "lang", F.lit("domain_pack_version"), "text")
    return tables.coverage(t(spark, sf_dir, "documents"), ["source"], F.size(quality.provenance_gaps(provenance)) == 0)


@query("""SELECT 'missing' AS check_name, CAST(doc_id AS VARCHAR) AS object_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'lost_lang', CAST(doc_id AS VARCHAR) FROM documents SEMI JOIN labels USING (doc_id) WHERE doc_id % 3 = 0 AND lang <> '' UNION ALL SELECT 'lost_source', CAST(doc_id AS VARCHAR) FROM documents SEMI JOIN labels USING (doc_id) WHERE lang = 'de' AND source <> ''""")
def migration_losses(spark, sf_dir):
    """Labelled documents kept, of which every third loses its language and German ones their source."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    kept = docs.join(t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.when(F.col("lang") != "de", F.col("source")).alias("source"))
    return quality.losses(docs, kept, "doc_id", ["lang", "source"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'WROTE' WHEN p_partkey % 3 = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS status FROM part""")
def incremental_upsert(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = part.where("p_partkey % 5 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" old"))).otherwise(F.col("p_name")))
    return bundles.upsert_status(part, old, "p_partkey").select("p_partkey", "status")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (p_name LIKE '%small%') + count(*) FILTER (p_type = 'ECONOMY' OR p_type ILIKE '%small%') + count(*) FILTER (p_brand > p_type) AS changed_cells, count(*) FILTER (p_brand > p_type) AS changed_search_cells FROM part""")
def clean_table_log(spark, sf_dir):
    """A search column in canonical form already where its terms are in order."""
    terms = F.concat(F.lit('"'), "p_brand", F.lit('" AND "'), "p_type", F.lit('"')).alias("search")
    return tables.cleaning_log(t(spark, sf_dir, "part").select("p_name", "p_type", terms), {"small": "little"}, {"economy": "cheap"}, ("search",))


@query("""SELECT user_id, event_type, arg_max(value, event_id) FILTER (ts = top) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS top FROM events
    WHERE ts <= (SELECT make_timestamp((epoch_us(min(ts)) + 3 * epoch_us(max(ts))) // 4) FROM events)) GROUP BY ALL""")
def state_as_of(spark, sf_dir):
    """Of all events, the state when three quarters of their time had passed."""
    return _state_at(spark, sf_dir, 3)


@query("""SELECT user_id, event_type, arg_max(value, event_id) FILTER (ts = top) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS top FROM events
    WHERE ts <= (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events)) GROUP BY ALL""")
def state_as_of_middle(spark, sf_dir):
    """Of all events, the state at the middle of their time."""
    return _state_at(spark, sf_dir, 2)


def _state_at(spark, sf_dir, quarters):
    log = t(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    micros = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    moment = log.agg(((4 - quarters) * micros(F.min) + quarters * micros(F.max)).alias("four")).select(F.expr("cast(timestamp_micros(four div 4) as timestamp_ntz)").alias("moment"))
    return linkage.state_as_of(log.crossJoin(F.broadcast(moment)), "user_id", "event_type", "ts", "value", F.col("moment"))  # one row


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) FILTER (ts = top) AS actor, max(ts) AS ts FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS top FROM events) GROUP BY ALL""")
def last_writer(spark, sf_dir):
    return linkage.last_writer(t(spark, sf_dir, "events").withColumn("seq", F.col("event_id")), "user_id", "event_type", "event_id")


@query("""WITH log AS (SELECT user_id || '-' || CAST(value > 50 AS VARCHAR) AS op, event_type, ts FROM events)
    SELECT DISTINCT op AS operation_id FROM log l WHERE event_type = 'view' AND ts < (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events) AND NOT EXISTS (SELECT 1 FROM log p WHERE p.op = l.op AND p.event_type = 'purchase')""")
def unapplied(spark, sf_dir):
    """Views as plans, purchases as what was applied; plans of the first half of the time."""
    events = t(spark, sf_dir, "events")
    micros = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    moment = events.agg((micros(F.min) + micros(F.max)).alias("two")).select(F.expr("cast(timestamp_micros(two div 2) as timestamp_ntz)").alias("moment"))
    kind = F.when(F.col("event_type") == "view", "planned").when(F.col("event_type") == "purchase", "applied").otherwise("other")
    log = events.select(F.concat_ws("-", "user_id", (F.col("value") > 50).cast("string")).alias("operation_id"), kind.alias("status"), F.col("ts").alias("timestamp"))
    return summary.never_applied(log.crossJoin(F.broadcast(moment)), F.col("moment"))  # one row


@query("SELECT CAST(user_id % 10 AS VARCHAR) AS session_id, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def session_counts(spark, sf_dir):
    return summary.session_counts(t(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").alias("session_id"), F.col("event_type").alias("status")))


@query("SELECT conv_id, turn FROM conversations WHERE role IS NULL OR role = '' OR lower(role) LIKE '%accepted%' OR role = 'user'")
def accepted_filter(spark, sf_dir):
    return t(spark, sf_dir, "conversations").where(decode.accepted(F.when(F.col("role") != "user", F.col("role")))).select("conv_id", "turn")
