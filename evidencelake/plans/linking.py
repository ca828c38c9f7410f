"""Registered queries that link, number and compare records, each with the DuckDB SQL that it must equal.

Customers are the source's records and parts the target's; their keys cross, so that many records have several candidates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import assignment, plan
from evidencelake.plans.catalog import query, t

OWNED = ["title", "year"]


def _source(spark, sf_dir):
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k).alias("id"), F.concat(F.lit("file-"), k).alias("bundle_id"), F.when(F.col("c_nationkey") < 15, F.concat(F.lit(" K"), F.expr("c_custkey div 2"))).alias("record_key"),
        F.when(F.col("c_nationkey") > 6, F.concat(F.lit("https://doi.org/10.1/"), k * 3)).alias("doi"), F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("Report  "), F.substring("c_mktsegment", 1, 1))).alias("title"),
        F.array(F.lit("A")).alias("authors"), F.col("c_nationkey").cast("int").alias("year"), F.lit(None).cast("string").alias("version"), F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")).alias("at"),
    )


def _target(spark, sf_dir):
    k = F.col("p_partkey")
    letter = F.expr("substring('abfhm', cast(substring(p_brand, 7) as int) % 5 + 1, 1)")
    return t(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("page-"), k).alias("bundle_id"), F.when(F.col("p_size") < 30, F.concat(F.lit("k"), F.expr("p_partkey div 3"))).alias("record_key"), F.concat(F.lit("10.1/"), k * 2 + 1).alias("doi"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("report "), letter)).alias("title"), F.array(F.lit("a")).alias("authors"), F.col("p_size").cast("int").alias("year"), F.lit(None).cast("string").alias("version"),
    )


SOURCE_SQL = """src AS (
        SELECT 'c' || c_custkey AS id, CASE WHEN c_nationkey < 15 THEN 'k' || (c_custkey // 2) END AS k0, CASE WHEN c_nationkey > 6 THEN '10.1/' || (c_custkey * 3) END AS k1,
            CASE WHEN c_nationkey % 5 = 0 THEN 'report ' || lower(left(c_mktsegment, 1)) || '|a' END AS k2,
            CASE WHEN c_nationkey % 5 = 0 THEN 'Report  ' || left(c_mktsegment, 1) END AS title, c_nationkey AS year,
            row_number() OVER (ORDER BY CASE WHEN c_nationkey <> 3 THEN c_acctbal END NULLS FIRST, 'c' || c_custkey) AS n FROM customer),
    tgt AS (
        SELECT 'p' || p_partkey AS id, CASE WHEN p_size < 30 THEN 'k' || (p_partkey // 3) END AS k0, '10.1/' || (p_partkey * 2 + 1) AS k1,
            CASE WHEN p_size % 4 = 0 THEN 'report ' || substr('abfhm', CAST(substr(p_brand, 7) AS INTEGER) % 5 + 1, 1) || '|a' END AS k2,
            CASE WHEN p_size % 4 = 0 THEN 'report ' || substr('abfhm', CAST(substr(p_brand, 7) AS INTEGER) % 5 + 1, 1) END AS title, p_size AS year FROM part),
    skey AS (SELECT id, n, unnest([0, 1, 2]) AS p, unnest(['record_key', 'doi', 'title_authors']) AS kind, unnest([k0, k1, k2]) AS v FROM src),
    tkey AS (SELECT id, unnest([0, 1, 2]) AS p, unnest([k0, k1, k2]) AS v FROM tgt)"""

#: The rule, one record after the other: walk has a row for each source record, with what is used up by then.
ASSIGN_SQL = f"""{SOURCE_SQL},
    pair AS (SELECT s.id AS sid, n, t.id AS tid, min(s.p) AS p FROM skey s JOIN tkey t ON s.p = t.p AND s.v = t.v GROUP BY ALL),
    cand AS (SELECT src.id AS sid, src.n, coalesce(list(tid ORDER BY tid) FILTER (tid IS NOT NULL), []) AS c FROM src LEFT JOIN pair ON pair.sid = src.id GROUP BY ALL),
    walk(n, used, took, free) AS (
        SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, 0::BIGINT
        UNION ALL
        SELECT n, CASE WHEN len(av) = 1 THEN list_append(used, av[1]) ELSE used END, CASE WHEN len(av) = 1 THEN av[1] END, len(av)
        FROM (SELECT o.n, w.used, list_filter(o.c, lambda x: NOT list_contains(w.used, x)) AS av FROM walk w JOIN cand o ON o.n = w.n + 1)),
    outcome AS (
        SELECT sid, n, c, took, CASE WHEN len(c) = 0 THEN 'no_candidate' WHEN free = 1 THEN 'matched' WHEN free = 0 THEN 'no_available_candidate' ELSE 'multiple_candidates' END AS status
        FROM walk JOIN cand USING (n))"""


def _assigned(spark, sf_dir):
    source = _source(spark, sf_dir)
    return assignment.assign(plan.match_keys(source), plan.match_keys(_target(spark, sf_dir)), source.select("id", "at"))


@query(f"""
    WITH RECURSIVE {ASSIGN_SQL}
    SELECT o.sid AS id, o.n - 1 AS place, status, took AS target_id, CASE WHEN took IS NOT NULL THEN kind || '=' || v END AS match_key, CAST(len(c) AS BIGINT) AS n_candidates
    FROM outcome o LEFT JOIN pair ON pair.sid = o.sid AND pair.tid = o.took LEFT JOIN skey ON skey.id = o.sid AND skey.p = pair.p""")
def assign_in_order(spark, sf_dir):
    """What each source record takes, in order, or why it takes nothing."""
    return _assigned(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("at").alias("place"), "status", "target_id", F.col("key").alias("match_key"), "n_candidates")


@query(f"""
    WITH RECURSIVE {ASSIGN_SQL},
    m AS (SELECT *, row_number() OVER (ORDER BY n) AS i FROM outcome WHERE status = 'matched'),
    both_ AS (SELECT 'match-' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS match_id, s.id AS sid, t.id AS tid, s.title AS st, t.title AS tt, s.year AS sy, t.year AS ty FROM m JOIN src s ON s.id = m.sid JOIN tgt t ON t.id = m.took)
    SELECT match_id || '-title' AS operation_id, tid AS target_reference_id, sid AS source_reference_id, 'title' AS field, tt AS old_value, st AS new_value FROM both_ WHERE tt IS DISTINCT FROM st
    UNION ALL SELECT match_id || '-year', tid, sid, 'year', CAST(ty AS VARCHAR), CAST(sy AS VARCHAR) FROM both_ WHERE ty IS DISTINCT FROM sy""")
def plan_in_order_updates(spark, sf_dir):
    """Field updates of the matches that records make one after the other."""
    parts = plan.sync_plan_in_order(_target(spark, sf_dir), _source(spark, sf_dir), OWNED, "at")
    return parts["operations"].select("operation_id", "target_reference_id", "source_reference_id", "field", "old_value", "new_value")


@query(f"""
    WITH RECURSIVE {ASSIGN_SQL},
    touched AS (SELECT unnest(c) AS id FROM outcome WHERE status IN ('multiple_candidates', 'no_available_candidate')),
    n AS (SELECT count(*) FILTER (status = 'matched') AS matches, count(*) FILTER (status = 'no_candidate') AS lonely, count(*) FILTER (status IN ('multiple_candidates', 'no_available_candidate')) AS ambiguous FROM outcome),
    changes AS (SELECT sum((t.title IS DISTINCT FROM s.title)::INT + (t.year IS DISTINCT FROM s.year)::INT) AS c FROM outcome m JOIN src s ON s.id = m.sid JOIN tgt t ON t.id = m.took)
    SELECT unnest(['target_records', 'source_records', 'matches', 'operations', 'only_source', 'only_target', 'ambiguous', 'review_actions']) AS counter,
        unnest([(SELECT count(*) FROM tgt), (SELECT count(*) FROM src), matches, (SELECT CAST(c AS BIGINT) FROM changes), lonely,
            (SELECT count(*) FROM tgt WHERE id NOT IN (SELECT id FROM touched) AND id NOT IN (SELECT took FROM outcome WHERE took IS NOT NULL)), ambiguous, lonely]) AS n FROM n""")
def plan_in_order_summary(spark, sf_dir):
    """The counters of that plan."""
    return plan.sync_plan_in_order(_target(spark, sf_dir), _source(spark, sf_dir), OWNED, "at")["summary"]


@query(f"""
    WITH {SOURCE_SQL},
    a AS (SELECT p, v, count(*) AS n FROM skey WHERE v IS NOT NULL GROUP BY ALL), b AS (SELECT p, v, count(*) AS n FROM tkey WHERE v IS NOT NULL GROUP BY ALL)
    SELECT s.id AS source_id, t.id AS target_id, kind || '=' || s.v AS match_key FROM skey s JOIN tkey t ON s.p = t.p AND s.v = t.v JOIN a ON a.p = s.p AND a.v = s.v JOIN b ON b.p = s.p AND b.v = s.v WHERE a.n = 1 OR b.n = 1""")
def candidates_listed(spark, sf_dir):
    """Pairs under the keys that one record alone has on either side."""
    keys = lambda df, name: assignment.key_lists(plan.match_keys(df), name)
    return assignment.listed_candidates(keys(_source(spark, sf_dir), "source_id"), keys(_target(spark, sf_dir), "target_id")).withColumnRenamed("key", "match_key")


@query(f"""
    WITH {SOURCE_SQL}
    SELECT s.id AS source_id, count(DISTINCT t.id) AS n_candidates FROM skey s JOIN tkey t ON s.p = t.p AND s.v = t.v GROUP BY s.id""")
def candidates_counted(spark, sf_dir):
    """How many candidates each record has under all its keys, without listing them."""
    keys = lambda df, name: assignment.key_lists(plan.match_keys(df), name)
    return assignment.candidate_counts(keys(_source(spark, sf_dir), "source_id"), keys(_target(spark, sf_dir), "target_id"))


@query("""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 7 = 0 THEN 4611686018427387904 + o_orderkey ELSE o_orderkey * o_orderkey END AS ordinal FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(ordinal AS VARCHAR) AS ordinal, row_number() OVER (ORDER BY o.ordinal, o.o_orderkey) AS number FROM o WHERE ordinal IS NOT NULL
    UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM o WHERE ordinal IS NOT NULL) + row_number() OVER (ORDER BY o_orderkey) FROM o WHERE ordinal IS NULL""")
def numbered_records(spark, sf_dir):
    """Consecutive numbers by ordinals that are uneven, huge or missing; rows without one stand last, in any order."""
    ordinal = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderkey") % 7 == 0, F.lit(1 << 62) + F.col("o_orderkey")).otherwise(F.col("o_orderkey") * F.col("o_orderkey"))
    rows = plan.numbered(t(spark, sf_dir, "orders").select("o_orderkey", ordinal.alias("ordinal")), "ordinal", "number")
    return rows.select(F.when(F.col("ordinal").isNotNull(), F.col("o_orderkey").cast("string")).alias("o_orderkey"), F.col("ordinal").cast("string").alias("ordinal"), "number")
