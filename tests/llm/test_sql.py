"""Operators over documents against their SQL, on the fixture's nulls, empty texts, copies, odd white space and clashing names."""

import duckdb
import pytest

from evidencelake.llm import backoff, nearjoin, registry, rules, suffixdup

OPERATORS = {
    "op4_word_lm_scoring": backoff.score_words,
    "op5_quality_rules": lambda docs: rules.judge(rules.ledger(docs)).withColumnRenamed("failed", "failed_bits"),
    "rule_ablation": lambda docs: rules.ablation(rules.ledger(docs)),
    "op7_ngram_jaccard_join": nearjoin.near_groups,
    "op8_suffix_dedup": suffixdup.remove_repeats,
}


def by_sql(docs, name):
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    found = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    return names, sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_equals_sql(docs, name):
    names, want = by_sql(docs, name)
    assert sorted(repr(tuple(r)) for r in OPERATORS[name](docs).select(names).collect()) == want


@pytest.mark.parametrize("name", ["op4_word_lm_scoring", "op5_quality_rules", "rule_ablation"])
def test_repeated_rows_equal_sql(docs, name):
    twice = docs.union(docs.where("doc_id % 3 = 0"))
    names, want = by_sql(twice, name)
    assert sorted(repr(tuple(r)) for r in OPERATORS[name](twice).select(names).collect()) == want


def test_empty_table_equals_sql(empty):
    for name in ("op5_quality_rules", "rule_ablation", "op8_suffix_dedup"):
        c = duckdb.connect()
        c.execute("create table documents (doc_id bigint, text varchar)")
        found = c.execute(registry.oracle_sql()[name])
        names = [x[0] for x in found.description]
        assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in OPERATORS[name](empty).select(names).collect())
