"""Findings: what is incomplete, unlinked, malformed or lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("source_id", "domain_pack_id", "domain_pack_version")


def findings(df: DataFrame, object_id: Column, checks: dict[str, Column]) -> DataFrame:
    """check_name and object_id for every check that an object fails, in one pass."""
    failed = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())), lambda x: x.isNotNull())
    return df.select(object_id.cast("string").alias("object_id"), F.explode(failed).alias("check_name"))


def provenance_gaps(provenance: Column) -> Column:
    """The required keys that a provenance map lacks or leaves empty."""
    lack = [F.when(F.coalesce(F.try_element_at(provenance, F.lit(k)), F.lit("")) == "", F.lit(k)) for k in PROVENANCE]
    return F.array_compact(F.array(*lack))


def missing_columns(row: Column, required: dict[str, list[str]]) -> Column:
    """Required columns of which neither the name nor an alias is among a row's keys; case counts."""
    have = F.map_keys(row)
    return F.array_compact(F.array(*(F.when(~F.arrays_overlap(have, F.array(*map(F.lit, [name, *aliases]))), F.lit(name)) for name, aliases in required.items())))


def template_matches(headers: Column, required: list[str], least: int) -> Column:
    """Whether enough required headers are within the joined headers."""
    joined = F.array_join(F.transform(headers, F.lower), " ")
    return sum((F.when(joined.contains(h.lower()), 1).otherwise(0) for h in required), F.lit(0)) >= least


def matching_columns(headers: DataFrame, names: DataFrame) -> DataFrame:
    """headers (header) joined to the columns (name, alias) whose name or alias they are, whatever the case."""
    known = names.select("name", F.lower("name").alias("key")).union(names.where("alias is not null").select("name", F.lower("alias"))).distinct()
    return headers.join(known, F.lower("header") == F.col("key")).drop("key")


def run_qa(references: DataFrame, workflow_states: DataFrame, extractions: DataFrame, known_states: list[str], templates: dict[str, dict[str, list[str]]]) -> DataFrame:
    """The five kinds of finding over flattened bundles: check_name, bundle_id, object_id, detail."""

    def row(df: DataFrame, name: str, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check_name"), "bundle_id", F.col("id").alias("object_id"), detail.alias("detail"))

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    parts = [
        row(references.where(blank("title") | (blank("doi") & blank("zotero_key"))), "incomplete_reference", F.col("title")),
        row(workflow_states.where(~F.coalesce("state", F.lit("")).isin(known_states)), "ambiguous_status", F.col("state")),
        row(extractions.where("reference_task_id is null"), "unlinked_extraction", F.col("template_id")),
        row(extractions.where(F.coalesce(F.size("extracted"), F.lit(0)) <= 0), "malformed_extraction", F.col("template_id")),
    ]
    for template, required in templates.items():
        lines = extractions.where(F.col("template_id") == template).select("bundle_id", "id", F.explode("extracted").alias("row"))
        lines = lines.withColumn("missing", missing_columns(F.col("row"), required)).where(F.size("missing") > 0)
        parts.append(row(lines, "missing_columns", F.array_join("missing", ", ")))
    return reduce(DataFrame.unionByName, parts)


def losses(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """check_name, object_id: pages without a counterpart, and fields that it leaves empty."""
    gone = before.join(after, key, "left_anti").select(F.lit("missing").alias("check_name"), F.col(key).cast("string").alias("object_id"))
    both = before.alias("a").join(after.alias("b"), key)
    lost = {f"lost_{f}": (F.coalesce(F.col(f"a.{f}").cast("string"), F.lit("")) != "") & (F.coalesce(F.col(f"b.{f}").cast("string"), F.lit("")) == "") for f in fields}
    return gone.unionByName(findings(both, F.col(key), lost))
