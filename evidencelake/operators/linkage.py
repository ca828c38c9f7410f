"""Matching records of two sources, comparing snapshots, ownership and update plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T


def match_keys(df: DataFrame, **keys: Column) -> DataFrame:
    """A row per non-empty key: id, priority, key_type, key_value."""
    entries = F.array(*(F.struct(F.lit(i).alias("priority"), F.lit(k).alias("key_type"), c.cast("string").alias("key_value")) for i, (k, c) in enumerate(keys.items())))
    return df.select("id", F.inline(entries)).where("coalesce(key_value, '') <> ''")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id and the first key type that they share."""
    a = left.withColumnRenamed("id", "left_id")
    b = right.select(F.col("id").alias("right_id"), "key_type", "key_value")
    return a.join(b, ["key_type", "key_value"]).groupBy("left_id", "right_id").agg(F.min_by("key_type", "priority").alias("key_type"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs both of whose ends have no other candidate."""
    left = pairs.groupBy("left_id").count().where("count = 1").select("left_id")
    right = pairs.groupBy("right_id").count().where("count = 1").select("right_id")
    return pairs.join(left, "left_id").join(right, "right_id")


def ambiguous(pairs: DataFrame) -> DataFrame:
    """left_id and n_candidates of records that aren't matched though they have candidates."""
    return pairs.groupBy("left_id").agg(F.count(F.lit(1)).alias("n_candidates")).join(one_to_one(pairs), "left_id", "left_anti")


def unmatched(ids: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return ids.select(F.col("id").alias(side)).join(pairs, side, "left_anti")


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """entity_id, field, old_value, new_value, change_type: added and removed entities give every field.

    Whole rows meet once; only then are the fields that differ taken apart.
    """
    side = lambda df, name: df.select(F.col(key).cast("string").alias("entity_id"), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(name))
    both = side(old, "o").join(side(new, "n"), "entity_id", "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value")) for f in fields))
    found = F.when(kind == "changed", F.filter(entries, lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))).otherwise(entries)
    return both.select("entity_id", kind.alias("change_type"), F.inline(found)).select("entity_id", "field", "old_value", "new_value", "change_type")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_entities"))


def with_owner(diff: DataFrame, owners: dict[str, str]) -> DataFrame:
    """diff with the owner of each field, 'unknown' where none is stated."""
    table = F.create_map(*(F.lit(x) for pair in owners.items() for x in pair))
    return diff.withColumn("owner", F.coalesce(F.try_element_at(table, F.col("field")), F.lit("unknown")))


def violations(diff: DataFrame, owners: dict[str, str], writer: str) -> DataFrame:
    return with_owner(diff, owners).where(~F.col("owner").isin(writer, "unknown"))


def operations(diff: DataFrame, owners: dict[str, str], source: str, target: str) -> DataFrame:
    """Executable updates of source-owned fields, one per changed field, with a stable id."""
    own = with_owner(diff, owners).where((F.col("owner") == source) & (F.col("change_type") == "changed"))
    return own.select(F.lit("update_field").alias("operation"), T.short_id("op", F.col("entity_id"), F.col("field")).alias("operation_id"), F.lit(target).alias("target"), F.lit(source).alias("source"), "entity_id", "field", "old_value", "new_value")


def quarantined(diff: DataFrame) -> DataFrame:
    """Entities all of whose fields are removed."""
    return diff.groupBy("entity_id").agg(F.bool_and(F.col("change_type") == "removed").alias("gone")).where("gone").select("entity_id")


def routed(diff: DataFrame, owners: dict[str, str], source: str) -> DataFrame:
    action = F.when(F.col("owner") == source, "push").when(F.col("owner") == "unknown", "flag").when(F.col("owner") == "system", "skip").otherwise("preserve")
    return with_owner(diff, owners).withColumn("action", action)


def payload(field: Column, value: Column, kinds: dict[str, str]) -> Column:
    """The typed property of a field as JSON text: rich text for a field of no stated kind; a kind that isn't known is an error."""
    table = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    kind = F.coalesce(F.try_element_at(table, field), F.lit("rich_text"))
    filled = F.coalesce(value, F.lit("")) != ""
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    none = F.array().cast("array<struct<text:struct<content:string>>>")
    rich = lambda name: json(F.struct(F.when(filled, F.array(F.struct(F.struct(value.alias("content")).alias("text")))).otherwise(none).alias(name)))
    named = lambda name, part="name": json(F.struct(F.when(filled, F.struct(value.alias(part))).alias(name)))
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    return (
        F.when(kind == "title", rich("title")).when(kind == "rich_text", rich("rich_text")).when(kind == "select", named("select")).when(kind == "status", named("status")).when(kind == "date", named("date", "start"))
        .when(kind == "multi_select", json(F.struct(F.when(blank, F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct(F.trim(value).alias("name")))).alias("multi_select"))))
        .when(kind == "number", json(F.struct(value.try_cast("double").alias("number")))).when(kind == "checkbox", json(F.struct(F.coalesce(value.try_cast("boolean"), filled).alias("checkbox"))))
        .when(kind == "url", json(F.struct(F.when(filled, value).alias("url")))).otherwise(F.raise_error(F.concat(F.lit("no such kind of property: "), kind)).cast("string"))
    )


def state_as_of(log: DataFrame, entity: str, field: str, at: str, value: str, until: Column) -> DataFrame:
    """The latest value of each (entity, field) up to a moment."""
    return log.where(F.col(at) <= until).groupBy(entity, field).agg(F.max_by(value, F.struct(at, "seq")).alias("value"))


def last_writer(log: DataFrame, entity: str, field: str, actor: str) -> DataFrame:
    return log.groupBy(entity, field).agg(F.max_by(actor, F.struct("ts", "seq")).alias("actor"), F.max("ts").alias("ts"))
