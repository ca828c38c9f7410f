"""Field-level differences between two collections of bundles, over whatever fields their documents hold.

Bundles are file_name and doc (a VARIANT). Each entity becomes one row with a map of its fields to JSON texts, so that
entities, not fields, are dealt out and joined, and no list of fields is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators.decode import ENTITIES

KEYS = ["file_name", "entity_type", "entity_id"]


def json_or_null(value: Column) -> Column:
    """A VARIANT as JSON text with keys in order; JSON's null is null, so that it equals an absent field."""
    return F.nullif(F.to_json(value), F.lit("null"))


def entities(bundles: DataFrame, kinds: tuple[str, ...] = tuple(ENTITIES)) -> DataFrame:
    """file_name, entity_type, entity_id and fields (name to JSON text, without id). Of entities with one id the last counts; items without an id or that are no objects are left out."""
    lists = F.array(*(F.struct(F.lit(k).alias("entity_type"), F.try_variant_get("doc", f"$.{k}", "array<variant>").alias("items")) for k in kinds))
    each = bundles.select("file_name", F.inline(lists)).select("file_name", "entity_type", F.posexplode("items").alias("pos", "item"))
    named = each.select("*", F.try_variant_get("item", "$.id", "string").alias("entity_id"), F.try_variant_get("item", "$", "map<string,variant>").alias("own")).where("entity_id is not null and own is not null")
    texts = named.select(*KEYS, "pos", F.map_filter(F.transform_values("own", lambda k, v: json_or_null(v)), lambda k, v: k != "id").alias("fields"))
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("pos")))
    return texts.withColumn("rank", last).where("rank = 1").drop("rank", "pos")


def bundle_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_name and bundle_id of each new file: its own, or if that is blank the old one's; a file without one is named by its stem."""
    own = lambda df: df.select("file_name", F.try_variant_get("doc", "$.bundle_id", "string").alias("bundle_id"), F.try_variant_get("doc", "$.bundle_id", "variant").isNotNull().alias("stated"))
    both = own(new).alias("n").join(own(old).alias("o"), "file_name", "left")
    named = F.when(F.col("n.stated"), T.blank_to_null(F.col("n.bundle_id"))).otherwise(F.regexp_replace("file_name", r"\.json$", ""))
    return both.select("file_name", F.coalesce(named, F.col("o.bundle_id"), F.lit("")).alias("bundle_id"))


def diff_bundles(old: DataFrame, new: DataFrame) -> DataFrame:
    """bundle_id, file_name, entity_type, entity_id, field, old_value, new_value (JSON texts) and change_type.

    Files pair by name: a new file is compared with nothing, an old file that has gone isn't looked at. Entities of one
    side alone give all their fields, null ones too; of entities on both sides the union of their fields is compared.
    """
    names = bundle_ids(old, new)
    before = entities(old.join(new.select("file_name"), "file_name", "left_semi")).withColumnRenamed("fields", "a")
    both = before.join(entities(new).withColumnRenamed("fields", "b"), KEYS, "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    entry = lambda f: F.struct(f.alias("field"), F.try_element_at(a, f).alias("old_value"), F.try_element_at(b, f).alias("new_value"))
    every = F.transform(F.array_union(F.map_keys(a), F.map_keys(b)), entry)
    found = F.when(kind == "changed", F.filter(every, lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))).otherwise(every)
    rows = both.select(*KEYS, kind.alias("change_type"), F.inline(found))
    return rows.join(names, "file_name").select("bundle_id", *KEYS, "field", "old_value", "new_value", "change_type")


def summary_lines(diff: DataFrame, names: DataFrame) -> DataFrame:
    """file_name and a line for each compared bundle: how many differences of which kind."""
    counts = diff.groupBy("file_name").agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "removed", "changed")))
    n = lambda k: F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}")))
    total = F.col("added") + F.col("removed") + F.col("changed")
    text = F.when(total > 0, F.concat(total.cast("string"), F.lit(" diff(s): "), F.concat_ws(", ", n("added"), n("removed"), n("changed")))).otherwise("No differences.")
    whole = names.join(counts, "file_name", "left").na.fill(0, ["added", "removed", "changed"])
    return whole.select("file_name", F.concat(F.lit("["), "bundle_id", F.lit("] "), text).alias("line"))
