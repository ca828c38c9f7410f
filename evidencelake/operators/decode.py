"""From raw pages, items and bundles to entity tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T

ENTITIES = {
    "references": "id string, title string, authors array<string>, year int, journal string, doi string, url string, zotero_key string, abstract string, item_type string, tags array<string>, search_terms string, search_date string, database string, journal_quartile string, provenance map<string,string>, validation_status string, sync_metadata variant",
    "tasks": "id string, name string, aliases array<string>, template_id string, family string, domain_pack string, provenance map<string,string>, validation_status string",
    "reference_tasks": "id string, reference_id string, task_id string, assignment_source string, inclusion_decision_for_task string, relevance_notes string, template_id string, provenance map<string,string>, validation_status string",
    "task_extractions": "id string, reference_task_id string, template_id string, schema_name string, raw_headers array<string>, extracted array<map<string,string>>, revision_status string, provenance map<string,string>, validation_status string",
    "workflow_states": "id string, reference_id string, state string, source_field string, provenance map<string,string>, validation_status string",
    "annotations": "id string, reference_id string, kind string, text string, provenance map<string,string>, validation_status string",
}


def flatten(bundles: DataFrame, entity: str) -> DataFrame:
    """A row per object of one entity list: file_name, bundle_id, pos and the entity's fields."""
    objects = bundles.select("file_name", "bundle_id", F.posexplode(F.try_variant_get("doc", f"$.{entity}", "array<variant>")).alias("pos", "item"))
    fields = [x.strip() for x in re.split(r",\s*(?=\w+ )", ENTITIES[entity])]
    return objects.select("file_name", "bundle_id", "pos", *(F.try_variant_get("item", f"$.{name}", kind).alias(name) for name, kind in (f.split(" ", 1) for f in fields)))


def property_value(kind: Column, value: Column) -> Column:
    """A typed page property as a list of strings; scalars as one item."""
    get = lambda path, t="string": F.try_variant_get(value, path, t)
    plain = lambda path: F.array_join(F.transform(get(path, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.plain_text", "string"), F.try_variant_get(x, "$.text.content", "string"))), "")
    names = lambda path: F.transform(get(path, "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string"))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    return (
        F.when(kind == "title", one(plain("$.title")))
        .when(kind == "rich_text", one(plain("$.rich_text")))
        .when(kind == "multi_select", names("$.multi_select"))
        .when(kind == "people", names("$.people"))
        .when(kind == "select", one(get("$.select.name")))
        .when(kind == "status", one(get("$.status.name")))
        .when(kind == "date", one(get("$.date.start")))
        .when(kind == "url", one(get("$.url")))
        .when(kind == "number", one(get("$.number")))
        .when(kind == "checkbox", one(get("$.checkbox")))
        .when(get("$.rich_text", "variant").isNotNull(), one(plain("$.rich_text")))
        .when(get("$.title", "variant").isNotNull(), one(plain("$.title")))
    )


def item_reference(items: DataFrame) -> DataFrame:
    """Bibliographic items (key, version, data) as reference rows."""
    d = lambda name: F.col(f"data.{name}")
    name = lambda c: F.coalesce(T.blank_to_null(F.concat_ws(", ", T.blank_to_null(c["lastName"]), T.blank_to_null(c["firstName"]))), c["name"])
    return items.select(
        F.col("key").alias("id"), d("title").alias("title"), F.filter(F.transform(d("creators"), name), lambda x: x.isNotNull()).alias("authors"), F.substring(d("date"), 1, 4).try_cast("int").alias("year"),
        F.coalesce(T.blank_to_null(d("publicationTitle")), T.blank_to_null(d("journalAbbreviation"))).alias("journal"), T.blank_to_null(d("DOI")).alias("doi"), T.blank_to_null(d("url")).alias("url"),
        F.col("key").alias("zotero_key"), d("abstractNote").alias("abstract"), d("itemType").alias("item_type"), F.transform(d("tags"), lambda t: t["tag"]).alias("tags"), F.col("version").alias("version"),
    )


def table_records(rows: Column) -> Column:
    """Rows of a page table as maps by its first row: short rows are padded, long ones cut, later headers win."""
    header = F.get(rows, F.lit(0))
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    padded = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header))
    entries = lambda r: F.arrays_zip(header.alias("k"), padded(r).alias("v"))
    last = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]))
    return F.transform(body, lambda r: F.map_from_entries(last(entries(r))))


def task_of(heading: Column, tasks: list[tuple[str, list[str]]]) -> Column:
    """The first task, in order, one of whose aliases is within the heading."""
    low = F.lower(heading)
    hits = []
    for task, aliases in tasks:
        test = F.lit(False)
        for alias in aliases:
            test |= low.contains(alias.lower())
        hits.append(F.when(test, F.lit(task)))
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def carry_heading(blocks: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Each block with the latest heading before it on its page."""
    own = F.when(F.col("type").startswith("heading"), F.col("text"))
    order = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("heading", F.last(own, ignorenulls=True).over(order))


def near_heading(blocks: DataFrame, page: str = "page_id", pos: str = "pos", reach: int = 5) -> DataFrame:
    """Each block with the earliest heading among the few blocks before it: the page export's rule."""
    own = F.when(F.col("type").startswith("heading"), F.col("text"))
    return blocks.withColumn("heading", F.first(own, ignorenulls=True).over(Window.partitionBy(page).orderBy(pos).rowsBetween(-reach, -1)))


def task_rows(extractions: DataFrame, reference_tasks: DataFrame, tasks: DataFrame, references: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row per extracted record with its task, page and schema; unlinked extractions fall back on their schema."""
    links = reference_tasks.select("file_name", F.col("id").alias("reference_task_id"), "reference_id", "task_id")
    names = tasks.select("file_name", F.col("id").alias("task_id"), F.col("name").alias("task_name"))
    titles = references.where("pos = 0").select("file_name", F.col("id").alias("source_page_id"), F.col("title").alias("source_title"))
    joined = extractions.join(links, ["file_name", "reference_task_id"], "left").join(names, ["file_name", "task_id"], "left").join(titles, "file_name", "left")
    label = F.coalesce("task_name", F.when(F.col("reference_task_id").isNull(), F.coalesce("schema_name", "template_id")))
    return joined.select("file_name", "source_page_id", "source_title", "schema_name", label.alias("task_label"), F.col("pos").alias("ex_pos"), *(keep or []), F.posexplode("extracted").alias("row_pos", "row"))


def accepted(status: Column) -> Column:
    """Blank passes, and so does anything that contains 'accepted'."""
    return (F.coalesce(status, F.lit("")) == "") | F.lower(status).contains("accepted")
