"""Raw page exports as bundle entities, and raw pages of a database as references.

A page row has page_id, title, properties (a map of name to VARIANT), tables (heading, block_id, index,
rows) and blocks (id, type, text). Every entity table is one projection of it; nothing is shuffled but
for the distinct tasks of a page.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import decode

PAGE = "page_id string, title string, properties map<string,variant>, tables array<struct<heading:string,block_id:string,index:string,rows:array<array<string>>>>, blocks array<struct<id:string,type:string,text:string>>"
STATUS_FIELDS = ("Status", "Status_1")

#: Property names, in lower case, and the reference's field that they fill (fixed values).
FIELD_OF = {
    "title": "title", "name": "title", "author": "authors", "authors": "authors", "year": "year", "publication year": "year",
    "journal": "journal", "publication": "journal", "doi": "doi", "url": "url", "link": "url", "zotero_key": "zotero_key",
    "zotero key": "zotero_key", "abstract": "abstract", "type": "item_type", "item_type": "item_type", "tags": "tags", "keywords": "tags",
    "search strategy": "search_terms", "search terms": "search_terms", "search_terms": "search_terms", "date of retrieval": "search_date",
    "search date": "search_date", "search_date": "search_date", "database": "database", "source database": "database",
    "search database": "database", "platform": "database", "quartile": "journal_quartile", "journal quartile": "journal_quartile",
    "sjr quartile": "journal_quartile", "journal_quartile": "journal_quartile", "article type": "journal_quartile",
}


@dataclass(frozen=True)
class Pack:
    """A domain: its tasks, as (id, aliases, template), the page properties it keeps and its status words."""

    id: str
    version: str
    tasks: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    properties: tuple[str, ...] = ()
    states: dict[str, str] = field(default_factory=dict)


def pages_of(raw: DataFrame, doc: str = "doc") -> DataFrame:
    """Page rows out of a VARIANT column."""
    fields = [x.split(" ", 1) for x in PAGE.split(", ")]
    return raw.select(*(F.try_variant_get(doc, f"$.{name}", kind).alias(name) for name, kind in fields))


def value_of(prop: Column) -> Column:
    """The values of a property: a list, with scalars as its one item; null without any."""
    read = lambda p: T.let(F.struct(F.try_variant_get(p, "$.type", "string").alias("kind"), p.alias("p")), lambda x: decode.property_value(x["kind"], x["p"]))
    filled = lambda v: T.let(F.filter(v, lambda x: x.isNotNull()), lambda own: F.when(F.size(own) > 0, F.when((F.size(own) > 1) | (F.get(own, F.lit(0)) != ""), own)))
    return T.let(prop, lambda p: filled(read(p)))


def read(pages: DataFrame) -> DataFrame:
    """pages with said: a map of property names to their values. As a generated column it is computed once a page."""
    entries = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("key"), value_of(e["value"]).alias("value")))
    return pages.select("*", F.explode(F.array(F.map_from_entries(entries))).alias("said"))


def values(said: Column, *names: str) -> Column:
    """The values of the first of the names that has any; a name in another case serves where the exact one has none."""
    found = []
    for name in names:
        wanted = name.lower()
        other = F.get(F.filter(F.map_entries(said), lambda e: F.lower(e["key"]) == F.lit(wanted)), F.lit(0))["value"]
        found += [F.try_element_at(said, F.lit(name)), other]
    return F.coalesce(*found)


def one(values_: Column) -> Column:
    return F.get(values_, F.lit(0))


def author_list(values_: Column) -> Column:
    """Several names as they are; one text cut at semicolons."""
    return F.coalesce(F.when(F.size(values_) > 1, F.filter(values_, lambda x: x != "")).otherwise(T.split_authors(one(values_))), F.array().cast("array<string>"))


def provenance(page: Column, pack: Pack, **extra: Column) -> Column:
    """The three keys that every object has, and more."""
    base = {"source_id": page, "domain_pack_id": F.lit(pack.id), "domain_pack_version": F.lit(pack.version)} | extra
    return F.map_filter(F.create_map(*(x for k, c in base.items() for x in (F.lit(k), c.cast("string")))), lambda k, v: v.isNotNull())


def references(pages: DataFrame, pack: Pack) -> DataFrame:
    """One reference a page; alternative property names are tried in order."""
    pages, p = read(pages), F.col("said")
    texts = {name: one(values(p, *names)) for name, names in {
        "journal": ("Journal",), "doi": ("DOI",), "url": ("URL",), "zotero_key": ("Zotero Key", "Zotero_Key"), "abstract": ("Abstract",),
        "search_terms": ("Search Strategy", "Search Terms"), "search_date": ("Date of Retrieval", "Search Date"),
        "database": ("Database", "Source Database", "Platform"), "journal_quartile": ("Article Type", "Quartile", "Journal Quartile", "SJR Quartile"),
    }.items()}
    return pages.select(
        F.col("page_id").alias("id"), F.coalesce(T.blank_to_null(F.col("title")), "page_id").alias("title"),
        author_list(F.coalesce(F.try_element_at(p, F.lit("Authors")), F.try_element_at(p, F.lit("Author")))).alias("authors"),
        T.strip(one(values(p, "Year", "Publication Year"))).try_cast("int").alias("year"),
        *(c.alias(name) for name, c in texts.items()),
        provenance(F.col("page_id"), pack).alias("provenance"), domain_properties(p, pack).alias("domain_properties"), statuses(p).alias("status_values"),
    )


def domain_properties(said: Column, pack: Pack) -> Column:
    """name to values of the properties that the pack keeps, where filled; false and 0 count as filled."""
    if not pack.properties:
        return F.create_map().cast("map<string,array<string>>")
    entries = F.array(*(F.struct(F.lit(n).alias("key"), values(said, n).alias("value")) for n in pack.properties))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def statuses(said: Column) -> Column:
    """source_field and value of every status field that is filled."""
    return F.filter(F.array(*(F.struct(F.lit(n).alias("source_field"), one(values(said, n)).alias("value")) for n in STATUS_FIELDS)), lambda e: e["value"].isNotNull())


def page_tables(pages: DataFrame, pack: Pack) -> DataFrame:
    """A row per table: page_id, at, heading, block_id, index, its records, headers, and the task and template of its heading, or null."""
    t = pages.select("page_id", F.posexplode("tables").alias("at", "t")).select("page_id", "at", F.coalesce("t.heading", F.lit("")).alias("heading"), "t.block_id", "t.index", F.coalesce("t.rows", F.array().cast("array<array<string>>")).alias("rows"))
    task = decode.task_of(F.col("heading"), [(name, list(aliases)) for name, aliases, _ in pack.tasks])
    template = F.coalesce(*(F.when(F.col("task_id") == name, F.lit(kind)) for name, _, kind in pack.tasks), F.lit(None).cast("string"))
    records = t.withColumn("extracted", decode.table_records(F.col("rows")))
    return records.withColumn("raw_headers", F.when(F.size("extracted") > 0, F.map_keys(F.get("extracted", F.lit(0))))).withColumn("task_id", task).withColumn("template_id", template).drop("rows")


def tasks(tables: DataFrame, pack: Pack) -> DataFrame:
    """The distinct tasks of each page."""
    return tables.where("task_id is not null").select("page_id", T.slugify(F.col("task_id")).alias("id"), F.col("task_id").alias("name")).distinct().withColumn("provenance", provenance(F.col("page_id"), pack))


def reference_tasks(tables: DataFrame, pack: Pack) -> DataFrame:
    """A link of page and task for every table with a task."""
    own = tables.where("task_id is not null").withColumn("task_id", T.slugify(F.col("task_id")))
    return own.select(T.short_id("rt", F.col("page_id"), F.col("task_id")).alias("id"), F.col("page_id").alias("reference_id"), "task_id", provenance(F.col("page_id"), pack, table_block_id=F.col("block_id")).alias("provenance"))


def extractions(tables: DataFrame, pack: Pack) -> DataFrame:
    """An extraction a table: linked to its task, or unlinked with the heading for a schema."""
    slug = T.slugify(F.col("task_id"))
    linked = F.col("task_id").isNotNull()
    schema = F.coalesce("template_id", T.blank_to_null(F.col("heading")), F.lit("table"))
    return tables.select(
        T.short_id("ex", F.col("page_id"), F.coalesce(slug, T.blank_to_null(F.col("heading")), F.lit("table")), F.coalesce("index", F.lit("None"))).alias("id"),
        "page_id", F.when(linked, T.short_id("rt", F.col("page_id"), slug)).alias("reference_task_id"), "template_id", schema.alias("schema_name"), "raw_headers", "extracted",
        provenance(F.col("page_id"), pack, block_index=F.col("index")).alias("provenance"),
    )


def annotations(pages: DataFrame, pack: Pack) -> DataFrame:
    """A note for every paragraph with text."""
    b = pages.select("page_id", F.explode("blocks").alias("b")).where("b.type = 'paragraph' and b.text <> ''")
    key = F.coalesce(T.blank_to_null(F.col("b.id")), F.substring("b.text", 1, 40))
    return b.select(T.short_id("an", F.col("page_id"), key).alias("id"), F.col("page_id").alias("reference_id"), F.lit("note").alias("kind"), F.col("b.text").alias("text"), provenance(F.col("page_id"), pack).alias("provenance"))


def workflow_states(pages: DataFrame, pack: Pack) -> DataFrame:
    """A state for every status field."""
    s = read(pages).select("page_id", F.explode(statuses(F.col("said"))).alias("s")).withColumn("state", T.workflow_state(F.col("s.value"), pack.states)).where("state <> ''")
    return s.select(T.short_id("ws", F.col("page_id"), F.col("s.source_field"), F.col("state")).alias("id"), F.col("page_id").alias("reference_id"), "state", F.col("s.source_field").alias("source_field"), provenance(F.col("page_id"), pack).alias("provenance"))


def bundle(pages: DataFrame, pack: Pack) -> dict[str, DataFrame]:
    """The six entity tables of raw pages."""
    tables = page_tables(pages, pack)
    return {
        "references": references(pages, pack), "tasks": tasks(tables, pack), "reference_tasks": reference_tasks(tables, pack),
        "task_extractions": extractions(tables, pack), "annotations": annotations(pages, pack), "workflow_states": workflow_states(pages, pack),
    }


def database_references(pages: DataFrame) -> DataFrame:
    """References of database pages by the table of property names; of several that fill a field the first counts, the unknown ones are kept as extras.

    properties is an array of (name, value) in the page's order.
    """
    names = F.create_map(*(F.lit(x) for pair in FIELD_OF.items() for x in pair))
    found = F.transform("properties", lambda e: F.struct(e["name"].alias("name"), F.try_element_at(names, F.lower(e["name"])).alias("field"), value_of(e["value"]).alias("value")))
    own = pages.select("page_id", found.alias("found"))
    get = lambda f: F.get(F.filter("found", lambda e: e["field"] == f), F.lit(0))["value"]
    none = F.array().cast("array<string>")
    extras = F.map_from_entries(F.transform(F.filter("found", lambda e: e["field"].isNull()), lambda e: F.struct(e["name"].alias("key"), e["value"].alias("value"))))
    single = ("title", "journal", "doi", "url", "abstract", "item_type", "search_terms", "search_date", "database", "journal_quartile")
    return own.select(
        F.coalesce(one(get("zotero_key")), "page_id").alias("id"), author_list(get("authors")).alias("authors"), T.strip(one(get("year"))).try_cast("int").alias("year"), F.coalesce(get("tags"), none).alias("tags"),
        one(get("zotero_key")).alias("zotero_key"), *(one(get(f)).alias(f) for f in single), extras.alias("extras"),
    )


#: Property names that are tried in order, in lower case, where a database gives no schema (fixed values).
WITHOUT_SCHEMA = {
    "title": ("title", "name"), "authors": ("authors", "author"), "year": ("year", "publication year"), "journal": ("journal", "publication"), "doi": ("doi",),
    "url": ("url", "link"), "zotero_key": ("zotero_key", "zotero key"), "abstract": ("abstract",), "item_type": ("item_type", "type"), "tags": ("tags", "keywords"),
    "search_terms": ("search strategy", "search terms", "search_terms"), "search_date": ("date of retrieval", "search date", "search_date"),
    "database": ("database", "source database", "search database", "platform"),
    "journal_quartile": ("quartile", "journal quartile", "sjr quartile", "journal_quartile", "article type"),
}


def plain_references(pages: DataFrame) -> DataFrame:
    """References of database pages by well-known names: the first name that is there counts, filled or not; each field reads the property types it can have."""
    def prop(name: str) -> Column:
        called = lambda n: F.get(F.filter("properties", lambda e: F.lower(e["name"]) == n), F.lit(0))["value"]
        present = [called(n) for n in WITHOUT_SCHEMA[name]]
        titled = F.get(F.filter("properties", lambda e: F.try_variant_get(e["value"], "$.type", "string") == "title"), F.lit(0))["value"]
        return F.coalesce(*present, *([titled] if name == "title" else []))

    def text(p: Column) -> Column:
        parts = F.coalesce(*(F.when(F.size(x) > 0, x) for x in (F.try_variant_get(p, "$.rich_text", "array<variant>"), F.try_variant_get(p, "$.title", "array<variant>"))))
        return T.blank_to_null(F.array_join(F.transform(parts, lambda x: F.try_variant_get(x, "$.plain_text", "string")), ""))

    select = lambda p: F.try_variant_get(p, "$.select.name", "string")
    several = lambda p: F.transform(F.try_variant_get(p, "$.multi_select", "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string"))
    url = lambda p: T.blank_to_null(F.try_variant_get(p, "$.url", "string"))
    none = F.array().cast("array<string>")
    made = {
        "title": text(prop("title")), "authors": F.coalesce(T.split_authors(text(prop("authors"))), none), "year": F.try_variant_get(prop("year"), "$.number", "double").try_cast("int"),
        "journal": text(prop("journal")), "doi": F.coalesce(text(prop("doi")), url(prop("doi"))), "url": F.coalesce(url(prop("url")), text(prop("url"))), "zotero_key": text(prop("zotero_key")), "abstract": text(prop("abstract")),
        "item_type": F.coalesce(T.blank_to_null(select(prop("item_type"))), one(several(prop("item_type"))), text(prop("item_type"))), "tags": F.coalesce(several(prop("tags")), none),
        "search_terms": text(prop("search_terms")), "search_date": text(prop("search_date")), "database": F.coalesce(T.blank_to_null(select(prop("database"))), text(prop("database"))),
        "journal_quartile": F.coalesce(T.blank_to_null(select(prop("journal_quartile"))), text(prop("journal_quartile")), one(several(prop("journal_quartile")))),
    }
    return pages.select(F.coalesce(text(prop("zotero_key")), "page_id").alias("id"), *(c.alias(n) for n, c in made.items()))


def block_tables(blocks: DataFrame) -> DataFrame:
    """Tables of an ordered block list, a row each: page_id, pos, heading (the latest before it) and rows of cell texts.

    blocks: page_id, pos, id, parent_id, type, text and cells (a row's cell texts); a table's rows are the table_row blocks it is the parent of.
    """
    table = decode.carry_heading(blocks).where("type = 'table'").select("page_id", F.col("id").alias("parent_id"), "pos", F.coalesce("heading", F.lit("")).alias("heading"))
    rows = blocks.where("type = 'table_row'").groupBy("page_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"]).alias("rows"))
    return table.join(rows, ["page_id", "parent_id"], "left").select("page_id", "pos", "heading", F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows"))
