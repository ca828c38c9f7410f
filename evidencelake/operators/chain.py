"""From a folder of documents, or of raw pages, to cleaned tables: one lazy chain over all of its tables at once.

Rows of every table stay maps in one frame (table_name, file_name, ex_pos, row_pos, row), so that scanning, labelling,
cleaning and the log are one plan however many tables the documents give; a table gets its columns when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import decode, pages, summary

READING_LIST = "Reading List"
#: Columns that one table may have; documents with more are an error.
MOST_COLUMNS = 5000
Label = Callable[[Column], Column]


def text_of(value: Column) -> Column:
    """A VARIANT as a cell: texts as they are, lists of texts joined by '; ', anything else as JSON; null for JSON's null."""
    texts = F.try_variant_get(value, "$", "array<string>")
    return F.when(F.schema_of_variant(value) == "ARRAY<STRING>", F.array_join(texts, "; ")).when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.nullif(F.to_json(value), F.lit("null")))


def _fields(item: Column, path: str = "$") -> Column:
    """The fields of an object as a map of cells, without null ones."""
    cells = F.transform_values(F.try_variant_get(item, path, "map<string,variant>"), lambda k, v: text_of(v))
    return F.coalesce(F.map_filter(cells, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def _cells(**values: Column) -> Column:
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _long(reading: DataFrame, extracted: DataFrame, label: Label | None) -> DataFrame:
    """reading: file_name, page_id, title and row. extracted: what decode.task_rows gives. A record whose task has no label is left out."""
    one = reading.select(F.lit(READING_LIST).alias("table_name"), "file_name", F.lit(0).alias("ex_pos"), F.lit(0).alias("row_pos"), "row")
    named = extracted.withColumn("label", label(F.col("task_label")) if label else F.col("task_label")).where("task_label <> '' and label <> ''")
    records = named.join(reading.select("file_name", "page_id", "title"), "file_name", "left")
    row = summary.overlay(F.map_filter("row", lambda k, v: v.isNotNull()), _cells(source_page_id=F.col("page_id"), source_title=F.col("title"), schema_name=F.col("schema_name")))
    return one.unionByName(records.select(F.col("label").alias("table_name"), "file_name", "ex_pos", "row_pos", row.alias("row")))


def _last_of_each(entities: DataFrame) -> DataFrame:
    """Of entities with one id in a file the last counts."""
    own = F.struct(*(F.col(c) for c in entities.columns))
    return entities.groupBy("file_name", "id").agg(F.max_by(own, "pos").alias("own")).select("own.*")


def document_rows(bundles: DataFrame, label: Label | None = None) -> DataFrame:
    """The rows of all tables of bundles (file_name, bundle_id, doc): the reading list's, one for each bundle, and its tasks' records."""
    reference = F.try_variant_get("doc", "$.references[0]", "variant")
    page = F.coalesce(T.blank_to_null(F.try_variant_get("doc", "$.provenance.source_id", "string")), T.blank_to_null(F.try_variant_get("doc", "$.references[0].id", "string")), F.lit(""))
    props = [_fields(reference, f"$.sync_metadata.{name}") for name in ("notion_properties", "domain_properties")]
    reading = bundles.select("file_name", page.alias("page_id"), F.try_variant_get("doc", "$.references[0].title", "string").alias("title"), summary.overlay(_fields(reference), *props, _cells(page_id=page)).alias("row"))
    of = lambda name: decode.flatten(bundles, name)
    records = decode.task_rows(of("task_extractions"), _last_of_each(of("reference_tasks")), _last_of_each(of("tasks")), of("references"))
    return _long(reading, records, label)


def page_rows(raw: DataFrame, pack: pages.Pack, label: Label | None = None) -> DataFrame:
    """The same from raw pages, by way of their entity tables."""
    entities = pages.bundle(raw, pack)
    named = {name: df.withColumn("file_name", F.col("id" if name == "references" else "reference_id" if name in ("reference_tasks",) else "page_id")) for name, df in entities.items() if name in ("references", "tasks", "reference_tasks", "task_extractions")}
    references = named["references"].withColumn("pos", F.lit(0))
    plain = {f.name: F.array_join(f.name, "; ") if f.dataType.typeName() == "array" else F.col(f.name).cast("string") for f in entities["references"].schema if f.dataType.typeName() not in ("map",) and f.name != "status_values"}
    states = F.map_from_entries("status_values")
    domain = F.transform_values("domain_properties", lambda k, v: F.array_join(v, "; "))
    reading = references.select("file_name", F.col("id").alias("page_id"), "title", summary.overlay(_cells(**plain), states, domain, _cells(page_id=F.col("id"))).alias("row"))
    extractions = named["task_extractions"]
    if "pos" not in extractions.columns:
        extractions = extractions.withColumn("pos", F.try_element_at("provenance", F.lit("block_index")).try_cast("int"))
    links = named["reference_tasks"].dropDuplicates(["file_name", "id"])  # tables of one task share a link
    return _long(reading, decode.task_rows(extractions, links, named["tasks"], references), label)


def cleaned(rows: DataFrame, fixes: dict[str, str], values: dict[str, str], search: tuple[str, ...] = ()) -> DataFrame:
    """rows with clean: every cell of every table in its clean form."""
    def cell(key: Column, value: Column) -> Column:
        plain = T.normalize_cell(value, fixes, values)
        return F.when(key.isin(*search), T.search_string(value)).otherwise(plain) if search else plain

    return rows.withColumn("clean", F.transform_values("row", cell))


def cleaning_log(clean: DataFrame, search: tuple[str, ...] = ()) -> DataFrame:
    """table_name, n_rows, changed_cells and changed_search_cells, of all tables in one pass."""
    changed = F.filter(F.map_entries("row"), lambda e: ~e["value"].eqNullSafe(F.try_element_at("clean", e["key"])))
    among = F.size(F.filter(changed, lambda e: e["key"].isin(*search))) if search else F.lit(0)
    return clean.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(changed)).alias("changed_cells"), F.sum(among).cast("long").alias("changed_search_cells"))


def table_columns(rows: DataFrame) -> dict[str, list[str]]:
    """The columns of each table, by name; found by one aggregate, and bounded for each table."""
    keys = rows.select("table_name", F.explode(F.map_keys("row")).alias("k")).groupBy("table_name").agg(F.count_distinct("k").alias("n"))
    widest = keys.agg(F.max("n")).first()[0] or 0
    if widest > MOST_COLUMNS:
        raise ValueError(f"a table has {widest} columns; {MOST_COLUMNS} are allowed")
    sets = rows.select("table_name", F.explode(F.map_keys("row")).alias("k")).distinct().groupBy("table_name").agg(F.sort_array(F.collect_list("k")).alias("names"))
    return {r["table_name"]: r["names"] for r in sets.collect()}


def table(rows: DataFrame, name: str, columns: list[str], row: str = "row") -> DataFrame:
    """One table with its columns, what lacks one empty, in the documents' order by file_name, ex_pos and row_pos."""
    own = rows.where(F.col("table_name") == name)
    return own.select("file_name", "ex_pos", "row_pos", *(F.coalesce(F.try_element_at(row, F.lit(c)), F.lit("")).alias(c) for c in columns))


def run(rows: DataFrame, fixes: dict[str, str], values: dict[str, str], search: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Raw tables, clean tables, and the log of all."""
    clean = cleaned(rows, fixes, values, search)
    columns = table_columns(rows)
    return {n: table(rows, n, c) for n, c in columns.items()}, {n: table(clean, n, c, "clean") for n, c in columns.items()}, cleaning_log(clean, search)
