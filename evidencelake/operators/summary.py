"""Summary tables of bundles, their cleaning, reports over entities, and audits between two sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import linkage, quality, tables

#: Words within a task's name, in order, and its short label (fixed values).
SHORT_LABELS = (("pred", "PRED"), ("desc", "DESC"), ("kt", "KT"), ("knowledge", "KT"), ("tracing", "KT"), ("rec", "REC"))


def task_label(name: Column, labels: dict[str, str]) -> Column:
    """A task's short label: by id, else by an id within the name or around it, else the name itself."""
    key = F.translate(F.lower(F.coalesce(name, F.lit(""))), " -", "__")
    exact = [F.when(key == task, F.lit(label)) for task, label in labels.items()]
    near = [F.when(key.contains(task) | F.contains(F.lit(task), key), F.lit(label)) for task, label in labels.items()]
    return F.coalesce(*exact, *near, name, F.lit(""))


def short_task_label(name: Column) -> Column:
    """The older rule: by words within the name, else its first four letters in capitals."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.coalesce(*(F.when(plain.contains(word), F.lit(label)) for word, label in SHORT_LABELS), F.substring(F.upper(name), 1, 4), F.lit(""))


def overlay(*maps: Column) -> Column:
    """One map out of several; later ones count."""
    out = maps[0]
    for new in maps[1:]:
        out = _over(out, F.coalesce(new, F.create_map().cast("map<string,string>")))
    return out


def _over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def reading_list(references: DataFrame, page: Column, status: Column, domain: Column) -> DataFrame:
    """page_id and row: a reference's fields, its status fields and its domain's fields as one map of texts."""
    texts = {f.name: F.array_join(f.name, "; ") if f.dataType.typeName() == "array" else F.col(f.name).cast("string") for f in references.schema if f.dataType.typeName() not in ("map", "struct", "variant")}
    base = F.map_filter(F.create_map(*(x for k, c in texts.items() for x in (F.lit(k), c))), lambda k, v: v.isNotNull())
    return references.select(page.alias("page_id"), overlay(base, status, domain, F.create_map(F.lit("page_id"), page.cast("string"))).alias("row"))


def wide(rows: DataFrame, row: str, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """A column for every key of the row maps, what lacks one empty. The keys, a table's column names, come to the driver."""
    if names is None:
        names = sorted(r[0] for r in rows.select(F.explode(F.map_keys(row)).alias("k")).distinct().collect())
    return rows.select(*keep, *(F.coalesce(F.try_element_at(row, F.lit(n)), F.lit("")).alias(n) for n in names if n not in keep))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables one after the other; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_analysis(raw: dict[str, DataFrame], fixes: dict[str, str], values: dict[str, str], search: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """The cleaned tables, and a log with a row for each."""
    clean = {name: tables.clean(df, fixes, values, search) for name, df in raw.items()}
    logs = [tables.cleaning_log(df, fixes, values, search).select(F.lit(name).alias("table"), "*") for name, df in raw.items()]
    return clean, reduce(DataFrame.unionByName, logs)


#: Corrections and values of the standard cleaning (fixed values).
STANDARD_FIXES = {r"\bFiiltering\b": "Filtering", r"\bExerrcise\b": "Exercise", r"\baprroach\b": "approach", r"\bThereotical\b": "Theoretical", r"\bMAchine\b": "Machine"}
STANDARD_VALUES = {"none": "Not Applicable", "none applicable": "Not Applicable", "not applicable": "Not Applicable", "n/a": "Not Applicable", "na": "Not Applicable", "elearning": "E-Learning", "e-learning": "E-Learning"}


def standard_clean(df: DataFrame, name: str, search: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """A table cleaned by the standard corrections, and its log."""
    return tables.clean(df, STANDARD_FIXES, STANDARD_VALUES, search), tables.cleaning_log(df, STANDARD_FIXES, STANDARD_VALUES, search).select(F.lit(name).alias("table"), "*")


def normalized_tables(sources: dict[str, DataFrame], candidates: tuple[str, ...], vocabulary: dict[str, list[str]], detect: Callable, ids: tuple[str, ...] = ("source_page_id", "page_id", "id", "source_id")) -> DataFrame:
    """task, paper_id, raw_token, value, matched over the tables that have one of the candidate columns."""
    parts = []
    for task, df in sources.items():
        column, key = detect(df.columns, candidates), detect(df.columns, ids)
        if column is not None and key is not None:
            named = df.select(F.lit(task).alias("task"), F.col(key).cast("string").alias("paper_id"), F.col(column).alias("cell"))
            parts.append(tables.long_values(named, F.col("cell"), vocabulary, ["task", "paper_id"]))
    return reduce(DataFrame.unionByName, parts)


def task_counts(references: DataFrame, reference_tasks: DataFrame, extractions: DataFrame) -> DataFrame:
    """kind, name and n: references, links, and extractions by template."""
    total = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")
    by = extractions.groupBy(F.coalesce("template_id", F.lit("(none)")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("extractions").alias("kind"), "name", "n")
    return total(references, "references").unionByName(total(reference_tasks, "reference_tasks")).unionByName(by)


def compared_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, title_match, authors_match and n_extractions of pages in both; titles and authors are compared without case and spacing."""
    same = lambda a, b: F.lower(T.collapse(F.coalesce(a, F.lit("")))) == F.lower(T.collapse(F.coalesce(b, F.lit(""))))
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, "page_id").select("page_id", same(F.col("a.title"), F.col("b.title")).alias("title_match"), same(F.col("a.authors"), F.col("b.authors")).alias("authors_match"), F.coalesce(F.col("b.n_extractions"), F.lit(0)).alias("n_extractions"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Totals of a comparison, without any text."""
    n = F.col("n_extractions")
    return compared.agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("title_match").alias("title_matches"), F.count_if(n > 0).alias("pages_with_extractions"), F.min(n).alias("min_extractions"), F.max(n).alias("max_extractions"), F.avg(n).alias("mean_extractions"))


def bundle_index(references: DataFrame) -> DataFrame:
    """id and file_name: where a bundle is found under its file's stem or any of its references' ids; of equal ids the last file counts."""
    stem = F.regexp_replace("file_name", r"\.json$", "")
    ids = references.select(F.explode(F.array_distinct(F.array(stem, F.col("id")))).alias("id"), "file_name").where("id <> ''")
    return ids.groupBy("id").agg(F.max("file_name").alias("file_name"))


def diff_files(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """file_name and the differences of its entities; files that only the old side has are left out, new ones are new in whole."""
    name = lambda df: df.withColumn("file_key", F.to_json(F.struct("file_name", F.col(key).cast("string").alias("id"))))
    kept = old.join(new.select("file_name").distinct(), "file_name", "left_semi")
    found = linkage.field_diff(name(kept), name(new), "file_key", fields)
    at = lambda path: F.get_json_object("entity_id", path)
    return found.select(at("$.file_name").alias("file_name"), at("$.id").alias("entity_id"), "field", "old_value", "new_value", "change_type")


def audit(pages: DataFrame, references: DataFrame, extractions: DataFrame, states: DataFrame, fields: list[str], expected: dict[str, str]) -> DataFrame:
    """check_name, page_id and detail: what old pages had and the bundles lack.

    pages: page_id, n_tables, status and the fields; the others have page_id, and a provenance map where it is to be checked.
    Bundles that no old page has aren't looked at.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = lambda df, name, detail: df.select(F.lit(name).alias("check_name"), F.col("page_id").cast("string").alias("page_id"), detail.cast("string").alias("detail"))
    there = pages.join(references.select("page_id").distinct(), "page_id", "left_semi")
    both = pages.alias("a").join(references.alias("b"), "page_id")
    lost = F.filter(F.array(*(F.when((text(F.col(f"a.{f}")) != "") & (text(F.col(f"b.{f}")) == ""), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    table = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair))
    states_ = there.select("page_id", F.try_element_at(table, F.col("status")).alias("wanted")).where("wanted is not null").join(states.select("page_id", "state"), "page_id").where(~F.col("state").eqNullSafe(F.col("wanted")))
    gaps = lambda df: df.select("page_id", F.array_join(quality.provenance_gaps(F.col("provenance")), ", ").alias("gaps")).where("gaps <> ''")
    return reduce(
        DataFrame.unionByName,
        [
            row(pages.join(references, "page_id", "left_anti"), "missing_reference", F.lit(None)),
            row(there.where("n_tables > 0").join(extractions, "page_id", "left_anti"), "missing_extractions", F.col("n_tables")),
            row(both.select("page_id", F.explode(lost).alias("f")), "field_loss", F.col("f")),
            row(reduce(DataFrame.unionByName, [gaps(df) for df in (references, extractions, states) if "provenance" in df.columns]).join(pages.select("page_id").distinct(), "page_id", "left_semi"), "provenance_loss", F.col("gaps")),
            row(states_, "state_mismatch", F.concat_ws(" / ", "wanted", "state")),
        ],
    )


def matched_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """left_id, right_id and key_type of pages with one DOI, or else one title and first author."""
    by_title = F.concat_ws("|", T.casefold(T.collapse(F.col("title"))), T.casefold(T.strip(F.col("first_author"))))
    keys = lambda df: linkage.match_keys(df, doi=T.doi_key(F.col("doi")), title_author=by_title)
    pairs = linkage.candidates(keys(old), keys(new))
    by_doi = pairs.where("key_type = 'doi'")
    rest = pairs.where("key_type <> 'doi'").join(by_doi.select("left_id").distinct(), "left_id", "left_anti")
    return by_doi.unionByName(rest)


def deduped(references: DataFrame, ordinal: Column, by_score: Column) -> DataFrame:
    """The most complete reference of each DOI, or else of each title and authors; records with neither stay apart."""
    title = T.blank_to_null(F.col("title"))
    authors = T.blank_to_null(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ";"))
    other = F.when(title.isNotNull() | authors.isNotNull(), F.concat(F.lit("ta:"), F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(authors, F.lit(""))))
    key = F.coalesce(F.concat(F.lit("doi:"), T.blank_to_null(T.status_key(F.col("doi")))), other)
    return tables.keep_best(references, key, by_score, ordinal)


def session_counts(log: DataFrame) -> DataFrame:
    """Records by session and status."""
    return log.groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("n"))


def never_applied(log: DataFrame, before: Column) -> DataFrame:
    """operation_id of what was planned before a moment and has no applied record."""
    planned = log.where((F.col("status") == "planned") & (F.col("timestamp") < before)).select("operation_id").distinct()
    return planned.join(log.where("status = 'applied'").select("operation_id"), "operation_id", "left_anti")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side and n: keys of both, of a alone and of b alone."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer")
    side = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))
