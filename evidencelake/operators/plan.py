"""A reviewable update plan between two snapshots of references, and what applying it would do.

Records match by key, DOI, or title and authors. ``sync_plan`` makes a match of a pair if neither end has another
candidate and reports the rest as ambiguous, so that the plan doesn't depend on the order of files; ``sync_plan_in_order``
lets the source's records choose one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import assignment, linkage
from evidencelake.operators.numbering import placed
from evidencelake.sources.scratch import kept

SUMMARY = ("bundle_id", "id", "title", "authors", "year", "doi", "record_key", "version")


def numbered(df: DataFrame, ordinal: str, name: str) -> DataFrame:
    """df with name: 1, 2, ... by ordinal of any ordered type; rows without one come last. No number is missing or given twice."""
    last = f"{name}__last"
    return placed(df.withColumn(last, F.col(ordinal).isNull()), [last, ordinal], name).withColumn(name, F.col(name) + 1).drop(last)


def match_keys(records: DataFrame) -> DataFrame:
    """The keys of records in their order: record key, DOI, title and authors."""
    title = T.casefold(T.collapse(F.coalesce("title", F.lit(""))))
    by_title = F.when(title != "", F.concat_ws("|", title, T.casefold(T.collapse(T.authors_text(F.coalesce("authors", F.array().cast("array<string>")))))))
    return linkage.match_keys(records, record_key=T.casefold(T.strip(F.col("record_key"))), doi=T.doi_key(F.col("doi")), title_authors=by_title)


def record_summary(records: DataFrame) -> DataFrame:
    """What a plan says of a record."""
    return records.select(*SUMMARY)


def candidates(target: DataFrame, source: DataFrame) -> DataFrame:
    """left_id (target), right_id (source), and the first key that they share."""
    a = match_keys(target).withColumnRenamed("id", "left_id")
    b = match_keys(source).select(F.col("id").alias("right_id"), "key_type", "key_value")
    return a.join(b, ["key_type", "key_value"]).groupBy("left_id", "right_id").agg(F.min_by(F.struct("key_type", "key_value"), "priority").alias("key")).select("left_id", "right_id", "key.*")


def sync_plan(target: DataFrame, source: DataFrame, owned: list[str], ordinal: str) -> dict[str, DataFrame]:
    """The parts of a plan: matches, operations, only_source, only_target, ambiguous, review_actions and summary.

    Both frames have id, bundle_id, record_key, doi, title, authors, version and the fields that the source owns;
    ordinal is the source's order, by which matches are numbered.
    """
    pairs = candidates(target, source)
    matched = linkage.one_to_one(pairs)
    order = source.select(F.col("id").alias("right_id"), F.col(ordinal).alias("at"))
    per_source = pairs.groupBy("right_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    ambiguous = per_source.join(matched.select("right_id"), "right_id", "left_anti").withColumn("reason", F.when(F.col("n_candidates") > 1, "multiple_candidates").otherwise("no_available_candidate"))
    lonely = source.join(pairs.select(F.col("right_id").alias("id")).distinct(), "id", "left_anti")
    unused = target.join(pairs.select(F.col("left_id").alias("id")).distinct(), "id", "left_anti")
    return _parts(target, source, owned, numbered(matched.join(order, "right_id"), "at", "number"), ambiguous, lonely, unused)


def sync_plan_in_order(target: DataFrame, source: DataFrame, owned: list[str], ordinal: str) -> dict[str, DataFrame]:
    """The parts of a plan in which the source's records take the one candidate that is still free, in the order of ordinal (equal ones by id).

    The assignment is worked out once, when this is called, and kept in the shared folder for all parts.
    """
    mine, other = match_keys(source), match_keys(target)
    assigned = kept(assignment.assign(mine, other, source.select("id", F.col(ordinal).alias("at"))))
    kind = F.split("key", "=", 2)
    matched = numbered(assigned.where(F.col("status") == assignment.MATCHED), "at", "number").select("number", F.col("target_id").alias("left_id"), F.col("source_id").alias("right_id"), kind[0].alias("key_type"), kind[1].alias("key_value"))
    ambiguous = assigned.where(F.col("status").isin(assignment.SEVERAL, assignment.NONE_FREE)).select(F.col("source_id").alias("right_id"), "n_candidates", F.col("status").alias("reason"))
    lonely = source.join(assigned.where(F.col("status") == assignment.NO_CANDIDATE).select(F.col("source_id").alias("id")), "id", "left_semi")
    unused = target.join(assignment.left_over(assigned, mine, other, target.select("id")), "id", "left_semi")
    return _parts(target, source, owned, kept(matched), ambiguous, lonely, unused)


def _parts(target: DataFrame, source: DataFrame, owned: list[str], numbers: DataFrame, ambiguous: DataFrame, lonely: DataFrame, unused: DataFrame) -> dict[str, DataFrame]:
    """The parts from matches with their numbers, and from what has none."""
    matches = numbers.select(assignment.match_name(F.col("number")).alias("match_id"), "left_id", "right_id", "key_type", "key_value")

    def text(df: DataFrame, c: str) -> Column:
        if dict(df.dtypes)[c].startswith("array"):
            return F.array_join(F.transform(df[c], lambda x: F.coalesce(x, F.lit(""))), "; ")
        return df[c].cast("string")

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.select(F.col("id").alias(end), F.struct(*(text(df, c).alias(c) for c in [*owned, "record_key"])).alias(end[0]))

    wide = matches.join(side(target, "left_id"), "left_id").join(side(source, "right_id"), "right_id")
    entries = [F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").alias("old_value"), F.col(f"r.{f}").alias("new_value")) for f in sorted(owned)]
    changed = F.filter(F.array(*entries), lambda d: ~d["old_value"].eqNullSafe(d["new_value"]))
    operations = wide.select("match_id", "left_id", "right_id", F.coalesce(T.blank_to_null(F.col("r.record_key")), F.col("l.record_key")).alias("record_key"), F.inline(changed)).select(
        F.lit("update_reference_field").alias("operation"), F.concat_ws("-", "match_id", "field").alias("operation_id"), "match_id", F.lit("pages").alias("target"), F.lit("library").alias("source"),
        "field", "old_value", "new_value", F.col("left_id").alias("target_reference_id"), F.col("right_id").alias("source_reference_id"), "record_key", F.lit("source_owned_field").alias("reason"),
    )
    review = lonely.select(
        F.lit("create_page_from_record").alias("operation"), F.lit("pages").alias("target"), F.lit("library").alias("source"), F.lit("needs_review").alias("status"), F.col("id").alias("source_reference_id"),
        "record_key", "version", "title", F.lit("record_missing_from_target").alias("reason"),
    )
    parts = {"matches": matches, "operations": operations, "only_source": record_summary(lonely), "only_target": record_summary(unused), "ambiguous": ambiguous, "review_actions": review}
    counted = {"target_records": target, "source_records": source, **parts}
    summary = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n") for name, df in counted.items()])
    return parts | {"summary": summary}


def shown(value: Column) -> Column:
    """A text as it is written in quotation marks; None for null."""
    plain = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = value.contains("'") & ~value.contains('"')
    return F.when(value.isNull(), "None").when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def executable(operations: DataFrame, owned: list[str]) -> DataFrame:
    """The operations that may be carried out: updates from the library to the pages, of fields that it owns."""
    return operations.where((F.col("operation") == "update_reference_field") & (F.col("target") == "pages") & (F.col("source") == "library") & F.col("field").isin(owned))


def rendered(operations: DataFrame, owned: list[str], kinds: dict[str, str]) -> DataFrame:
    """operation_id, what a dry run says of each executable operation, and the typed payload that would be sent."""
    line = F.concat(F.lit("[DRY-RUN] pages.update ["), "target_reference_id", F.lit("] "), "field", F.lit(": "), shown(F.col("old_value")), F.lit(" -> "), shown(F.col("new_value")))
    return executable(operations, owned).select("operation_id", line.alias("line"), linkage.payload(F.col("field"), F.col("new_value"), kinds).alias("payload"))


def log_rows(operations: DataFrame, status: str, session: str, at: Column, actor: str, error: Column | None = None) -> DataFrame:
    """Log records of operations: planned, applied or failed."""
    return operations.select(
        F.coalesce("operation_id", "match_id").alias("operation_id"), F.lit(session).alias("session_id"), at.cast("string").alias("timestamp"), F.lit("references").alias("entity_type"), F.col("target_reference_id").alias("entity_id"),
        "field", "old_value", "new_value", F.lit(actor).alias("actor"), F.lit(status).alias("status"), (F.lit(None) if error is None else error).cast("string").alias("error_message"), F.lit(None).cast("string").alias("rollback_ref"),
    )


def change_lines(diff: DataFrame, owners: dict[str, str], system: str, entity_type: str) -> DataFrame:
    """What a system's writer says of each change to a field that it owns: entity_id, field and line."""
    own = linkage.with_owner(diff, owners).where(F.col("owner") == system)
    line = F.concat(F.lit(f"{system}."), "change_type", F.lit(f" [{entity_type}/"), "entity_id", F.lit("] "), "field", F.lit(": "), shown(F.col("old_value")), F.lit(" -> "), shown(F.col("new_value")))
    return own.select("entity_id", "field", line.alias("line"))
