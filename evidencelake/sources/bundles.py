"""Reading and writing bundles, page exports, bibliographic items and the write log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "operation_id string, session_id string, timestamp string, entity_type string, entity_id string, field string, old_value string, new_value string, actor string, status string, error_message string, rollback_ref string"
STATE = ("entity_type", "entity_id", "field", "new_value", "actor", "timestamp", "operation_id")
STATE_SCHEMA = ", ".join(f"{c} string" for c in STATE)
LOG_REQUIRED = LOG_SCHEMA.replace(" string", "").split(", ")[:10]


def read_bundles(spark: SparkSession, path: str, pattern: str = "*.canonical.json") -> DataFrame:
    """file_name, bundle_id and doc (a VARIANT) of every file that holds a JSON object whose first reference is an object."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file_name"), F.try_parse_json("value").alias("doc"))
    own = raw.where(F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT") & F.schema_of_variant(F.try_variant_get("doc", "$.references[0]", "variant")).startswith("OBJECT"))
    stem = F.regexp_replace("file_name", r"(\.canonical)?\.json$", "")
    return own.select("file_name", F.coalesce(F.try_variant_get("doc", "$.bundle_id", "string"), stem).alias("bundle_id"), "doc")


def read_bundle_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of merged bundles, one document a line, as write_bundles has them; a bundle's id stands for its file."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("doc"))
    own = raw.where(F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT") & F.schema_of_variant(F.try_variant_get("doc", "$.references[0]", "variant")).startswith("OBJECT"))
    named = own.select(F.try_variant_get("doc", "$.bundle_id", "string").alias("bundle_id"), "doc")
    return named.select(F.col("bundle_id").alias("file_name"), "bundle_id", "doc")


def file_status(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file_name and OK, WARN (the root is no object) or ERROR (no JSON)."""
    doc = F.try_parse_json("value")
    status = F.when(doc.isNull(), "ERROR").when(~F.schema_of_variant(doc).startswith("OBJECT"), "WARN").otherwise("OK")
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file_name"), status.alias("status"))


def read_log(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """The log's records; log_date is the folder, so that conditions on it leave whole days unread. Lines that are no records are left out."""
    log = spark.read.schema(f"{LOG_SCHEMA}, log_date date").option("mode", "DROPMALFORMED").json(path)
    return log.where(F.col("session_id") == session_id) if session_id else log


def append_log(records: DataFrame, path: str, session_id: str | None = None) -> None:
    """Appends records, a folder for each day. A required column that is absent is an error; null values pass.

    session_id stands in where the records have none.
    """
    if session_id is not None and "session_id" not in records.columns:
        records = records.withColumn("session_id", F.lit(session_id))
    absent = sorted(set(LOG_REQUIRED) - set(records.columns))
    if absent:
        raise ValueError(f"log records lack the required columns {absent}")
    columns = [F.col(c).cast("string").alias(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in LOG_SCHEMA.replace(" string", "").split(", ")]
    dated = records.select(*columns).withColumn("log_date", F.try_to_date(F.substring("timestamp", 1, 10)))
    dated.write.mode("append").partitionBy("log_date").option("ignoreNullFields", "false").json(path)


def prune_log(spark: SparkSession, path: str, before: str) -> list[str]:
    """Deletes the days before a date from the log, folder by folder, and names them; no record is read or written.

    Records whose day isn't known are kept.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [f.getPath() for f in files.listStatus(hadoop) if re.fullmatch(r"log_date=\d{4}-\d\d-\d\d", f.getPath().getName())]
    gone = sorted((d for d in days if d.getName().partition("=")[2] < before), key=lambda d: d.getName())
    for day in gone:
        files.delete(day, True)
    return [d.getName().partition("=")[2] for d in gone]


def snapshot_states(spark: SparkSession, log: str, snapshots: str, day: str) -> None:
    """Writes every entity field's latest applied value at the end of a day, from the snapshot before it and the days since then."""
    last = _snapshot_before(spark, snapshots, day)
    later = read_log(spark, log).where((F.col("log_date") <= F.lit(day).cast("date")) & (F.col("log_date") > F.lit(last).cast("date") if last else F.lit(True)))
    state = later.where("status = 'applied'").select(*STATE)
    if last:
        state = state.unionByName(spark.read.schema(STATE_SCHEMA).parquet(f"{snapshots}/day={last}"))
    _latest(state).write.parquet(f"{snapshots}/day={day}")


def state_as_of(spark: SparkSession, log: str, snapshots: str, moment: str) -> DataFrame:
    """entity_type, entity_id, field, new_value, actor and timestamp of the latest applied records up to a moment (an ISO time).

    Reads the latest snapshot of an earlier day and only those days of the log that come after it.
    """
    day = moment[:10]
    last = _snapshot_before(spark, snapshots, day)
    days = F.col("log_date") <= F.lit(day).cast("date")
    state = read_log(spark, log).where((days & (F.col("log_date") > F.lit(last).cast("date"))) if last else days).where((F.col("status") == "applied") & (F.col("timestamp") <= moment)).select(*STATE)
    return _latest(state.unionByName(spark.read.schema(STATE_SCHEMA).parquet(f"{snapshots}/day={last}")) if last else state)


def _latest(state: DataFrame) -> DataFrame:
    """Of records of the same moment, the one with the greatest operation id counts."""
    own = F.struct("timestamp", "operation_id", "new_value", "actor")
    return state.groupBy("entity_type", "entity_id", "field").agg(F.max(own).alias("own")).select("entity_type", "entity_id", "field", "own.*").select(*STATE)


def _snapshot_before(spark: SparkSession, snapshots: str, day: str) -> str | None:
    """The latest day before a day that has a finished snapshot."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(snapshots)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda p: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    days = [f.getPath().getName().partition("=")[2] for f in (files.listStatus(hadoop) if files.exists(hadoop) else []) if f.getPath().getName().startswith("day=") and done(f.getPath())]
    return max((d for d in days if d < day), default=None)


def kept_log(log: DataFrame, days: int, today: Column) -> DataFrame:
    """The log without what is older than so many days before a date."""
    return log.where(F.to_date(F.substring("timestamp", 1, 10)) >= F.date_sub(today, days))


def upsert_status(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new with status WROTE, UPDATED or UNCHANGED, by the hash of every column."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))), 256)
    before = old.select(F.col(key).alias("key"), F.struct(digest(old).alias("digest")).alias("before"))
    own = new.select(F.col(key).alias("key"), F.struct(*(F.col(f"`{c}`") for c in new.columns)).alias("row"), digest(new).alias("after"))
    status = F.when(F.col("before").isNull(), "WROTE").when(F.col("before.digest") == F.col("after"), "UNCHANGED").otherwise("UPDATED")
    return own.join(before, "key", "left").select(*(F.col("row").getField(c).alias(c) for c in new.columns), status.alias("status"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One entity table as parquet, json lines or csv; in csv, nested columns and documents are JSON text."""
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True, escape='"')
    else:
        df.write.format(kind).save(path)


def write_by_task(df: DataFrame, path: str, task: str = "task") -> None:
    """A folder of csv files for each task."""
    df.write.partitionBy(task).csv(path, header=True)


def write_bundles(bundles: DataFrame, path: str) -> None:
    """All bundles as JSON lines, one document a line."""
    bundles.select(F.to_json("doc").alias("value")).write.text(path)
