"""Counts, trends, pivots, cleaning and deduplication over analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.functions import vocab as V


def value_counts(df: DataFrame, column: Column, name: str, drop_blank: bool = False, top: int | None = None) -> DataFrame:
    """name and n; the most frequent first where a top is asked for, ties by value."""
    rows = df.select(column.alias(name))
    rows = rows.where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "") if drop_blank else rows
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(top) if top else counts


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows by the values of several columns."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, by: list[str], present: Column) -> DataFrame:
    """n, n_with and pct by group."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(present).alias("n_with"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n_with") / F.col("n"), 2))


def long_values(df: DataFrame, cell: Column, vocabulary: V.Vocabulary, keep: list[str]) -> DataFrame:
    """A row per token and label: keep, raw_token, value, matched. Distinct tokens are matched once.

    Of a cell's tokens with one key, each label counts once, under the first token.
    """
    cells = df.select(*keep, F.monotonically_increasing_id().alias("cell_row"), V.cell_tokens(cell).alias("tokens"))
    tokens = cells.select(*keep, "cell_row", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "raw_token"))
    found = tokens.select("raw_token").distinct().withColumns({"labels": V.labels_of(F.col("raw_token"), vocabulary), "key": T.token_key(F.col("raw_token"))})
    # outer, as Spark would otherwise look for the labels of every row, before tokens are made distinct
    values = found.select("raw_token", "key", (F.size("labels") > 0).alias("matched"), F.explode_outer(F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(V.unmatched_label(F.col("raw_token"))))).alias("value"))
    labelled = tokens.join(values, "raw_token")
    columns = [*keep, "raw_token", "value", "matched"]
    several = labelled.where("n > 1").groupBy(*keep, "cell_row", "key", "value").agg(F.min_by(F.struct("raw_token", "matched"), "at").alias("first"))
    return labelled.where("n = 1").select(*columns).unionByName(several.select(*keep, "first.raw_token", "value", "first.matched"))


def unmatched_audit(long: DataFrame, task: str, paper: str) -> DataFrame:
    return long.where("not matched").groupBy(task, "raw_token", "value").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(paper).alias("n_papers"))


def task_value_pivot(long: DataFrame, task: str, paper: str, order: list[str], by_total: bool = False) -> DataFrame:
    """Distinct papers by value and task, zeros filled in; total sums the ordered tasks alone, and may order the rows."""
    wide = long.groupBy("value").pivot(task, order).agg(F.countDistinct(paper)).na.fill(0)
    total = sum((F.col(f"`{t}`") for t in order), F.lit(0))
    values = long.select("value").distinct()
    table = values.join(wide, "value", "left").na.fill(0).withColumn("total", total.cast("long"))
    return table.orderBy(F.desc("total"), "value") if by_total else table


def trend(long: DataFrame, entity: str, year: str, groups: list[str] | None = None) -> DataFrame:
    """Distinct entities by year and value (and group), with zeros for every year between the first and last."""
    own = [*(groups or [])]
    counts = long.where(F.col(year).isNotNull()).select(*own, F.col(year).alias("year"), "value", entity).distinct().groupBy(*own, "year", "value").agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.sequence(F.min("year"), F.max("year")).alias("years"))
    grid = counts.select(*own, "value").distinct().join(F.broadcast(span)).select(*own, F.explode("years").alias("year"), "value")
    return grid.join(counts, [*own, "year", "value"], "left").na.fill(0, ["n"])


def clean(df: DataFrame, fixes: dict[str, str], values: dict[str, str], search: tuple[str, ...] = ()) -> DataFrame:
    """Every string column cleaned, search columns in canonical form."""
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.withColumns({c: T.search_string(F.col(c)) if c in search else T.normalize_cell(F.col(c), fixes, values) for c in strings})


def cleaning_log(df: DataFrame, fixes: dict[str, str], values: dict[str, str], search: tuple[str, ...] = ()) -> DataFrame:
    """n_rows, changed_cells and changed_search_cells in one pass, nulls equal to nulls."""
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    new = {c: T.search_string(F.col(c)) if c in search else T.normalize_cell(F.col(c), fixes, values) for c in strings}
    changed = lambda names: sum((F.when(~F.col(c).eqNullSafe(new[c]), 1).otherwise(0) for c in names), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(changed(strings)), F.lit(0)).cast("long").alias("changed_cells"), F.coalesce(F.sum(changed([c for c in strings if c in search])), F.lit(0)).cast("long").alias("changed_search_cells"))


def keep_best(df: DataFrame, key: Column, score: Column, ordinal: Column) -> DataFrame:
    """The row of each key with the highest score, the earliest of equals; rows without a key stay apart. Best rows are found before anything is shuffled."""
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), key.alias("key"), F.struct((-F.coalesce(score, F.lit(0))).alias("score"), ordinal.alias("at")).alias("rank"))
    best = own.where("key is not null").groupBy("key").agg(F.min_by("row", "rank").alias("row")).select("row")
    kept = best.unionByName(own.where("key is null").select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def completeness(*columns: Column) -> Column:
    return sum((F.when(F.coalesce(c.cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0))
