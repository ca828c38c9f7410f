"""Distinct entities by many groupings out of one aggregate: bitmaps of entity numbers, which merge by or."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators.numbering import placed
from evidencelake.sources.scratch import kept


def entity_bitmaps(long: DataFrame, keys: Sequence[str], entity: str, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """keys, bucket and members: which of the bucket's entities a group holds. Rows without an entity don't count.

    Entities are numbered without gaps, so that bitmaps are dense; repeated rows of an entity set the same bit, so nothing
    has to be made distinct, and a group's bitmaps are built where its rows are, before they are dealt out.
    """
    numbers = placed(long.select(entity).where(F.col(entity).isNotNull()).distinct(), [entity], "entity_number", keep=keep).withColumn("entity_number", F.col("entity_number") + 1)
    rows = long.join(numbers, entity)
    return keep(rows.groupBy(*keys, F.bitmap_bucket_number("entity_number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("entity_number")).alias("members")))


def counts(bitmaps: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Distinct entities by some of the keys."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("members").alias("members"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("members")).alias(name))


def pivoted(bitmaps: DataFrame, value: str, task: str, order: Sequence[str]) -> DataFrame:
    """Distinct entities by value and task, zeros filled in; total sums the ordered tasks, anywhere counts an entity of several tasks once."""
    per_task = counts(bitmaps, [value, task]).groupBy(value).agg(*(F.coalesce(F.max(F.when(F.col(task) == x, F.col("n"))), F.lit(0)).alias(x) for x in order))
    total = sum((F.col(f"`{x}`") for x in order), F.lit(0).cast("long"))
    return per_task.withColumn("total", total).join(counts(bitmaps, [value], "anywhere"), value)


def trend(bitmaps: DataFrame, year: str, value: str) -> DataFrame:
    """Distinct entities by year and value, with zeros between the first and the last year."""
    found = counts(bitmaps.where(F.col(year).isNotNull()), [year, value])
    span = found.agg(F.sequence(F.min(year), F.max(year)).alias("years"))
    grid = found.select(value).distinct().crossJoin(F.broadcast(span)).select(value, F.explode("years").alias(year))  # one row
    return grid.join(found, [year, value], "left").na.fill(0, ["n"])
