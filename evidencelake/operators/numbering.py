"""Consecutive numbers over a whole table, or within groups of any size, without one task that sees all rows of either."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.sources.scratch import kept


def placed(df: DataFrame, order: Sequence[str], name: str, group: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] = kept, total: str | None = None) -> DataFrame:
    """df with name: 0, 1, ... by the order columns (ascending, null first), within each group of rows; with total, if named: the group's rows.

    Rows are range-partitioned and sorted by group and order and written once. A group's rows in one partition are
    a run; a run's numbers start where the earlier runs of its group end, so only a row for each run is summed up.
    Rows that are equal in group and order are numbered in any order. A group is split between partitions wherever
    its order columns allow it. keep writes a table and reads it again.
    """
    spark = df.sparkSession
    at, part, size, first, shift = (f"{name}__{x}" for x in ("at", "part", "size", "first", "shift"))
    keys = [*group, *order]
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    # the id's upper bits are the partition, the lower ones the place in it
    held = keep(dealt.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    runs = held.groupBy(part, *group).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(size))
    whole = Window.partitionBy(*group)  # at most a row for each partition
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(part, *(F.col(g).alias(f"{shift}{i}") for i, g in enumerate(group)), (F.col(first) - F.coalesce(F.sum(size).over(earlier), F.lit(0))).alias(shift), F.sum(size).over(whole).alias(f"{name}__total"))
    same = held[part] == shifts[part]
    for i, g in enumerate(group):
        same = same & held[g].eqNullSafe(shifts[f"{shift}{i}"])
    return held.join(shifts, same).select(*(held[c] for c in df.columns), (F.col(at) - F.col(shift)).alias(name), *([F.col(f"{name}__total").alias(total)] if total else []))
