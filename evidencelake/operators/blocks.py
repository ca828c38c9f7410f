"""Trees of page blocks: each block's page-level ancestor, depth and path, level by level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators import decode
from evidencelake.sources.scratch import kept


def closure(blocks: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """blocks (page_id, id, parent_id, pos and more) with top (the id of the block right under the page), depth (from 0) and path.

    A block whose parent is null or isn't there is right under the page. path holds the positions from there down, by which
    blocks sort as they are read. One join for each level; blocks that only hang on each other in a circle are left out.
    """
    own = keep(blocks)
    ids = own.select("page_id", F.col("id").alias("parent_id"))
    level = keep(own.join(ids, ["page_id", "parent_id"], "left_anti").select(*own.columns, F.col("id").alias("top"), F.lit(0).alias("depth"), F.array(F.col("pos").cast("long")).alias("path")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        above = level.select("page_id", F.col("id").alias("parent_id"), "top", (F.col("depth") + 1).alias("depth"), F.col("path").alias("above"))
        level = keep(own.join(above, ["page_id", "parent_id"]).select(*(own[c] for c in own.columns), "top", "depth", F.array_append("above", F.col("pos").cast("long")).alias("path")))
    return reduce(DataFrame.unionByName, levels, level)


def texts(blocks: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """page_id, top and text: a page-level block's texts and those of all blocks below it, in reading order, a line each."""
    rows = closure(blocks, keep).groupBy("page_id", "top").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("rows"))
    return rows.select("page_id", "top", F.array_join(F.filter(F.transform("rows", lambda r: r["text"]), lambda x: x != ""), "\n").alias("text"))


def exported_tables(blocks: DataFrame) -> DataFrame:
    """The page export's rule: tables with the earliest heading among the five blocks before them. blocks are those of block_tables."""
    near = decode.near_heading(blocks).where("type = 'table'").select("page_id", F.col("id").alias("parent_id"), "pos", F.coalesce("heading", F.lit("")).alias("heading"))
    rows = blocks.where("type = 'table_row'").groupBy("page_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"]).alias("rows"))
    return near.join(rows, ["page_id", "parent_id"], "left").select("page_id", "pos", "heading", F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows"))
