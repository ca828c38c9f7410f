"""A Merkle manifest of a table: per-source trees, a tree over their roots, and a proof for every row.

Levels are built by sibling shifts. A node's index over the fan-out is its parent's index, the remainder is its slot.
The node in slot zero computes its siblings' indices by slot offsets, an equijoin on (tree, index) fetches them, and the
slot-zero row, which then has its whole run in order, emits the parent. Runs are kept, so that proofs are read off them
from the root down: a row's path is its run's place beside the path of its parent. All joins are on unique keys, so a
source that holds most rows is no hot key, and every level is a table in the shared folder.

Cases: null fields are marked in the leaf and differ from empty ones; a null source is a tree of its own, the first; rows
of the same doc_id stand in order of their leaf digests, and equal rows each have a leaf; a null doc_id comes first and is
never tampered with. Very long texts are hashed whole, each where it is read. Other columns are no part of a leaf. An
empty table has no rows and no root.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import Scratch, only
from evidencelake.operators.numbering import placed

FAN = 16
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
#: Every how many of the rows' checksums a copy is tampered with.
EVERY = 5
DIGITS = 64  # of a digest

LOAD = "struct<doc_id: bigint, tampered: string>"  # what leaves carry besides their digest
#: What stands beside a node and its ancestors, upwards: the digests to the left and to the right, in one string each.
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    plain = value.cast("string")
    return F.when(plain.isNull(), "-").otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (a key that orders sources, null first), leaf and tampered: the leaf of a tampered copy, null where there is none."""
    rows = only(docs, **FIELDS)
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    other = digest(*head, field(F.translate("text", ascii_uppercase, ascii_lowercase)))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    return rows.select("doc_id", tree.alias("tree"), digest(*head, field(F.col("text"))).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % EVERY == 0, other).alias("tampered"))


def runs_of(nodes: DataFrame, fan: int) -> DataFrame:
    """tree, size (nodes of its level), parent (index) and run: index, digest and load of up to fan consecutive nodes in slot order.

    nodes has tree, size, index, digest and load, a row for each node of one level.
    """
    siblings = F.explode(F.sequence(F.col("index"), F.least(F.col("index") + (fan - 1), F.col("size") - 1)))
    wanted = nodes.where(F.col("index") % fan == 0).select("tree", "size", F.expr(f"index div {fan}").alias("parent"), siblings.alias("index"))
    found = wanted.join(nodes.select("tree", "index", "digest", "load"), ["tree", "index"])
    return found.groupBy("tree", "size", "parent").agg(F.array_sort(F.collect_list(F.struct("index", "digest", "load"))).alias("run"))


def parents_of(runs: DataFrame, fan: int) -> DataFrame:
    """The nodes of the next level."""
    up = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
    return runs.select("tree", F.expr(f"(size + {fan - 1}) div {fan}").alias("size"), F.col("parent").alias("index"), up.alias("digest"), F.lit(None).cast(LOAD).alias("load"))


def build(nodes: DataFrame, scratch: Scratch, name: str, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level, and for each level the roots (tree, subroot) of the trees that end there.

    There are as many levels as the largest tree has: the logarithm of its size.
    """
    runs, roots = [], []
    while True:
        roots.append(nodes.where("size = 1").select("tree", F.col("digest").alias("subroot")))
        if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
            return runs, roots
        level = len(runs)
        runs.append(scratch.keep(runs_of(nodes.where("size > 1"), fan), f"{name}-runs-{level}"))
        nodes = scratch.keep(parents_of(runs[-1], fan), f"{name}-nodes-{level + 1}")


def beside(slot: Column) -> Column:
    """The digests to the left and to the right of a slot of joined, the run's digests in one string."""
    return F.struct(F.substring("joined", F.lit(1), slot * DIGITS).alias("left"), F.substring("joined", (slot + 1) * DIGITS + 1, F.length("joined")).alias("right"))


def spread(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each node of the runs: tree, subroot, index, digest, load, step (what stands beside it), its parent's path, and above: that in one string."""
    held = runs.join(paths.withColumnRenamed("index", "parent"), ["tree", "parent"])
    each = held.select(
        "tree", "subroot", "path", F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "").alias("above"),
        F.array_join(F.transform("run", lambda x: x["digest"]), "").alias("joined"), F.posexplode("run").alias("slot", "node"),
    )
    return each.select("tree", "subroot", "node.index", "node.digest", "node.load", beside(F.col("slot")).alias("step"), "path", "above")


def paths_above(runs: list[DataFrame], roots: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """tree, subroot, index and path of the nodes of level 1, from tops: tree, subroot and path of every root."""
    ended = lambda level: tops.join(roots[level].select("tree"), "tree").select("tree", "subroot", F.lit(0).cast("long").alias("index"), "path")
    paths = ended(len(runs))
    for level in range(len(runs) - 1, 0, -1):
        below = spread(runs[level], paths).select("tree", "subroot", "index", F.concat(F.array("step"), "path").alias("path"))
        paths = scratch.keep(below.unionByName(ended(level)), f"{name}-paths-{level}")
    return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a digest leads to, with what stands beside it on each level."""
    return F.aggregate(path, start, lambda own, x: digest(x["left"], own, x["right"]))


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot (of the source), root, proof_sha256 (the digest of the row's siblings, from its run up to the
    root), folded_root (recomputed from the tampered copy's leaf where there is one) and verified."""
    scratch = Scratch(docs.sparkSession)
    given = scratch.keep(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    number = iter(range(9))
    keep = lambda df: scratch.keep(df, f"placed-{next(number)}")
    at = placed(given, ["doc_id", "leaf", "row"], "index", ["tree"], keep, total="size")
    nodes = scratch.keep(at.select("tree", "size", "index", F.col("leaf").alias("digest"), F.struct("doc_id", "tampered").alias("load")), "nodes-0")
    runs, roots = build(nodes, scratch, "source", fan)
    every = scratch.keep(reduce(DataFrame.unionByName, roots), "subroots")
    listed = scratch.keep(placed(every, ["tree"], "index", keep=keep, total="size"), "listed")
    top_runs, top_roots = build(listed.select(F.lit("").alias("tree"), "size", "index", F.col("subroot").alias("digest"), F.lit(None).cast(LOAD).alias("load")), scratch, "top", fan)
    found = top_roots[-1].first()
    root = F.lit(found[1] if found else None).cast("string")
    nothing = F.array().cast(PATH)
    if top_runs:
        start = top_roots[-1].select("tree", "subroot", nothing.alias("path"))
        places = spread(top_runs[0], paths_above(top_runs, top_roots, start, scratch, "top")).select("index", F.concat(F.array("step"), "path").alias("path"))
        tops = scratch.keep(listed.join(places, "index").select("tree", "subroot", "path"), "tops")
    else:
        tops = listed.select("tree", "subroot", nothing.alias("path"))
    alone = nodes.where("size = 1").join(tops, "tree").select(
        "subroot", "digest", "load", F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "").alias("siblings"), F.col("load.tampered").alias("changed"), "path",
    )
    proven = alone.withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("path"))).drop("changed")
    if runs:
        each = spread(runs[0], paths_above(runs, roots, tops, scratch, "source"))
        up = digest(F.col("step.left"), F.coalesce("load.tampered", "digest"), F.col("step.right"))
        more = each.select("subroot", "digest", "load", F.concat("step.left", "step.right", "above").alias("siblings"), "path", folded(up, F.col("path")).alias("folded_root"))
        proven = proven.unionByName(more)
    return proven.select(
        F.col("load.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", F.coalesce(F.col("folded_root") == root, F.lit(False)).alias("verified"),
    )
