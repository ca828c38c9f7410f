"""The trie of conversations' common beginnings, with totals of every subtree by parallel tree contraction.

A turn's place and digest make two 64-bit lanes; a prefix is known by the lanes of its turns combined by exclusive or, so
that prefixes are running totals, which range partitions compute side by side. The trie is then contracted in rounds.
Rake: leaves hand their totals to their parents. Compress: of two neighbours in a unary chain one is taken out, its child
moves up and carries its weight on the way. Which one is tossed by a bit of the depth, as long as there are bits, so that
a chain halves each round, and then by a hash. Every round is one table in the shared folder. When all nodes are gone,
the nodes taken out of chains are put back in reverse order, each with its child's total.

Cases: a null conv_id takes no part; turns stand by turn (null first), then by digest; repeated rows are turns of their
own; null roles and texts are empty; other columns are left out; an empty table has no nodes, not even a root. Texts are
only hashed, where they are read. No step gathers a conversation, a node's members or a parent's children in one task but
for the digest of a node's ends, which one task reads from pieces of some thousand ids each, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import Scratch, only, partitions
from evidencelake.operators.numbering import placed

BORROWED = 9  # a conversation borrows fewer turns than this
NEAR = 5  # conversations that borrow from the same one
EMPTY = hashlib.sha256(b"").hexdigest()
TOTALS = ("n_leaves", "saved_tokens")


def node_id(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def narrow(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (digest of role and text) and n_bytes of each row."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null").na.fill("", ["role", "text"])
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select("conv_id", "turn", said.alias("said"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, pos, last, n_bytes and the lanes a and b), and conv_id and length of all."""
    rows = scratch.keep(narrow(conversations).withColumn("row", F.monotonically_increasing_id()), "rows")
    number = iter(range(9))
    turns = scratch.keep(placed(rows, ["turn", "said", "row"], "pos", ["conv_id"], lambda df: scratch.keep(df, f"placed-{next(number)}")), "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(NEAR))).alias("lender"))
    lent = sizes.select(F.col("conv_id").alias("lender"), F.col("n").alias("there"))
    borrowed = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(lent, "lender", "left").select("conv_id", "lender", "h", borrowed.alias("borrowed"), (borrowed + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = scratch.keep(convs, "convs")
    lenders = turns.where((F.pmod("conv_id", F.lit(NEAR)) == 0) & (F.col("pos") < BORROWED - 1)).withColumnRenamed("conv_id", "lender")
    taken = convs.where("h > 0").join(lenders, "lender").where("pos < h").select("conv_id", "pos", "length", "said", "n_bytes")
    own = turns.where(F.col("pos") >= h).join(convs, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("borrowed")).alias("pos"), "length", "said", "n_bytes")
    lanes = [F.xxhash64("pos", "said").alias("a"), F.xxhash64("said", "pos", F.lit("b")).alias("b")]
    return taken.unionByName(own).select("conv_id", "pos", (F.col("pos") == F.col("length") - 1).alias("last"), "n_bytes", *lanes), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, last, n_bytes, id (of the prefix that ends with the turn) and parent (of the one before).

    Running totals like those of numbering.placed: within runs, behind the totals of the runs before.
    """
    n = partitions(turns.sparkSession)
    dealt = scratch.keep(turns.repartitionByRange(n, "conv_id", "pos").sortWithinPartitions("conv_id", "pos").withColumn("part", F.spark_partition_id()), "dealt")
    run = Window.partitionBy("part", "conv_id").orderBy("pos")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each partition
    totals = dealt.groupBy("part", "conv_id").agg(F.bit_xor("a").alias("run_a"), F.bit_xor("b").alias("run_b"))
    starts = totals.select("part", "conv_id", *(F.coalesce(F.bit_xor(f"run_{x}").over(earlier), F.lit(0)).alias(f"start_{x}") for x in "ab"))
    within = dealt.select("*", *(F.bit_xor(x).over(run).alias(f"in_{x}") for x in "ab"))
    ends = {x: F.col(f"in_{x}").bitwiseXOR(F.col(f"start_{x}")) for x in "ab"}
    own = node_id(ends["a"], ends["b"])
    parent = node_id(*(ends[x].bitwiseXOR(F.col(x)) for x in "ab"))
    return within.join(starts, ["part", "conv_id"]).select("conv_id", (F.col("pos") + 1).alias("depth"), "last", "n_bytes", own.alias("id"), parent.alias("parent"))


def contracted(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The rounds of contraction, as tables of nodes with a status: raked, compressed or stays.

    nodes has id, parent, depth, degree and the totals' own parts. Of a round's row, the totals are what the node has
    gathered so far; carried is what it takes along to its parent beside its own total; child and child_carried are of
    the one child left to a compressed node.
    """
    zero = F.struct(*(F.lit(0).cast("long").alias(t) for t in TOTALS))
    state = nodes.select("id", "parent", "depth", (F.col("degree") == 0).alias("leaf"), F.struct(*TOTALS).alias("total"), zero.alias("carried"))
    bits = (nodes.agg(F.max("depth")).first()[0] or 0).bit_length()
    rounds: list[DataFrame] = []
    plus = lambda *parts: F.struct(*(reduce(Column.__add__, (p[t] for p in parts)).alias(t) for t in TOTALS))
    while True:
        k = len(rounds)
        coin = (lambda depth, own, k=k: F.shiftright(depth, k).bitwiseAND(F.lit(1)) == 1) if k < bits else (lambda depth, own, k=k: F.pmod(F.xxhash64(own, F.lit(k)), F.lit(2)) == 1)
        tossed = coin(F.col("depth"), F.col("id"))
        row = F.struct("parent", "depth", "leaf", "total", "carried", tossed.alias("coin"))
        to_parent = F.struct(
            F.col("parent").alias("key"), F.lit(None).cast(_kind(state.select(row.alias("x")))).alias("own"),
            F.when(F.col("leaf"), plus(F.col("total"), F.col("carried"))).alias("handed"), F.when(~F.col("leaf"), F.struct("id", "carried", tossed.alias("coin"))).alias("child"),
        )
        to_self = F.struct(F.col("id").alias("key"), row.alias("own"), F.lit(None).cast(_kind(state.select(F.col("total")))).alias("handed"), F.lit(None).cast(_kind(state.select(F.struct("id", "carried", tossed.alias("coin")).alias("x")))).alias("child"))
        told = state.select(F.inline(F.array(to_self, to_parent))).where("key is not null")
        met = told.groupBy("key").agg(
            F.max("own").alias("own"), F.count("child").alias("children"), F.max("child").alias("child"), *(F.coalesce(F.sum(f"handed.{t}"), F.lit(0)).alias(t) for t in TOTALS),
        )
        chain = F.col("own.parent").isNotNull() & (F.col("children") == 1) & F.col("own.coin") & ~F.col("child.coin")
        after = met.select(
            F.col("key").alias("id"), "own.parent", "own.depth", (F.col("children") == 0).alias("leaf"), plus(F.col("own.total"), F.struct(*TOTALS)).alias("total"), "own.carried",
            F.when(F.col("own.leaf"), "raked").when(chain, "compressed").otherwise("stays").alias("status"), F.col("child.id").alias("child"), F.col("child.carried").alias("child_carried"),
        )
        rounds.append(scratch.keep(after, f"round-{k}"))
        if rounds[-1].where("status = 'stays'").isEmpty():
            return rounds
        gone = rounds[-1].where("status = 'compressed'").select(F.col("child").alias("id"), F.col("parent").alias("higher"), plus(F.col("total"), F.col("carried")).alias("more"))
        state = rounds[-1].where("status = 'stays'").join(gone, "id", "left").select(
            "id", F.coalesce("higher", "parent").alias("parent"), "depth", "leaf", "total", F.when(F.col("more").isNull(), F.col("carried")).otherwise(plus(F.col("carried"), F.col("more"))).alias("carried"),
        )


def _kind(one: DataFrame) -> str:
    return one.schema[0].dataType.simpleString()


def expanded(rounds: list[DataFrame], scratch: Scratch) -> DataFrame:
    """id and the totals of every node's subtree: raked nodes have theirs, compressed ones get their child's, the last first."""
    known = [r.where("status = 'raked'").select("id", "total.*") for r in rounds]
    for k in range(len(rounds) - 1, -1, -1):
        back = rounds[k].where("status = 'compressed'")
        if back.isEmpty():
            continue
        below = reduce(DataFrame.unionByName, known).withColumnRenamed("id", "child")
        totals = [(F.col(f"total.{t}") + F.col(f"child_carried.{t}") + F.col(t)).alias(t) for t in TOTALS]
        known.append(scratch.keep(back.join(below, "child").select("id", *totals), f"back-{k}"))
    return reduce(DataFrame.unionByName, known)


def ends_digest(ends: DataFrame) -> DataFrame:
    """id and ends_sha256: the digest of a node's conv_ids in ascending order, joined by commas.

    Range partitions write the ids of a node as texts of up to a batch each; only those texts meet in one task, as a stream.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "conv_id")), strict=True):
                found.setdefault((a, b), []).append(c)
            keys = list(found)
            yield pa.record_batch(
                {"a": pa.array([k[0] for k in keys], pa.int64()), "b": pa.array([k[1] for k in keys], pa.int64()), "first": pa.array([found[k][0] for k in keys], pa.int64()), "ids": pa.array([",".join(map(str, found[k])) for k in keys], pa.string())}
            )

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ids")), strict=True):
                if (a, b) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digests(out)
        yield _digests([(*key, digest.hexdigest())] if key else [])

    n = partitions(ends.sparkSession)
    flat = ends.select("id.a", "id.b", "conv_id")
    texts = flat.repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(pieces, "a long, b long, first long, ids string")
    found = texts.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digests, "a long, b long, ends_sha256 string")
    return found.select(node_id(F.col("a"), F.col("b")).alias("id"), "ends_sha256")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ends_sha256": pa.array(d, pa.string())})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    scratch = Scratch(conversations.sparkSession)
    turns, convs = rebuilt(conversations, scratch)
    reached = scratch.keep(prefixes(turns, scratch), "prefixes")
    root = node_id(*(F.lit(0).cast("long") for _ in "ab"))
    below = reached.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").cast("long").alias("depth"), F.min("parent").alias("parent"), F.min("n_bytes").alias("n_bytes"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("id"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(_kind(below.select("parent"))).alias("parent"), F.lit(0).cast("long").alias("n_bytes"),
    )
    found = scratch.keep(below.unionByName(top), "found")
    children = found.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = found.join(children, "id", "left").na.fill(0, ["n_children"])
    own = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")]
    nodes = scratch.keep(nodes.select("id", "parent", "depth", "conv_id", "n_convs", F.col("n_children").alias("degree"), *own), "nodes")
    totals = expanded(contracted(nodes, scratch), scratch)
    ends = ends_digest(reached.where("last").select("id", "conv_id").unionByName(convs.where("length = 0").select(root.alias("id"), "conv_id")))
    whole = nodes.drop(*TOTALS).join(totals, "id").join(ends, "id", "left")
    # the root, of which any share of all nodes may be children, is one row; other hot parents Spark splits
    high = whole.where("depth <= 1").crossJoin(F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv")))).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv"))).drop("root_conv")
    low = whole.where("depth > 1").join(nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return high.unionByName(low).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("degree").alias("n_children"), *TOTALS, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
