"""Exact top-k search by inner product with M-trees.

Candidates are dealt by a hash into shards of bounded size and queries into blocks; each task
bulk-loads an M-tree over one shard and answers one block. A node pages at most LEAF vectors
around a routing vector and stores its covering radius and its distance to the parent's routing
vector. By the triangle inequality no vector x below a node with centre c and radius r scores
more than q.c + |q| r, and none below a child at distance d from its parent p more than
q.p + |q| (d + r): the second bound is tested first, so q.c is only computed where it may help.
Nodes are opened best bound first; a query leaves a node's list once its k-th score is higher.

The work is queries times candidates in blocks, less what the bounds spare. Shards depend on the
number of rows alone, so equal vectors, however many, are spread evenly.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do
null ids; vectors of other dimensions than the query's are no candidates of it; ties go to the
smaller vec_id; a row is never its own candidate, nor are repeated rows of the same vec_id; of
repeated candidate rows each counts; a score beyond 64 bits counts as the nearest that they can hold; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4096  # candidates of a task
BLOCK = 4096  # queries of a task
TOGETHER = 256  # queries that search side by side
LEAF = 128
SCALE = 64
LIMIT = (1 << 63) - 1  # of a score, either way


class Node:
    __slots__ = ("centre", "children", "ids", "parent_distance", "radius", "rows")

    def __init__(self, rows: np.ndarray, ids: np.ndarray, parent: np.ndarray | None):
        middle = rows.mean(0)
        self.centre = rows[((rows - middle) ** 2).sum(1).argmin()]
        away = np.sqrt(((rows - self.centre) ** 2).sum(1))
        self.radius = float(away.max())
        self.parent_distance = 0.0 if parent is None else float(np.sqrt(((self.centre - parent) ** 2).sum()))
        self.children: list[Node] = []
        self.rows, self.ids = rows, ids

    def divide(self) -> None:
        """Moves the rows of a node that holds too many to children, the largest of which has three quarters of them at most."""
        rows, ids = self.rows, self.ids
        seeds = [self.centre]
        nearest = ((rows - self.centre) ** 2).sum(1)
        while len(seeds) < 8 and nearest.max() > 0:  # farthest-first routing vectors
            seeds.append(rows[nearest.argmax()])
            nearest = np.minimum(nearest, ((rows - seeds[-1]) ** 2).sum(1))
        s = np.array(seeds)
        own = ((s**2).sum(1)[None, :] - 2 * rows @ s.T).argmin(1)
        parts = [np.flatnonzero(own == k) for k in range(len(s))]
        if 4 * max(map(len, parts)) > 3 * len(rows):  # a few vectors far out: halves along the line to the farthest one
            along = rows @ (s[1] - s[0]) if len(s) > 1 else np.zeros(len(rows))
            parts = np.array_split(np.argsort(along, kind="stable"), 2)
        self.children = [Node(rows[p], ids[p], self.centre) for p in parts if len(p)]
        self.rows = self.ids = None


def tree(rows: np.ndarray, ids) -> Node:
    """An M-tree over the rows, divided until no leaf holds more than LEAF."""
    root = Node(rows, ids, None)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) > LEAF:
            node.divide()
            todo += node.children
    return root


def search(root: Node, queries: np.ndarray, query_ids: np.ndarray, k: int, width: int) -> np.ndarray:
    """The k best of a tree for each query, best first, as score * width - position; absent ones are the least int64.

    width exceeds every position, so that one number orders by score and then by smaller vec_id.
    """
    least = np.iinfo(np.int64).min
    best = np.full((len(queries), k), least)
    bar = np.full(len(queries), -np.inf)  # the k-th score so far; a node must reach it, as ties may win
    norm = np.sqrt((queries**2).sum(1)) * (1 + 1e-9) + 1e-9
    order = count()
    everyone = np.arange(len(queries))
    dots = queries @ root.centre
    heap = [(-np.inf, next(order), root, everyone, dots, dots + norm * root.radius)]
    while heap:
        _, _, node, active, dots, bound = heapq.heappop(heap)
        alive = bound >= bar[active]
        if not alive.any():
            continue
        active, dots = active[alive], dots[alive]
        if node.children:
            for child in node.children:
                may = dots + norm[active] * (child.parent_distance + child.radius) >= bar[active]
                if may.any():
                    some = active[may]
                    to_child = queries[some] @ child.centre
                    limit = to_child + norm[some] * child.radius
                    heapq.heappush(heap, (-float((limit - np.maximum(bar[some], -1e300)).max()), next(order), child, some, to_child, limit))
            continue
        ids, position = node.ids
        scores = np.rint(queries[active] @ node.rows.T).astype(np.int64) * width - position
        scores[query_ids[active][:, None] == ids[None, :]] = least
        merged = np.hstack([best[active], scores])
        if merged.shape[1] > k:
            merged = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        best[active] = merged
        kth = merged.min(1)
        bar[active] = np.where(kth == least, -np.inf, -((-kth) // width))
    return -np.sort(-np.maximum(best, least + 1), axis=1)


def scaled(x: float) -> int:
    """floor(64 x) of any finite x; from 1e16 on a double is whole."""
    return math.floor(x) * SCALE if abs(x) >= 1e16 else math.floor(x * SCALE)


class _Tagged:
    """vec_ids with their positions in order, sliced together."""

    def __init__(self, ids: np.ndarray, position: np.ndarray):
        self.ids, self.position = ids, position

    def __getitem__(self, at):
        return _Tagged(self.ids[at], self.position[at])

    def __iter__(self):
        return iter((self.ids, self.position))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest integer inner products.

    Both frames have vec_id and embedding; components count as floor(64 x).
    """

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(fine).select("id", F.col("e").alias("v"), F.size("e").alias("dim"))

    candidates, asked = usable(vectors), usable(queries)
    shards = max(1, -(-candidates.count() // SHARD))
    blocks = max(1, -(-asked.count() // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("shard", F.pmod(F.hash("id", F.lit(11)), F.lit(shards))).withColumn("block", each(blocks))
    right = asked.withColumn("block", F.pmod(F.hash("id", F.lit(12)), F.lit(blocks))).withColumn("shard", each(shards))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t["id"].to_numpy()
        flat = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat[order]

    def run(own: pa.Table, q: pa.Table) -> pa.Table:
        if not own.num_rows or not q.num_rows:
            return schema.empty_table()
        ids, given = matrix(own)
        query_ids, asked_given = matrix(q)
        with np.errstate(over="ignore"):
            rows, asked_rows = np.floor(given * SCALE), np.floor(asked_given * SCALE)
            largest = max(1.0, float(np.abs(rows).max())) * max(1.0, float(np.abs(asked_rows).max())) * rows.shape[1]
        out: list[np.ndarray] = []
        if largest >= 1 << 49:  # beyond exact doubles: whole numbers of any size, row by row
            whole, asked_whole = ([[scaled(x) for x in v] for v in m.tolist()] for m in (given, asked_given))
            for qid, v in zip(query_ids.tolist(), asked_whole, strict=True):
                scored = ((max(-LIMIT, min(LIMIT, sum(a * b for a, b in zip(v, x, strict=True)))), -i) for i, x in zip(ids.tolist(), whole, strict=True) if i != qid)
                out += [np.array([[qid, -i, s]], np.int64) for s, i in heapq.nlargest(k, scored)]
        else:
            width = len(ids) + 1
            root = tree(rows, _Tagged(ids, np.arange(len(ids))))
            for at in range(0, len(query_ids), TOGETHER):
                some = query_ids[at : at + TOGETHER]
                best = search(root, asked_rows[at : at + TOGETHER], some, k, width)
                i, j = np.nonzero(best > np.iinfo(np.int64).min + 1)
                found = best[i, j]
                score = -((-found) // width)
                out.append(np.stack([some[i], ids[score * width - found], score], 1))
        table = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.table([pa.array(table[:, c]) for c in range(3)], schema=schema)

    keys = ["dim", "shard", "block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
