"""Connected components of an edge table by repeated contraction; nothing is gathered on the driver.

Each round hooks every node to its smallest neighbour, shortens the pointers once and relabels the edges;
loops and repeated edges go. The number of roots falls by half or more each round. Edges are first thinned
to a spanning forest within each partition, and few remaining edges are finished in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.text_kernels import trim

#: Edges that one task may finish, and edges a task holds at once when it thins them.
FINISH, HELD = 200_000, 1 << 18


class Forest:
    """Union-find over integers; a root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def rows(self) -> pa.RecordBatch:
        nodes = [x for x in self.up if self.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([self.find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of each partition, the smallest member first."""

    def run(batches):
        forest = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.join(x, y)
            if len(forest.up) > HELD:
                yield forest.rows()
                forest = Forest()
        yield forest.rows()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> (node, component) for every node of an edge; component is its smallest node.

    Rows with a null end are left out; loops count as nodes; an empty table gives no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    spark, began = edges.sparkSession, scratch.mark()
    current = scratch.saved(thinned(edges).where("a <> b"), f"{name}-edges")
    labels = None
    while True:
        n = current.count()
        if n == 0:
            break
        if n <= FINISH:
            step = thinned(current.repartition(1)).select(F.col("b").alias("node"), F.col("a").alias("root"))
            current = None
        else:
            both = current.union(current.select("b", "a"))
            hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
            hook = scratch.saved(hook, f"{name}-hooks")
            moved = hook.where("node <> root")
            next_ = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = moved.join(next_, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        step = scratch.saved(step, f"{name}-step")
        if labels is None:
            labels = step
        else:
            over = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            kept = labels.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            labels = scratch.saved(kept.unionByName(step.join(labels.select("node"), "node", "left_anti")), f"{name}-labels")
        if current is None:
            break
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_up"))
        moved = current.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        current = scratch.saved(thinned(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), f"{name}-edges")
        scratch.cleared(spark, began, current, labels)
    if labels is None:
        labels = edges.sparkSession.createDataFrame([], "node long, root long")
    moved = labels.select("node", F.col("root").alias("component"))
    # A root is no node of the label table; it stands for itself.
    roots = moved.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return moved.unionByName(roots)


def sorted_groups(batches, key: int = 0):
    """(key, table) for each run of equal keys in batches sorted by a column; a run may span batches."""
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if held and keys[lo] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)
    trim()
