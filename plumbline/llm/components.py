"""Connected components by repeated contraction, everything in tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import write_once


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b): any order, repeats and loops allowed, no nulls. Returns (node, root) for every
    node of an edge between two different nodes; nodes of one component share their root, which is one of them.

    Each round, every node is replaced by that of its neighbours and itself which a hash puts first,
    so a path of any length shrinks by a constant factor; the links that remain go to the next round.
    Minima are combined before the shuffle, and joins read tables afresh, so adaptive execution
    can split the rows of a node with many links. No edge: no row.
    """
    left = write_once(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("node"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("to"))
        step = first.select("node", F.least("to", rank("node"))["node"].alias("root"))
        steps.append(write_once(step, f"{name}-step"))
        to = steps[-1]
        moved = left.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a") \
            .join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        left = write_once(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if not steps:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("a").alias("root")).schema)
    roots = steps.pop()
    while steps:
        later = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        roots = write_once(steps.pop().join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), f"{name}-roots")
    return roots
