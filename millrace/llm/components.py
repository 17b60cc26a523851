"""Connected components of an edge table, by contraction in rounds.

Each round gives every node a fresh pseudo-random rank, joins it to its lowest
ranked neighbour, relabels the edges and drops loops and repeats. Random ranks
make the number of rounds logarithmic whatever the order of the ids, and a star
of any size falls together in two. Rounds are written to the shared folder, so
a lost executor never replays them, and deleted when the result is written. All
joins are plain equi-joins that adaptive execution may split; no neighbour list
is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import scratch, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Null ends, loops and repeated edges are harmless; without edges the result is empty.
    The result is written to ``folder``, or to the shared folder.
    """
    with scratch(edges.sparkSession, "cc") as inner:
        return written(_contracted(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), inner), "cc", folder=folder)


def _contracted(edges: DataFrame, folder: str) -> DataFrame:
    edges = edges.where("a is not null and b is not null and a <> b").distinct()
    edges = written(edges, "cc-edges", folder=folder)
    steps, salt = [], 0
    while edges.limit(1).count():
        rank = lambda c, salt=salt: F.struct(F.xxhash64(F.lit(salt), c).alias("rank"), c.alias("node"))
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ends.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low")).select(F.col("a").alias("node"), F.least(F.col("low"), rank(F.col("a"))).node.alias("to"))
        lowest = written(lowest, f"cc-step-{salt}", folder=folder)
        steps.append(lowest)
        left = lowest.toDF("a", "to_a")
        right = lowest.toDF("b", "to_b")
        moved = edges.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = written(moved.where("a <> b").distinct(), f"cc-edges-{salt}", folder=folder)
        salt += 1
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].toDF("node", "root")
    for step in reversed(steps[:-1]):
        found = step.join(found.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    found = written(found, "cc-roots", folder=folder)
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(smallest, "root").select("node", "component")
