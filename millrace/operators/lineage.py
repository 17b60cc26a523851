"""Depths in a table of parents.

Every row points at its parent. In each round a pointer jumps to what its target
points at, so there are as many rounds as the logarithm of the longest chain, and
a round reads every row once, whatever the length of chains. Joins are plain
equi-joins that adaptive execution splits where many rows point at one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def depths(edges: DataFrame) -> DataFrame:
    """id and depth of rows (id, parent): how many rows the chain from a row upwards holds, itself included.

    A chain ends where no row has the parent as its id; chains must end. An id
    with several parents has the depth of its longest chain; null ids are no
    parents.
    """
    edges = written(edges.select("id", "parent").distinct(), "lineage-edges")
    known = edges.select(F.col("id").alias("parent"), F.lit(True).alias("held")).distinct()
    state = edges.join(known, "parent", "left").select("id", F.when(F.col("held"), F.col("parent")).alias("up"), F.lit(1).alias("depth"))
    state = written(state, "lineage")
    while state.where("up is not null").limit(1).count():
        ahead = state.toDF("up", "next", "more")
        jumped = state.where("up is not null").join(ahead, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        state = written(state.where("up is null").unionByName(jumped), "lineage")
    return state.groupBy("id").agg(F.max("depth").alias("depth"))
