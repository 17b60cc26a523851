"""Quotas, splits and mixes that are exact and repeatable.

Order inside a stratum is a digest of a seed and the row's key, so results do
not depend on partitions or on the process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int = 42) -> Column:
    """Pseudo-random rank of a key; ties are broken by the caller's key."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def quotas(weights: DataFrame, total: int | Column, within: list[str] | None = None) -> DataFrame:
    """Adds ``quota`` by largest remainders: floors first, the rest to the largest fractions, ties by ``category``."""
    exact = F.round(F.col("weight") * total, 9)
    group = Window.partitionBy(*(within or [F.lit(0)]))
    rank = F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.desc("_rest"), "category"))
    base = weights.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    goal = total if isinstance(total, Column) else F.lit(total)
    lack = goal - F.sum("_floor").over(group)
    return base.withColumn("quota", (F.col("_floor") + F.when(rank <= lack, 1).otherwise(0)).cast("long")).drop("_floor", "_rest")


def ranked(df: DataFrame, key: str, stratum: str | None, seed: int = 42) -> DataFrame:
    """Adds ``_k``, the row's rank in its stratum in seeded order, and ``_n``, the size of the stratum.

    Rows are ranked inside the 4,096 ranges of the digest's first digits, and
    the rows of the ranges before are added, so no task sorts a whole stratum.
    What is ordered per stratum is one row per range.
    """
    groups = [stratum] if stratum else []
    rows = df.withColumn("_rank", shuffled(F.col(key), seed)).withColumn("_range", F.substring("_rank", 1, 3))
    sizes = rows.groupBy(*groups, "_range").agg(F.count("*").alias("_rows"))
    inside = Window.partitionBy(*(groups or [F.lit(0)]))
    before = sizes.select(*groups, "_range", (F.sum("_rows").over(inside.orderBy("_range")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(inside).alias("_n"))
    names = {c: f"_own_{c}" for c in groups}
    met = before.withColumnsRenamed(names)
    same = F.col("_range") == F.col("_own_range")
    for c, own in names.items():
        same &= F.col(c).eqNullSafe(F.col(own))
    placed = rows.join(met.withColumnRenamed("_range", "_own_range"), same)
    k = F.col("_before") + F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_rank", key))
    return placed.withColumn("_k", k).drop("_rank", "_range", "_own_range", "_before", *names.values())


def stratified(df: DataFrame, key: str, stratum: str, validation: float = 0.05, test: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``. Strata of one row train; of two, the last validates; of three or four, the last two validate and test; else at least one each."""
    n, k = F.col("_n"), F.col("_k")
    share = lambda r: F.greatest(F.lit(1), F.round(n * F.lit(r)).cast("int"))
    v = F.when(n == 1, 0).when(n < 5, 1).otherwise(share(validation))
    s = F.when(n < 3, 0).when(n < 5, 1).otherwise(share(test))
    return ranked(df, key, stratum, seed).withColumn("split", F.when(k > n - s, "test").when(k > n - s - v, "validation").otherwise("train")).drop("_k", "_n")


def ratio_split(df: DataFrame, key: str, train: float, validation: float, seed: int = 42) -> DataFrame:
    """Adds ``split`` with exactly int(n*train) and int(n*validation) rows of the first two."""
    first = F.floor(F.col("_n") * F.lit(train))
    second = first + F.floor(F.col("_n") * F.lit(validation))
    return ranked(df, key, None, seed).withColumn("split", F.when(F.col("_k") <= first, "train").when(F.col("_k") <= second, "validation").otherwise("test")).drop("_k", "_n")


def group_split(df: DataFrame, group: str, train: float = 0.9, validation: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``; all rows of a group share one.

    Groups in seeded order fill train, then validation, then test: a group
    goes where the rows before it end. Only group sizes are ordered, ranked in
    two levels like :func:`ranked`.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_size")).withColumn("_rank", shuffled(F.col(group), seed))
    sizes = sizes.withColumn("_bucket", F.substring("_rank", 1, 2))
    parts = sizes.groupBy("_bucket").agg(F.sum("_size").alias("_n"))
    before = parts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = sizes.join(F.broadcast(before), "_bucket")  # one row per bucket, 256 at most
    start = F.col("_before") + F.sum("_size").over(Window.partitionBy("_bucket").orderBy("_rank", group)) - F.col("_size")
    split = F.when(start < F.col("_all") * F.lit(train), "train").when(start < F.col("_all") * F.lit(round(train + validation, 9)), "validation").otherwise("test")
    return df.join(placed.withColumn("_start", start).select(group, split.alias("split")), group)


def take(df: DataFrame, key: str, stratum: str, wanted: DataFrame, seed: int = 42) -> DataFrame:
    """The first ``quota`` rows of each stratum in seeded order; ``wanted`` has category and quota."""
    return ranked(df, key, stratum, seed).join(wanted.select(F.col("category").alias(stratum), "quota"), stratum).where("_k <= quota").drop("_k", "_n", "quota")
