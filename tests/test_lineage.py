"""Depths by jumping pointers."""

from pyspark.sql import functions as F

from millrace.operators.lineage import depths


def test_more_rows_than_a_recursive_query_may_make(spark):
    ids = spark.range(1, 200_001)  # two million steps; Spark's recursion ends in an error at one million rows
    found = depths(ids.selectExpr("id", "id div 2 AS parent"))
    wrong = found.where(F.col("depth") != F.length(F.bin("id")))
    assert (found.count(), wrong.count()) == (200_000, 0)


def test_long_chains_gaps_and_several_parents(spark):
    chain = [(k, k - 1) for k in range(1, 301) if k != 150]  # deeper than a hundred levels
    rows = [*chain, (1000, 10), (1000, 200), (1000, 200), (None, 5), (2000, None)]
    found = {r.id: r.depth for r in depths(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert (found[149], found[151], found[300], found[1000], found[2000], found[None]) == (149, 1, 150, 51, 1, 6)
    assert depths(spark.createDataFrame([], "id long, parent long")).count() == 0
