"""Release steps: gates with an overall verdict, freezing, file checks, ordered digests, stage checkpoints, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gate(name: str, passes: Column, otherwise: str = "FAIL", critical: bool = True) -> Column:
    """A gate: PASS where ``passes`` holds, else ``otherwise`` (also where a fact is missing)."""
    return F.struct(F.lit(name).alias("gate"), F.when(passes, "PASS").otherwise(otherwise).alias("verdict"), F.lit(critical).alias("critical"))


def judged(facts: DataFrame, gates: Iterable[Column], overall: Callable[[Callable[[str], Column], Column], Column]) -> DataFrame:
    """Rows gate, verdict, critical of one row of facts, and last the row ``overall``.

    ``overall(any_is)`` gives the last verdict, where ``any_is(status)`` tells
    whether any gate, and ``any_is(status, True)`` whether any critical one, has that status.
    """
    made = facts.select(F.array(*gates).alias("gates"))

    def any_is(status: str, critical: bool = False) -> Column:
        return F.exists("gates", lambda g: (g["verdict"] == status) & (g["critical"] | F.lit(not critical)))

    last = F.struct(F.lit("overall").alias("gate"), overall(any_is).alias("verdict"), F.lit(True).alias("critical"))
    return made.select(F.explode(F.concat("gates", F.array(last))).alias("g")).select("g.gate", "g.verdict", "g.critical")


def freeze(gates: DataFrame, files: DataFrame, state: str = "DRAFT", force: bool = False) -> DataFrame:
    """The files (path, digest, ...) with the version's new ``state``: FROZEN, or REFUSED with a reason.

    A version that is FROZEN already, or whose overall verdict is FAIL, is
    refused unless forced. The verdict is one row, so the join is bounded.
    """
    verdict = gates.where("gate = 'overall'").select(F.col("verdict").alias("_verdict"))
    reason = F.when(F.lit(force), F.lit(None).cast("string")).when(F.lit(state == "FROZEN"), "already frozen").when(F.col("_verdict") == "FAIL", "gates failed")
    joined = files.join(F.broadcast(verdict)).withColumn("reason", reason).drop("_verdict")
    return joined.withColumn("state", F.when(F.col("reason").isNull(), "FROZEN").otherwise("REFUSED"))


def verify(catalog: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Every key of either side with its state: ok, mismatch, missing (listed, not found) or unexpected."""
    a = catalog.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = found.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "mismatch").otherwise("ok")
    return a.join(b, key, "full").select(key, state.alias("state"))


def ordered_digest(rows: DataFrame, group: str, order: str, text: Column, step: int = 1000, levels: int = 3) -> DataFrame:
    """n and the digest of each group's texts in the order of an integer column, equal for equal content however it is partitioned.

    A tree instead of one running digest: sha256 over the digests of up to
    ``step`` neighbours, then over those of ``step`` such nodes, and so on, so
    that no task ever holds a whole group. Ties go by digest; null counts as empty.
    """
    node = rows.select(group, F.floor(F.col(order) / step).alias("_at"), F.struct(F.col(order).alias("k"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("d")).alias("_d"), F.lit(1).alias("_n"))
    for level in range(levels):
        last = level == levels - 1
        keys = [group] if last else [group, "_at"]
        digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_d")), lambda d: d["d"]), "").cast("binary"), 256)
        node = node.groupBy(*keys).agg(digest.alias("_s"), F.sum("_n").alias("_n"))
        if not last:
            node = node.select(group, F.floor(F.col("_at") / step).alias("_at"), F.struct(F.col("_at").alias("k"), F.col("_s").alias("d")).alias("_d"), "_n")
    return node.select(group, F.col("_n").alias("n"), F.col("_s").alias("digest"))


def content_digest(df: DataFrame) -> DataFrame:
    """One row: n and an order-free digest of all rows (sums of two hashes), for comparing a table with what was recorded of it."""
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("n"), total(F.xxhash64(*df.columns)).alias("one"), total(F.hash(*df.columns)).alias("two"))


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The stage's stored result if it is whole and unchanged, else a new one; with ``reused``, ``computed`` or ``recomputed``.

    Rows go to a new folder each time; then their digest and that folder's name
    are written to ``folder``/``name``/mark. A mark that is missing, or whose
    digest differs from the rows, means a run that broke off or a changed file.
    Frames read from an earlier version stay readable.
    """
    mark, state = f"{folder}/{name}/mark", "computed"
    try:
        recorded = spark.read.parquet(mark).first()
        if recorded is not None:
            kept = spark.read.parquet(recorded["path"])
            if content_digest(kept).first() == recorded[1:]:
                return kept, "reused"
            state = "recomputed"
    except AnalysisException:  # nothing stored yet, or its rows are gone
        pass
    data = f"{folder}/{name}/rows-{uuid.uuid4().hex}"
    build().write.parquet(data)
    fresh = spark.read.parquet(data)
    content_digest(fresh).select(F.lit(data).alias("path"), "*").write.mode("overwrite").parquet(mark)
    return fresh, state


def markdown(metrics: DataFrame, columns: list[str], title: str) -> DataFrame:
    """Aggregates as the lines of a Markdown report: line and text.

    For the few rows of a report: they meet in one array to be numbered in order.
    """
    listed = metrics.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    row = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(r[c].cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
    text = F.concat(F.array(*[F.lit(h) for h in head]), F.transform("rows", row))
    return listed.select(F.posexplode(text).alias("line", "text")).select(F.col("line").cast("long").alias("line"), "text")
