"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, jaccard, lattice, length_packing, line_dedup, orchard, packing, periodic_runs, pii, suffix_dedup, token_store, toxicity, url_rules
from millrace.session import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path).drop("ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.planted(table(spark, sf_dir, "documents")))


def op13_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.pack(table(spark, sf_dir, "documents"))


REGISTERED = (
    op1_pii,
    op2_token_store,
    op3_line_dedup,
    op4_suffix_dedup,
    op5_packing,
    op6_lattice,
    op7_url_rules,
    op8_toxicity,
    op9_jaccard,
    op10_decontam,
    op11_orchard,
    op12_periodic_runs,
    op13_length_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {"op11_orchard": orchard.SQL}
