"""What a caller can add: one of each kind of extension."""

import pytest
from pyspark.sql import functions as F

from millrace.extensions import ADAPTERS, EVALUATORS, STAGES, STRATEGIES, Registry, run_stages
from millrace.operators import adapters as A


def test_names_are_given_once_and_unknown_ones_say_so():
    r = Registry("thing")
    r.register("a")(len)
    with pytest.raises(ValueError, match="twice"):
        r.register("a")(max)
    with pytest.raises(KeyError, match="no thing 'b'; known: a"):
        r["b"]
    assert list(r) == ["a"] and "a" in r and r["a"] is len


def test_a_caller_adds_one_of_each(spark):
    docs = spark.createDataFrame([(1, " a  \r\nb "), (2, "c"), (3, "c"), (4, None)], "doc_id long, text string")

    @STAGES.register("test_shout")
    def shout(df, column="text", mark="!"):
        return df.withColumn(column, F.concat(F.upper(column), F.lit(mark)))

    out = run_stages(docs, [{"name": "normalize_text"}, {"name": "deduplicate"}, {"name": "test_shout", "params": {"mark": "?"}}])
    assert {r.doc_id: r.text for r in out.collect()} == {1: " A\nB?", 2: "C?", 4: "?"}
    assert run_stages(docs, [{"name": "generate_statistics"}]).collect()[0].n_rows == 4
    with pytest.raises(KeyError):
        run_stages(docs, [{"name": "test_shout"}, {"name": "not there"}])

    @STRATEGIES.register("test_first")
    def first(df, key, stratum, total):
        return df.orderBy(key).limit(total)

    rows = docs.withColumn("s", F.when(F.col("doc_id") < 3, "x").otherwise("y"))
    assert [r.doc_id for r in STRATEGIES["test_first"](rows, "doc_id", "s", 2).collect()] == [1, 2]
    assert sorted(r.s for r in STRATEGIES["balanced"](rows, "doc_id", "s", 2).collect()) == ["x", "y"]

    @EVALUATORS.register("test_length")
    def length(text):
        return F.least(F.lit(1.0), F.length(text) / 10)

    assert docs.where("doc_id = 2").select(EVALUATORS["test_length"](F.col("text")).alias("q")).collect()[0].q == 0.1

    @ADAPTERS.register("test_shouted")
    def shouted(raw, source=A.Source()):
        return A.human_authored(F.upper(raw), source)

    assert A.adapter_of("internal") is ADAPTERS["human_authored"] and A.adapter_of("CURATED") is A.adapter_of("anything") is ADAPTERS["existing"]
    raw = spark.createDataFrame([("not json",), ("[1]",), (None,), ('{"prompt": 5, "response": "x", "source_id": ""}',)], "j string")
    for name in ADAPTERS:
        found = raw.select(ADAPTERS[name](F.col("j")).alias("r")).collect()
        assert sum(r.r is None for r in found) == 1


def test_source_definitions_win(spark):
    source = A.Source(name="set", source_type="benchmark", file="f.jsonl", source_url="u")
    df = spark.createDataFrame([('{"question": "q", "answer": "a", "source": "own"}',)], "j string")
    r = df.select(A.existing(F.col("j"), source).alias("r")).collect()[0].r
    assert (r.metadata.source, r.metadata.source_type, r.metadata.source_id, r.provenance.source_url) == ("set", "benchmark", None, "u")
    r = df.select(A.existing(F.col("j"), A.Source(file="f.jsonl")).alias("r")).collect()[0].r
    assert (r.metadata.source, r.metadata.source_id[:4]) == ("own", "ext_")
    done = df.select(A.enriched(A.existing(F.col("j"), source), F.lit("given"), now="t").alias("r")).collect()[0].r
    assert (done.metadata.source_id, done.metadata.created_at, done.metadata.generator_version) == ("given", "t", "1.0.0")
