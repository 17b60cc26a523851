"""Release steps, record shapes and structure on small rows: nulls, empty tables, ties."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunks as C
from millrace.operators import records as R
from millrace.operators import release as L
from millrace.sources import raw


def one(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("text"))).collect()]


def test_formula_lines_are_joined_and_other_lines_stay(spark):
    got = one(spark, T.join_formulas, "so\n∂ρ\n= 0\n(2.1)\n\nend of the sentence here.", "a\nb", None, "", " x \n  \n A long line that is no fragment, ok.")
    assert got == ["so\n∂ρ\n= 0\n(2.1)".replace("so\n∂ρ\n= 0\n(2.1)", "\n$$so ∂ρ = 0 (2.1)$$\n") + "\n\nend of the sentence here.", "a\nb", None, "", "x\n\n A long line that is no fragment, ok."]


def test_a_very_long_run_of_fragments_and_of_table_lines(spark):
    n = 50_000
    formula = one(spark, lambda t: F.length(T.join_formulas(t)), "\n".join(["∂x", "="] * n))
    assert formula == [1 + 2 + (2 * n + n + 2 * n - 1) + 2 + 1]
    table = one(spark, lambda t: F.size(C.tables(t)[0]["rows"]), "| a | b |\n" * n)
    assert table == [n - 1]


def test_tables_fill_cut_and_skip(spark):
    got = one(spark, C.tables, "| a | b |\n|---|---|\n| 1 |\n| 1 | 2 | 3 |\ntext\n| alone |", None, "")
    assert [(t["headers"], t["rows"]) for t in got[0]] == [(["a", "b"], [["1", ""], ["1", "2"]])]
    assert got[1:] == [None, []]


def test_shapes_by_precedence(spark):
    got = one(spark, R.adapt, '{"messages": [{"role": "HUMAN", "content": "q"}], "prompt": "p", "response": "r"}', '{"prompt": "p", "response": "r", "system": "s"}', '{"instruction": "i", "input": "", "output": "o"}', '{"other": 1}', "no json", None)
    assert [[(m["role"], m["content"]) for m in rows or []] for rows in got] == [[("user", "q")], [("system", "s"), ("user", "p"), ("assistant", "r")], [("user", "i"), ("assistant", "o")], [], [], []]


def test_secrets_in_nested_json(spark):
    got = one(spark, T.redact_json, '{"a": {"API_KEY": "x\\"y", "b": [1, 2]}, "cookies": ["p", "q"], "auth": {"k": 1}, "n": 1}', None)
    assert got == ['{"a": {"API_KEY": "[REDACTED]", "b": [1, 2]}, "cookies": "[REDACTED]", "auth": "[REDACTED]", "n": 1}', None]


def test_ordered_digest_ignores_partitions_and_sees_order(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 5000, None), ("b", 1, "x")], "g string, k long, text string")
    first = {r["g"]: (r["n"], r["digest"]) for r in L.ordered_digest(rows, "g", "k", F.col("text")).collect()}
    again = {r["g"]: (r["n"], r["digest"]) for r in L.ordered_digest(rows.repartition(7), "g", "k", F.col("text")).collect()}
    swapped = rows.withColumn("text", F.when(F.col("k") == 1, "y").when(F.col("k") == 2, "x").otherwise(F.col("text")))
    other = {r["g"]: (r["n"], r["digest"]) for r in L.ordered_digest(swapped, "g", "k", F.col("text")).collect()}
    assert first == again and first["a"][0] == 3 and first["a"] != other["a"]
    assert L.ordered_digest(rows.limit(0), "g", "k", F.col("text")).count() == 0


def test_verify_states_and_null_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k long, d string")
    b = spark.createDataFrame([(2, "y"), (3, None), (4, "z")], "k long, d string")
    assert dict(L.verify(a, b, "k", "d").collect()) == {1: "missing", 2: "mismatch", 3: "ok", 4: "unexpected"}


def test_stage_is_reused_only_if_whole(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10)

    states = [L.stage(spark, str(tmp_path), "s", build)[1] for _ in range(2)]
    spark.read.parquet(f"{tmp_path}/s/mark").drop("one").withColumn("one", F.lit(0).cast("decimal(30,0)")).select("path", "n", "one", "two").write.parquet(f"{tmp_path}/m")
    spark.read.parquet(f"{tmp_path}/m").write.mode("overwrite").parquet(f"{tmp_path}/s/mark")
    rows, state = L.stage(spark, str(tmp_path), "s", build)
    assert (states, state, len(calls), rows.count()) == (["computed", "reused"], "recomputed", 2, 10)


def test_gates_with_missing_facts_fail_and_freeze_refuses(spark):
    facts = spark.createDataFrame([(None, 3)], "q double, n long")
    gates = L.judged(facts, [L.gate("q", F.col("q") > 0.8), L.gate("n", F.col("n") > 5, "WARN", False)], lambda any_is: F.when(any_is("FAIL", True), "FAIL").otherwise("PASS"))
    assert [tuple(r) for r in gates.collect()] == [("q", "FAIL", True), ("n", "WARN", False), ("overall", "FAIL", True)]
    files = spark.createDataFrame([("f", "d")], "path string, digest string")
    assert [r["state"] for r in (L.freeze(gates, files).first(), L.freeze(gates, files, force=True).first())] == ["REFUSED", "FROZEN"]


def test_validity_counts_empty_files_and_conversions_reject_other_pairs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello")
    (tmp_path / "a" / "y.txt").write_text("")
    assert tuple(raw.validity(spark, str(tmp_path)).first()) == (2, 1, 1, 5)
    with pytest.raises(ValueError):
        raw.convert(spark, "csv", "xml", "a", "b")


def test_conversion_sorts_the_union_of_keys(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"b": 1, "c": {"d": 2}}\n{"a": "x"}\n')
    raw.convert(spark, "jsonl", "csv", str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert rows.columns == ["a", "b", "c"] and sorted(map(tuple, rows.collect()), key=str) == sorted([(None, "1", '{"d":2}'), ("x", None, None)], key=str)
