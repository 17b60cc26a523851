"""Operators against plain Python on inline rows."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import allocation as A
from millrace.operators import chunks as C
from millrace.operators import records as R
from millrace.operators import similarity as M
from millrace.sources import raw


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("v")).first().v


def test_brackets(spark):
    for text, want in (("", True), ("a(b[c]{d})", True), ("(]", False), (")(", False), ("((", False), ("{[()]}()", True)):
        assert one(spark, T.balanced, text) is want, text


def test_glyphs_and_unicode(spark):
    assert one(spark, T.glyphs, chr(0xF8EB) + "x" + chr(0xF03D) + "y" + chr(0xE123)) == "(x = y "
    assert one(spark, T.nfc, "é") == "é"
    assert one(spark, T.tokens, "café naïve") == ["café", "naïve"]


def test_normal_forms_take_few_texts_at_once(spark):
    import unicodedata

    texts = [None, "", "plain\r\n", "caf\u00e9", "cafe\u0301", "e\u0301" * 3, "\u02ff\u0300", "\ufb01 \u00bd \u00a0", "\u1100\u1161\u11a8", "\u212b", "q\u0307\u0323", "\u00ad\u2126"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    made = df.select("id", T.nfc(F.col("text")).alias("c"), T.nfkc(F.col("text")).alias("k"))
    assert [(r.c, r.k) for r in made.orderBy("id").collect()] == [tuple(t and unicodedata.normalize(form, t) for form in ("NFC", "NFKC")) for t in texts]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # Arrow batches hold 10,000 texts


def test_greedy_keeps_both_ends_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert {r.id for r in M.greedy_keep(nodes, links).where("kept").collect()} == {0, 2, 4}
    assert M.greedy_keep(nodes, links.where("false")).where("kept").count() == 6


def test_quotas_and_splits(spark):
    w = spark.createDataFrame([("a", 0.25), ("b", 0.4), ("c", 0.25), ("d", 0.1)], "category string, weight double")
    assert [r.quota for r in A.quotas(w, 7).orderBy("category").collect()] == [2, 3, 2, 0]
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 37).alias("g"))
    split = A.ratio_split(rows, "id", 0.8, 0.15)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 800, "validation": 150, "test": 50}
    groups = A.group_split(rows, "g").groupBy("g").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows"))
    assert groups.where("n > 1").count() == 0 and groups.agg(F.sum("rows")).first()[0] == 1000


def test_chunks_keep_every_paragraph(spark):
    text = "\n".join(f"paragraph {i} " + "word " * (i % 40) for i in range(60))
    rows = C.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 64).orderBy("chunk").collect()
    assert "\n\n".join(r.text for r in rows).split("\n\n") == [p.strip() for p in text.split("\n")]
    assert len(rows) > 3


def test_json_lines_from_files(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"role": "user"}\n\n{"role": \n{"role": "system"}\n')
    (folder / "b.txt").write_text('{"role": "no"}\n')
    rows = raw.read_json_lines(spark, f"file://{tmp_path}/in", "role string").collect()
    assert sorted((r.record.role if r.record else "", r.error or "") for r in rows) == [("", '{"role": '), ("system", ""), ("user", "")]


def test_inventory_and_csv(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.html").write_text("")
    assert [r.bytes for r in raw.inventory(spark, f"file://{tmp_path}").collect()] == [1]
    (tmp_path / "d.csv").write_text("id,text\n1,a\n2,b,c\n")
    rows = raw.read_csv(spark, f"file://{tmp_path}/d.csv", "id int, text string").collect()
    assert [r._corrupt is None for r in rows] == [True, False]


def test_cleaning_reasons(spark):
    kind = "messages array<struct<role:string,content:string>>"
    long = "a sound message"
    cases = [([("user", long), ("assistant", long)], None), ([], "empty_record"), ([("user", " ")], "empty_message"), ([("user", "short")], "excessively_short"), ([("user", long + "�")], "corrupted_unicode"), ([("user", long + "<|im_end|>")], "formatting_artifact"), ([("assistant", long)], "schema_error"), ([("user", long), ("user", long)], "schema_error")]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], f"i int, {kind}")
    got = {r.i: r.v for r in df.select("i", R.rejection(F.col("messages")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_licences_and_topics_in_the_middle_of_a_text(spark):
    from millrace.operators import quality as Q

    text = "word " * 2_000 + "Apache License, Version 2.0, about a qubit " + "word " * 2_000
    row = spark.createDataFrame([(text,)], "text string").select(Q.licence(F.col("text"), F.lit(None).cast("string"), F.lit("web")).alias("l"), Q.topic(F.lit("web"), F.col("text")).alias("t")).first()
    assert row.l.name == "Apache-2.0" and row.t.subtopic == "quantum_mechanics"
