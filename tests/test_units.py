"""Knowledge units at their edges."""

from pyspark.sql import functions as F

from millrace.operators import units as U


def test_empty_texts_and_each_level(spark):
    words = "plain words of no kind that go on and on " * 4
    rows = [
        (1, None, 0, 0), (2, "", None, None), (3, words, 0, 0), (4, words * 10, 0, 0), (5, "we derive it " + words, 2, 0), (6, "we derive it " + words, 4, 0), (7, "it weighs 5 kg " + words, 0, 0),
        (8, "by an algorithm " + words, 0, 0), (9, "summary " + words, 0, 1), (10, "x", 0, 0),
    ]
    df = U.analysed(spark.createDataFrame(rows, "id int, text string, n_equations int, n_tables int"))
    got = {r.id: (r.difficulty, r.rationale, r.content, r.tasks) for r in df.withColumn("tasks", U.tasks(F.col("content"), F.col("n_words"))).collect()}
    assert got[1] == got[2] == ("beginner", "empty", [], ["explanation"])
    assert got[3] == ("beginner", "concept", ["concept"], ["explanation", "question_answering"])
    assert got[4] == ("intermediate", "long_concept", ["concept"], ["explanation", "question_answering", "multi_turn"])
    assert got[5][:2] == ("advanced", "derivation") and got[6][:2] == ("expert", "long_derivation")
    assert got[5][3] == ["proof", "explanation", "reasoning"]
    assert got[7][:3] == ("intermediate", "quantitative", ["calculation"]) and got[7][3] == ["calculation", "problem_solving"]
    assert got[8][:2] == ("advanced", "methodical")
    assert got[9][:3] == ("intermediate", "standard", ["conclusion", "table_data"]) and got[9][3] == ["data_interpretation", "analysis", "summarization"]
    assert {r.id for r in U.selected(df).collect()} == {3, 4, 5, 6, 7, 8, 9}
