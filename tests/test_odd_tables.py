"""Queries against their SQL on rows that the smallest tables do not hold."""

import duckdb
import pytest
from test_oracles import rows_of

from millrace.plans import load
from millrace.plans.registry import ORACLES, PLANS, Tables

load()


def same(spark, folder, table, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = PLANS[name](Tables(spark, folder))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["flt18_case_findings", "flt19_case_scores", "ag25_suite_verdict"])
def test_answers_of_code_alone(spark, tmp_path, name):
    """Talks without an assistant turn, whose answer is code outside a fence and nothing else."""
    rows = [(k, 0, "user", "Please explain the stack and the queue.") for k in range(420)] + [(k, 1, "assistant", "A stack is last in, first out.") for k in range(0, 420, 4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(spark, str(tmp_path), "conversations", name)


@pytest.mark.parametrize("name", ["gen4_page_sections", "gen1_section_chunks", "gen9_document_levels", "gen4_page_references"])
def test_prose_with_signs_of_formulas(spark, tmp_path, name):
    """Settings and numbered ends of lines in prose: two signs of equality or more make a line look like a formula."""
    text = ". ".join(['key = "a" and token = "b" of it', "plain words", "more = less = same  (3)", "x = 1", 'so a = b = c and token = "d"', "α = β = γ  (2)", "the end = of = it", "last"])
    rows = [(1, text, "en", "s", len(text)), (2, "one", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path), "documents", name)
