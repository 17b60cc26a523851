"""Sections over pages, equations by phase, and chunks that carry tables and equations."""

import random
import re
import time

from millrace.operators import structure as S


def forms(text):
    return [(e["form"], e["tag"], e["latex"]) for e in S.find_equations(text)[0]]


def test_every_form_in_order():
    text = r"""An inline $x_1$ first, then $$a = b$$ and
\[ E = \hbar k \] and
\begin{equation*}c  =   d\end{equation*} and
\begin{align}e &+ f \\ g &+ h\end{align}
\begin{gather}i\end{gather} again $$a = b$$ and $a + b$ and $a = b$.
∂ρ/∂t + ∇·(ρV) = 0   (2.2)
∇·E = ρ/ε
∇·E = ρ/ε
E = m c   (1)
This is a sentence with α and β = 1 in it.
α + β = γ."""
    assert forms(text) == [
        ("dollars", None, "a = b"), ("brackets", None, r"E = \hbar k"), ("equation", None, "c = d"), ("align", None, "e &+ f \\\\\ng &+ h"), ("gather", None, "i"),
        ("numbered", "2.2", r"∂ρ/∂t + ∇·(ρV) = 0 \tag{2.2}"), ("line", None, "∂ρ/∂t + ∇·(ρV) = 0 (2.2)"), ("line", None, "∇·E = ρ/ε"), ("dollar", None, "x_1"), ("dollar", None, "a + b"),
    ]
    rewritten = S.find_equations(text)[1]
    assert rewritten.count("$$∇·E = ρ/ε$$") == 1 and rewritten.count("∇·E = ρ/ε") == 2


def test_validity_and_odd_marks():
    found, _ = S.find_equations(r"$$\frac{a}{b + [c$$ and $$\int_{0}^{\infty} (x)$$ and $ $ and $$open \[ open \begin{align} open")
    assert [(e["latex"], e["valid"]) for e in found] == [(r"\frac{a}{b + [c", False), (r"\int_{0}^{\infty} (x)", True)]
    assert forms("") == [] and forms("$$$$ $$$ $") == [] and forms("a\n\n(2)  (3)") == []
    assert forms("α = β = γ\n\n  (4)")[0] == ("numbered", "4", r"α = β = γ \tag{4}")
    began = time.time()
    for hostile in ("\\begin{align}", "$$", "$", " ", "\t", "a  (1", "\n ", "\\[", "= ", "[1]  "):
        S.find_equations(hostile * (400_000 // len(hostile)))
    assert time.time() - began < 30


def page(number, *paragraphs, title=None, tables=()):
    return {"page": number, "title": title or f"Page {number}", "paragraphs": list(paragraphs), "tables": list(tables)}


def test_sections_run_on_over_pages():
    pages = [
        page(1, "Opening words\nof the text."),
        page(2, "1. Introduction\nFirst line\nsecond line", "Another paragraph"),
        page(3, "runs on here"),
        page(4, "still\nRESULTS OF ALL\n", "2.1 Methods of Work\nbody"),
        page(5, "References\n[1] Smith, J. (2020)\n2. Landau and Lifshitz\nnot an item", "[3] Third"),
        page(6, "[4] Fourth\nAppendix A\n[5] no longer listed"),
    ]
    sections, references = S.merge_pages(pages)
    assert [(s["number"], s["title"], s["kind"], s["page_start"], s["page_end"], s["paragraphs"]) for s in sections] == [
        (0, "Overview", "section", 1, 2, ["Opening words of the text."]),
        (1, "1. Introduction", "introduction", 2, 4, ["First line second line", "Another paragraph", "runs on here", "still"]),
        (2, "2.1 Methods of Work", "methodology", 4, 5, ["body"]),
        (3, "References", "references", 5, 6, ["not an item"]),
        (4, "Appendix A", "appendix", 6, 6, ["[5] no longer listed"]),
    ]
    assert references == ["Smith, J. (2020)", "Landau and Lifshitz", "Third", "Fourth"]
    assert S.merge_pages([page(1, title="Given")]) == ([], [])


def test_tables_stay_with_their_section():
    given = {"number": 9, "caption": "c", "headers": ["h"], "rows": [["v"]], "markdown": "| h |"}
    sections, _ = S.merge_pages([page(1, "Results\n| a | b |\n|---|:-:|\n| 1 |\n| 2 | 3 | 4 |\nafter", "| lone |", tables=[given])])
    assert [(s["title"], s["paragraphs"], [(t["number"], t["headers"], t["rows"]) for t in s["tables"]]) for s in sections] == [("Overview", [], [(1, ["h"], [["v"]]), (2, ["a", "b"], [["1", ""], ["2", "3"]])]), ("Results", ["after", "| lone |"], [])]


def brute_chunks(section, most):
    """Chunk texts of one section, by trying for each part whether it still fits."""
    parts = [p.strip() for p in section["paragraphs"]] + [t["markdown"] for t in section["tables"]] + ["$$" + e["latex"] + "$$" for e in section["equations"] if e["kind"] == "display"]
    groups = []
    for p in parts:
        if groups and sum(map(S.estimate, groups[-1])) + S.estimate(p) <= most:
            groups[-1].append(p)
        else:
            groups.append([p])
    return ["\n\n".join(g) for g in groups]


def test_chunks_hold_their_tables_and_equations():
    rng = random.Random(6)
    for _ in range(60):
        pages = []
        for k in range(rng.randrange(1, 6)):
            paragraphs = [" ".join(rng.choice(["word", "longerword", "$y$", "\nConclusion\n", "\n| a | b |\n| 1 | 2 |\n", "$$E_%d = m$$" % rng.randrange(9)]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 5))]
            pages.append(page(k + 1, *paragraphs))
        document = S.read_document(pages, "d", 40)
        want = [(s["number"], text) for s in document["sections"] for text in brute_chunks(s, 40)]
        assert [(c["section"], c["text"]) for c in document["chunks"]] == want
        assert [c["number"] for c in document["chunks"]] == list(range(len(want)))
        assert sum(c["n_tables"] for c in document["chunks"]) == document["n_tables"]
        assert sum(c["n_equations"] for c in document["chunks"]) == sum(e["kind"] == "display" for s in document["sections"] for e in s["equations"])
        assert len({c["chunk_id"] for c in document["chunks"]}) == len(want) and all(re.fullmatch("[0-9a-f]{16}", c["chunk_id"]) for c in document["chunks"])


def test_rows_of_documents(spark):
    from pyspark.sql import functions as F

    texts = ["Abstract\nshort\n\nmore\fResults\n$$a = b$$ text", None, "", " \n\f ", "word " * 50_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (0, "y")], "doc_id long, text string").repartition(3)
    found = S.structured(docs.withColumn("pages", S.text_pages(F.col("text"))))
    assert found.count() == 7
    rows = {(r.doc_id, r.number): r for r in S.sections(found).where("doc_id is not null").collect()}
    assert rows[0, 0].title in ("Abstract", "Overview") and sorted(r.number for k, r in rows.items() if k[0] == 0) == [0, 0, 1] or len(rows) >= 3
    assert S.chunks(found).where("doc_id = 4").count() == 1 and S.references(found).count() == 0
    assert S.structured(docs.where("false").withColumn("pages", S.text_pages(F.col("text")))).count() == 0
    assert [r.form for r in S.equations(docs).where("doc_id = 0").collect()] == ["dollars"]


def test_references_straight_from_pages(spark):
    """The short way gives the references of the nested rows, also for null and empty documents and pages with tables of their own."""
    from millrace.operators.chunks import HEADINGS

    rng = random.Random(5)
    lines = ("References", "REFERENCES", "[1] A | b", "2. B", "12. Other 3", "plain", "| a | b |", "2.1 Methods of Work", "Abstract", "", "$$x$$", "References [3] c")
    table = {"number": 9, "caption": None, "headers": ["h"], "rows": [["v", None]], "markdown": "| h |"}
    made = lambda k: page(k + 1, *("\n".join(rng.choice(lines) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(3))), tables=[table] * (rng.random() < 0.1))
    rows = [(i, [made(k) for k in range(rng.randrange(9))]) for i in range(200)] + [(900, None), (901, []), (902, [{"page": None, "title": None, "paragraphs": None, "tables": None}, page(2, "References", None, "[1] x")])]
    docs = spark.createDataFrame(rows, f"doc_id long, pages {S.PAGES}").repartition(3)
    got = sorted(tuple(r) for r in S.listed(docs, rows=7).collect())
    assert got == sorted((i, k, r) for i, pages in rows if pages for k, r in enumerate(S.merge_pages(pages)[1], 1)) and len(got) > 100
    assert got == sorted(tuple(r) for r in S.references(S.structured(docs)).collect())
    one_by_one = lambda line: next((kind for p, kind in HEADINGS if re.match(p, line)), None)
    for line in (*lines, "Module iv: x", "3 week 2", "key  takeaways", "Experimental results", "results", "bibliography", "Appendix A", "1 Unit 3", "Unit x", "related work", "2. Background of en"):
        assert S.heading_kind(line) == one_by_one(line), line


def test_one_level_is_read_without_writing(spark, tmp_path):
    """Queries that read one level of the nested rows leave nothing in the shared folder."""
    import os

    from millrace import session
    from millrace.plans import load
    from millrace.plans.registry import PLANS, Tables

    load()
    spark.createDataFrame([(1, "a. References b. c", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/in/documents.parquet")
    folder = session.work_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for name in ("gen4_page_sections", "gen4_page_references", "gen1_section_chunks", "gen9_document_levels"):
        PLANS[name](Tables(spark, f"{tmp_path}/in")).collect()
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_equations_in_pieces(spark):
    """A batch of many texts is read a few at a time, with the same rows."""
    texts = [None, "", "$$a = b$$ and $c$", "x" * 900 + " $d$"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [sorted((r.doc_id, r.number, r.latex) for r in S.equations(docs, chars=chars).collect()) for chars in (1, 1000, 10_000_000)]
    want = sorted((i, e["number"], e["latex"]) for i, t in enumerate(texts) for e in S.find_equations(t or "")[0])
    assert got == [want] * 3
