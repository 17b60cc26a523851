import hashlib
import random
import re

import pytest

from millrace.llm import line_dedup as L

LONG = "one two three four five six seven eight nine ten eleven"
OTHER = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def plain_units(text, least=10):
    """Spans and normal forms of all units, found by trying every run of sentences."""
    lines, sentences, at = [], [], 0
    for line in (text or "").split("\n"):
        if line.strip():
            lines.append((at, at + len(line)))
            if clean(line):
                inner = [m.span() for m in re.finditer(r"[^.!?]+[.!?]*\s*", line)] or [(0, len(line))]
                sentences += [(at + s, at + e) for s, e in inner]
        at += len(line) + 1
    count = lambda i, j: sum(len(text[s:e].split()) for s, e in sentences[i : j + 1])
    runs = set()
    for k in range(len(sentences)):
        forth = [j for j in range(k, len(sentences)) if count(k, j) >= least]
        back = [i for i in range(k + 1) if count(i, k) >= least]
        runs |= {(sentences[k][0], sentences[forth[0]][1])} if forth else set()
        runs |= {(sentences[back[-1]][0], sentences[k][1])} if back else set()
    found = {span: clean(text[span[0] : span[1]]) or text[span[0] : span[1]].strip() for span in lines}
    return found | {span: clean(text[span[0] : span[1]]) for span in runs - set(lines) if clean(text[span[0] : span[1]])}


def clean(unit):
    return re.sub(r"\s+", " ", unit.casefold()).strip(" ").strip(" \t\r\f\v.,;:!?\"'()[]{}-*#>")


def brute(docs, stretch):
    """Kept text and removed stretches of each document, character by character."""
    first, units = {}, {i: plain_units(t) for i, t in docs}
    for i, _ in sorted(docs):
        for (s, e), u in sorted(units[i].items()):
            first.setdefault(u, (i, s, e))
    out = {}
    for i, text in docs:
        text = text or ""
        covered = [False] * len(text)
        for (s, e), u in units[i].items():
            if first[u] != (i, s, e):
                covered[s:e] = [True] * (e - s)
        gone, k = [], 0
        while k < len(text):
            if not covered[k]:
                k += 1
                continue
            end = k
            while end < len(text) and (covered[end] or not text[end : next((x for x in range(end, len(text)) if covered[x]), len(text))].strip() and any(covered[end:])):
                end += 1
            if len(text[k:end].split()) >= stretch:
                gone.append((k, end))
            k = end
        out[i] = ("".join(c for x, c in enumerate(text) if not any(s <= x < e for s, e in gone)), gone)
    return out


@pytest.mark.parametrize("stretch", [1, 12, L.MIN_STRETCH])
def test_matches_brute_force(spark, stretch):
    rng = random.Random(stretch)
    pool = [" ".join(rng.choice(["red", "Blue", "sun", "(sky)", "rain", "dog", "house"]) for _ in range(rng.randrange(1, 14))) for _ in range(25)]
    docs = [(5, f"{LONG}\nshort"), (2, f"x\n{LONG.upper()}!\n{OTHER}. {LONG}."), (9, f"{OTHER}.  {OTHER}"), (4, None), (7, ""), (8, "short\nshort\n\n --\n--")]
    docs += [(i, "".join(rng.choice(pool) + rng.choice([". ", "! ", "\n", ".\n\n"]) for _ in range(rng.randrange(1, 12)))) for i in range(20, 60)]
    rows = L.dedup(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, removed int"), min_stretch=stretch).collect()
    got = {r.doc_id: (r.kept, [tuple(x) for x in r.removed_1]) for r in rows}
    assert got == brute(docs, stretch)


def test_digest_columns(spark):
    docs = [(1, f"{LONG} {OTHER}"), (2, f"ß {LONG} {OTHER}"), (3, f"Ünder\n{LONG} {OTHER}\nend")]
    rows = {r.doc_id: r for r in L.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[3].spans == f"6:{len(docs[2][1]) - 4}" and rows[3].n_removed == len(docs[2][1]) - 10 and rows[3].n_spans == 1
    assert rows[3].kept_sha256 == hashlib.sha256("Ünder\n\nend".encode()).hexdigest() and rows[2].n_removed == 0


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = f"{LONG} {OTHER}"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in L.digest(df).collect()) == [(0, 0), (1, len(text)), (1, len(text)), (2, len(text))]
    assert L.digest(df.where("false")).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"{LONG} {i}" for i in range(20_000))
    rows = L.digest(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: len(text)}


def test_short_lines_and_short_sentences_of_a_passage_go(spark):
    passage = "It rained. We stayed in. Nobody came by. The dog slept. All was quiet then."
    docs = [(1, f"All rights reserved.\nBefore it all. {passage}\n* * *"), (2, f"All rights reserved.\n* * *\n}}\n\n{passage} Something else."), (3, f"Other. {passage[:-5]} now.")]
    got = {r.doc_id: r.kept for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_stretch=1).collect()}
    assert got[1] == docs[0][1]
    assert got[2] == "\n}\n\nSomething else."  # a line of other signs is no copy
    assert got[3] == "Other. All was quiet  now."


def test_runs_reach_over_line_ends(spark):
    head, tail = "We walked home.", "It was late and dark and very cold."
    docs = [(1, f"Some words here. {head}\n{tail} The end."), (2, f"Others stand there. {head}\n{tail} No end.")]
    got = {r.doc_id: r.kept for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_stretch=1).collect()}
    assert got == {1: docs[0][1], 2: "Others stand there. No end."}


def test_rows_of_one_id_are_told_apart_by_64_bits(spark):
    """Two texts that one 32-bit hash confuses: only the one whose line repeats elsewhere loses it."""
    rows = [(1, "row number 21944"), (1, "row number 78811"), (0, "row number 21944"), (None, "row number 78811")]
    found = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1, min_stretch=1).collect()
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.kept) for r in found)
    assert kept == [(False, 0, "row number 78811", "row number 78811"), (True, 0, "row number 21944", "row number 21944"), (True, 1, "row number 21944", ""), (True, 1, "row number 78811", "")]
    unique = [(1, "row number 21944"), (1, "row number 78811"), (0, "row number 21944")]
    found = L.dedup(spark.createDataFrame(unique, "doc_id long, text string"), min_words=1, min_stretch=1).collect()
    assert {(r.doc_id, r.text): r.kept for r in found}[1, "row number 78811"] == "row number 78811"
