import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import jaccard as J
from millrace.llm import queries
from millrace.llm import shingles as S


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(docs):
    """Set sizes and components, all against all that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in index[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int").repartition(3)


def answer(df, block=J.BLOCK_SHINGLES):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, block).collect()}


def crowd(seed, n=220):
    """Chains of edits, boilerplate in most documents, copies and short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    plate = [f"p{i}" for i in range(14)]
    docs, base = [], [rng.choice(vocab) for _ in range(60)]
    for k in range(n):
        if k % 3 == 0:
            words = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(60)] = rng.choice(vocab)
            if k % 9 == 0:
                base = words
        elif k % 3 == 1:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 9, 30]))]
        else:
            words = plate + [rng.choice(vocab) for _ in range(rng.choice([0, 2, 6, 20]))]
        docs.append((k * 7 % 1009, " ".join(words)))
    return docs


@pytest.mark.parametrize("block", [300, J.BLOCK_SHINGLES])
def test_random_crowds_match_brute_force(spark, block):
    docs = [*crowd(2), (5000, None), (5001, ""), (5002, " \t\n"), (5003, "ÀB  c"), (5004, "Àb c"), (5005, "àb c")]
    assert answer(frame(spark, docs), block) == brute(docs)


def test_one_crowd_over_many_blocks(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    docs = []
    for k in range(240):
        words = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(80)] = f"x{rng.randrange(40)}"
        docs.append((k, " ".join(words[: 80 - k % 3])))
    want = brute(docs)
    assert 1 < len({c for _, c in want.values()}) < 200
    assert answer(frame(spark, docs), 900) == want


def test_block_search_matches_brute_force():
    for seed in range(4):
        ids, sets = {}, list({shingles(t): 0 for _, t in crowd(seed)})
        flat = [np.array([ids.setdefault(g, len(ids)) for g in s], np.int64) for s in sets]
        hub = J.divide_skip(np.array([len(s) for s in sets]), np.concatenate(flat), np.array([len(s) for s in sets]), np.full(len(sets), -1), np.arange(len(sets)))
        part = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    old, new = part[i], part[j]
                    part = [new if p == old else p for p in part]
        assert len({(h, p) for h, p in zip(hub.tolist(), part, strict=True)}) == len(set(part)) == len(set(hub.tolist()))


def test_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard(spark, sf).collect()} == brute(docs)


def test_repeated_rows_null_ids_no_rows(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in J.join(df).collect()) == [(0, 0), (0, 4), (4, 4), (4, 4), (9, 4)]
    assert J.join(df.where("false")).count() == 0


def test_repeated_ids_tie_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (9, b), (7, c), (None, c), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in J.join(df).collect())
    assert got == [(0, 7), (0, 7), (2, 2), (5, 2), (5, 2), (7, 7), (9, 2)]


def test_keep_first_keeps_one_row_of_each_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(4, a, "p"), (4, a, "q"), (4, b, "r"), (9, a + " z", "s"), (None, b, "t"), (None, " ", "u"), (3, None, "v"), (3, None, "v"), (1, "only me", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own string")
    got = sorted(map(tuple, J.keep_first(df).collect()), key=lambda r: r[2])
    assert got == [(4, a, "p"), (4, b, "r"), (None, " ", "u"), (3, None, "v"), (3, None, "v"), (1, "only me", "w")]
    assert J.keep_first(df).columns == df.columns and J.keep_first(df.where("false")).count() == 0


def test_extra_columns_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["mark", "n", "high", "low", "part", "class", "component", "group", "_id", "_mark"]
    df = spark.createDataFrame([(1, text, *[0] * 10), (2, text + " x", *[1] * 10)], "doc_id long, text string, " + ", ".join(f"`{x}` int" for x in names))
    assert answer(df) == {1: (26, 1), 2: (27, 1)}
    assert [r.doc_id for r in J.keep_first(df).collect()] == [1]


def test_exactly_at_the_limit_links(spark):
    words = [f"w{i}" for i in range(13)]  # 9 shingles; the first 12 words have 8, 8 of 9 is over; 8 of 10 is at the limit
    docs = [(1, " ".join(words[:12])), (2, " ".join(words + ["w13"])), (3, " ".join(words + ["w13", "w14"]))]
    assert answer(frame(spark, docs)) == brute(docs) and brute(docs)[3][1] == 1
    assert 100 * 8 == 80 * 10


def test_long_texts_and_words(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    assert answer(frame(spark, [(1, text), (2, text + " x"), (3, "y")])) == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}
    word = "y" * 200_000
    found = list(S.shingle_sets(pa.array([f"{word} b c d e", f"{word.upper()} b c d e", f"z{word} b c d e", f"{word} b"])))
    assert found[0].tolist() == found[1].tolist() != found[2].tolist() and len(found[3]) == 1
    assert [J.least_shared(n) for n in (1, 4, 5, 10, 101)] == [1, 4, 4, 8, 81]
