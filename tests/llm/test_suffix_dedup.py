import hashlib
import random

import numpy as np
import pytest

from millrace.llm import queries
from millrace.llm import suffix_dedup as S


def brute(docs):
    """Spans by one dictionary over all strings, in order."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - S.SPAN + 1):
            part = raw[s : s + S.SPAN]
            if part in seen:
                gone[s : s + S.SPAN] = True
            seen.add(part)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())
    return out


def answer(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(df).collect()}


def crowd(seed=1, n=160):
    rng = random.Random(seed)
    letters = "abcdé \n"
    line = "".join(rng.choice(letters) for _ in range(130))
    base = "".join(rng.choice(letters) for _ in range(700))
    docs = []
    for k in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        if k % 3 == 0:
            text += line + "".join(rng.choice(letters) for _ in range(rng.randrange(150)))
        if k % 4 == 0:
            cut = rng.randrange(600)
            text += base[:cut] + rng.choice(["", "x", "yy"]) + base[cut:]
        if k % 10 == 0:
            text += rng.choice(["ab", "a", "\0"]) * rng.randrange(260)
        docs.append((k * 37 % 401, text))
    return docs


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (60, 2), (300, 1), (500, 3), (400, 256), *((80, 4),) * 40):
        text = rng.integers(0, k, n).astype(np.uint8)
        order, raw = S.suffix_array(text, n + 8), text.tobytes()
        for shallow in (10, 100):
            got = S.suffix_array(text, shallow)
            cut = [packed[:shallow] for packed in (raw[i:] for i in got.tolist())]
            assert len(set(cut)) == 1 + sum(a != b for a, b in zip(cut, cut[1:], strict=False))
        assert sorted(order.tolist()) == list(range(n))
        want = [next((j for j in range(n) if raw[a + j : a + j + 1] != raw[b + j : b + j + 1] or a + j >= n), 0) for a, b in zip(order.tolist(), order.tolist()[1:], strict=False)]
        assert S.common_prefixes(text, order)[1:].tolist() == want
        rough = S.suffix_array(text, 8)
        want = [next((j for j in range(n) if raw[a + j : a + j + 1] != raw[b + j : b + j + 1] or a + j >= n), 0) for a, b in zip(rough.tolist(), rough.tolist()[1:], strict=False)]
        assert S.common_prefixes(text, rough)[1:].tolist() == want


@pytest.mark.parametrize("how", [{}, {"CROWD": 3, "SHARD_BYTES": 3_000}, {"BATCH_BYTES": 500}])
def test_crowds_match_brute_force(spark, monkeypatch, how):
    for name, value in how.items():
        monkeypatch.setattr(S, name, value)
    docs = [*crowd(), (900, None), (901, ""), (902, "z" * 99), (903, "z" * 100), (904, "z" * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, doc long").repartition(3)
    assert answer(df) == brute(docs)


def test_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, sf).collect()} == brute(docs)


def test_repeated_and_null_ids(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(2, text), (2, text), (1, "q" + text), (None, text), (None, None), (3, text[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.dedup(df).collect())
    assert got == [(0, 0, 0), (0, 150, 0), (1, 151, 150), (2, 150, 150), (2, 150, 150), (3, 100, 100)]
    assert S.dedup(df.where("false")).count() == 0
