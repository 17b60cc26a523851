import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import periodic_runs as R


def brute_runs(words, least=12):
    """All runs by comparing every word with the one a period on."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)  # periods ascend, so the first is the smallest
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def samples(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind, size = rng.randrange(5), rng.randrange(0, 160)
        letters = [f"w{k}" for k in range(rng.choice([1, 2, 2, 3, 5, 40]))]
        words = [rng.choice(letters) for _ in range(size)]
        if kind == 1 and size:
            a, p = rng.randrange(size), rng.randrange(1, 40)
            words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < size else w for i, w in enumerate(words)]
        elif kind == 2:
            root = words[: rng.randrange(1, 30)]
            words = words + root * rng.randrange(2, 6) + ["x"] + root * rng.randrange(2, 6)
        elif kind == 3:
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randrange(1, 10)):
                a, b = b, b + a
            words = b
        elif kind == 4:
            words = (words[:7] * 9 + words[:5] * 8) * 2
        yield words


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_runs_match_brute_force(least):
    lists = list(samples(least, 250))
    got = R.scan([" ".join(w) for w in lists], least)
    for words, (n, runs, collapsed) in zip(lists, got, strict=True):
        want = brute_runs(words, least)
        assert n == len(words)
        assert runs == want, words
        assert collapsed == " ".join(brute_collapsed(words, want))


def test_every_period_has_one_pass():
    for least in (2, 3, 12, 33):
        seen = []
        for w, low, high in R.passes(least, 3000):
            seen += range(low, high + 1)
            for q in (low, high):
                assert 2 * w - 1 + q <= max(least, 2 * q) and high - low < 2 * w
        assert seen == list(range(1, len(seen) + 1)) and len(seen) >= 1500


def test_meeting_digests_change_nothing(monkeypatch):
    monkeypatch.setattr(R, "_mixed", lambda x: x % np.uint64(3))
    monkeypatch.setattr(R, "PRIMES", (5, 7))
    lists = list(samples(7, 120))
    for words, (_, runs, _) in zip(lists, R.scan([" ".join(w) for w in lists]), strict=True):
        assert runs == brute_runs(words)


def test_slices_change_nothing(monkeypatch):
    texts = [" ".join(w) for w in samples(5, 60)]
    whole = R.scan(texts)
    monkeypatch.setattr(R, "SLICE", 13)
    assert R.scan(texts) == whole


def test_long_texts_of_one_word_and_two_runs_of_one_root():
    one, two = "a " * 300_000, "a b " * 50_000 + "x " + "a b " * 50_000
    (n, runs, text), (_, other, rest) = R.scan([one, two])
    assert (n, runs, text) == (300_000, [(0, 300_000, 1)], "a")
    assert [r for r in other if r[2] == 2] == [(0, 100_000, 2), (100_001, 100_000, 2)]
    assert all(n >= 2 * q for _, n, q in other) and len(rest.split()) < 100_010


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(brute_collapsed(words, runs))))


def test_query_rows_match_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(w) for w in samples(11, 300)] + ["", None, "  \t\n", "a b a b " * 9, "\x1c a\x85" * 30, "x " * 500, "é " * 13]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)] + [(None, "a b " * 20, "z", 1), (5, "same " * 12, "z", 1), (5, "same " * 12, "z", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, top int").repartition(4)
    got = [tuple(r) for r in R.digest(R.planted(docs)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    want = sorted((brute_row(r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, str(r))) == want
    assert R.digest(R.planted(docs.where("false"))).count() == 0
