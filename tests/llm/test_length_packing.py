import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import length_packing as L
from millrace.llm import tokens


def best_fit_decreasing(lengths, size):
    """Room left in each sequence when pieces are placed one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(size - n)
    return rooms


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 16, 64, 100])
    lengths = [min(size, 1 + int(rng.expovariate(1 / (size * rng.choice([0.1, 0.3, 0.6]))))) for _ in range(rng.randrange(400))]
    taken, counts = defaultdict(list), Counter(lengths)
    for length, first, last, each, base, offset in L.plan(counts, size):
        for rank in range(first, last):
            nth = rank - first
            taken[base + nth // each].append((offset + nth % each * length, length, rank))
    assert Counter(n for found in taken.values() for _, n, _ in found) == counts
    assert len({(n, k) for found in taken.values() for _, n, k in found}) == len(lengths)
    for found in taken.values():
        at = 0
        for offset, n, _ in sorted(found):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(size - sum(n for _, n, _ in found) for found in taken.values()) == sorted(best_fit_decreasing(lengths, size))


def test_plan_stays_small():
    rng = np.random.default_rng(1)
    steps = L.plan(dict(enumerate(rng.integers(1, 10_000_000, 4096).tolist(), 1)))
    assert len(steps) < 40_000
    assert L.plan({}) == []
    assert L.plan({4096: 3, 1: 4096}) == [(4096, 0, 3, 1, 0, 0), (1, 0, 4096, 4096, 3, 0)]


def test_pieces_hold_every_id_once(spark):
    plain = Tokenizer.from_file(tokens.default_path())
    rng = random.Random(4)
    texts = ["", None, "word " * 9000, "a b c", "<|endoftext|> x", "日本語 é", "one two " * 2048, "w " * 4095, "w " * 4096]
    texts += [" ".join(rng.choice(["red", "blue", "green", "it's"]) for _ in range(rng.randrange(900))) for _ in range(150)] + ["same text here"] * 200
    rows = [(i, t, 7, 8) for i, t in enumerate(texts)] + [(None, "null id", 7, 8), (3, "twice", 7, 8), (3, "twice", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, task int").repartition(5)
    found = L.pack(docs).collect()
    want = Counter()
    for key, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, L.END_ID]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[key, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by_sequence) == len(best_fit_decreasing([r.length for r in found], 4096))
    assert L.pack(docs.where("false")).count() == 0
