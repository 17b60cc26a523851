"""Arrow batches in pieces."""

import random

import pyarrow as pa

from millrace.functions.arrow import slices


def test_pieces_keep_order_and_size():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "é" * rng.randrange(40) for _ in range(3000)] + ["x" * 5000, "", None, "y" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    taken = []

    def source():
        for part in (batch.slice(0, 1000), batch.slice(1000), batch.slice(0, 0)):
            taken.append(part.num_rows)
            yield part

    pieces = []
    for piece in slices(source(), 1000):
        assert pieces or taken == [1000]  # batches are asked for one by one
        rows = piece.column(1).to_pylist()
        assert len(rows) == 1 or sum(len((t or "").encode()) for t in rows) <= 1000
        pieces.append((piece.column(0).to_pylist(), rows))
    assert [k for ks, _ in pieces for k in ks] == list(range(len(texts))) and [t for _, ts in pieces for t in ts] == texts
    assert 50 < len(pieces) < 400
