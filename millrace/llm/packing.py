"""Packing along a space-filling curve.

Each document's hashed bag of token ids is projected to four dimensions; the
Hilbert index of the projected point orders all documents, so neighbours on the
curve share vocabulary. Range partitions of that order are packed one by one:
the ids run on from document to document and are cut at every 4096th, and what
is left at the end of a partition is cut into sequences of the powers of two
that add up to it, so no sequence needs padding.

Scale. Ids are computed once and written (two bytes each) to the shared folder;
one range shuffle brings them into curve order. The order breaks ties by
``doc_id`` and text digest, so a third of all documents may share one point
without sharing a partition. A task holds one batch and at most one open
sequence.

Defined cases: a null text counts as empty (one piece with the end id), keys
may be null or repeat, an empty table gives no pieces, very long documents are
cut over many sequences, other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm import tokens
from millrace.session import written

SEQUENCE_IDS = 4096
BUCKETS = 1024
DIMENSIONS = 4
BITS = 12
SEED = 20_26
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of rows of integer coordinates below 2**bits.

    The transposed form of J. Skilling, "Programming the Hilbert curve" (2004),
    over all rows at once; the bits of the coordinates are then interleaved.
    """
    x = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for k in range(len(x)):
            on = (x[k] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - one), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = (out << one) | (((v ^ flip) >> np.uint64(level)) & one)
    return out.astype(np.int64)


def curve_keys(bags: np.ndarray) -> np.ndarray:
    """Hilbert index of hashed bags (one row per document, ``BUCKETS`` counts)."""
    plane = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))
    size = np.linalg.norm(bags, axis=1, keepdims=True)
    flat = (bags / np.where(size == 0, 1, size)) @ plane
    unit = 1 / (1 + np.exp(-1.7 * flat))  # close to the normal distribution function
    return hilbert_index(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def bag(ids: np.ndarray) -> np.ndarray:
    """Signed hashed counts of one document's ids, damped by the square root."""
    mixed = (ids.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(7)
    counts = np.bincount(mixed % BUCKETS, weights=1.0 - 2.0 * ((mixed >> np.uint32(20)) & 1), minlength=BUCKETS)
    return np.sign(counts) * np.sqrt(np.abs(counts))


def with_curve(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, curve key, digest and ids of each document."""
    vocabulary = tokenizer or tokens.default_path()

    def encode(batches):
        coder = tokens.encoder(vocabulary)
        try:
            for batch in batches:
                key, text = batch.column(0), batch.column(1).to_pylist()
                for a, b in tokens.blocks(text):
                    raw = [x + coder.end for x in coder.encode(text[a:b])]
                    curve = curve_keys(np.stack([bag(np.frombuffer(x, coder.dtype)) for x in raw]))
                    yield pa.RecordBatch.from_arrays(
                        [key.slice(a, b - a), pa.array(curve), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([coder.dtype.itemsize] * (b - a), pa.int32()), pa.array(raw, pa.binary())],
                        names=["doc_id", "curve", "digest", "width", "ids"],
                    )
        finally:
            coder.forget()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, curve long, digest long, width int, ids binary")


def cut(lengths, size: int = SEQUENCE_IDS):
    """Pieces (document, start, length, sequence, offset) of a run of documents.

    ``lengths`` is an iterable; pieces of closed sequences come out as soon as
    they are known. The last sequence is cut anew at powers of two.
    """
    sequence, fill, open_pieces = 0, 0, []
    for doc, n in enumerate(lengths):
        at = 0
        while at < n:
            take = min(n - at, size - fill)
            open_pieces.append((doc, at, take, sequence, fill))
            at, fill = at + take, fill + take
            if fill == size:
                yield from open_pieces
                sequence, fill, open_pieces = sequence + 1, 0, []
    parts = [1 << b for b in range(size.bit_length() - 1, -1, -1) if fill >> b & 1]
    offset = 0
    for doc, at, n, *_ in open_pieces:
        while n:
            take = min(n, parts[0] - offset)
            yield doc, at, take, sequence, offset
            at, n, offset = at + take, n - take, offset + take
            if offset == parts[0]:
                sequence, offset = sequence + 1, 0
                parts.pop(0)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_IDS) -> DataFrame:
    """One row per piece; see the module. ``size`` is a power of two."""

    def fill(batches):
        first = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}  # documents of which a piece is still to come, by number

        def lengths():
            n = 0
            for batch in batches:
                for key, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    held[n] = (key, np.frombuffer(raw, f"<u{width}"))
                    yield len(held[n][1])
                    n += 1

        out, last = [], -1
        for doc, start, length, sequence, offset in cut(lengths(), size):
            for done in range(last, doc):
                held.pop(done, None)
            last = doc
            key, ids = held[doc]
            out.append((key, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), first + sequence, offset))
            if len(out) == 10_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    encoded = written(with_curve(docs, tokenizer), "packing-ids")
    ordered = encoded.repartitionByRange("curve", "doc_id", "digest").sortWithinPartitions("curve", "doc_id", "digest", "ids")
    return ordered.select("doc_id", "width", "ids").mapInArrow(fill, PIECES)
