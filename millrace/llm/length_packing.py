"""Best-fit packing planned on the histogram of lengths.

Documents of more than ``size`` ids are cut into full pieces and a rest; nothing
else is cut. The plan is best-fit decreasing over *counts*: lengths come longest
first, and all pieces of one length go at once into the open sequences with the
least room that still holds one, as many into each as fit, or into new ones.
Sequences of equal contents stay together as a span of numbers, so a step of the
plan is one row: pieces ``first`` to ``last`` of a length, in the order of their
rank, lie ``each`` to a sequence from sequence ``base`` on, at ``offset``. The
pieces then take their slots by their rank within their length.

Scale. Ids are made once; of a piece only place, length and checksum are
written. The task that encodes numbers the pieces of each length on its own, so
a rank is that number plus the count of the length in earlier tasks: one row per
task and length is summed, and no length, however common, is ever sorted or
brought together. The driver sees the histogram alone (``size`` counts). The
plan has at most two new spans a length, and lengths of one sequence sum up to
``size``, so it stays under ``2 * size * sqrt(2 * size)`` rows (about 740,000,
30 MB, at 4096; some thousands in practice) and is broadcast; each piece finds
its step by binary search.

Defined cases: a null text counts as empty (the end id alone); ids may be null
or repeat (each row is packed by itself); very long texts are cut over many
sequences; other columns are ignored; an empty table gives no pieces. Which of
two pieces of one length goes where is arbitrary, but fixed once written.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.session import written

SEQUENCE_IDS = 4096
#: Id that ends each document here.
END_ID = 1
CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def plan(histogram: dict[int, int], size: int = SEQUENCE_IDS) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, last, each, base, offset) of best-fit decreasing over counts; ``last`` is exclusive."""
    spans: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, how many)
    rooms: list[int] = []  # with spans, ascending
    steps, opened = [], 0

    def put(room: int, base: int, n: int) -> None:
        if room and n:
            if not spans[room]:
                insort(rooms, room)
            spans[room].append((base, n))

    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]
        while done < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                base, n = spans[room].pop()
                if not spans[room]:
                    rooms.pop(at)
            else:
                room, base, n = size, opened, -((done - count) // (size // length))
                opened += n
            each = room // length
            take = min(count - done, n * each)
            full, rest = divmod(take, each)
            steps.append((length, done, done + take, each, base, size - room))
            put(room - each * length, base, full)
            put(room - rest * length, base + full, 1 if rest else 0)
            put(room, base + full + bool(rest), n - full - bool(rest))
            done += take
    return steps


def cut(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_IDS) -> DataFrame:
    """Pieces of at most ``size`` ids, numbered by task and length."""
    vocabulary = tokenizer or tokens.default_path()

    def pieces(batches):
        coder = tokens.encoder(vocabulary)
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END_ID], coder.dtype).tobytes()
        try:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in tokens.blocks(texts):
                    out = []
                    for key, raw in zip(keys[a:b], coder.encode(texts[a:b]), strict=True):
                        ids = np.frombuffer(raw + end, coder.dtype)
                        for k, at in enumerate(range(0, len(ids), size)):
                            part = ids[at : at + size]
                            out.append((key, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), task, seen[len(part)]))
                            seen[len(part)] += 1
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(CUT))
        finally:
            coder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, CUT)


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank within their length, from 0."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("number"))


def seated(ranks: DataFrame, steps: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Each ranked piece in its slot of the plan."""
    length, first, _, each, base, offset = np.array(sorted(steps), np.int64).reshape(-1, 6).T
    table = ranks.sparkSession.sparkContext.broadcast((length, first, each, base, offset))

    def seat(batches):
        length, first, each, base, offset = table.value
        block = np.searchsorted(length, np.arange(int(length.max(initial=0)) + 2))  # where the steps of a length begin
        heads = np.concatenate([first[a:b] for a, b in zip(block[:-1].tolist(), block[1:].tolist(), strict=True)]) if len(first) else first
        for batch in batches:
            own = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.zeros(len(own), np.int64)
            for n in np.unique(own).tolist():
                mine = own == n
                at[mine] = block[n] + np.searchsorted(heads[block[n] : block[n + 1]], rank[mine], "right") - 1
            nth = rank - first[at]
            sequence = base[at] + nth // each[at]
            place = offset[at] + nth % each[at] * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], names=_names(PIECES))

    return ranks.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(seat, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_IDS) -> DataFrame:
    """One row per piece with its sequence and offset; see the module. The cut pieces stay in the shared folder."""
    pieces = written(cut(docs, tokenizer, size), "cut-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    return seated(ranked(pieces), plan(histogram, size))
