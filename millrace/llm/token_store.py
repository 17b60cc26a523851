"""Token-ID output: bit-plane shuffled, zstandard-compressed blocks with an index.

Layout. A store is a Parquet folder that Spark's own committer writes, so a
lost executor or a repeated task leaves no stray file. One row is a *segment*:
a run of whole documents in ascending ``doc_id`` order of about
``segment_ids`` ids. Its ids are cut into fixed blocks of ``block_ids``; each
block is transposed into planes (all first bytes, all second bytes, ... or all
lowest bits, ...), every plane is a zstandard frame, and ``plane_ends`` indexes
the frames inside ``payload``. ``doc_ids`` and ``lengths`` index the documents,
``first_id`` counts the shard's ids before the segment; shards follow each other
in key order. Any block can be read without its neighbours.

Scale. Documents are range-partitioned by key (one shuffle of text), encoded
where they land, and written once. Reading is one narrow pass over segments;
only one row per shard is summed for the global offsets.

Defined cases: a null text counts as empty (it holds the end id alone), null
keys sort first, rows that repeat a key stay next to each other in text order,
an empty table makes a store without segments, and other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import tokens

SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 15
BLOCK_IDS = 1 << 16
LEVEL = 3
SEGMENTS = (
    "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "width int, planes string, block_ids int, plane_ends array<long>, payload binary"
)


def split_planes(ids: np.ndarray, planes: str = "byte") -> np.ndarray:
    """Rows are the planes of a block of little-endian ids."""
    rows = ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if planes == "byte":
        return np.ascontiguousarray(rows.T)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def join_planes(found: list[bytes], n: int, dtype: np.dtype, planes: str = "byte") -> np.ndarray:
    """The inverse of :func:`split_planes` for a block of ``n`` ids."""
    rows = np.stack([np.frombuffer(p, np.uint8) for p in found])
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(rows.T)
    return rows.reshape(-1).view(dtype)


def pack_ids(ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS) -> tuple[list[int], bytes]:
    """Frame ends and payload of a segment."""
    press, ends, out, size = zstandard.ZstdCompressor(level=LEVEL), [], [], 0
    for at in range(0, len(ids), block_ids):
        for plane in split_planes(ids[at : at + block_ids], planes):
            out.append(press.compress(plane.tobytes()))
            size += len(out[-1])
            ends.append(size)
    return ends, b"".join(out)


def unpack_ids(ends: list[int], payload: bytes, n_ids: int, width: int, planes: str, block_ids: int) -> np.ndarray:
    """All ids of a segment."""
    dtype, per = np.dtype(f"<u{width}"), width * (8 if planes == "bit" else 1)
    read, starts, out = zstandard.ZstdDecompressor(), [0, *ends[:-1]], []
    for k, at in enumerate(range(0, n_ids, block_ids)):
        frames = [read.decompress(payload[starts[i] : ends[i]]) for i in range(k * per, (k + 1) * per)]
        out.append(join_planes(frames, min(block_ids, n_ids - at), dtype, planes))
    return np.concatenate(out) if out else np.empty(0, dtype)


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, planes: str = "byte", segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the store at ``path``."""
    vocabulary = tokenizer or tokens.default_path()

    def encode(batches):
        coder = tokens.encoder(vocabulary)
        shard, segment, first, keys, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        width = coder.dtype.itemsize

        def row():
            ids = np.frombuffer(b"".join(held), coder.dtype)
            ends, payload = pack_ids(ids, planes, block_ids)
            values = (shard, segment, first, len(ids), keys, [len(x) // width for x in held], width, planes, block_ids, ends, payload)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        try:
            for batch in batches:
                key, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in tokens.blocks(text):
                    for k, ids in zip(key[a:b], coder.encode(text[a:b]), strict=True):
                        keys.append(k)
                        held.append(ids + coder.end)
                        size += len(held[-1]) // width
                        if size >= segment_ids or len(keys) >= SEGMENT_DOCS:
                            yield row()
                            segment, first, keys, held, size = segment + 1, first + size, [], [], 0
        finally:
            coder.forget()
        if keys:
            yield row()

    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "none").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, ids (unsigned 32-bit, little-endian)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_ids(r["plane_ends"], r["payload"], r["n_ids"], r["width"], r["planes"], r["block_ids"]).astype("<u4")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * len(raw), pa.int32()),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(r["first_id"] + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["shard", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
                )

    # One row per shard; there are as many shards as range partitions.
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    found = segments.mapInArrow(decode, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    return found.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
