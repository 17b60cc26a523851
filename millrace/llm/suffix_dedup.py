"""Exact substring dedup with suffix arrays.

Every byte covered by a ``SPAN``-byte string that also starts earlier (in a
smaller ``doc_id``, or earlier in the same document) goes; strings are judged on
the input.

1. Anchors. Each string of ``SPAN`` bytes names the smallest hashed gram of
   ``GRAM`` bytes inside it as its anchor, so equal strings name equal anchors.
   Consecutive starts that name one anchor form a *window*. Strings that repeat
   can only lie in windows whose anchor occurs twice, so all other windows drop
   out by one grouped count.
2. Copies. Windows equal in content are collapsed to the first; at all the
   others every start repeats.
3. Shards. Where one anchor has several distinct windows, those are routed by
   anchor to shards of bounded size. A shard builds the suffix array of its
   windows in numpy, by Larsson and Sadakane's refinement of unsorted groups,
   and Kasai's common prefixes; runs of suffixes that share ``SPAN`` bytes are
   one string, and all but its first start repeat.
4. Merging. An anchor with very many distinct windows is dealt over several
   shards. Each sends the sorted digests of its strings with their first
   starts, cut by binary search at fixed points of the digest space; the tasks
   of those ranges merge the sorted runs by binary search and return the starts
   that some other shard holds earlier.

Scale. What is shuffled is one narrow row per window (about one per 40 bytes)
and, twice, compressed text by document; nothing grows with the square of a
group, and no task holds more than a shard, a range or a document.

Defined cases: a null text counts as empty; documents shorter than ``SPAN``
lose nothing; rows equal in ``doc_id`` and text are one document and get the
same result; rows that share only ``doc_id`` are ranked by a hash of the text;
null ids rank first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

SPAN = 100
GRAM = 20
#: Bytes of windows in a shard, and distinct windows of one anchor beyond which it is dealt over several shards.
SHARD_BYTES = 2 << 20
CROWD = 4_000
BATCH_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
WINDOWS = "anchor long, content long, doc long, start int, n int"


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive bytes, by doubling."""
    out, have, at = None, 0, 0
    power = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    power ^= power >> np.uint64(29)
    step = 1
    rest = width
    while rest:
        if rest & 1:
            out = power[: len(data) - width + 1] if out is None else (out * np.uint64(0xD6E8FEB86659FD93)) ^ power[at : at + len(data) - width + 1]
            at += step
        rest >>= 1
        have = step
        if rest:
            mixed = power[:-have] * np.uint64(0xBF58476D1CE4E5B9) + power[have:]
            power = mixed ^ (mixed >> np.uint64(31))
            step *= 2
    return (out * _ODD) ^ (out >> np.uint64(32))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of the smallest (the first of equals)."""
    place = np.arange(len(values), dtype=np.uint64)
    key = (values & ~np.uint64(0xFFFFFFFF)) | place  # batches are below 2**32 bytes
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        gap = width - have
        key = np.minimum(key[: len(key) - gap], key[gap:])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Windows of concatenated documents: (document, start in it, number of starts, place, anchor hash).

    ``starts`` and ``lengths`` place each document in ``data``.
    """
    if len(data) < SPAN:
        return [np.empty(0, np.int64)] * 5
    hashes = gram_hashes(data, GRAM)
    anchor = sliding_argmin(hashes, SPAN - GRAM + 1)  # by start of string
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - SPAN + 1, 0))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(lengths - SPAN + 1, 0)) - np.maximum(lengths - SPAN + 1, 0), np.maximum(lengths - SPAN + 1, 0)) + starts[owner]
    if not len(at):
        return [np.empty(0, np.int64)] * 5
    named = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return owner[first], at[first] - starts[owner[first]], count, at[first], hashes[named[first]].view(np.int64)


def window_rows(docs: DataFrame) -> DataFrame:
    """One row per window of every document."""

    def run(batches):
        for batch in batches:
            keys, raw = batch.column(0).to_numpy(), [b"" if t is None else t.encode() for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(raw):
                j, size = i, 0
                while j < len(raw) and (j == i or size + len(raw[j]) <= BATCH_BYTES):
                    size += len(raw[j])
                    j += 1
                lengths = np.fromiter(map(len, raw[i:j]), np.int64, j - i)
                text = b"".join(raw[i:j])
                doc, start, n, place, anchor = windows(np.frombuffer(text, np.uint8), np.cumsum(lengths) - lengths, lengths)
                content = [xxhash.xxh3_64_intdigest(text[p:e]) - (1 << 63) for p, e in zip(place.tolist(), (place + n + SPAN - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content, pa.int64()), pa.array(keys[i:j][doc]), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["anchor", "content", "doc", "start", "n"])
                i = j

    return docs.select("doc", "text").mapInArrow(run, WINDOWS)


def packed_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number, the first one leading; past the end they are zero."""
    long = np.concatenate([text, np.zeros(8, np.uint8)])
    out = long[: len(text)].astype(np.uint64) << np.uint64(56)
    for k in range(1, 8):
        out |= long[k : k + len(text)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (Larsson and Sadakane).

    The order by eight symbols is refined by the rank of what follows, looking
    twice as far each time, and only in groups that are still unsorted. Symbols
    past the end sort first.
    """
    n = len(text)
    # Zero bytes and the end look alike; where there are any, what is left tells them apart.
    value, left = packed_bytes(text), np.minimum(n - np.arange(n), 8)
    order = np.lexsort((left, value)) if (text == 0).any() else np.argsort(value)
    head = np.ones(n, bool)
    head[1:] = (value[order[1:]] != value[order[:-1]]) | (left[order[1:]] != left[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    reach = 8
    while reach < depth:
        alone = head & np.concatenate([head[1:], [True]])
        unsorted = np.flatnonzero(~alone)
        if not len(unsorted):
            break
        at = order[unsorted]
        after = at + reach
        following = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = (rank[at] << 32) | (following + 1)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[unsorted] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[unsorted] = new
        rank[at] = unsorted[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes: symbols that each suffix of ``order`` shares with the one before it.

    Where the predecessors of neighbouring places are neighbours too, Kasai's
    bound is exact (one symbol less), so symbols are compared, eight at a time,
    only at the places that begin such a run.
    """
    n = len(order)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    begins = np.ones(n, bool)
    begins[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    eight, shared, place = packed_bytes(text), np.zeros(n, np.int64), np.arange(n)

    def compare(live):
        while len(live):
            a, b = live + shared[live], before[live] + shared[live]
            room = np.minimum(n - np.maximum(a, b), 8)
            inside = room > 0
            live, a, b, room = live[inside], a[inside], b[inside], room[inside]
            gap = eight[a] ^ eight[b]
            equal = np.full(len(live), 8)
            for k in range(8):
                equal = np.minimum(equal, np.where((gap >> np.uint64(56 - 8 * k)) & np.uint64(255), k, 8))
            equal = np.minimum(equal, room)
            shared[live] += equal
            live = live[equal == 8]

    compare(np.flatnonzero(begins & (before >= 0)))
    run = np.maximum.accumulate(np.where(begins, place, 0))
    # Past the first difference a run says nothing more.
    beyond = (place - run > shared[run]) & (before >= 0)
    shared = np.where(beyond, 0, np.maximum(shared[run] - (place - run), 0))
    compare(np.flatnonzero(beyond))
    return shared[order]


def strings_of(parts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within one shard: row and offset of every start of every window, and the number of its string in suffix order."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"".join(parts), np.uint8)
    order = suffix_array(text, SPAN)
    fresh = common_prefixes(text, order) < SPAN
    string = np.empty(len(text), np.int64)
    string[order] = np.cumsum(fresh)
    row = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, offset, string[(np.cumsum(lengths) - lengths)[row] + offset]


def _first_of(key: np.ndarray, *rank: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its key by rank."""
    by = np.lexsort((*rank[::-1], key))
    head = np.concatenate([[True], key[by][1:] != key[by][:-1]]) if len(by) else np.empty(0, bool)
    out = np.zeros(len(key), bool)
    out[by[head]] = True
    return out


def _runs(batches, keys: int):
    """Whole groups of batches sorted by their first ``keys`` columns."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        columns = [held.column(i).to_numpy() for i in range(keys)]
        change = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        for s, e in zip([0, *change], change, strict=False):
            yield held.slice(s, e - s)
        held = held.slice(([0, *change])[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


#: A window that is the first of its content, and which of its starts repeat (a byte each).
MARKS = "doc long, start int, n int, gone binary"


def _mark_rows(doc, start, n, gone: list[bytes]):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(gone, pa.binary())], names=["doc", "start", "n", "gone"])


def shard_marks(texts: DataFrame) -> DataFrame:
    """Marks of shards that hold all windows of their anchors. ``texts``: shard, doc, start, n, bytes, with doc as rank."""

    def run(batches):
        for shard in _runs(batches, 1):
            doc, start, n = (shard.column(i).to_numpy() for i in (1, 2, 3))
            row, offset, string = strings_of(shard.column(4).to_pylist(), n)
            gone = (~_first_of(string, doc[row], start[row] + offset)).astype(np.uint8).tobytes()
            ends = np.cumsum(n).tolist()
            yield _mark_rows(doc, start, n, [gone[e - k : e] for e, k in zip(ends, n.tolist(), strict=True)])

    columns = ["shard", "doc", "start", "n", "bytes"]
    return texts.select(*columns).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, MARKS)


def merge_runs(one, two):
    """Two sorted runs (digest, doc, at) as one; equal digests keep the earlier start. Binary search finds the places."""
    place = np.searchsorted(one[0], two[0])
    met = one[0][np.minimum(place, len(one[0]) - 1)] == two[0]
    spot = place[met]
    earlier = (two[1][met] < one[1][spot]) | ((two[1][met] == one[1][spot]) & (two[2][met] < one[2][spot]))
    doc, at = one[1].copy(), one[2].copy()
    doc[spot[earlier]], at[spot[earlier]] = two[1][met][earlier], two[2][met][earlier]
    return tuple(np.insert(a, place[~met], b[~met]) for a, b in zip((one[0], doc, at), two, strict=True))


def crowd_marks(texts: DataFrame, ranges: int) -> DataFrame:
    """Marks of windows whose anchors are dealt over several shards: local suffix arrays, then a merge by digest ranges."""
    cuts = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    RUNS = "range int, digest binary, doc binary, at binary"

    def local(batches):
        for shard in _runs(batches, 1):
            doc, start, n = (shard.column(i).to_numpy() for i in (1, 2, 3))
            parts = shard.column(4).to_pylist()
            row, offset, string = strings_of(parts, n)
            first = np.flatnonzero(_first_of(string, doc[row], start[row] + offset))
            digest = np.fromiter((xxhash.xxh3_64_intdigest(parts[r][o : o + SPAN]) for r, o in zip(row[first].tolist(), offset[first].tolist(), strict=True)), np.uint64, len(first))
            by = np.argsort(digest, kind="stable")
            first, digest = first[by], digest[by]
            bounds = [0, *np.searchsorted(digest, cuts).tolist(), len(digest)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if b > a:
                    own = first[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([digest[a:b].tobytes()]), pa.array([doc[row[own]].tobytes()]), pa.array([(start[row[own]] + offset[own]).astype(np.int64).tobytes()])], names=["range", "digest", "doc", "at"]
                    )

    def merge(batches):
        for group in _runs(batches, 1):
            columns = [[np.frombuffer(x, kind) for x in group.column(i).to_pylist()] for i, kind in ((1, np.uint64), (2, np.int64), (3, np.int64))]
            runs = list(zip(*columns, strict=True))
            while len(runs) > 1:
                runs = [merge_runs(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
            best, best_doc, best_at = runs[0]
            for i in range(0, len(best), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(best_doc[i : i + 50_000]), pa.array(best_at[i : i + 50_000])], names=["doc", "at"])

    def mark(batches):
        for batch in batches:
            start, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            gone = []
            for s, k, kept in zip(start.tolist(), n.tolist(), batch.column(3).to_pylist(), strict=True):
                own = np.ones(k, np.uint8)
                own[np.array(kept or [], np.int64) - s] = 0
                gone.append(own.tobytes())
            yield _mark_rows(batch.column(0), start, n, gone)

    columns = ["shard", "doc", "start", "n", "bytes"]
    runs = texts.select(*columns).repartition("shard").sortWithinPartitions("shard").mapInArrow(local, RUNS)
    firsts = runs.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "doc long, at long")
    places = texts.select("doc", "start", "n")
    owned = firsts.join(places.withColumnRenamed("doc", "_doc"), (F.col("doc") == F.col("_doc")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n")))
    kept = owned.groupBy("_doc", F.col("start").alias("_start")).agg(F.collect_list("at").alias("kept"))
    found = places.join(kept, (F.col("doc") == F.col("_doc")) & (F.col("start") == F.col("_start")), "left").select("doc", "start", "n", "kept")
    return found.mapInArrow(mark, MARKS)


def removals(docs: DataFrame) -> DataFrame:
    """doc, and its windows with marks: every start of a window is in ``gone`` (null: all of them)."""
    rows = window_rows(docs)
    often = rows.groupBy("anchor").count().where("count > 1").select("anchor")
    found = written(rows.join(often, "anchor"), "suffix-windows")
    place = F.struct("doc", "start", "n")
    first = found.groupBy("anchor", "content").agg(F.min(place).alias("first"))
    distinct = written(first.select("anchor", "content", "first.doc", "first.start", "first.n"), "suffix-distinct")
    crowd = distinct.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1")
    mixed = written(distinct.join(crowd, "anchor").select("anchor", "doc", "start", "n", "many"), "suffix-mixed")
    total = mixed.agg(F.sum(F.col("n") + SPAN - 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    deal = F.ceil(F.col("many") / F.lit(CROWD))
    own = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    spread = F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("doc", "start"), deal)), F.lit(shards))
    wanted = mixed.select("doc", "start", "n", F.when(F.col("many") > CROWD, spread).otherwise(own).cast("int").alias("shard"), (F.col("many") > CROWD).alias("crowd"))
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "shard", "crowd")).alias("want"))
    texts = written(packed(docs).join(by_doc, "doc").mapInArrow(_cut, "doc long, start int, n int, shard int, crowd boolean, bytes binary"), "suffix-texts")
    marks = shard_marks(texts.where("not crowd"))
    if texts.where("crowd").limit(1).count():
        marks = marks.unionByName(crowd_marks(texts.where("crowd"), max(16, shards)))
    marks = written(marks, "suffix-marks")
    # The first window of a content repeats only where its marks say so: nowhere, if its anchor has no other content.
    lone = distinct.join(crowd, "anchor", "left_anti").select("doc", "start", "n", F.lit(b"").alias("gone"))
    every = found.select("doc", "start", "n", F.lit(None).cast("binary").alias("gone"))
    return every.unionByName(marks).unionByName(lone).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "gone")).alias("windows"))


def packed(docs: DataFrame) -> DataFrame:
    """doc and its compressed bytes, one row per document."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 2_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 2_000), pa.array([press.compress((t or "").encode()) for t in texts[i : i + 2_000]], pa.binary())], names=["doc", "packed"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, packed binary")


def _cut(batches):
    """Bytes of the wanted windows of each document."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for doc, raw, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = zstandard.decompress(raw)
            for w in want:
                for column, value in zip(out, (doc, w["start"], w["n"], w["shard"], w["crowd"], text[w["start"] : w["start"] + w["n"] + SPAN - 1]), strict=True):
                    column.append(value)
            if len(out[0]) > 20_000:
                yield _cut_rows(out)
                out = [[] for _ in range(6)]
        yield _cut_rows(out)


def _cut_rows(out):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc", "start", "n", "shard", "crowd", "bytes"])


def spans_of(found) -> list[tuple[int, int]]:
    """Maximal removed runs of one document from its windows; a marked window overrules the plain row of the same start."""
    marked = {w["start"]: w["gone"] for w in found if w["gone"] is not None}
    starts = []
    for w in found:
        gone = marked.get(w["start"]) if w["gone"] is None else b""
        if w["gone"] is None:
            starts.append(np.arange(w["start"], w["start"] + w["n"]) if gone is None else w["start"] + np.flatnonzero(np.frombuffer(gone, np.uint8)))
    at = np.unique(np.concatenate(starts)) if starts else np.empty(0, np.int64)
    if not len(at):
        return []
    jump = np.flatnonzero(np.diff(at) > SPAN)
    return list(zip(at[[0, *(jump + 1).tolist()]].tolist(), (at[[*jump.tolist(), len(at) - 1]] + SPAN).tolist(), strict=True))


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"


def _finish(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for doc, raw, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, kept, at = zstandard.decompress(raw), hashlib.sha256(), 0
            spans = spans_of(found or ())
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            values = (doc, len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), ",".join(f"{s}:{e}" for s, e in spans))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def _plain(known: DataFrame) -> DataFrame:
    """The result for ``known(doc, text)`` whose ``doc`` is distinct and not null."""
    full = packed(known).join(removals(known), "doc", "left").select("doc", "packed", "windows")
    return full.mapInArrow(_finish, RESULT)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets, ``start:end``)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = given.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    if rows["most"] is None or (rows["most"] == 1 and not rows["nulls"]):
        return _plain(given.withColumnRenamed("doc_id", "doc")).withColumnRenamed("doc", "doc_id")
    # Ids are null or repeat: number the distinct documents in order, and give each row its document's result.
    marked = given.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    ordered = marked.select("doc_id", "mark", F.coalesce("text", F.lit("")).alias("text")).distinct().repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    known = written(ordered.withColumn("doc", F.monotonically_increasing_id()), "suffix-documents")
    found = _plain(known.select("doc", "text")).join(known.select("doc", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "doc")
    both = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    return marked.select("doc_id", "mark").join(found, both).select("doc_id", *[x.split()[0] for x in RESULT.split(", ")[1:]])
