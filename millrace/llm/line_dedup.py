"""Substring dedup by unit hashing.

Units are all lines that are not blank, sentences inside lines of at least
``MIN_WORDS`` words, and runs of consecutive sentences, also over line ends: the
shortest of that length from each sentence on and the shortest up to each, so
every sentence of a repeated passage counts, however short it is.
A unit is normalised (case folded, white space collapsed, outer punctuation
dropped) and digested to 96 bits. Digests are grouped over all documents, the
occurrence that ranks first (smallest ``doc_id``, then text hash, then offset) is
kept, and the others are repeats. Repeats with nothing but white space between
them make a stretch; stretches of at least ``MIN_STRETCH`` words are removed. A
lone short line or sentence recurs in documents that share nothing else and
stays (``min_stretch=1`` removes it). Offsets are code points of the original
text, so what is left can always be traced back.

Scale. One row per unit; grouping combines on the map side and yields one row
per repeated digest, which joins back to the units. Both sides of that join are
plain shuffles that adaptive execution may split, so a line in a third of all
documents is no task's burden. Removed spans meet their text by document.

Defined cases: a null text counts as empty and keeps the digest of nothing;
texts of any length are read whole, in rows of bounded batches; rows equal in
``doc_id`` and text are one document, so copies of a row are treated alike; rows
that share only ``doc_id`` are ranked by a hash of the text; null ids rank
first; an empty table gives no rows; other columns are kept, and where one is
called ``kept`` or ``removed`` the new column has the next free name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh, written

MIN_WORDS = 10
MIN_STRETCH = 20
BATCH_UNITS = 50_000
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")
_EDGE = " \t\r\f\v.,;:!?\"'()[]{}-*#>"


def normalise(unit: str) -> str:
    return " ".join(unit.casefold().split()).strip(_EDGE)


def units(text: str | None, min_words: int = MIN_WORDS):
    """(start, end, normalised) of each line, each sentence that is long enough, and the shortest long enough run of sentences from and to each."""
    text, done = text or "", set()
    starts, ends, words, forms, odd = [], [], [0], [], [0]
    for line in _LINE.finditer(text):
        raw, at = line[0], line.start()
        n = len(raw.split())
        if not n:
            continue
        done.add((at, line.end()))
        parts = [m.span() for m in _SENTENCE.finditer(raw)] or [(0, len(raw))]
        # Each sentence is folded once; a line or run is its sentences' words, unless something but white space, or nothing, stands between two.
        own = [" ".join(raw[s:e].casefold().split()) for s, e in parts]
        plain = [e == s and own[k] and own[k + 1] and (raw[e - 1].isspace() or raw[e].isspace()) for k, ((_, e), (s, _)) in enumerate(zip(parts, parts[1:], strict=False))]
        if parts[0][0] == 0 and parts[-1][1] == len(raw) and all(plain):
            whole = " ".join(own).strip(_EDGE)
        else:
            whole = normalise(raw)
        # A line of signs alone is its own normal form, and no run starts or ends with it.
        yield at, line.end(), whole or raw.strip()
        if not whole:
            continue
        first = not starts or text[ends[-1] : at + parts[0][0]].isspace() and own[0] and forms[-1]
        for (s, e), form, joins in zip(parts, own, [first, *plain], strict=True):
            starts.append(at + s)
            ends.append(at + e)
            words.append(words[-1] + (n if len(parts) == 1 else len(form.split())))
            forms.append(form)
            odd.append(odd[-1] + (not joins))
    last = first = 0
    for k in range(len(starts)):
        while last <= len(starts) and words[last] - words[k] < min_words:  # forth: from sentence k to the first end that is far enough
            last += 1
        while first <= k and words[k + 1] - words[first] >= min_words:  # back: from the last start that is far enough
            first += 1
        for i, j in ((k, last - 1), (first - 1, k)):
            if 0 <= i and j < len(starts) and (starts[i], ends[j]) not in done:
                done.add((starts[i], ends[j]))
                found = " ".join(forms[i : j + 1]).strip(_EDGE) if odd[j + 1] == odd[i + 1] else normalise(text[starts[i] : ends[j]])
                if found:
                    yield starts[i], ends[j], found


def digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit: doc_id, text hash, start, end and a 96-bit digest."""
    names = ["doc_id", "mark", "start", "end", "high", "low"]

    def run(batches):
        for batch in batches:
            keys, marks = batch.column(0), batch.column(1)
            row, starts, ends, raw = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for start, end, unit in units(text, min_words):
                    row.append(k)
                    starts.append(start)
                    ends.append(end)
                    raw.append(xxhash.xxh3_128_digest(unit.encode("utf-8", "replace")))
                    if len(row) >= BATCH_UNITS:
                        yield rows(keys, marks, row, starts, ends, raw)
                        row, starts, ends, raw = [], [], [], []
            yield rows(keys, marks, row, starts, ends, raw)

    def rows(keys, marks, row, starts, ends, raw):
        digest = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([keys.take(at), marks.take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1].astype(np.int32))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, start int, end int, high long, low int")


def text_mark():
    """64 bits that tell rows of one id apart by their texts."""
    return F.xxhash64("text")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans that repeat: doc_id, mark, start, end; every occurrence of a repeated unit but the first."""
    found = digests(docs, min_words)
    place = F.struct("doc_id", "mark", "start", "end")
    first = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join has no aggregate beside it and a hot line's rows can be split.
    first = written(first, "repeated-units")
    return found.join(first, ["high", "low"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "mark", "start", "end")


def keep(text: str | None, spans, min_stretch: int = MIN_STRETCH) -> tuple[str, list[tuple[int, int]]]:
    """What is left of a text, and the stretches that went."""
    text, merged = text or "", []
    for s, e in sorted(spans or ()):
        if merged and (s <= merged[-1][1] or not text[merged[-1][1] : s].strip()):
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    gone = [(s, e) for s, e in merged if len(text[s:e].split()) >= min_stretch]
    out, at = [], 0
    for s, e in gone:
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]]), gone


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_stretch: int = MIN_STRETCH) -> DataFrame:
    """All columns of ``docs``, and two more at the end: ``kept`` (what is left of the text) and ``removed`` (array of start and end)."""
    key, mark, own, spans = (fresh(docs, x) for x in ("_id", "_mark", "_own", "_spans"))
    kept, removed = fresh(docs, "kept"), fresh(docs, "removed")
    gone = repeated(docs, min_words).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans")).toDF(key, mark, spans)
    joined = docs.withColumn(own, text_mark()).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark)), "left").drop(key, mark, own)
    shape = docs.withColumn(kept, F.lit("")).withColumn(removed, F.expr("cast(array() as array<struct<start:int,end:int>>)")).schema
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            done = [keep(t, [(x["start"], x["end"]) for x in s or ()], min_stretch) for t, s in zip(batch.column(at).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([k for k, _ in done], pa.string()), pa.array([[{"start": s, "end": e} for s, e in r] for _, r in done], kind)], names=shape.names)

    return joined.mapInArrow(run, shape)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.coalesce(F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0)).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )

