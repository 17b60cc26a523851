"""Periodic runs of words, caught online by dyadic square catchers.

A run is a stretch of words that repeats with a period (words that far apart
are the same), at least twice over and at least ``least`` words long, and that
no neighbouring word extends.

Catchers. When the words of an aligned power-of-two block are complete, a
catcher holds it and waits for its return: a run with period q holds, near its
start, a whole aligned block of about q/2 to q/4 words whose copy q words later
lies inside the run too (``passes`` gives the size for each period). Of every
size just two blocks are live at any word, so an appended word costs two
comparisons a size: the digest of the suffix it ends, against the digests of the
live blocks. A hit is a square in the making. Hits of neighbouring blocks at one
distance belong together; each such group is extended word by word to both
sides, by binary search over prefix digests where it goes on, and kept if it is
long enough. Stretches that are one and the same run under multiples of its
period merge, and blocks that return inside a run already known are passed over,
as they can only yield such multiples. All kept runs are compared word by word,
so digests speed the search and decide nothing.

Appends are made in slices over many documents at once in numpy: the documents
of an Arrow batch stand behind each other, longest first, so every size looks at
a prefix of them.

Scale. One narrow pass over the documents: no shuffle, nothing gathered. A task
holds the words of a few million characters or of one document.

Defined cases: a null or blank text has no words and no runs; ids may be null or
repeat (each row stands for itself); texts of any length are read whole; other
columns are ignored; an empty table gives no rows. Words are what ASCII white
space parts, so other Unicode spaces belong to words.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import blocks

#: Words that a run has at least.
LEAST = 12
#: Words appended at once.
SLICE = 1 << 19
#: Words that a group is extended by one at a time before prefix digests take over.
STEPS = 16
#: Two primes whose products fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
SEED = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
WORD = r"[^\x20\x09-\x0D]+"


def passes(least: int, longest: int):
    """(block size, lowest period, highest period) in order of the period.

    A run of m words with period q surely holds an aligned block of w words and
    its copy if ``2 * w - 1 + q <= m``; w is the largest such power of two.
    """
    size = lambda q: 1 << (((max(least, 2 * q) - q + 1) // 2).bit_length() - 1)
    q = 1
    while max(least, 2 * q) <= longest:
        w, high = size(q), q
        if 2 * q >= least:
            high = 4 * w - 2
        while 2 * high < least and max(least, 2 * (high + 1)) <= longest and size(high + 1) == w and high + 1 - q < 2 * w:
            high += 1
        yield w, q, high
        q = high + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Digests:
    """Digests of blocks by doubling, made when a size is first asked for."""

    def __init__(self, words: np.ndarray):
        self.by_size = {1: _mixed(words.astype(np.uint64) + np.uint64(1))}

    def of(self, w: int, n: int) -> np.ndarray:
        """For each of the first ``n`` places, the digest of the ``w`` words from there; what reaches beyond is not to be used."""
        if w not in self.by_size:
            half = self.of(w // 2, n)
            whole = half.copy()
            at = max(0, len(half) - w // 2)
            whole[:at] = _mixed(half[:at] * np.uint64(0x9E3779B97F4A7C15) + half[len(half) - at :])
            self.by_size[w] = whole
            self.by_size.pop(w // 4 if w > 2 * LEAST else 0, None)
        return self.by_size[w]


class Prefixes:
    """Polynomial digests of prefixes under two primes: equality of any two stretches in one step."""

    def __init__(self, words: np.ndarray):
        rng, self.parts = np.random.default_rng(SEED), []
        for prime in PRIMES:
            base, p = int(rng.integers(2, prime - 1)), np.uint64(prime)
            power = np.ones(len(words) + 1, np.uint64)
            done, step = 1, base
            while done <= len(words):
                more = min(done, len(words) + 1 - done)
                power[done : done + more] = power[:more] * np.uint64(step) % p
                done, step = done + more, step * step % prime
            value = _mixed(words.astype(np.uint64) + np.uint64(prime)) % p
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(value * power[:-1] % p, out=total[1:])
            self.parts.append((p, power, total % p))

    def same(self, at: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` are those from ``at + q``."""
        out = np.ones(len(at), bool)
        for p, power, total in self.parts:
            here = (total[at + length] + p - total[at]) % p * power[q] % p
            out &= here == (total[at + q + length] + p - total[at + q]) % p
        return out


class Catcher:
    """Runs of documents that stand behind each other in ``words``, longest first."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, least: int = LEAST):
        self.words, self.lengths, self.least = words, lengths, least
        self.ends = np.cumsum(lengths)
        starts = self.ends - lengths
        self.place = np.arange(len(words)) - np.repeat(starts, lengths)
        self.left = np.repeat(self.ends, lengths) - np.arange(len(words))
        self.prefixes: Prefixes | None = None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs, by start, then period; places count through all documents."""
        if len(self.words) == 0:
            return (np.empty(0, np.int64),) * 3
        digests = Digests(self.words)
        for w, low, high in passes(self.least, int(self.lengths[0])):
            of = int(np.searchsorted(-self.lengths, -max(self.least, 2 * low), "right"))
            n = int(self.ends[of - 1])
            digest, reach = digests.of(w, n), self._reach(w, low + w, n)
            for a in range(0, n, SLICE):
                self._append(a, min(n, a + SLICE), w, low, high, digest, reach)
        if not self.found:
            return (np.empty(0, np.int64),) * 3
        start, end, period = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)  # of equal stretches the smallest period stays
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def _reach(self, w: int, length: int, n: int) -> np.ndarray | None:
        """How far the known runs with period up to ``w`` that start no later than a place reach."""
        if not self.found:
            return None
        start, end, period = (np.concatenate(x) for x in zip(*self.found, strict=True))
        use = (period <= w) & (end - start >= length)
        if not use.any():
            return None
        reach = np.zeros(len(self.words), np.int64)
        np.maximum.at(reach, start[use], end[use])
        return np.maximum.accumulate(reach[:n])

    def _append(self, a: int, b: int, w: int, low: int, high: int, digest: np.ndarray, reach: np.ndarray | None) -> None:
        """Take the suffixes of ``w`` words that begin at places a to b, and compare each with the live blocks."""
        place, whole, here = self.place[a:b], self.left[a:b] >= w, np.arange(a, b)
        block = (place - low) // w * w
        hits = []
        for _ in range(-((low - high - 1) // w)):
            q = place - block
            live = whole & (block >= 0) & (q <= high)
            at = here - np.where(live, q, 0)
            hit = np.flatnonzero(live & (digest[a:b] == digest[at]))
            if len(hit):
                hits.append((at[hit], q[hit]))
            block = block - w
        if not hits:
            return
        at, q = (np.concatenate(x) for x in zip(*hits, strict=True))
        if reach is not None:
            fresh = reach[at] < at + q + w
            at, q = at[fresh], q[fresh]
        if len(at):
            self._extend(at, q, w)

    def _extend(self, at: np.ndarray, q: np.ndarray, w: int) -> None:
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        joined = (q[1:] == q[:-1]) & (at[1:] - at[:-1] == w)
        head = np.flatnonzero(np.concatenate([[True], ~joined]))
        tail = np.append(head[1:], len(at)) - 1
        first, last, q = at[head], at[tail] + w, q[head]
        start = first - self._grown(first, q, self.place[first], -1)
        room = self.left[first] - (last - first) - q
        end = last + self._grown(last, q, room, 1) + q
        keep = end - start >= np.maximum(self.least, 2 * q)
        start, end, q = start[keep], end[keep], q[keep]
        true = np.array([np.array_equal(self.words[s : e - p], self.words[s + p : e]) for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True)], bool)
        for i in np.flatnonzero(~true):  # digests of unequal words met: cut the stretch into its true parts
            self._exact(int(start[i]), int(end[i]), int(q[i]))
        if true.any():
            self.found.append((start[true], end[true], q[true]))

    def _grown(self, at: np.ndarray, q: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
        """Words by which the equality of ``at`` and ``at + q`` goes on, backward (-1) or forward (1), at most ``room``."""
        grown, alive = np.zeros(len(at), np.int64), np.arange(len(at))
        edge = at - 1 if way < 0 else at
        for k in range(STEPS):
            alive = alive[room[alive] > k]
            spot = edge[alive] + way * k
            alive = alive[self.words[spot] == self.words[spot + q[alive]]]
            grown[alive] += 1
            if not len(alive):
                return grown
        alive = alive[room[alive] > STEPS]
        if len(alive):
            self.prefixes = self.prefixes or Prefixes(self.words)
            least, most, near = np.full(len(alive), STEPS), room[alive].copy(), at[alive]
            while (least < most).any():
                middle = (least + most + 1) // 2
                same = self.prefixes.same(near - middle if way < 0 else near, q[alive], middle)
                least, most = np.where(same, middle, least), np.where(same, most, middle - 1)
            grown[alive] = least
        return grown

    def _exact(self, start: int, end: int, q: int) -> None:
        """The true runs of period ``q`` inside a stretch, extended as far as they go."""
        same = np.concatenate([[False], self.words[start : end - q] == self.words[start + q : end], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip((start + edges[::2]).tolist(), (start + edges[1::2] + q).tolist(), strict=True):
            while self.place[a] and self.words[a - 1] == self.words[a - 1 + q]:
                a -= 1
            while self.left[b - 1] > 1 and self.words[b] == self.words[b - q]:
                b += 1
            if b - a >= max(self.least, 2 * q):
                self.found.append(tuple(np.array([v]) for v in (a, b, q)))


def scan(texts: list[str | None], least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """Of each text its number of words, its runs (start, length, period) by start and period, and the text without what they repeat."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    long = sorted((i for i in range(len(split)) if len(split[i]) >= least), key=lambda i: -len(split[i]))
    lengths = np.array([len(split[i]) for i in long], np.int64)
    words = np.fromiter((number[w] for i in long for w in split[i]), np.int64, int(lengths.sum()))
    start, end, period = Catcher(words, lengths, least).runs()
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum(lengths)
    for s, e, p, k in zip(start.tolist(), end.tolist(), period.tolist(), np.searchsorted(ends, start, "right").tolist(), strict=True):
        runs[long[k]].append((s - int(ends[k] - lengths[k]), e - s, p))
    out = []
    for found, own in zip(runs, split, strict=True):
        if found:
            dropped = np.zeros(len(own) + 1, np.int64)
            for s, n, p in found:
                dropped[s + p] += 1
                dropped[s + n] -= 1
            kept = [own[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]
        else:
            kept = own
        out.append((len(own), found, b" ".join(kept).decode("utf-8", "surrogatepass")))
    return out


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id``, number of words, runs by start and period, and the collapsed text (kept words joined by one space)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def caught(batches):
        for batch in batches:
            text = batch.column(1).to_pylist()
            for a, b in blocks(text, 2_000_000):
                n, runs, collapsed = zip(*scan(text[a:b], least), strict=True)
                rows = [[{"start": s, "length": k, "period": p} for s, k, p in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(rows, kind), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(caught, FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and text, where every tenth document by digest repeats a stretch from some word on to its end.

    With h the crc32 of the decimal id and g its tenth: words from ``g % n`` on
    become copies of the ``1 + (n - g % n) // (3 + g % 8)`` words there.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    tenth = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    cut = tenth.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    placed = cut.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("case when n > 0 then int(g % n) end"))
    sized = placed.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = F.flatten(F.array_repeat(F.expr("slice(w, a + 1, p)"), F.expr("int(ceil((n - a) / p))")))
    text: Column = F.array_join(F.slice(F.concat(F.expr("slice(w, 1, a)"), tail), F.lit(1), F.col("n")), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Digest columns of :func:`find_runs`: the longest run (ties: first start, then period) and hashes of all runs and of the collapsed text."""
    found = find_runs(docs, least)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    with_top = found.withColumn("top", top)
    return with_top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
