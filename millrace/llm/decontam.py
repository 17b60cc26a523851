"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, everything else is folded
to lower case. Windows of ``WINDOW`` template tokens of the benchmark are hash
joined with those of all documents, so a question whose figures or names were
exchanged still meets its original. Meetings of one document and one item that
lie at one offset are a copy; it counts when its slots agree: throughout it,
each benchmark value stands for one document value of its type, and the other
way round. Of a copy whose slots disagree, two or more verbatim windows in a row
still count, and so does each stretch of the others that agrees in itself; a
single verbatim window in such a copy does not. Windows are also compared
without placeholders, so verbatim ones meet however few literal words they hold
(others need ``MIN_LITERALS``) and whatever stands around them. Coverage is the
share of all windows of the item.

Scale. Texts are read in blocks of bounded size, in numpy over all code points of a
block; token and window hashes come from running sums, so no object is made per
token. The
benchmark's windows are counted first. Up to ``MAX_BROADCAST_WINDOWS`` they are
broadcast (at most 200 bytes each) and documents are scanned in one narrow pass
in which only meetings leave the task; beyond that, both sides' windows are
shuffled by hash. Both ways give the same rows. Documents are never cut, sampled
or collected.

Defined cases: a null text counts as empty; null ids are carried; texts of any
length are read whole; items shorter than a window are one window, looked for at
their own width anywhere in a document, so a very short item meets every
document that holds its words; an empty benchmark or table gives no rows;
repeated rows, which share ``doc_id``, are reported once, and ``clean`` judges
each row by its own text, so rows that share an id but not a text may part;
benchmark rows that repeat an item id or a text are each matched; other columns
are ignored, whatever their names, and kept by ``clean``.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.characters import CAPITAL, DIGIT, FIGURE, SIGN, STOP, Characters, mixed
from millrace.llm.tokens import blocks
from millrace.session import fresh

WINDOW = 10
MIN_LITERALS = 6
MAX_BROADCAST_WINDOWS = 200_000
BLOCK_CHARS = 250_000

# Units of measure and money.
UNITS = frozenset(
    "% $ € £ ° mm cm m km in ft yd mi mile miles inch inches foot feet metre metres meter meters g kg mg lb lbs oz ton tons tonne tonnes ml l litre litres liter liters s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph dollar dollars cent cents euro euros pound pounds percent degrees".split()
)
NAME, NUMBER, UNIT = range(1, 4)
_UNIT = 8
_BASE = 0xD6E8FEB86659FD93
_KINDS = np.array([0x9AE16A3B2F90404F * k % (1 << 64) for k in range(4)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def least_literals(width: int) -> int:
    """Literal words that a window with placeholders must hold: of a short item's own window half the tokens, and two at least."""
    return MIN_LITERALS if width >= WINDOW else max(2, -(-width // 2))


class Windows:
    """All windows of one width in a block: row, place in its text, template hash, whether it holds enough literals, hash without placeholders."""

    def __init__(self, block, width: int, at: np.ndarray):
        self.block, self.width, self.first = block, width, at
        sums = [s[at + width] - s[at] for s in block.counts]
        free, bare_free, capitals, words = sums
        loud = words < 2 * capitals  # capitals throughout a window say nothing
        typed, bare, literal = ((s[at + width] - s[at]) * block.down[at] + np.uint64(width) for s in block.sums)
        self.row, self.at, self.loud = block.row[at], at - block.begin[block.row[at]], loud
        self.enough = np.where(loud, bare_free, free) >= least_literals(width)
        self.literal = mixed(literal)
        self.hash = mixed(np.where(loud, bare, typed))

    def slots(self, i: int) -> list[int]:
        """The values under the placeholders of window i, each as a number."""
        a = int(self.first[i])
        types = (self.block.bare if self.loud[i] else self.block.kinds)[a : a + self.width]
        return [self.block.value(a + j, int(types[j])) for j in np.flatnonzero(types).tolist()]


class Block:
    """Tokens of several texts, without sentence stops: kinds, literal hashes and running sums."""

    def __init__(self, maker, texts: list[str | None]):
        # A line end between texts is a sentence stop, as the start of a text is.
        self.text = "\n".join([t or "" for t in texts])
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        maker.characters.need(codes)
        group = maker.characters.kind[codes]
        n = len(codes)
        # A point or comma between two digits is part of the number.
        inner = np.flatnonzero((codes == 0x2E) | (codes == 0x2C))
        inner = inner[(inner > 0) & (inner < n - 1)]
        inner = inner[(group[inner - 1] == DIGIT) & (group[inner + 1] == DIGIT)]
        group[inner] = DIGIT
        begin, end = group > 0, group > 0
        same = (group[1:] == group[:-1]) & (group[1:] != SIGN)
        begin[1:] &= ~same
        end[:-1] &= ~same
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        flags = maker.characters.flag[codes[starts]]
        up, down = maker.powers(max(n, len(starts)) + 1)
        run = self._sum(maker.characters.value[codes] * up[:n])
        literal = mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        at = np.minimum(np.searchsorted(maker.units, literal), len(maker.units) - 1)
        flags[maker.units[at] == literal] |= _UNIT
        before, after = np.roll(flags, 1), np.roll(flags, -1)
        before[:1], after[-1:] = STOP, 0
        kinds = np.zeros(len(starts), np.uint8)
        kinds[((flags & CAPITAL) != 0) & ((flags & FIGURE) == 0) & ((before & STOP) == 0)] = NAME
        kinds[(flags & FIGURE) != 0] = NUMBER
        kinds[((flags & _UNIT) != 0) & (((before | after) & FIGURE) != 0)] = UNIT
        kept = np.flatnonzero((flags & STOP) == 0)
        flags, self.kinds, literal, self.starts, self.ends = flags[kept], kinds[kept], literal[kept], starts[kept], ends[kept]
        sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
        self.row = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        self.lengths = np.bincount(self.row, minlength=len(texts))
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.bare = np.where(self.kinds == NAME, 0, self.kinds).astype(np.uint8)
        self.down = down
        rows = [np.where(x > 0, _KINDS[x], literal) for x in (self.kinds, self.bare)] + [literal]
        self.sums = [self._sum(r * up[: len(r)]) for r in rows]
        capital = ((flags & CAPITAL) != 0) & ((flags & FIGURE) == 0)
        self.counts = [self._sum(x.astype(np.int64)) for x in (self.kinds == 0, self.bare == 0, capital, (flags & FIGURE) == 0)]

    def value(self, token: int, kind: int) -> int:
        """A number for what stands under a placeholder."""
        word = self.text[self.starts[token] : self.ends[token]].lower().replace(",", "")
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), kind) - (1 << 63)

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, x.dtype)
        np.cumsum(x, out=out[1:])
        return out

    def windows(self, width: int, whole: bool = False):
        """The block's windows of ``width``; with ``whole``, a shorter text is one window of its own width."""
        n = len(self.row)
        if n >= width:
            at = np.flatnonzero(self.row[width - 1 :] == self.row[: n - width + 1])
            if len(at):
                yield Windows(self, width, at)
        if whole:
            for length in range(1, width):
                at = self.begin[self.lengths == length]
                if len(at):
                    yield Windows(self, length, at)


class Templates:
    """Turns texts into blocks of template tokens."""

    def __init__(self):
        self.characters, self._up, self._down = Characters(), np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.units = np.sort(np.array([self._literal(u) for u in sorted(UNITS)], np.uint64))

    def powers(self, n: int):
        if len(self._up) < n:
            n += n // 2
            self._up, self._down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return self._up, self._down

    def _literal(self, word: str) -> int:
        codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        self.characters.need(codes)
        up, _ = self.powers(len(codes))
        return int(mixed((self.characters.value[codes] * up[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes)))[0])

    def blocks(self, texts: list[str | None]):
        """(number of the first text, block) over all texts."""
        for a, b in blocks(texts, BLOCK_CHARS):
            yield a, Block(self, texts[a:b])


def agree(left: list[int], right: list[int]) -> bool:
    """Each value on one side stands for one value on the other; equal templates have equal types."""
    return len(left) == len(right) and len(set(zip(left, right, strict=True))) == len(set(left)) == len(set(right))


def settled(hits: list[tuple]) -> list[tuple]:
    """Those meetings (.., slots, slots, verbatim) of one document and item at one offset that count.

    All if their slots agree; else two or more verbatim ones in a row, and of the others each stretch that agrees.
    """
    if agree([x for h in hits for x in h[4]], [x for h in hits for x in h[5]]):
        return hits
    out = []
    for same, stretch in groupby(sorted(hits, key=lambda h: h[3]), key=lambda h: h[6]):
        part = list(stretch)
        if part[-1][3] > part[0][3] if same else agree([x for h in part for x in h[4]], [x for h in part for x in h[5]]):
            out += part
    return out


WINDOWS = "low long, high long, key long, at long, n long, hash long, literal long, slots array<long>"


def _text_key() -> list:
    """Two hashes of a text, which stand for it."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def all_windows(docs: DataFrame, key: str, widths, whole: bool = False) -> DataFrame:
    """Text key, id, place, windows of the text, hash, hash without placeholders, slots: a row per window by the latter hash, and one by its own if that differs and it has enough literals."""

    def run(batches):
        maker = Templates()
        for batch in batches:
            low, high, keys = (batch.column(i) for i in range(3))
            for start, block in maker.blocks(batch.column(3).to_pylist()):
                for width in sorted(widths):
                    for w in block.windows(width, whole):
                        more = np.flatnonzero(w.enough & (w.hash != w.literal))
                        at = np.concatenate([np.arange(len(w.hash)), more])
                        place = pa.array(start + w.row[at])
                        count = block.lengths[w.row[at]] - w.width + 1
                        columns = [low.take(place), high.take(place), keys.take(place), _signed(w.at[at]), _signed(count), _signed(np.concatenate([w.literal, w.hash[more]])), _signed(w.literal[at]), pa.array([w.slots(i) for i in at.tolist()], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in WINDOWS.split(", ")])

    return docs.select(*_text_key(), F.col(key).cast("long").alias("key"), "text").mapInArrow(run, WINDOWS)


def widths_of(benchmark: DataFrame, width: int = WINDOW) -> list[int]:
    """Window widths that the benchmark's texts need: ``width``, and the lengths of those that are shorter."""

    def run(batches):
        maker, found = Templates(), set()
        for batch in batches:
            for _, block in maker.blocks(batch.column(0).to_pylist()):
                found |= set(np.minimum(block.lengths, width).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found - {0}), pa.int32())], names=["width"])

    return [r["width"] for r in benchmark.select("text").mapInArrow(run, "width int").distinct().collect()]


class Index:
    """The benchmark's windows as arrays, sorted by hash."""

    def __init__(self, windows: list):
        windows = sorted(windows, key=lambda r: (r["hash"], r["key"] is None, r["key"], r["at"]))
        self.hash = np.array([r["hash"] for r in windows], np.int64).view(np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        windows = [windows[i] for i in order.tolist()]
        self.key = [r["key"] for r in windows]
        self.at, self.n, self.literal = (np.array([r[c] for r in windows], np.int64) for c in ("at", "n", "literal"))
        self.border = np.cumsum([0] + [len(r["slots"]) for r in windows])
        self.slots = np.array([x for r in windows for x in r["slots"]], np.int64)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray, these=None) -> np.ndarray:
        """Which of ``hashes`` occur."""
        if not len(self.hash):
            return np.empty(0, np.int64)
        near = self.marks[(hashes >> np.uint64(44)).astype(np.int64)]
        near = np.flatnonzero(near if these is None else near & these)
        place = np.minimum(np.searchsorted(self.hash, hashes[near]), len(self.hash) - 1)
        return near[self.hash[place] == hashes[near]]

    def entries(self, value):
        """(item, place, windows, slots, literal hash) of every window with this hash."""
        for k in range(int(np.searchsorted(self.hash, value)), int(np.searchsorted(self.hash, value, "right"))):
            yield self.key[k], int(self.at[k]), int(self.n[k]), self.slots[self.border[k] : self.border[k + 1]].tolist(), int(self.literal[k])


def _meetings(maker: Templates, texts, index: Index, widths):
    """(number of the text, meetings (item, place in item, windows of item, place in text, verbatim) that count) for texts with any."""
    for start, block in maker.blocks(texts):
        copies: dict = defaultdict(list)
        for width in widths:
            for w in block.windows(width):
                for i in index.known(w.literal).tolist():
                    row, at, own = int(w.row[i]), int(w.at[i]), int(w.literal[i].view(np.int64))
                    for item, there, n, theirs, same in index.entries(w.literal[i]):
                        if same == own:
                            copies[row, item, width, at - there].append((item, there, n, at, theirs, theirs, True))
                for i in index.known(w.hash, w.enough & (w.hash != w.literal)).tolist():
                    row, at, own, mine = int(w.row[i]), int(w.at[i]), int(w.literal[i].view(np.int64)), w.slots(i)
                    for item, there, n, theirs, same in index.entries(w.hash[i]):
                        if same != own:
                            copies[row, item, width, at - there].append((item, there, n, at, theirs, mine, theirs == mine))
        found: dict = defaultdict(list)
        for (row, *_), hits in copies.items():
            found[row] += [(*hit[:4], hit[6]) for hit in settled(hits)]
        yield from ((start + row, hits) for row, hits in found.items() if hits)


MEETINGS = "low long, high long, doc_id long, item_id long, item_at long, item_windows long, doc_at long, verbatim boolean"


def _rows(hits: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in hits], kinds[i]) for i in range(8)], names=[x.split()[0] for x in MEETINGS.split(", ")])


def meetings(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Every window that a row shares with an item, verbatim or slots agreeing; ``low`` and ``high`` are the key of its text."""
    widths = sorted(widths_of(benchmark, width))
    items = all_windows(benchmark, "item_id", (width,), whole=True)
    if items.count() > most:
        left = all_windows(docs, "doc_id", widths).distinct().toDF("low", "high", "doc_id", "doc_at", "doc_windows", "hash", "literal", "slots")
        right = items.drop("low", "high").toDF("item_id", "item_at", "item_windows", "hash", "item_literal", "item_slots")
        # By the literal hash only verbatim windows meet, by the other one the rest.
        pairs = left.join(right, "hash").where("(hash = literal and hash = item_literal) or (hash <> literal and literal <> item_literal)")
        hit = F.struct("item_at", "item_windows", "doc_at", "slots", "item_slots", (F.col("literal") == F.col("item_literal")).alias("same"))
        # One group is one item's windows of one width at most. Windows of a text and the width say together how long it is.
        length = F.col("doc_windows").alias("width")
        copies = pairs.groupBy("low", "high", "doc_id", "item_id", length, (F.col("doc_at") - F.col("item_at")).alias("offset")).agg(F.collect_list(hit).alias("hits"))

        def settle(batches):
            for batch in batches:
                out = []
                for low, high, doc, item, hits in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 6)), strict=True):
                    made = [(item, h["item_at"], h["item_windows"], h["doc_at"], h["item_slots"], h["item_slots"] if h["same"] else h["slots"], h["same"] or h["item_slots"] == h["slots"]) for h in hits]
                    out += [(low, high, doc, *h[:4], h[6]) for h in settled(made)]
                yield _rows(out)

        return copies.mapInArrow(settle, MEETINGS)
    shared = docs.sparkSession.sparkContext.broadcast(Index(items.collect()))  # at most ``most`` windows

    def run(batches):
        maker, index = Templates(), shared.value
        for batch in batches:
            low, high, keys, texts = (batch.column(i).to_pylist() for i in range(4))
            yield _rows([(low[k], high[k], keys[k], *h) for k, hits in _meetings(maker, texts, index, widths) for h in hits])

    return docs.select(*_text_key(), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEETINGS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that meet: doc_id, item_id, n_windows, coverage, verbatim, reparameterised."""
    one = meetings(docs, benchmark).groupBy("doc_id", "item_id", "item_at").agg(F.max("item_windows").alias("of"), F.max("verbatim").alias("verbatim"))
    both = one.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.round(F.least(F.lit(1.0), F.count("*") / F.max("of")), 6).alias("coverage"), F.max("verbatim").alias("verbatim"), (~F.min("verbatim")).alias("reparameterised"))
    return both.select("doc_id", "item_id", "n_windows", "coverage", "verbatim", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` whose texts meet no item, all columns kept."""
    widths = sorted(widths_of(benchmark, width))
    items = all_windows(benchmark, "item_id", (width,), whole=True)
    if items.count() > most:
        names = [fresh(docs, x) for x in ("_low", "_high")]
        bad = meetings(docs, benchmark, width, most).select("low", "high").distinct().toDF(*names)
        low, high = _text_key()
        return docs.join(bad, (low == F.col(names[0])) & (high == F.col(names[1])), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(Index(items.collect()))  # at most ``most`` windows
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        maker, index = Templates(), shared.value
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            good[[k for k, _ in _meetings(maker, batch.column(at).to_pylist(), index, widths)]] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
