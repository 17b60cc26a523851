"""Word shingles of whole texts, hashed in numpy straight from Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Its 64-bit hash is a
polynomial over its bytes, read off one running sum per stretch of text, so no
Python object is made per word and memory follows the stretch, not the text's
number of distinct words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
#: Bytes whose running sum is held at once; a longer word is digested by itself.
STRETCH = 1 << 16
#: Bytes of text whose words are held at once; a longer text is one block.
BLOCK = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]


def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row borders of a string array; a null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, raw = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    borders = np.frombuffer(places, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)), borders


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``data``, and how many words each row has; ``borders`` are relative to ``data``."""
    inside = ~_BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = borders[(borders > 0) & (borders < len(data))]
    begin[cuts] |= inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + STRETCH, "right"))
        if j == i:  # one word longer than the stretch
            out[i] = xxhash.xxh3_64_intdigest(data[a : ends[i]].tobytes().lower())
            i += 1
            continue
        n = ends[j - 1] - a
        run = _VALUE[data[a : a + n]]
        run *= _UP[:n]
        np.cumsum(run, out=run)
        s, e = starts[i:j] - a, ends[i:j] - a
        before = np.where(s > 0, run[s - 1], np.uint64(0))
        out[i:j] = _mixed((run[e - 1] - before) * _DOWN[s] + (e - s).astype(np.uint64))
        i = j
    return out, np.diff(np.searchsorted(starts, borders))


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row."""
    n = len(words) - k + 1
    out, shifted = np.full(n, k, np.uint64), np.empty(n, np.uint64)
    for i in range(k):
        out ^= words[i : n + i]
        out *= _MIX
        np.right_shift(out, np.uint64(31), out=shifted)
        out ^= shifted
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Sorted distinct 64-bit shingles of each text; a text of fewer words is one shingle, one without words has none."""
    data, borders = buffers(texts)
    i, n = 0, len(borders) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
        part = data[borders[i] : borders[j]]
        hashes, counts = word_hashes(part, borders[i : j + 1] - borders[i]) if len(part) else (np.empty(0, np.uint64), np.zeros(j - i, np.int64))
        rolled = _rolled(hashes, words) if len(hashes) >= words else hashes
        last = np.cumsum(counts)
        for start, count in zip((last - counts).tolist(), counts.tolist(), strict=True):
            if count >= words:
                out = np.sort(rolled[start : start + count - words + 1])
                fresh = np.ones(len(out), bool)
                np.not_equal(out[1:], out[:-1], out=fresh[1:])
                yield out if fresh.all() else out[fresh]
            elif count:
                yield _rolled(hashes[start : start + count], count)
            else:
                yield np.empty(0, np.uint64)
        i = j
