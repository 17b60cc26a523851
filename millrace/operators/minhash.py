"""Deduplication by MinHash buckets: a row goes if a kept row before it shares a bucket.

A signature holds the minima of 16 permutations of the grams' 32-bit digests;
each band of four minima is a bucket. Rows are taken in the order of their ids,
and only kept rows are entered in their buckets, so what is dropped hides
nothing. That order is settled in rounds over (row, bucket) entries, without
pairs: the first open row of all its buckets is kept, all others in a kept row's
buckets go, and the rest is open for the next round.

Scale. Rows of one signature are one class from the start, and buckets of one
class decide nothing. A bucket's first row is a minimum that combines before the
shuffle, and joins back to entries are plain equi-joins that adaptive execution
splits, so a bucket may hold a third of all rows. Rounds are written; there are
as many as the longest chain of rows of which each is decided by the one before.

Defined cases: a null text counts as empty, and empty texts equal each other;
texts of fewer than three characters are one gram; rows that repeat an id are
entered once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import similarity as M
from millrace.session import written

# The masks of the 16 permutations; bands of four.
SEEDS = (
    0x9E3779B9, 0x517CC1B7, 0xBF58476D, 0x94D049BB, 0x6C62272E, 0xC2B2AE35, 0x165667B1, 0xFF51AFD7,
    0x4BE98134, 0xDBC97B49, 0xA54FF53A, 0x3C6EF372, 0xABB58F65, 0x7FB5D329, 0xD76AA478, 0x02441453,
)
BAND = 4
#: Digests of grams that a task holds at most, and the bits of a character.
MOST_KNOWN, LOW = 1 << 19, (1 << 21) - 1


def grams(text: Column) -> Column:
    """Distinct character 3-grams; of an empty text the empty one."""
    return T.let(T.char_grams(F.coalesce(text, F.lit(""))), lambda g: F.when(F.size(g) == 0, F.array(F.lit(""))).otherwise(g))


def digests(codes: np.ndarray, known: dict[int, int]) -> np.ndarray:
    """The low 32 bits of md5 of grams, given as their characters' codes plus one, 21 bits each; ``known`` holds those made before."""
    own, at = np.unique(codes, return_inverse=True)
    if len(known) + len(own) > MOST_KNOWN:
        known.clear()
    out = np.empty(len(own), np.uint32)
    for k, code in enumerate(own.tolist()):
        found = known.get(code)
        if found is None:
            gram = "".join(chr(c - 1) for c in (code >> 42, code >> 21 & LOW, code & LOW) if c)
            found = known[code] = int.from_bytes(hashlib.md5(gram.encode()).digest()[12:], "big")
        out[k] = found
    return out[at]


def signatures(texts: list[str | None], seeds: tuple[int, ...], known: dict[int, int], chars: int = 1 << 20) -> np.ndarray:
    """A row of minima per text; texts are read in blocks of about ``chars`` characters, longer ones in pieces."""
    out = np.full((len(texts), len(seeds)), 0xFFFFFFFF, np.uint32)
    owners: list[int] = []
    pieces: list[str] = []
    held = 0

    def close() -> None:
        sizes = np.array([max(3, len(p)) for p in pieces])
        signs = np.zeros(sizes.sum(), np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        short = np.array([len(p) for p in pieces]) < 3
        whole = np.frombuffer("".join(p if len(p) > 2 else p + "\0" * (3 - len(p)) for p in pieces).encode("utf-32-le"), np.uint32)
        signs[:] = whole
        signs += 1
        for k in np.flatnonzero(short):
            signs[starts[k] + len(pieces[k]) : starts[k] + 3] = 0
        first = np.ones(len(signs), bool)
        first[starts + sizes - 1] = first[starts + sizes - 2] = False
        at = np.flatnonzero(first)
        found = digests(signs[at] << 42 | signs[at + 1] << 21 | signs[at + 2], known)
        begins = starts - 2 * np.arange(len(pieces))
        for k, mask in enumerate(seeds):
            np.minimum.at(out[:, k], owners, np.minimum.reduceat(found ^ np.uint32(mask), begins))
        owners.clear()
        pieces.clear()

    for i, text in enumerate(texts):
        text = text or ""
        for start in range(0, max(1, len(text) - 2), chars):
            owners.append(i)
            pieces.append(text[start : start + chars + 2])
            held += len(pieces[-1])
            if held >= chars:
                close()
                held = 0
    if pieces:
        close()
    return out


def signature(text: Column, seeds: tuple[int, ...] = SEEDS) -> Column:
    """Minima over the 3-grams of the low 32 bits of md5, under each mask; in Arrow batches, where each gram is digested once."""

    @F.pandas_udf("array<long>")
    def minima(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[int, int] = {}
        for part in parts:
            yield pd.Series(list(signatures(part.tolist(), seeds, known).astype(np.int64)))

    return minima(T.collapse(F.lower(F.coalesce(text, F.lit("")))))


def buckets(sig: Column, n: int = len(SEEDS), band: int = BAND) -> Column:
    """One key per band of a signature."""
    return F.array(*[F.concat(F.lit(f"b{k}:"), F.array_join(F.slice(sig, k * band + 1, band).cast("array<string>"), "-")) for k in range(n // band)])


def bucket_keep(rows: DataFrame) -> DataFrame:
    """id and kept, of rows (id, keys): kept if no kept row before shares a key."""
    rows = written(rows.select("id", "keys"), "bucket-rows")
    firsts = written(rows.groupBy("keys").agg(F.min("id").alias("id")), "bucket-classes")
    entries = firsts.select("id", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    still = written(entries.join(met, "key"), "bucket-open")
    lost_parts = []
    while still.limit(1).count():
        lowest = still.groupBy("key").agg(F.min("id").alias("first"))
        kept = still.join(lowest, "key").groupBy("id").agg(F.min("first").alias("first")).where("first = id").select("id")
        kept = written(kept, "bucket-kept")
        taken = still.join(kept, "id", "left_semi").select("key").distinct()
        reached = still.join(taken, "key", "left_semi").select("id").distinct()
        lost = written(reached.join(kept, "id", "left_anti"), "bucket-lost")
        lost_parts.append(lost)
        still = written(still.join(kept.unionByName(lost), "id", "left_anti"), "bucket-open")
    alone = firsts.select("id", F.lit(True).alias("kept"))
    if lost_parts:
        gone = reduce(DataFrame.union, lost_parts).withColumn("gone", F.lit(True))
        alone = firsts.select("id").join(gone, "id", "left").select("id", F.col("gone").isNull().alias("kept"))
    return rows.select("id").join(alone, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def dedup(texts: DataFrame, verify: int | None = None) -> DataFrame:
    """id, kept and reason (exact, near, null) of rows (id, text); ``verify`` asks for that percentage of common grams too.

    Exact is a row whose stripped text a kept row has. With ``verify``, a shared
    bucket alone drops nothing: pairs that alike are found by the similarity
    join, and those without a common bucket are left out.
    """
    more = [] if verify is None else [F.transform(grams(F.col("text")), lambda g: F.xxhash64(g)).alias("grams")]
    made = texts.select("id", F.sha2(T.strip(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("digest"), signature(F.col("text")).alias("signature"), *more)
    made = written(made.withColumn("keys", buckets(F.col("signature"))).drop("signature"), "minhash-rows")
    if verify is None:
        kept = bucket_keep(made)
    else:
        sets = made.select("id", "grams")
        members = written(M.classes(sets), "minhash-classes")
        heads = M.heads(made, members)
        found = M.pairs(heads.select("id", "grams"), None, verify).select("a", "b")
        keys = heads.select("id", "keys")
        bound = found.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b").where(F.arrays_overlap("ka", "kb"))
        first = M.greedy_keep(heads.select("id"), bound.select("a", "b")).withColumnRenamed("id", "class")
        kept = members.join(first, "class").select("id", (F.col("kept") & (F.col("id") == F.col("class"))).alias("kept"))
    flags = written(kept.join(made.select("id", "digest"), "id"), "minhash-kept")
    held = flags.where("kept").select("digest", F.lit("exact").alias("why")).distinct()
    reason = F.when(~F.col("kept"), F.coalesce("why", F.lit("near")))
    return flags.join(held, "digest", "left").select("id", "kept", reason.alias("reason"))
