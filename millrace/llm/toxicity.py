"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 to 5, with word borders)
and of itself; a document shows the average of its ``TOP_WORDS`` most telling
distinct words to a linear softmax. Embeddings and softmax are trained together
in numpy. Unseen misspellings share most n-grams with known words. Averaging the
most telling words instead of all is a departure from the plain bag: a few words
count in a text of any length (the plain average, and the average of any 24
words in a row, hide them). While training, each document shows random words
first and then those that score highest.

Bound. The fit takes at most ``MAX_PER_CLASS`` rows of each label (those with
the smallest hash of their id, whatever the size of the corpus) of at most
``MAX_BYTES`` bytes; that sample is all the driver holds. Scoring is a narrow
pass over every whole text, in numpy over blocks of bounded size, without an
object per word.

Defined cases: a null or wordless text scores as an empty bag (the bias); texts
of any length are scored whole; null ids are never held out; labels that are
null or lack a document are skipped, and of labels that repeat an id the
smallest counts; with no labelled row of one class every document scores the
smoothed share of toxic labels; equal texts, and so ties and repeated rows,
score alike; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.characters import LETTER, Characters, mixed
from millrace.llm.tokens import blocks
from millrace.session import fresh

MAX_PER_CLASS = {1: 3_000, 0: 6_000}
MAX_BYTES = 16_384
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
TOP_WORDS = 4
#: Words in a row that a document shows in the first epochs.
RANDOM_WORDS = 24
RANDOM_EPOCHS = 3
EPOCHS = 12
BATCH = 64
RATE = 0.1
#: Documents of the sample that must hold an n-gram for it to have an embedding.
LEAST_DOCS = 10
#: Every so many rows of the sample only calibrate.
CALIBRATION = 5
THRESHOLD = 0.7
SEED = 7
BLOCK_CHARS = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The distinct words of each text of a block, text by text in order of first use."""

    def __init__(self, characters: Characters, texts: list[str | None]):
        parts = [(t or "").lower() for t in texts]
        self.codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        characters.need(self.codes)
        inside = characters.kind[self.codes] == LETTER
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        row = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
        hashes = word_hashes(self.codes, starts, ends)
        first = np.sort(np.unique(hashes ^ mixed((row + 1).astype(np.uint64) * _BASE), return_index=True)[1])
        self.starts, self.ends, self.row, self.hash = starts[first], ends[first], row[first], hashes[first]
        self.counts = np.bincount(self.row, minlength=len(texts))


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a word, from as many steps as the longest common length and the rest from running sums."""
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = mixed((codes[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * (mixed((place + 1).astype(np.uint64) * _BASE) | np.uint64(1)))
    return mixed(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)) if len(starts) else np.empty(0, np.uint64)


def word_grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and of the words themselves (by their hashes ``own``), and the word of each."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = ends - starts + 2
    last = np.cumsum(lengths)
    total = int(last[-1])
    code = codes[np.clip(np.repeat(starts - 1 - last + lengths, lengths) + np.arange(total), 0, len(codes) - 1)].astype(np.uint64)
    code[last - lengths], code[last - 1] = ord("<"), ord(">")
    word_of = np.repeat(np.arange(len(starts)), lengths)
    left = np.repeat(last, lengths) - np.arange(total)  # code points up to the word's end
    owners, hashes = [np.arange(len(starts))], [own]
    rolled = code
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * _BASE + code[n - 1 :]
        if n in GRAMS:
            fits = np.flatnonzero(left[: len(rolled)] >= n)
            hashes.append((rolled[fits] ^ np.uint64(n)) * _BASE)
            owners.append(word_of[fits])
    return (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners)


@dataclass
class Model:
    """Embeddings of the n-gram buckets, softmax weights and bias."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def gram_scores(self) -> np.ndarray:
        """Contribution of each bucket to the log odds; averaging is linear, so a scalar is enough for scoring."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])

    def odds_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(values.shape[1])], 1)


def top_mean(scores: np.ndarray) -> float:
    """Mean of the ``TOP_WORDS`` highest scores; 0 without words."""
    return float((scores if len(scores) <= TOP_WORDS else np.partition(scores, len(scores) - TOP_WORDS)[-TOP_WORDS:]).mean()) if len(scores) else 0.0


def top_words(scores: np.ndarray) -> np.ndarray:
    """Places of the ``TOP_WORDS`` highest scores."""
    return np.arange(len(scores)) if len(scores) <= TOP_WORDS else np.argpartition(scores, len(scores) - TOP_WORDS)[-TOP_WORDS:]


class Sample:
    """Documents as arrays of word numbers, and the n-grams of each word."""

    def __init__(self, texts: list[str | None]):
        characters, rows, known = Characters(), [], np.empty(0, np.uint64)
        found: list = []
        for a, b in blocks(texts, BLOCK_CHARS):
            words = Words(characters, texts[a:b])
            rows += np.split(words.hash, np.cumsum(words.counts)[:-1])
            new, first = np.unique(words.hash, return_index=True)
            at = np.minimum(np.searchsorted(known, new), max(0, len(known) - 1))
            unseen = known[at] != new if len(known) else np.ones(len(new), bool)
            flat, owner = word_grams(words.codes, words.starts[first[unseen]], words.ends[first[unseen]], new[unseen])
            found.append((new[unseen], flat[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=int(unseen.sum()))))
            known = np.sort(np.concatenate([known, new[unseen]]))
        hashes = np.concatenate([h for h, _, _ in found]) if found else known
        self.flat = np.concatenate([f for _, f, _ in found]) if found else np.empty(0, np.int32)
        self.sizes = np.concatenate([n for _, _, n in found]) if found else np.empty(0, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        number = np.argsort(hashes)
        self.docs = [number[np.searchsorted(known, r)].astype(np.int32) for r in rows]

    def common(self, use: np.ndarray) -> np.ndarray:
        """Buckets that at least ``LEAST_DOCS`` of these documents hold."""
        seen = np.zeros(BUCKETS, np.int64)
        for ids in (self.docs[k] for k in np.flatnonzero(use)):
            n = self.sizes[ids]
            at = np.repeat(self.begins[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen[np.unique(self.flat[at])] += 1
        return seen >= LEAST_DOCS

    def scores(self, model: Model) -> np.ndarray:
        """Score of every word, in runs that keep memory low."""
        grams, out = model.gram_scores().astype(np.float32), []
        for i in range(0, len(self.begins) - 1, 20_000):
            ends = self.begins[i : i + 20_001]
            out.append(np.add.reduceat(grams[self.flat[ends[0] : ends[-1]]], ends[:-1] - ends[0]) / np.diff(ends))
        return np.concatenate(out) if out else np.empty(0)


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Train on a bounded sample held in memory."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels, np.int64)
    model = Model(rng.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS)) / DIMENSIONS, np.zeros((DIMENSIONS, 2)), np.zeros(2))
    if len(set(labels)) < 2:
        model.bias[1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return model
    model.weights[:] = rng.normal(0, 0.1, model.weights.shape)
    sample = Sample(texts)
    fitted = np.arange(len(y)) % CALIBRATION != 0
    # An n-gram of few documents would only learn those by heart.
    known = sample.common(fitted)
    model.embeddings[~known] = 0
    share = np.maximum(np.bincount(y[fitted], minlength=2), 1)
    cost = len(y) / (2 * share[y])  # both classes weigh the same
    sums = [np.full(x.shape, 1e-12) for x in (model.embeddings, model.weights, model.bias)]
    for epoch in range(epochs):
        per_word = sample.scores(model) if epoch >= RANDOM_EPOCHS else None
        shown = []
        for ids in sample.docs:
            if per_word is None:
                at = int(rng.integers(0, max(1, len(ids) - RANDOM_WORDS + 1)))
                shown.append(ids[at : at + RANDOM_WORDS])
            else:
                shown.append(ids[top_words(per_word[ids])])
        order = rng.permutation(np.flatnonzero(fitted))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            _step(model, [shown[k] for k in some], y[some], cost[some], sample, known, sums, RATE * (1 - epoch / epochs))
    per_word = sample.scores(model)
    _calibrate(model, np.array([top_mean(per_word[sample.docs[k]]) for k in np.flatnonzero(~fitted)]), y[~fitted])
    return model


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Stretch and shift the log odds on rows of the sample that the steps left out."""
    if len(set(y.tolist())) < 2:
        return
    x = x + model.odds_bias()
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g, h = p - y, p * (1 - p)
        slopes = np.array([(g * x).sum() + 0.1 * (slope - 1), g.sum()])
        curve = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(curve, slopes), -1, 1)
        slope, shift = max(0.1, slope - move[0]), shift - move[1]
    model.weights *= slope
    model.bias *= slope
    model.bias[1] += shift


def _step(model: Model, docs, y, cost, sample: Sample, known, sums, rate) -> None:
    """One Adagrad step over a batch of bags of words."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    words, which = np.unique(np.concatenate(docs), return_inverse=True)
    doc_of = np.repeat(np.arange(len(docs)), lengths)
    n_grams = sample.sizes[words]
    first = np.repeat(sample.begins[words] - np.concatenate([[0], np.cumsum(n_grams)[:-1]]), n_grams) if len(words) else np.empty(0, np.int64)
    gram = sample.flat[first + np.arange(len(first))]
    word_of = np.repeat(np.arange(len(words)), n_grams)
    buckets, inverse = np.unique(gram, return_inverse=True)
    vectors = _sums(model.embeddings[gram], word_of, len(words)) / np.maximum(n_grams, 1)[:, None]
    hidden = _sums(vectors[which], doc_of, len(docs)) / np.maximum(lengths, 1)[:, None]
    logits = hidden @ model.weights + model.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (cost / len(y))[:, None]
    up = p @ model.weights.T / np.maximum(lengths, 1)[:, None]
    by_word = _sums(up[doc_of], which, len(words)) / np.maximum(n_grams, 1)[:, None]
    found = ((model.embeddings, sums[0], buckets, _sums(by_word[word_of], inverse, len(buckets)) * known[buckets][:, None]), (model.weights, sums[1], slice(None), hidden.T @ p), (model.bias, sums[2], slice(None), p.sum(0)))
    for parameter, seen, at, slope in found:
        seen[at] += slope**2
        parameter[at] -= rate * slope / np.sqrt(seen[at])


class Scorer:
    """Scores whole texts."""

    def __init__(self, gram_scores: np.ndarray, bias: float):
        self.grams, self.bias, self.characters = gram_scores, bias, Characters()

    def score(self, texts: list[str | None]) -> list[float]:
        best = []
        for a, b in blocks(texts, BLOCK_CHARS):
            words = Words(self.characters, texts[a:b])
            flat, owner = word_grams(words.codes, words.starts, words.ends, words.hash)
            scores = np.bincount(owner, self.grams[flat]) / np.bincount(owner)
            ends = np.cumsum(words.counts).tolist()
            best += [top_mean(scores[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
        return (1 / (1 + np.exp(-np.clip(np.array(best) + self.bias, -500, 500)))).tolist()


def held_out(key: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where("_id is not null and _y is not null").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    # At most the sum of MAX_PER_CLASS ids: a proven bound for the broadcast.
    picked = None
    for y, most in MAX_PER_CLASS.items():
        part = usable.where(F.col("_y") == y).orderBy(*order).limit(most)
        picked = part if picked is None else picked.unionByName(part)
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_BYTES)
    sample = short.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "text", "_y").toPandas()
    sample = sample.sort_values(["_id", "text"], kind="stable").drop_duplicates("_id")
    texts, toxic = sample["text"].tolist(), sample["_y"].astype(int).tolist()
    del sample
    return fit(texts, toxic)


def score(docs: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and, at the end, the score: called ``column``, or the next free name where that is taken."""
    column = fresh(docs, column)
    grams, bias = model.gram_scores().astype(np.float32), model.odds_bias()
    shared = docs.sparkSession.sparkContext.broadcast(grams)  # BUCKETS floats
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            for a, b in blocks(batch.column(at).to_pylist(), 4 * BLOCK_CHARS):
                part = batch.slice(a, b - a)
                yield part.append_column(column, pa.array(scorer.score(part.column(at).to_pylist()), pa.float64()))

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    column = fresh(docs, "toxic_score")
    return score(docs, model, column).where(F.col(column) < threshold).drop(column)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
