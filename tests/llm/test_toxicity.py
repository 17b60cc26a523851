import zlib

import numpy as np
import pytest

from millrace.llm import queries, toxicity
from millrace.llm.characters import Characters

SF = "/root/testdata/sf0.1"


def grams(words):
    found = toxicity.Words(Characters(), words)
    flat, owner = toxicity.word_grams(found.codes, found.starts, found.ends, found.hash)
    return [flat[owner == k] for k in range(len(found.starts))]


def test_misspelling_shares_grams():
    cut = grams(["horrible", "horribble", "zzz"])
    assert len(set(cut[0]) & set(cut[1])) >= 8 and not set(cut[0]) & set(cut[2])
    assert set(grams(["Horribble"])[0]) == set(cut[1]) and len(cut[0]) == 8 + 7 + 6 + 1


def test_words_are_distinct_runs_of_letters():
    texts = ["The cat_the CAT 9lives", None, "", "Éaux. éaux! x²", "a" * 300_000 + " b"]
    found = toxicity.Words(Characters(), texts)
    cut = ["".join(map(chr, found.codes[s:e])) for s, e in zip(found.starts, found.ends, strict=True)]
    assert cut[:3] == ["the", "cat", "lives"] and cut[3] == "éaux" and found.counts.tolist() == [3, 0, 0, 2, 2]


def test_score_matches_a_plain_computation():
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = ["one two three four five six seven", "one", None, "one one one two", "x" * 50_000 + " two"]
    got = toxicity.Scorer(weights, 0.25).score(texts)
    for text, value in zip(texts, got, strict=True):
        words = list(dict.fromkeys((text or "").split()))
        means = sorted((float(weights[grams([w])[0]].mean()) for w in words), reverse=True)[: toxicity.TOP_WORDS]
        assert abs(value - 1 / (1 + np.exp(-(np.mean(means) if means else 0) - 0.25))) < 1e-6


def test_one_class_or_none_is_constant():
    for labels in ([], [0, 0]):
        model = toxicity.fit(["a b", None][: len(labels)], labels)
        assert len(set(toxicity.Scorer(model.gram_scores(), model.odds_bias()).score(["x", None, ""]))) == 1


@pytest.fixture(scope="module")
def result(spark):
    return queries.op8_toxicity(spark, SF).toPandas()


def test_held_out_accuracy(spark, result):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    found = labels.merge(result, on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    out = found[found.held_out]
    hit = out.predicted == 1
    assert out.toxic[hit].mean() > 0.8 and hit[out.toxic == 1].mean() > 0.8


def test_rows_and_odd_input(spark, result):
    assert len(result) == spark.read.parquet(f"{SF}/documents.parquet").count() and result.score.between(0, 1).all()
    docs = spark.createDataFrame([(1, None, 5.0), (None, "x", 1.0), (2, "", 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (9, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_clashing_columns_and_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot", 0.5), (2, "kind words", 0.1)], "doc_id long, text string, toxic_score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs, model).columns == [*docs.columns, "toxic_score_1"]
