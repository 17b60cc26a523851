import sys
import zlib
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from millrace.llm import pii, tokens, toxicity
from test_decontam import brute as leaks
from test_jaccard import brute as jaccard_components

SF = "/root/testdata/sf0.01"


def test_run_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.Scorer(model.gram_scores().astype(np.float32), model.odds_bias()).score(list(docs.values()))
    docs = {i: t for (i, t), s in zip(docs.items(), scores, strict=True) if s < toxicity.THRESHOLD}
    parts = jaccard_components(docs.items())
    docs = {i: t for i, t in docs.items() if parts[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {doc for doc, _ in leaks(docs.items(), items)}
    plain = Tokenizer.from_file(tokens.default_path())
    want = {}
    for i, t in docs.items():
        if i not in leaky:
            ids = [*plain.encode(pii.redact(t, pii.find_spans(t)), add_special_tokens=False).ids, 2]
            want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    whole = pieces[(pieces.start == 0) & (pieces.length == pieces.doc_tokens)]
    assert set(pieces.doc_id) == set(want) and len(leaky) > 0
    assert all(want[i] == (n, c) for i, n, c in zip(whole.doc_id, whole.doc_tokens, whole.ids_crc32, strict=True))
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        docs = out


def test_odd_rows_pass_every_stage(spark):
    text = "A plain text of some words that stands here for all the others. " * 3
    names = ["_own", "_mark", "toxic_score", "_low", "_before", "kept", "mark", "component"]
    rows = [(1, text), (1, text), (2, text + "more"), (3, None), (None, ""), (4, "x " * 150_000), (5, "Write to a.b@example.com now, please do.")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[k] * len(names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for empty in (False, True):
        left = docs.where("false") if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, "/root/testdata/sf0.001")
            assert left.columns == docs.columns
        found = [r.doc_id for r in left.select("doc_id").collect()]
        assert sorted(i or 0 for i in found) == ([] if empty else [0, 1, 3, 4, 5])
        pieces = corpus_pipeline.pack_sequences(spark, left, "/root/testdata/sf0.001").toPandas()
        assert sorted(set(pieces.doc_id.fillna(0).astype(int))) == ([] if empty else [0, 1, 3, 4, 5])
