import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, token_store, tokens

ODD = ["", None, "Don't stop", "İstanbul ΣΑΣ é  x y", "<|endoftext|>a <|startoftext|> b", "日本語 text", "''s !!'re", "x" * 3000, "a\tb\nc\r\nd", "½ 3.14 ²", "\u0085q​z", "…“quoted”—it's"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_library_ids(plain):
    rng = random.Random(3)
    alphabet = "abcXYZ019 .,!?'\n\téßÀ’-_<|>́ "
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    coder = tokens.PieceEncoder(tokens.default_path())
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, coder.dtype).tolist() == ids_of(plain, text)[:-1], repr(text)


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(planes, width):
    for n in (0, 1, 7, 1000, 2500):
        ids = np.random.default_rng(n).integers(0, 49_000, n).astype(f"<u{width}")
        ends, payload = token_store.pack_ids(ids, planes, 1000)
        assert (token_store.unpack_ids(ends, payload, n, width, planes, 1000) == ids).all()


def docs(spark, texts):
    return spark.createDataFrame([(i * 3, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)


def test_store_matches_plain_encoding(spark, tmp_path, plain):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, ODD * 5), path, segment_ids=500, block_ids=64, planes="bit")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, path).collect()}
    start = 0
    for i, text in enumerate(ODD * 5):
        ids = ids_of(plain, text)
        assert got[i * 3] == (start, len(ids), crc(ids))
        start += len(ids)


def test_empty_store(spark, tmp_path):
    token_store.write_store(docs(spark, ["x"]).where("false"), f"file://{tmp_path}/none")
    assert token_store.read_store(spark, f"file://{tmp_path}/none").count() == 0


def test_hilbert_visits_every_cell_by_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_index(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_covers_every_id_once(spark, plain):
    texts = ODD + ["word " * 9000, "same", "same", "same"]
    pieces = packing.pack(docs(spark, texts)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        ids, at = ids_of(plain, text), 0
        for p in sorted(by_doc[i * 3], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at & (at - 1) == 0 and at <= packing.SEQUENCE_IDS
    assert packing.pack(docs(spark, texts).where("false")).count() == 0


def test_repeated_and_null_keys(spark, plain, tmp_path):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id long, text string")
    assert sum(p.length for p in packing.pack(df).collect()) == 2 * 3 + 1
    token_store.write_store(df, f"file://{tmp_path}/ties")
    assert sorted((r.start, r.n_tokens) for r in token_store.read_store(spark, f"file://{tmp_path}/ties").collect()) == [(0, 2), (2, 1), (3, 2), (5, 2)]


def test_other_vocabularies_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "It's": 1, "the": 2}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "other.json")
    other.save(path)
    coder = tokens.PieceEncoder(path)
    assert coder.whole and np.frombuffer(coder.encode(["It's the It's", None])[0], coder.dtype).tolist() == [1, 2, 1]
    assert not tokens.PieceEncoder(tokens.default_path()).whole
