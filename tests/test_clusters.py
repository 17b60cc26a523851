"""Order-dependent dedup and clusters against plain runs, one row after the other."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import minhash as H
from millrace.operators import similarity as M
from millrace.session import written


def rows_of(seed, n=90, words=14):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijkl") * 3 for _ in range(words)) for _ in range(6)]
    out = []
    for i in range(n):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice("mnopq") * 3
        out.append((i * 7, rng.choice(["x", "y"]), rng.choice(["s", "t", None]), " ".join(text)))
    crowd = base[0] + " more"
    out += [(10_000 + i, "x", "s", crowd) for i in range(n // 2)] + [(20_000, "x", "s", ""), (20_001, "x", "s", None), (20_002, "y", "t", "ab"), (20_003, "y", "t", " AB ")]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, domain string, task string, text string").repartition(5)


def char_grams(text):
    flat = " ".join((text or "").lower().split())
    return {flat[i : i + 3] for i in range(max(1, len(flat) - 2))}


def keys(text):
    low = [int(hashlib.md5(g.encode()).hexdigest()[-8:], 16) for g in char_grams(text)]
    sig = [min(v ^ s for v in low) for s in H.SEEDS]
    return [f"b{k}:" + "-".join(map(str, sig[4 * k : 4 * k + 4])) for k in range(4)]


def like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_dedup(rows, verify=None):
    held, hashes, out = {}, set(), {}
    for i, *_, text in sorted(rows, key=lambda r: r[0]):
        digest, own, grams = (text or "").strip(), keys(text), char_grams(text)
        met = [g for k in own for g in held.get(k, [])]
        hit = any(verify is None or like(g, grams) >= verify for g in met)
        if hit:
            out[i] = (False, "exact" if digest in hashes else "near")
            continue
        out[i] = (True, None)
        hashes.add(digest)
        for k in own:
            held.setdefault(k, []).append(grams)
    return out


@pytest.mark.parametrize("verify", [None, 85])
def test_minhash_dedup_matches_a_sequential_run(spark, verify):
    rows = rows_of(3)
    got = {r.id: (r.kept, r.reason) for r in H.dedup(frame(spark, rows).select("id", "text"), verify).collect()}
    want = brute_dedup(rows, verify and verify / 100)
    assert got == want
    assert {reason for _, reason in want.values()} == {None, "exact", "near"}


def test_chains_of_buckets(spark):
    """Each row shares a bucket with the next alone: every other one is kept."""
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(9)] + [(100, ["z"]), (101, ["z"]), (102, ["z"])]
    df = spark.createDataFrame(rows, "id long, keys array<string>")
    assert {r.id for r in H.bucket_keep(df).where("kept").collect()} == {0, 2, 4, 6, 8, 100}
    assert H.bucket_keep(df.where("false")).count() == 0


def word_grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)} if w else set()


def brute_stars(rows):
    rows = sorted(rows, key=lambda r: r[0])
    grams, label, number = {r[0]: word_grams(r[3]) for r in rows}, {}, 0
    for k, (i, domain, task, _) in enumerate(rows):
        if i in label:
            continue
        dup = sim = False
        for j, d, t, _ in rows[k + 1 :]:
            s = like(grams[i], grams[j])
            if s >= 0.9 and d == domain and t == task:
                dup = True
                label[j] = ("DUPLICATE", i, number + 1)
            elif s >= 0.7 and d == domain:
                sim = True
                label.setdefault(j, ("SIMILAR", i, number + 1))
        number += dup or sim
        label[i] = ("DUPLICATE", i, number) if dup else ("SIMILAR", i, number) if sim else ("UNIQUE", None, None)
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_star_clusters_match_a_sequential_run(spark, seed):
    rows = rows_of(seed)
    sets = frame(spark, rows).select("id", "domain", "task", T.gram_hashes(F.coalesce("text", F.lit(""))).alias("grams"))
    got = {r.id: (r.kind, r.centre, r.cluster) for r in M.numbered_clusters(M.star_clusters(sets)).collect()}
    want = brute_stars(rows)
    assert got == want
    assert {kind for kind, *_ in want.values()} == {"DUPLICATE", "SIMILAR", "UNIQUE"}


def test_near_kept_matches_a_sequential_run(spark):
    rows = rows_of(5)
    kept = []
    for i, *_, text in sorted(rows, key=lambda r: r[0]):
        if not any(like(word_grams(text), word_grams(other)) >= 0.85 for other in kept):
            kept.append(text)
    got = {r.id for r in M.near_kept(frame(spark, rows).select("id", T.gram_hashes(F.coalesce("text", F.lit(""))).alias("grams")), 85).where("kept").collect()}
    want, texts = set(), []
    for i, *_, text in sorted(rows, key=lambda r: r[0]):
        if not any(like(word_grams(text), g) >= 0.85 for g in texts):
            want.add(i)
            texts.append(word_grams(text))
    assert got == want


def test_staged_contamination_stages(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    training = [(5, long, "c1"), (3, long, "c2"), (4, None, "c3"), (6, "a b", "c4"), (7, None, None), (8, long + " end", "c5")]
    cases = [(1, long, "x"), (2, "other words here now", "c3"), (3, long + " more", "x"), (4, "a b", "c9"), (5, "a b c", None), (6, None, None), (7, "b a", "c8")]
    schema = "id long, prompt string, content string"
    found = M.staged_contamination(spark.createDataFrame(cases, schema), spark.createDataFrame(training, schema))
    got = {r.id: (r.verdict, r.matched_id) for r in found.collect()}
    assert got == {1: ("exact_prompt", 3), 2: ("exact_content", 4), 3: ("near", 3), 4: ("exact_prompt", 6), 5: ("clean", None), 6: ("clean", None), 7: ("clean", None)}


def test_signatures_of_odd_texts(spark):
    """Short, empty and wide texts, and one longer than a block; grams of every length are told apart."""
    rng = random.Random(3)
    texts = [None, "", " ", "a", "ab", "abc", "a\0", "\0\0\0", "\U0010ffff" * 3, "\u4e00\U0001f600", "".join(rng.choice("abc \u00e9\u4e00\U0001f600") for _ in range(5000)), *(r[3] for r in rows_of(9, 20))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.k for r in df.select("id", H.buckets(H.signature(F.col("text"))).alias("k")).orderBy("id").collect()]
    assert got == [keys(t) for t in texts]
    flat = [" ".join((t or "").lower().split()) for t in texts]
    assert (H.signatures(flat, H.SEEDS, {}, chars=7) == H.signatures(flat, H.SEEDS, {})).all()


def test_long_texts_take_no_square_of_their_length(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh \u00e9") for _ in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text + " ")], "id long, text string")
    began = time.time()
    assert [(r.id, r.reason) for r in H.dedup(df).where("not kept").collect()] == [(2, "exact")]
    assert df.where(F.size(T.char_grams(F.col("text"))) == len(char_grams(text))).count() == 2
    assert time.time() - began < 60


def test_star_clusters_write_the_sets_once(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    rows = [(k, "x", "s", [draw.getrandbits(63) for _ in range(400)]) for k in range(300)]
    rows += [(1000 + k, "x", "s", rows[k][3][:-20]) for k in range(20)] + [(2000 + k, *rows[k][1:]) for k in range(20)]
    sets = spark.createDataFrame(rows, "id long, domain string, task string, grams array<long>")
    monkeypatch.setattr(M, "written", lambda df, label: written(df, label, folder=f"file://{tmp_path}"))
    assert M.star_clusters(sets).where("kind = 'DUPLICATE'").count() == 60
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.5 * 8 * sum(len(r[3]) for r in rows)


def test_heads_by_broadcast_and_by_join_are_the_same(spark, monkeypatch):
    rows = [(1, [1, 2]), (2, [1, 2]), (2, [3]), (3, [3]), (4, []), (4, []), (None, [1, 2]), (None, []), (5, [9]), (5, [1, 2])]
    sets = spark.createDataFrame(rows, "id long, grams array<long>")
    members = M.classes(sets)
    got = sorted((r.id, r.grams) for r in M.heads(sets, members).collect())
    want = sorted((r.id, r.grams) for r in sets.join(members.where("id = class").select("id").distinct(), "id", "left_semi").collect())
    monkeypatch.setattr(M, "MOST_SENT", 0)
    assert sorted((r.id, r.grams) for r in M.heads(sets, members).collect()) == got == want
    assert {i for i, _ in got} == {1, 2, 4, 5}
