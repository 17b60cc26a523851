import numpy as np
import pytest

from millrace.llm import lattice as L
from millrace.llm import queries
from millrace.llm.components import connected_components


def brute(rows, threshold=0.9):
    """Links, components by comparing all with all."""
    ids, unit = [], []
    for i, x in rows:
        x = None if x is None else np.array([np.nan if v is None else v for v in x], float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            ids.append(i)
            unit.append(x / np.linalg.norm(x))
    close = np.stack(unit) @ np.stack(unit).T >= threshold
    np.fill_diagonal(close, False)
    n = {i: int(c) for i, c in zip(ids, close.sum(1))}
    parts = {i: i for i in ids}
    for _ in ids:
        for k, i in enumerate(ids):
            parts[i] = min([parts[i], *(parts[ids[j]] for j in np.flatnonzero(close[k]))])
    return {i: (n.get(i, 0), parts.get(i, i)) for i, _ in rows}


def planted(seed=0, groups=12, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.standard_normal(width)
        for k in range(int(rng.integers(1, 9))):
            rows.append(base + rng.standard_normal(width) * 0.25 * (k % 3) / np.sqrt(width) * 2)
    rows += [rows[0], rows[0] * 1.0, rng.standard_normal(width)]
    return [(7 * i % 1000, x.tolist()) for i, x in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "s") for i, x in rows], "vec_id long, embedding array<double>, rep string")


def test_decoding_is_nearest():
    rng, found = np.random.default_rng(1), L.facets()
    assert found.shape == (240, 8) and np.allclose((found**2).sum(1), 2)
    x = rng.standard_normal((500, 8)) * 2
    at = L.decode(x)
    gap = ((x - at) ** 2).sum(1)
    assert all((gap <= ((x - at - f) ** 2).sum(1) + 1e-12).all() for f in found)


@pytest.mark.parametrize("rows, small", [(4_096, 64), (4, 64), (4_096, 1), (3, 2)])
def test_matches_brute_force_also_in_blocks(spark, monkeypatch, rows, small):
    monkeypatch.setattr(L, "BLOCK_ROWS", rows)
    monkeypatch.setattr(L, "SMALL_CELL", small)
    monkeypatch.setattr(L, "PAIRS", 7)
    data = [*planted(), (2001, None), (2002, []), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [None] + [1.0] * 15), (2006, [float("inf")] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in L.near_duplicates(frame(spark, data), sizes=((None, 1, 16),)).collect()}
    assert got == brute(data)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op6_lattice(spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_every_length_is_searched(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1]), (6, [1.0]), (7, [2.0]), (8, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in L.near_duplicates(frame(spark, rows), sizes=((None, 1, 16),)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_ties_at_the_threshold_and_long_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [1.0] + [0.0] * 19_999), (4, [1.0, 1e-3] + [0.0] * 19_998)]
    got = {r.vec_id: r.n_links for r in L.near_duplicates(frame(spark, rows), threshold=0.96, sizes=((None, 1, 16),)).collect()}
    assert got[1] == got[2] == int(np.array([0.6, 0.8]) @ np.array([0.8, 0.6]) >= 0.96) and got[3] == got[4] == 1


def test_empty_and_null_ids(spark):
    df = frame(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])])
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in L.near_duplicates(df).collect()) == [(0, 0, 0), (1, 0, 1), (1, 0, 1)]
    assert L.near_duplicates(df.where("false")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (300, 299), (299, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def at_the_threshold(n, width=64, seed=5):
    """Two lists of unit vectors, pairwise at the cosine 0.9."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, 0.9000001 * x + np.sqrt(1 - 0.9000001**2) * y


@pytest.mark.parametrize("setting", range(len(L.SIZES)))
def test_no_setting_finds_less_than_the_first(setting):
    x, y = at_the_threshold(2_000)

    def share(blocks, tables):
        lattice, hit = L.Lattice(64, blocks, tables), np.zeros(len(x), bool)
        for t in range(tables):
            a, b = lattice.cells(x, t), lattice.cells(y, t)
            hit |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
        return hit.mean()

    found = share(*L.SIZES[setting][1:])
    print("setting", L.SIZES[setting], "share", found)
    assert found >= share(*L.SIZES[0][1:]) - 0.002


@pytest.mark.parametrize("setting", range(len(L.SIZES)))
def test_each_setting_against_brute_force(spark, setting):
    x, y = at_the_threshold(100, seed=6)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in L.near_duplicates(frame(spark, rows), sizes=((None, *L.SIZES[setting][1:]),)).collect()}
    assert all(got[i] <= want[i][0] for i in want) and sum(got.values()) >= 0.97 * sum(n for n, _ in want.values()) > 0
