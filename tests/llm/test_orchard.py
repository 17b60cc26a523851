import hashlib
import math

import duckdb
import numpy as np
import pytest

from millrace.llm import orchard as O
from millrace.llm.queries import op11_orchard


def brute_nearest(x, points):
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points)) for v in x]


@pytest.mark.parametrize("seed", range(12))
def test_search_matches_all_distances(seed):
    rng = np.random.default_rng(seed)
    k, spread = int(rng.integers(1, 18)), [2, 4, 1000][seed % 3]  # few values: many ties and equal centroids
    points = rng.integers(-spread, spread, (k, 5)).tolist()
    x = rng.integers(-spread, spread, (400, 5))
    now, best = O.Centroids(points).nearest(x)
    assert list(zip(best.tolist(), now.tolist(), strict=True)) == brute_nearest(x.tolist(), points)


def test_large_numbers_stay_exact():
    points = [[1 << 60, 0], [(1 << 60) + 1, 0], [3, 4]]
    x = np.array([[(1 << 60) + 2, 0], [3, 5], [1 << 60, 1]], object)
    now, best = O.Centroids(points).nearest(x)
    assert list(zip(best.tolist(), now.tolist(), strict=True)) == brute_nearest(x.tolist(), points)
    now, best = O.Centroids(points).nearest(np.array([[3, 5]]))
    assert (now.tolist(), best.tolist()) == ([2], [1])


def brute_cluster(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    points = [v for _, _, _, v in sorted((i is None, sha(f"1:{i}") if i is not None else "", v, v) for i, v in kept)[:k]]
    for _ in range(rounds):
        found = brute_nearest([v for _, v in kept], points)
        for c in range(len(points)):
            own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = brute_nearest([v for _, v in kept], points)
    inertia = [sum(d for d, c in found if c == at) for at in range(len(points))]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, points[c])))) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, v string").repartition(5)


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.float32(rng.integers(-3, 4, 64) / 8 + (i % 5))], 1, "x") for i in range(120)]
    rows += [(1000 + i, rows[0][1], 1, "x") for i in range(60)]
    odd = [(1, None), (2, [1.0] * 63), (3, [1.0] * 63 + [None]), (4, [1.0] * 63 + [float("nan")]), (5, [float("inf")] + [0.0] * 63), (6, []), (None, [0.5] * 64), (None, [0.25] * 64), (7, rows[3][1]), (7, rows[4][1])]
    rows += [(i, v, 2, "y") for i, v in odd]
    got = O.cluster(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_cluster(rows, 16, 3)


def test_few_vectors_none_and_huge_ones(spark):
    rows = [(i, [float(i)] * 64, 1, "x") for i in range(3)]
    assert sorted((tuple(r) for r in O.cluster(frame(spark, rows)).collect()), key=str) == brute_cluster(rows, 16, 3)
    assert O.cluster(frame(spark, rows).where("false")).collect() == []
    huge = rows + [(9, [1e15] * 64, 1, "x"), (10, [-1e15] * 64, 1, "x"), (11, [1e30] * 64, 1, "x")]
    got = O.cluster(frame(spark, huge), k=2).collect()
    assert len(got) == 5 and {r.vec_id for r in got} == {0, 1, 2, 9, 10}
    assert any(r.distance is None for r in got) and all(r.inertia is None for r in got)


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    found = con.execute(O.SQL)
    names = [d[0] for d in found.description]
    got = op11_orchard(spark, folder)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(found.fetchall())
