"""Clustering around centroids with Orchard's search.

For each centroid the others are listed by distance. A vector starts at one
centroid and walks its list; as soon as a centroid is closer (or as close and of
a smaller number) the walk goes on in that one's list, centroids seen before are
passed over, and it ends where the list goes strictly beyond twice the vector's
present distance: by the triangle inequality nothing further can win or tie.
Distances are squared, so "beyond twice" is "above four times".

Components are scaled to integers (``floor(64 * x)``) and all sums are exact, so
the result depends neither on the order of rows nor on partitions.

Scale. Each round is one narrow pass: a task walks its vectors in lockstep in
numpy and hands on its sums, k rows per dimension; these are added up in one
small aggregation and only k centroids reach the driver. A group of equal
vectors is no group here: rows never meet. The last assignment is written, so
its sums and rows come from one pass.

Defined cases: vectors that are null, of another length, or hold null, NaN or
infinite components are left out, as are those beyond ``LIMIT``, where sums
would leave 38 digits; with fewer vectors than centroids each is one; ids may be
null or repeat (each row counts; among the first centroids ties go by the
vector, null ids come last); distances and sums beyond a long become null; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
#: Components from here on are no vectors of this kind.
LIMIT = 1e20
#: Below this, four times a squared distance of 64 dimensions fits 64 bits.
SMALL = 1 << 26
LONG = (1 << 63) - 1
SUMS = "cluster int, dim int, total decimal(38,0), n long"
ASSIGNED = "vec_id long, cluster int, distance long"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers."""
    d = a - b
    return (d * d).sum(axis=1)


class Centroids:
    """Centroids with, for each, the others by distance and number."""

    def __init__(self, points: list[list[int]]):
        big = any(abs(v) >= SMALL for p in points for v in p)
        self.points = np.array(points, object if big else np.int64).reshape(len(points), len(points[0]))
        k = len(points)
        self.gaps = np.array([distances(self.points, np.broadcast_to(p, self.points.shape)) for p in self.points]).reshape(k, k)
        self.lists = np.array([sorted((j for j in range(k) if j != c), key=lambda j: (self.gaps[c, j], j)) for c in range(k)], np.int64).reshape(k, max(0, k - 1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the closest centroid of each row, all rows in lockstep."""
        x = x.astype(np.result_type(x, self.points), copy=False)
        points = self.points.astype(x.dtype, copy=False)
        n, k = len(x), len(points)
        now, best, at = np.zeros(n, np.int64), distances(x, points[:1]), np.zeros(n, np.int64)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        walking = np.arange(n if k > 1 else 0)
        while len(walking):
            c = now[walking]
            j = self.lists[c, at[walking]]
            on = self.gaps[c, j] <= 4 * best[walking]
            walking, j = walking[on], j[on]
            at[walking] += 1
            new = ~seen[walking, j]
            row, j = walking[new], j[new]
            seen[row, j] = True
            d = distances(x[row], points[j])
            closer = (d < best[row]) | ((d == best[row]) & (j < now[row]))
            row, j = row[closer], j[closer]
            best[row], now[row], at[row] = d[closer], j, 0
            walking = walking[at[walking] < k - 1]
        return now, best


def scaled(column: pa.Array, scale: int = SCALE, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows of ``floor(scale * x)`` as integers; Python's own where they are large."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dimensions)
    if len(x) and np.abs(x).max() >= SMALL:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(np.int64)


def usable(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id`` and the vectors that take part, as doubles."""
    v = F.col(column).cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce((x > -LIMIT) & (x < LIMIT), F.lit(False)))
    return vectors.where(v.isNotNull() & (F.size(v) == dimensions) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(usable_vectors: DataFrame, k: int = K, seed: int = 1) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = usable_vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    return [scaled(pa.array([r.v], pa.list_(pa.float64())), dimensions=len(r.v))[0].tolist() for r in rows]


def _moved(vectors: DataFrame, centroids: Centroids, dimensions: int) -> list[list[int]]:
    """One round: the exact floor of the mean of each centroid's vectors; one without vectors stays."""
    k = len(centroids.points)

    def sums(batches):
        total, n = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for batch in batches:
            x = scaled(batch.column(1), dimensions=dimensions)
            now, _ = centroids.nearest(x)
            n += np.bincount(now, minlength=k)
            for c in np.unique(now).tolist():
                total[c] += x[now == c].sum(axis=0)
        rows = [(c, d, Decimal(int(total[c, d])), int(n[c])) for c in np.flatnonzero(n).tolist() for d in range(dimensions)]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cluster", "dim", "total", "n"])

    added = vectors.mapInArrow(sums, SUMS).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    points = [[int(v) for v in p] for p in centroids.points]
    for r in added.collect():  # at most k rows per dimension
        points[r.cluster][r.dim] = int(r.total) // r.n
    return points


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """Per vector its cluster, squared distance, the inertia of its cluster and of all, and the digest of its centroid."""
    spark, rows = vectors.sparkSession, usable(vectors, column, dimensions)
    points = first_centroids(rows, k, seed)
    if not points:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = Centroids(points)
    for _ in range(rounds):
        centroids = Centroids(_moved(rows, centroids, dimensions))

    def assign(batches):
        for batch in batches:
            now, best = centroids.nearest(scaled(batch.column(1), dimensions=dimensions))
            distance = [d if d <= LONG else None for d in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(now, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(assign, ASSIGNED), "assigned")
    known = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()  # k rows
    fits = lambda rows: None if any(r.unknown for r in rows) or (s := sum(int(r.total) for r in rows)) > LONG else s
    digests = [hashlib.sha256(",".join(str(int(v)) for v in p).encode()).hexdigest() for p in centroids.points]
    facts = spark.createDataFrame([(r.cluster, fits([r]), fits(known), digests[r.cluster]) for r in known], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """The same clusters by brute force over all pairs of vector and centroid, as SQL."""
    order = "sha256('1:' || CAST(vec_id AS VARCHAR))"
    steps = [
        f"k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS c, v FROM (SELECT * FROM k ORDER BY {order} LIMIT {K}))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (SELECT k.vec_id, k.v, c.c, CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT) AS d FROM k, c{r} c) GROUP BY vec_id)"
        )
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)")
            steps.append(f"m{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    last = f"SELECT a.vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.best.c"
    return "WITH " + ",\n".join(steps) + "\n" + last


SQL = _rounds_sql()
