"""Centroid clustering: rounds of nearest centroid and exact mean, by partial-distance search.

Vectors become whole numbers, so sums, means and distances are exact and the same in any order of rows.

1. One pass adds up each component and its square: components are searched in order of falling variance.
2. The first centroids are the k vectors whose seeded id digests are smallest.
3. A round is one pass: a task holds the centroids (k x dims numbers, whatever the table's size). For a
   block of vectors it takes the centroids in order and adds squared differences over a few
   components at a time; a vector gives a centroid up once its partial sum is strictly above its best distance
   so far. Those left after the last component have their exact distance. Tasks hand on k rows of
   sums; their grouped sums, k rows again, come back as the next centroids.
4. One more pass adds up distances for each cluster, the last one gives each vector its row.

Nothing is shuffled but k rows for each task, so a third of all vectors being equal changes nothing.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left
out; components beyond 2^27 after scaling are held at that bound, so that squares fit; a null id
comes after all digests; of rows with one id (or digest) the one with smaller components starts first; distances that tie go
to the smaller number; fewer vectors than k make fewer centroids; a cluster that empties keeps its
centroid; a total beyond a long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

BOUND = 1 << 27
STEP = 8  # components between two looks at the best distance
ROWS = 4096  # vectors searched at once


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # k x dims, whole numbers
    order: np.ndarray  # components by falling variance
    scale: float

    @property
    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def scaled(batch, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, whole numbers) of the vectors of an Arrow column that count."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.cast(pa.list_(pa.float64()))
    held = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(held)))
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls come as nan
    good = np.isfinite(x).all(axis=1)
    return held[good], np.clip(np.floor(x[good] * scale), -BOUND, BOUND).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of x, and how many squared differences were added up."""
    n, dims = x.shape
    cluster, best, work = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), 0
    for at in range(0, n, ROWS):
        columns = np.ascontiguousarray(x[at : at + ROWS, order].T)
        m = columns.shape[1]
        near, found = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
        for c, centre in enumerate(centroids[:, order]):
            left, part, total = np.arange(m), columns, np.zeros(m, np.int64)
            for k in range(0, dims, step):
                gap = part[k : k + step] - centre[k : k + step, None]
                total += np.einsum("ij,ij->j", gap, gap)
                work += gap.size
                stays = total <= near[left]
                if not stays.all():
                    keep = np.flatnonzero(stays)
                    left, total = left[keep], total[keep]
                    part = part[:, keep] if k + step < dims else part
                if not len(left):
                    break
            closer = total < near[left]
            near[left[closer]], found[left[closer]] = total[closer], c
        cluster[at : at + m], best[at : at + m] = found, near
    return cluster, best, work


def _sums(vectors: DataFrame, run, keys: int, width: int) -> list:
    """Rows (key, n, width sums) of all tasks, added up by key; at most ``keys`` rows come back."""
    names = [f"s{i}" for i in range(width)]
    parts = vectors.mapInArrow(run, "key long, n long, " + ", ".join(f"{s} decimal(38,0)" for s in names))
    out = parts.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).limit(keys).collect()
    return [(r[0], int(r[1]), [int(v) for v in r[2:]]) for r in out]


def _told(rows: list[tuple[int, int, list[int]]], width: int):
    """An Arrow batch of (key, n, sums)."""
    from decimal import Decimal

    import pyarrow as pa

    arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
    arrays += [pa.array([Decimal(r[2][i]) for r in rows], pa.decimal128(38, 0)) for i in range(width)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "n", *[f"s{i}" for i in range(width)]])


def spread(vectors: DataFrame, dims: int, scale: float) -> np.ndarray:
    """Components by falling variance, ties by position."""

    def run(batches):
        n, one, two = 0, np.zeros(dims, object), np.zeros(dims, object)
        for b in batches:
            _, x = scaled(b.column("embedding"), dims, scale)
            f = x.astype(object) if len(x) and np.abs(x).max() > 1 << 20 else x
            n, one, two = n + len(x), one + f.sum(axis=0), two + (f * f).sum(axis=0)
        if n:
            yield _told([(0, n, [*map(int, one), *map(int, two)])], 2 * dims)

    got = _sums(vectors, run, 1, 2 * dims)
    if not got:
        return np.arange(dims)
    _, n, s = got[0]
    variance = [n * s[dims + i] - s[i] ** 2 for i in range(dims)]
    return np.array(sorted(range(dims), key=lambda i: (-variance[i], i)), np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int) -> np.ndarray:
    """The vectors with the k smallest digests of seed and id, in that order."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, x = scaled(b.column("embedding"), dims, scale)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "x"])

    kept = vectors.mapInArrow(run, "vec_id long, x array<long>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r[0] for r in first], np.int64).reshape(-1, dims)


def moved(vectors: DataFrame, model: Model) -> Model:
    """The model after one round: each centroid is the floor of its vectors' mean; one without vectors stays."""
    dims, centroids, order, scale = model.centroids.shape[1], model.centroids, model.order, model.scale

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            _, x = scaled(b.column("embedding"), dims, scale)
            cluster, _, _ = nearest(x, centroids, order)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                n, s = held.get(c, (0, np.zeros(dims, object)))
                held[c] = (n + len(mine), s + mine.sum(axis=0))
        if held:
            yield _told([(c, n, list(map(int, s))) for c, (n, s) in sorted(held.items())], dims)

    after = centroids.copy()
    for c, n, s in _sums(vectors, run, len(centroids), dims):
        after[c] = [v // n for v in s]
    return Model(after, order, scale)


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1) -> Model:
    """Centroids of vectors (vec_id, embedding) after so many rounds. k x dims numbers are the driver's share."""
    ship(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding")
    model = Model(first_centroids(vectors, k, dims, scale, seed), spread(vectors, dims, scale), scale)
    for _ in range(rounds if len(model.centroids) else 0):
        model = moved(vectors, model)
    return model


def inertias(vectors: DataFrame, model: Model) -> dict[int, int]:
    """Summed distances by cluster."""
    dims, centroids, order, scale = model.centroids.shape[1], model.centroids, model.order, model.scale

    def run(batches):
        held: dict[int, tuple[int, int]] = {}
        for b in batches:
            _, x = scaled(b.column("embedding"), dims, scale)
            cluster, distance, _ = nearest(x, centroids, order)
            for c in np.unique(cluster).tolist():
                mine = distance[cluster == c]
                n, s = held.get(c, (0, 0))
                held[c] = (n + len(mine), s + int(mine.astype(object).sum()))
        if held:
            yield _told([(c, n, [s]) for c, (n, s) in sorted(held.items())], 1)

    return {c: s[0] for c, _, s in _sums(vectors, run, len(centroids), 1)}


def assign(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that counts."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(model.centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    ship(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding")
    dims, centroids, order, scale = model.centroids.shape[1], model.centroids, model.order, model.scale
    by, digests = inertias(vectors, model), model.digests
    fits = lambda v: v if v < 1 << 63 else None
    of, whole = [fits(by.get(c, 0)) for c in range(len(centroids))], fits(sum(by.values()))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, x = scaled(b.column("embedding"), dims, scale)
            cluster, distance, _ = nearest(x, centroids, order)
            at = pa.array(cluster)
            arrays = [b.column("vec_id").take(pa.array(rows)), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(of, pa.int64()).take(at), pa.array([whole] * len(rows), pa.int64()), pa.array(digests).take(at)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return assign(vectors, fit(vectors))


def _near(i: int) -> str:
    return f"n{i} AS MATERIALIZED (SELECT vec_id, rid, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS b FROM v, c{i} k GROUP BY ALL)"


def _round(i: int) -> str:
    """SQL of one round: nearest centroids, then their means."""
    return f"""{_near(i)},
s{i} AS (SELECT b.c AS c, p, CAST(sum(x[p]) AS HUGEINT) AS s, count(*) AS n FROM n{i}, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < 16),
{_round(0)},
{_round(1)},
{_round(2)},
{_near(3)}
SELECT vec_id, CAST(b.c AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM n3 JOIN c3 ON c3.c = n3.b.c
"""
