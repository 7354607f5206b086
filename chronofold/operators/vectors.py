"""Vectors: norms, centroids by position, nearest centroid by cosine."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bind import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    scaled = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return let(F.sqrt(dot(v, v)), scaled)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean of the vectors of each label, of unit length: one vector sum for each task and label is shuffled."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    return df.groupBy(label).agg(mean.alias("m")).select(label, unit(F.col("m")).alias("centroid"))


class Tiles:
    """Unit vectors in tiles of neighbours, each with a middle and the distance of its farthest member.

    No member is nearer to x than x is to the middle, less that distance, so a tile that can't beat what x has
    found is skipped. Ties, to nine decimals of cosine, go to the smaller rank.
    """

    SLACK = 4e-9  # more than nine decimals of cosine can hide

    def __init__(self, c: np.ndarray, rows: int = 256):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        at = [np.arange(len(c))]
        while at:  # halve along the direction from a member to its farthest, until a part fits
            i = at.pop()
            if len(i) <= rows:
                self.parts.append((i, np.ascontiguousarray(c[i].T)))
                continue
            a = c[i[np.argmin(c[i] @ c[i[0]])]]
            b = c[i[np.argmin(c[i] @ a)]]
            order = i[np.argsort(c[i] @ (a - b), kind="stable")]
            at += [np.sort(order[: len(i) // 2]), np.sort(order[len(i) // 2 :])]
        self.middle = np.stack([c[i].mean(axis=0) for i, _ in self.parts]) if self.parts else np.zeros((0, c.shape[1]))
        self.reach = np.array([np.sqrt(((c[i] - m) ** 2).sum(axis=1).max()) for (i, _), m in zip(self.parts, self.middle)])
        self.products = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine to nine decimals, rank) of each row of x, which are unit vectors or zero."""
        n = len(x)
        best, rank = np.full(n, -np.inf), np.zeros(n, np.int64)
        own = (x * x).sum(axis=1)
        apart = np.sqrt(np.maximum(0.0, own[:, None] + (self.middle**2).sum(axis=1) - 2 * x @ self.middle.T))
        near = np.maximum(0.0, apart - self.reach)
        most = (own[:, None] + 1 - near**2) / 2 + self.SLACK  # cosine that a tile can reach
        for t in np.argsort(-most.max(axis=0), kind="stable"):
            rows = np.flatnonzero(most[:, t] >= best)
            if not len(rows):
                continue
            of, tile = self.parts[t]
            told = np.round(x[rows] @ tile, 9) + 0.0
            self.products += told.size
            k = told.argmax(axis=1)  # the first of equals, and ranks rise within a tile
            value, found = told[np.arange(len(rows)), k], of[k]
            wins = (value > best[rows]) | ((value == best[rows]) & (found < rank[rows]))
            best[rows[wins]], rank[rows[wins]] = value[wins], found[wins]
        return best, rank


def assign(df: DataFrame, key: str, vector: str, centroids: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Each row's label of greatest cosine, ties to the smaller label; key tells rows apart.

    Centroids go to the tasks in tiles and the vectors are scanned once. More than ``most`` centroids (which are
    counted; as many as fill 256 MB if not given) are cut into blocks of about as many, each a scan, whose best are compared.
    A zero vector's cosine is 0; without centroids there is no row.
    """
    spark = df.sparkSession
    n, width = centroids.agg(F.count("*"), F.coalesce(F.max(F.size("centroid")), F.lit(1))).first()
    blocks = max(1, -(-n // (most or max(1, (256 << 20) // (16 * width)))))
    held = df.select(F.col(key).alias("key"), unit(F.col(vector)).alias("v"))
    schema = StructType(held.schema.fields[:1]).add("rank", "long").add("cosine", "double")
    ranked = centroids.select(F.col(label).alias("label"), "centroid")
    found = None
    for b in range(blocks if n else 0):
        part = ranked if blocks == 1 else ranked.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b)
        model = sorted((r[0], r[1]) for r in part.collect())  # about most, which is bounded
        if not model:
            continue
        labels = [m[0] for m in model]
        sent = spark.sparkContext.broadcast(np.array([m[1] for m in model], np.float64))
        one = held.mapInArrow(_search(sent), schema)
        names = spark.createDataFrame([*enumerate(labels)], StructType().add("rank", "long").add("nearest", ranked.schema["label"].dataType))
        one = one.join(F.broadcast(names), "rank").select("key", "nearest", "cosine")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return held.where("false").select(F.col("key").alias(key), F.lit(None).cast(ranked.schema["label"].dataType).alias("nearest"), F.lit(0.0).alias("cosine"))
    if blocks > 1:
        top = found.groupBy("key").agg(F.max("cosine").alias("cosine"))
        found = found.join(top, ["key", "cosine"]).groupBy("key").agg(F.min("nearest").alias("nearest"), F.first("cosine").alias("cosine"))
    return found.select(F.col("key").alias(key), "nearest", F.round("cosine", 4).alias("cosine"))


def _search(sent):
    def run(batches):
        import pyarrow as pa

        tiles = None
        for b in batches:
            if not b.num_rows:
                continue
            tiles = tiles or Tiles(sent.value)
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            cosine, rank = tiles.nearest(flat.reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(rank), pa.array(cosine)], ["key", "rank", "cosine"])

    return run
