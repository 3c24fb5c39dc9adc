"""Centroid clustering by sort-means.

Vectors become whole numbers and are written once. In each round every centroid has the other centroids in order of their distance
from it. A vector measures the centroid that it had before, then walks that list and leaves it at the first centroid that lies
strictly beyond twice the distance to its own one: by the triangle inequality nothing from there on can be as near. Squared
distances are exact integers, so the stop is `gap > 4 * distance` without rounding and ties are seen as ties. Tasks reduce
their vectors to a sum a cluster and component; the driver gets at most clusters x components numbers a round. Each round's
assignment is written to the shared folder, where the next one takes its start from.

Edge cases: vectors that are null, of another length or hold null or non-finite components take no part; a null identifier counts as
empty text when the first centroids are drawn, is kept and returned; rows that repeat an identifier are vectors of their own (equal
hashes: the smaller vector first); fewer vectors than centroids give as many centroids; equal centroids: the smaller number; a centroid
without vectors stays; identifiers may be of any type, other columns are ignored; an empty table gives an empty result. Components,
distances and their sums have to fit 64 bits, else the job fails.
"""

from __future__ import annotations

from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written
from spanloom.llm.vectors import as_lists, matrix, quantised, wide

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, "1"
#: Numbers up to which 4 * distance fits 64 bits in 64 dimensions; larger ones are counted with Python integers.
_NARROW = 1 << 26


class Centroids:
    """Centroids with their distances from each other, and for each the others from near to far."""

    def __init__(self, rows: list[list[int]]):
        c = np.array(rows, dtype=object)
        self.c = c if max(abs(v) for r in rows for v in r) >= _NARROW else c.astype(np.int64)
        d = self.c[:, None] - self.c[None]
        self.gap = (d * d).sum(axis=2)
        self.order = [sorted((j for j in range(len(rows)) if j != i), key=lambda j, i=i: (self.gap[i, j], j)) for i in range(len(rows))]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row and its squared distance (ties: the smaller number), and how many distances were measured."""
        x = wide(x, _NARROW)
        square = lambda rows, j: ((x[rows] - self.c[j]) ** 2).sum(axis=1)
        own = ((x - self.c[before]) ** 2).sum(axis=1)
        best, least, measured = before.astype(np.int32), own.copy(), len(x)
        for i in np.unique(before):
            rows = np.flatnonzero(before == i)
            for j in self.order[i]:
                rows = rows[own[rows] * 4 >= self.gap[i, j]]  # the rest has come to its end: lists rise
                if not len(rows):
                    break
                d = square(rows, j)
                measured += len(rows)
                nearer = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
                best[rows[nearer]], least[rows[nearer]] = j, d[nearer]
        return best, least, measured


def _vectors(width: int, scale: int):
    def run(batches):
        for batch in batches:
            for rows, x in quantised(batch.column("v"), scale, width):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), as_lists(x)], names=["vec_id", "v"])

    return run


def _assigned(centroids: Centroids):
    width = centroids.c.shape[1]

    def run(batches):
        for batch in batches:
            before = batch.column("cluster").to_numpy(zero_copy_only=False)
            best, least, _ = centroids.assign(matrix(batch.column("v"), width), before)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return run


def _sums(width: int):
    """A task's vectors as one row a cluster and component: their sum and number."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            cluster, x = batch.column("cluster").to_numpy(zero_copy_only=False), wide(matrix(batch.column("v"), width), 1 << 40)
            for k in np.unique(cluster):
                rows = x[cluster == k]
                s, n = total.get(k, (0, 0))
                total[k] = s + rows.sum(axis=0).astype(object), n + len(rows)
        each = [(int(k), i, Decimal(int(v)), n) for k, (s, n) in total.items() for i, v in enumerate(s)]
        cols = list(zip(*each)) if each else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()))], names=["cluster", "i", "s", "n"])

    return run


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of the mean of its vectors; one without vectors where it was."""
    sums = state.select("v", "cluster").mapInArrow(_sums(len(centroids[0])), "cluster int, i int, s decimal(38,0), n long")
    out = [list(c) for c in centroids]
    for r in sums.groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # clusters x components at most
        out[r["cluster"]][r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    vectors = written(rows.mapInArrow(_vectors(width, scale), f"vec_id {kind}, v array<bigint>"), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["v"]) for r in vectors.select("v", drawn.alias("h")).orderBy("h", "v").limit(clusters).collect()]
    state = vectors.withColumn("cluster", F.lit(0))
    if not centroids:
        return state.select("vec_id", "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for k in range(rounds + 1):
        # a vector starts from where it was before, at first from centroid 0
        state = written(state.select("vec_id", "v", "cluster").mapInArrow(_assigned(Centroids(centroids)), f"vec_id {kind}, v array<bigint>, cluster int, distance long"), "assigned")
        if k < rounds:
            centroids = moved(state, centroids)
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    digest = lambda c: sha256(",".join(map(str, c)).encode()).hexdigest()
    of = [(k, s, sum(inertia.values()), digest(centroids[k])) for k, s in inertia.items()]
    ends = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
