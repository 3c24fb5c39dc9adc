"""An approximate vector index: vectors in lists about centroids, of which a probe reads the few nearest.

Centroids are fitted on a bounded sample drawn by a hash; every row is then put into its nearest list and stored, a folder a list. A search finds the lists of each
probe from the centroids, a table of at most MOST_LISTS rows, and meets only the rows of those: the join is on the partition column, so other lists aren't read. `nearest` in
`retrieval` stays the exact way; `recall` says how much of it a search finds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spanloom.functions import columns as C

SAMPLE, MOST_LISTS, ROUNDS, WANTED = 20_000, 1024, 10, 0.96


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def fitted(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of `lists` centroids of sampled vectors, by spherical k-means from evenly spread rows; one that loses its rows stays."""
    x = _unit(x.astype(float))
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=lists)[:, None] > 0, _unit(sums), c)
    return c


def lists_to_read(x: np.ndarray, c: np.ndarray, k: int = 8, wanted: float = WANTED, probes: int = 200) -> int:
    """How many lists a probe has to read: measured on the sample, so that of the k nearest of evenly spread rows of it the share `wanted` lies in them."""
    x = _unit(x.astype(float))
    at = np.unique(np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int))
    like = x[at] @ x.T
    like[np.arange(len(at)), at] = -np.inf  # a row is not its own neighbour
    best = np.argsort(-like, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[at] @ c.T), axis=1, kind="stable"), axis=1)  # of each list among a probe's
    needed = np.take_along_axis(place, (x @ c.T).argmax(axis=1)[best], axis=1)
    return int(np.quantile(needed, wanted, method="higher")) + 1 if needed.size else 1


def build(corpus: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Index a corpus (id, embedding, ...) of vectors of one length, null ones left out, in `folder`: at most `sample` rows fit the centroids and say how many
    lists a probe reads; all rows are stored."""
    spark, rows = corpus.sparkSession, corpus.where("embedding IS NOT NULL")
    drawn = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most `sample`
    if not drawn:
        raise ValueError("a corpus without vectors has no index")
    x = np.array([r["embedding"] for r in drawn], dtype=float)
    c = fitted(x, min(lists or max(1, int(np.sqrt(len(x)))), len(x), MOST_LISTS))
    read = lists_to_read(x, c)
    spark.createDataFrame([(i, v.tolist(), read) for i, v in enumerate(c)], "list int, centre array<double>, read int").coalesce(1).write.parquet(f"{folder}/centres")
    out = StructType([*rows.schema.fields, StructField("list", IntegerType())])
    shared = spark.sparkContext.broadcast(c)

    def put(batches):
        for batch in batches:
            v = batch.column("embedding")
            near = (v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) @ shared.value.T).argmax(axis=1) if len(v) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list"])

    # a list with many rows is cut over several tasks
    rows.mapInArrow(put, out).hint("rebalance", "list").write.partitionBy("list").parquet(f"{folder}/rows")


def search(spark: SparkSession, folder: str, probes: DataFrame, k: int = 8, read: int | None = None) -> DataFrame:
    """The k best of the `read` nearest lists (as many as the index was measured to need, by default) for each probe (probe, embedding): probe, rank, id, relevance."""
    table = sorted(spark.read.parquet(f"{folder}/centres").collect())  # at most MOST_LISTS rows
    c, read = np.array([r["centre"] for r in table]), read or table[0]["read"]
    shared = spark.sparkContext.broadcast(c)

    @F.pandas_udf("array<int>")
    def nearest_lists(q: pd.Series) -> pd.Series:
        x = np.array(q.tolist(), dtype=float).reshape(len(q), -1)
        return pd.Series(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :read].tolist())

    asked = probes.where("embedding IS NOT NULL").select("probe", F.col("embedding").alias("q"), F.explode(nearest_lists(F.col("embedding"))).alias("list"))
    found = spark.read.parquet(f"{folder}/rows").select("id", "list", "embedding").join(asked, "list")
    scored = found.select("probe", "id", F.round(F.greatest(F.lit(0.0), C.cosine(F.col("embedding"), F.col("q"))), 4).alias("relevance"))
    best = Window.partitionBy("probe").orderBy(F.desc("relevance"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("probe", "rank", "id", "relevance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(hits, wanted, recall): how many of the exact hits (probe, id) a search found."""
    both = exact.select("probe", "id").join(found.select("probe", "id", F.lit(1).alias("hit")), ["probe", "id"], "left")
    return both.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
