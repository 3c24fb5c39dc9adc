"""Exact top-k inner-product search by ball trees.

Vectors are dealt into shards by a hash of their place in a written table, so equal rows spread. Each shard becomes a ball tree once, stored as a row: every node knows
its centre and radius, so `q.c + |q| r` bounds the inner product of a query with anything below. Queries travel to the
shards in blocks, as they are many times fewer than vectors. Nodes are walked by falling bound for a block of queries at
once, and a query leaves a branch whose bound is under its current k-th score. Shards are searched in rounds of growing width (1, 1,
2, 4, ...), and each round begins with the k-th scores that all rounds before it found.

Scores are whole-number inner products: in float64 where every partial sum is below 2^53, else in 64-bit integers, which the true scores have to fit.

Edge cases: vectors that are null or hold null or non-finite components, or that have no identifier, take no part; vectors of
different lengths have no inner product, so those of each length are searched among themselves; rows that repeat an identifier are
queries and candidates of their own, but never candidates of a query with that identifier; equal vectors make a leaf; fewer candidates
than k give all; identifiers are whole numbers (as text they have to read as such); ties go to the smaller identifier; empty vectors score 0; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import shuffle_partitions, written

SCALE, K, EVERY = 64, 20, 20
SHARD, BLOCK, LEAF = 16_384, 4_096, 1_024
LOWEST, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_TREE = "n int, shard int, ids binary, v binary, centres binary, shape binary"


def quantised(df: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v): each component x as floor(scale * x), x as double; unusable vectors are left out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & good & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


class BallTree:
    """Nodes in preorder; a leaf holds a range of the reordered rows. A tree can be stored as four byte strings."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.v, self.ids = v, ids
        order = np.arange(len(v))
        self.nodes: list[tuple] = []  # centre, radius, lo, hi, left, right
        self._build(order, 0, len(v), leaf)
        self.v, self.ids = v[order], ids[order]

    def _build(self, order, lo, hi, leaf) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        part = self.v[order[lo:hi]].astype(np.float64)
        centre = part.mean(axis=0)
        d = ((part - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(d.max()))
        left = right = -1
        if hi - lo > leaf and radius > 0:
            a = part[d.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            side = part @ (a - b)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(side, mid)]
            left = self._build(order, lo, lo + mid, leaf)
            right = self._build(order, lo + mid, hi, leaf)
        self.nodes[me] = (centre, radius, lo, hi, left, right)
        return me


    def stored(self) -> tuple:
        top = int(np.abs(self.v).max(initial=0))
        narrow = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
        centres = np.array([n[0] for n in self.nodes], dtype="<f8")
        shape = np.array([(n[1], *n[2:]) for n in self.nodes], dtype="<f8")  # places are far below 2^53
        return self.ids.astype("<i8").tobytes(), self.v.astype(narrow).tobytes(), centres.tobytes(), shape.tobytes()

    @classmethod
    def loaded(cls, width: int, ids: bytes, v: bytes, centres: bytes, shape: bytes) -> "BallTree":
        tree = cls.__new__(cls)
        tree.ids = np.frombuffer(ids, dtype="<i8")
        each = len(v) // max(1, len(tree.ids) * width)
        tree.v = np.frombuffer(v, dtype=f"<i{each or 8}").reshape(len(tree.ids), width).astype(np.int64)
        shape = np.frombuffer(shape, dtype="<f8").reshape(-1, 5)
        centres = np.frombuffer(centres, dtype="<f8").reshape(len(shape), width)
        tree.nodes = [(c, float(r[0]), *map(int, r[1:])) for c, r in zip(centres, shape)]
        return tree


class BlockSearch:
    """The best k of a block of queries so far, by falling score, then identifier."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, k: int, floor: np.ndarray):
        self.q, self.qid, self.k = q, qid, k
        self.exact = q.astype(np.float64)
        self.norm = np.sqrt((self.exact**2).sum(axis=1))
        self.least = floor.astype(np.int64)  # a score that the k-th best reaches at least
        self.score = np.full((len(q), k), LOWEST)
        self.id = np.full((len(q), k), NONE)

    def search(self, tree: BallTree) -> None:
        self.tree = tree
        top = np.abs(self.q).max(initial=0) * float(np.abs(tree.v).max(initial=0)) * self.q.shape[1]
        self.safe = top < 2.0**53
        self._visit(0, np.arange(len(self.q)))

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        centre, radius, *_ = self.tree.nodes[node]
        b = self.exact[rows] @ centre + self.norm[rows] * radius
        return b + 1e-9 * (1 + np.abs(b))  # never below the true bound by rounding

    def _visit(self, node: int, rows: np.ndarray) -> None:
        _, _, lo, hi, left, right = self.tree.nodes[node]
        if left < 0:
            self._leaf(rows, lo, hi)
            return
        kids = [(self._bound(x, rows), x) for x in (left, right)]
        for bound, x in sorted(kids, key=lambda p: -p[0].mean()):
            open_ = bound >= self.least[rows]
            if open_.any():
                self._visit(x, rows[open_])

    def _leaf(self, rows: np.ndarray, lo: int, hi: int) -> None:
        for at in range(lo, hi, LEAF):  # a leaf of equal vectors may be long
            ids = self.tree.ids[at : min(at + LEAF, hi)]
            v = self.tree.v[at : min(at + LEAF, hi)]
            s = self.exact[rows] @ v.T.astype(np.float64) if self.safe else self.q[rows] @ v.T
            take = (s >= self.least[rows, None]) & (ids[None, :] != self.qid[rows, None])
            for r in np.flatnonzero(take.any(axis=1)):
                c, row = np.flatnonzero(take[r]), rows[r]
                sc, ii = np.concatenate([self.score[row], s[r, c].astype(np.int64)]), np.concatenate([self.id[row], ids[c]])
                if len(c) > 4 * self.k:  # only what reaches the k-th score needs a full sort
                    keep = sc >= np.partition(sc, -self.k)[-self.k]
                    sc, ii = sc[keep], ii[keep]
                best = np.lexsort((ii, ~sc))[: self.k]
                self.score[row], self.id[row] = sc[best], ii[best]
                self.least[row] = max(self.least[row], self.score[row, -1])

    def found(self, asked: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(self.id != NONE)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[r], self.qid[r], self.id[r, c], self.score[r, c])], names=["asked", "query_id", "vec_id", "score"])


def _grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    n, shard = key
    v = np.array(rows["v"].to_list(), dtype=np.int64).reshape(len(rows), n)
    return pd.DataFrame([(n, shard, *BallTree(v, rows["vec_id"].to_numpy()).stored())], columns=["n", "shard", "ids", "v", "centres", "shape"])


def _search(k: int):
    """Rows of a partition come as shard after shard, its tree before its queries; queries are searched a block at a time."""

    def run(batches):
        tree, at, waiting, held = None, None, [], 0

        def searched():
            asked, qid, floor = (np.concatenate([w.column(c).to_numpy() for w in waiting]) for c in ("asked", "qid", "floor"))
            q = np.concatenate([w.column("q").flatten().to_numpy() for w in waiting]).reshape(len(asked), at[0])
            block = BlockSearch(q, qid, k, floor)
            block.search(tree)
            return block.found(asked)

        for batch in batches:
            ids = batch.column("ids")
            marks = [i for i in range(batch.num_rows) if ids[i].is_valid]  # trees are few
            for a, b in zip([-1, *marks], [*marks, batch.num_rows]):
                if a >= 0:
                    if held:
                        yield searched()
                    at = tuple(batch.column(c)[a].as_py() for c in ("n", "shard"))
                    tree = BallTree.loaded(at[0], *(batch.column(c)[a].as_py() for c in ("ids", "v", "centres", "shape")))
                    waiting, held = [], 0
                if tree is None:
                    continue
                mine = batch.slice(a + 1, b - a - 1)  # a shard that has no vector of a query's length has no tree
                mine = mine.filter(pc.and_(pc.equal(mine.column("n"), at[0]), pc.equal(mine.column("shard"), at[1])))
                while mine.num_rows:
                    part, mine = mine.slice(0, BLOCK - held), mine.slice(BLOCK - held)
                    waiting.append(part)
                    held += part.num_rows
                    if held >= BLOCK:
                        yield searched()
                        waiting, held = [], 0
        if held:
            yield searched()

    return run


def rounds(shards: int) -> list[tuple[int, int]]:
    """Shards from and up to which each round goes: one, one, then as many as before."""
    edges = [0, 1]
    while edges[-1] < shards:
        edges.append(min(2 * edges[-1], shards))
    return list(zip(edges, edges[1:]))


def top_k(df: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries are the rows whose identifier is divisible by `every`: query_id, rank, vec_id, score of the k best other rows each."""
    spark = df.sparkSession
    rows = written(quantised(df, scale, id_col, vector_col).withColumn("n", F.size("v")), "vectors")
    shards = max(1, -(-rows.count() // SHARD))
    place = F.xxhash64(F.monotonically_increasing_id())  # of the written row, so that many rows under one identifier spread
    dealt = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))
    trees = written(dealt.select("n", "shard", "vec_id", "v").groupBy("n", "shard").applyInPandas(_grow, _TREE), "trees")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("asked"), F.col("vec_id").alias("qid"), "n", F.col("v").alias("q"))
    queries, found = written(asked, "queries"), None
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    for lo, hi in rounds(shards):
        low, now = F.lit(int(LOWEST)), queries
        if found is None:
            now = now.withColumn("floor", low)
        else:
            kth = found.where(F.col("rank") == k).select("asked", F.col("score").alias("floor"))
            now = now.join(kth, "asked", "left").withColumn("floor", F.coalesce("floor", low))
        sent = now.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        sent = sent.select("n", "shard", none("ids", "binary"), none("v", "binary"), none("centres", "binary"), none("shape", "binary"), "asked", "qid", "q", "floor")
        held = trees.where(F.col("shard").between(lo, hi - 1)).select("*", none("asked", "long"), none("qid", "long"), none("q", "array<bigint>"), none("floor", "long"))
        # an explicit number of partitions: adaptive execution must not gather the shards in one task
        meet = held.unionByName(sent).repartition(max(shuffle_partitions(spark), hi - lo), "n", "shard").sortWithinPartitions("n", "shard", F.desc_nulls_last("ids"))
        hits = meet.mapInArrow(_search(k), "asked long, query_id long, vec_id long, score long")
        found = written(ranked(hits if found is None else hits.unionByName(found.drop("rank"))), "found")
    return found.select("query_id", "rank", "vec_id", "score")
