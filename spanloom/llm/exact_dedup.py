"""Exact dedup by content sort.

Sampled splitters deal rows into ranges, each task sorts its rows by their normalised bytes on disk where needed, so equal texts
become neighbours; neighbouring rows are compared in full and the smallest identifier of a run stays. The splitters see short
keys only: the text's first 16 characters, then 64 hash bits, then the identifier. They follow the order of the bytes,
samples stay short however long the texts are, and a group of copies or a common opening that holds a third of all rows is
spread over as many ranges as its share. A group of copies that a border cuts lies in the last key of one range and the first
key of the next: the texts of these keys are written to the shared folder and compared in full.

Edge cases: null and empty texts are equal to each other; null identifiers sort last and stay only if no other is there;
rows that repeat an identifier are separate rows of which one is kept; texts that share a hash are told apart by the full
comparison, inside a range and across its border; an empty table gives an empty result; columns besides the identifier and
text are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import shuffle_partitions, written

PREFIX = 16
_NAMES = ["doc_id", "keep_id", "group_size", "text_sha256", "head", "pid", "run", "side", "text"]


class _Border:
    """The runs of the least and of the greatest key (prefix, hash) of a range; more than one each only where hashes collide."""

    def __init__(self):
        self.first, self.last = [], []  # (key, run, text, first identifier, size)

    def add(self, key, run, text, ids):
        entry = (key, run, text, ids[0].as_py(), len(ids))
        if not self.first or key <= self.first[0][0]:
            self.first = [*(e for e in self.first if e[0] == key), entry]
        if not self.last or key >= self.last[0][0]:
            self.last = [*(e for e in self.last if e[0] == key), entry]


def _runs(batches):
    """Rows sorted by text: each gets its run's number, first identifier, length and digest. The runs that a border may cut follow as rows
    with a side (1: least key, 2: greatest key) and their whole text."""
    pid, number, border, kind = TaskContext.get().partitionId(), 0, _Border(), None
    text = key = None  # of the run that is still open
    held = []  # its identifiers

    def closed():
        ids = pa.concat_arrays(held)
        border.add(key, number, text, ids)
        return ids, sha256(text.encode("utf-8", "replace")).hexdigest()

    def rows(runs):
        sizes = np.array([len(ids) for _, ids, _ in runs])
        at = np.repeat(np.arange(len(runs)), sizes)
        ids = pa.concat_arrays([ids for _, ids, _ in runs])
        starts = np.cumsum(sizes) - sizes
        head = np.zeros(len(ids), dtype=bool)
        head[starts] = True
        n = len(ids)
        cols = [ids, ids.take(pa.array(starts[at])), pa.array(sizes[at]), pa.array([d for *_, d in runs]).take(pa.array(at)), pa.array(head)]
        cols += [pa.array(np.full(n, pid, dtype=np.int32)), pa.array(np.array([k for k, *_ in runs])[at]), pa.array(np.zeros(n, dtype=np.int32)), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        norm, ids = batch.column("norm"), batch.column("doc_id")
        kind, out = ids.type, []
        same = np.zeros(batch.num_rows, dtype=bool)
        same[1:] = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        starts = [*np.flatnonzero(~same).tolist(), batch.num_rows]
        if held and norm[0].as_py() == text:
            held.append(ids[: starts[1]])
            starts = starts[1:]
        for a, b in zip(starts, starts[1:]):
            if held:
                out.append((number, *closed()))
                number += 1
            text = norm[a].as_py()
            key, held = (text[:PREFIX].encode("utf-8", "replace"), batch.column("hash")[a].as_py()), [ids[a:b]]
        if out:
            yield rows(out)
    if held:
        yield rows([(number, *closed())])
        ends = [(side, *e[1:]) for side, part in ((1, border.first), (2, border.last)) for e in part]
        side, run, texts, first, size = zip(*ends)
        n = len(ends)
        first, none = pa.array(first, kind), pa.nulls(n, pa.string())
        cols = [first, first, pa.array(size, pa.int64()), none, pa.nulls(n, pa.bool_()), pa.array([pid] * n, pa.int32()), pa.array(run, pa.int64()), pa.array(side, pa.int32()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _cut_runs(borders: DataFrame) -> list[tuple]:
    """Runs that borders cut: (pid, run, keep_id, group_size, holds the first row). Texts are compared in full and in Spark; the driver
    sees numbers, two rows a range but for colliding hashes."""
    part = F.struct("pid", "run", "keep_id", "group_size")
    cut = borders.groupBy("text").agg(F.sort_array(F.collect_set(part)).alias("parts")).where(F.size("parts") > 1)
    fixes = []
    for row in cut.select("parts").collect():
        total = sum(p["group_size"] for p in row["parts"])
        fixes += [(p["pid"], p["run"], row["parts"][0]["keep_id"], total, i == 0) for i, p in enumerate(row["parts"])]
    return fixes


def normalised(c) -> Column:
    """A text with white space runs as one space; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the text with white space runs as one space)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    last = F.asc_nulls_last("doc_id")
    dealt = rows.repartitionByRange(ranges or shuffle_partitions(spark), F.substring("norm", 1, PREFIX), F.col("hash"), last)
    kind = rows.schema["doc_id"].dataType
    kinds = [kind, kind, T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.IntegerType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_NAMES, kinds)])
    runs = written(dealt.sortWithinPartitions("norm", last).mapInArrow(_runs, schema), "exact-runs")
    fix_schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("keep_2", kind), T.StructField("size_2", T.LongType()), T.StructField("head_2", T.BooleanType())])
    fixed = spark.createDataFrame(_cut_runs(runs.where("side > 0")), fix_schema)
    joined = runs.where("side = 0").join(F.broadcast(fixed), ["pid", "run"], "left")  # two rows a range
    there = F.col("size_2").isNotNull()
    return joined.select(
        "doc_id",
        F.when(there, F.col("keep_2")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size_2", "group_size").alias("group_size"),
        (F.col("head") & F.coalesce("head_2", F.lit(True))).alias("kept"),
        "text_sha256",
    )
