"""Best-fit packing of token streams into fixed-length sequences by large-item matching.

Lengths are whole numbers up to the capacity, so a packing is decided on the histogram of lengths, which has at most
`capacity` rows however many documents there are. Documents above a third of the capacity go at most two to a
sequence: the largest is matched with the largest other that fits. Smaller ones, longest first, go where the remaining gap
is tightest. Sequences with the same gap are handled as ranges, so a step places thousands of documents at once.
Each piece then finds its place from its rank among the pieces of its length: no task ever sees all pieces of a
length, and no token moves.

Edge cases: null and empty texts are one piece holding the closing id alone; a document longer than the capacity is cut
into full pieces and a rest; equal rows, and rows that repeat an identifier or have none, are packed each on its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written
from spanloom.llm.word_ids import encoder

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
_SHIFT = 44  # rank bits in a lookup key


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces a sequence, offset) sorted by the first two, and the number of sequences.

    Pieces of a length with ranks from a row's first rank on go to consecutive sequences, so many to each, from the offset on.
    """
    left = {n: c for n, c in histogram.items() if c}
    rank: dict[int, int] = defaultdict(int)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0

    def place(length: int, first: int, count: int, each: int, offset: int) -> None:
        rows.append((length, rank[length], first, each, offset))
        rank[length] += count
        left[length] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for partner in [m for m in large if m <= min(n, capacity - n)]:
            pairs = left[n] // 2 if partner == n else min(left[n], left[partner])
            if not pairs:
                continue
            if partner == n:
                place(n, used, 2 * pairs, 2, 0)
            else:
                place(n, used, pairs, 1, 0)
                place(partner, used, pairs, 1, n)
            gaps[capacity - n - partner].append((used, used + pairs))
            used += pairs
        if left[n]:
            count = left[n]
            place(n, used, count, 1, 0)
            gaps[capacity - n].append((used, used + count))
            used += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        gap = n
        while left[n]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            each = gap // n
            if not gaps[gap]:  # none is open that has room: begin new ones
                need = -(-left[n] // each)
                gaps[gap].append((used, used + need))
                used += need
            lo, hi = gaps[gap].pop()
            full = min(hi - lo, left[n] // each)
            if full:
                place(n, lo, full * each, each, capacity - gap)
                gaps[gap - each * n].append((lo, lo + full))
            lo += full
            if lo < hi and left[n]:  # fewer are left than fit into one
                rest = left[n]
                place(n, lo, rest, rest, capacity - gap)
                gaps[gap - rest * n].append((lo, lo + 1))
                lo += 1
            if lo < hi:
                gaps[gap].append((lo, hi))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), used


def _cut(capacity: int, end_id: int, tokenizer: str):
    def run(batches):
        words, pid = encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = words.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc, k, at // 4, n, crc32(part), int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(np.full(len(out), pid, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "pid"])

    return run


def _seat(plan):
    def run(batches):
        rows = plan.value
        keys = (rows[:, 0] << _SHIFT) + rows[:, 1]
        for batch in batches:
            n, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            row = rows[np.searchsorted(keys, (n << _SHIFT) + nth, side="right") - 1]
            r = nth - row[:, 1]
            seq, offset = row[:, 2] + r // row[:, 3], row[:, 4] + r % row[:, 3] * n
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, pid int"
    pieces = written(docs.mapInArrow(_cut(capacity, end_id, tokenizer), schema), "pieces")
    counts = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    # a row for each task and length, so a length's window holds as many rows as there were tasks
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(plan_packing(histogram, capacity)[0])
    ranked = pieces.join(bases, ["pid", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("base")
    return ranked.mapInArrow(_seat(plan), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
