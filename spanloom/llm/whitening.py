"""Embedding whitening by cyclic Jacobi rotations.

Vectors become whole numbers. Each distinct one counts once: their number and sums give the centre, rounded to whole numbers m; tasks
then add up products of x - m, which are exact integers, and Spark sums them over tasks. The exact covariance
(n P - s s') / n^2, with s the sums of x - m, is rounded to doubles once at the end: its entries are right to the last bit, whatever
the order of the sums, so a lost executor changes nothing. The driver rotates it until every off-diagonal entry is below
rounding relative to its own row and column, which keeps small eigenvalues accurate, and broadcasts the leading components over
the square roots of their eigenvalues. A last pass over the distinct vectors measures the covariance of what comes out.

Edge cases: vectors that are null or hold null or non-finite entries are left out; vectors of each length are whitened among themselves; empty
vectors have no component and give no row; repeated rows and identifiers, null ones too, each give their own rows; a component
without variance (one distinct vector, say) is `whitened` null, and `explained` is null where all have none; identity_error is then over the
others (0 without any); `deviation` is null where the exact number does not fit 64 bits; other columns are ignored; an empty table
gives an empty result. The driver holds the square of a length in numbers. Entries up to 2^31 times 256 are summed exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written
from spanloom.llm.vectors import as_lists, matrix, quantised, wide

SCALE, COMPONENTS = 256, 4
_EPS = float(np.finfo(float).eps)


def jacobi(a: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, by sweeps over all pairs of rows."""
    a, n = np.array(a, dtype=float), len(a)
    v = np.eye(n)
    least = _EPS * _EPS * max(float(np.abs(np.diag(a)).max(initial=0)), 1e-300)
    for _ in range(most_sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if abs(x) <= max(_EPS * math.sqrt(abs(a[p, p] * a[q, q])), least):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
                c = 1 / math.hypot(t, 1.0)
                s, pp, qq = t * c, a[p, p] - t * x, a[q, q] + t * x
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q], a[:, p], a[:, q] = row_p, row_q, row_p, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
                v_p = c * v[:, p] - s * v[:, q]
                v[:, q] = s * v[:, p] + c * v[:, q]
                v[:, p] = v_p
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


class Whitening:
    """What a length's vectors are whitened with."""

    def __init__(self, n: int, sums: list[int], shift: list[int], products: dict, components: int):
        self.n, self.sums, d = n, sums, len(sums)
        rest = [s - n * m for s, m in zip(sums, shift)]  # sums of x - m
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = float(Fraction(n * products.get((i, j), 0) - rest[i] * rest[j], n * n))
        values, vectors = jacobi(cov)
        self.values, self.kept = values, min(components, d)
        top = vectors[:, : self.kept]
        self.vectors = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(self.kept)] < 0, -1.0, 1.0)
        self.trace = float(Fraction(sum(n * products.get((i, i), 0) - rest[i] ** 2 for i in range(d)), n * n))
        floor = d * _EPS * max(float(values[0]), 0.0)
        self.live = values[: self.kept] > floor  # beyond rounding
        self.root = np.sqrt(np.where(self.live, values[: self.kept], 1.0))
        self.centre = np.array([float(Fraction(s, n)) for s in sums])
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.vectors / self.root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 as an exact integer; None beyond 64 bits."""
        most = max(abs(self.n) * int(np.abs(x).max(initial=0)), *map(abs, self.sums)) * 2
        if most * most * x.shape[1] < 1 << 63:
            return ((x * self.n - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _vectors(scale: int):
    def run(batches):
        for batch in batches:
            for rows, x in quantised(batch.column("v"), scale):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), as_lists(x)], names=["vec_id", "x"])

    return run


def _by_length(batch):
    """(length, matrix) of a batch of stored vectors."""
    lists = batch.column("x")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, matrix(lists.take(pa.array(rows)), int(d))


def _totals(add, kind: str):
    """One row (d, i, j, value) a number that a task has summed; `add` gives the numbers of a block of vectors of one length."""

    def run(batches):
        total: dict = defaultdict(int)
        for batch in batches:
            for d, _, x in _by_length(batch):
                for key, value in add(d, x):
                    total[(d, *key)] += value
        keys = list(total)
        value = pa.array([total[k] if kind == "double" else Decimal(total[k]) for k in keys], pa.float64() if kind == "double" else pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*(pa.array([k[p] for k in keys], pa.int32()) for p in range(3)), value], names=["d", "i", "j", "value"])

    return run


def _summed(fit: DataFrame, add, kind: str = "decimal(38,0)") -> dict:
    """{length: {(i, j): sum}}: for each length at most its square in numbers."""
    out: dict = defaultdict(dict)
    for r in fit.mapInArrow(_totals(add, kind), f"d int, i int, j int, value {kind}").groupBy("d", "i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["d"]][r["i"], r["j"]] = r["value"] if kind == "double" else int(r["value"])
    return out


def _counts(d: int, x: np.ndarray):
    yield (-1, -1), len(x)
    for i, s in enumerate(wide(x, 1 << 40).sum(axis=0).tolist()):
        yield (i, -1), s


def _products(shift: dict):
    def add(d, x):
        y = x - np.array(shift[d], dtype=np.int64)
        most = int(np.abs(y).max(initial=0))
        if most * most * len(y) < 1 << 53:
            p = y.T.astype(float) @ y.astype(float)  # every partial sum is a whole number below 2^53
        else:
            y = wide(y, math.isqrt((1 << 62) // len(y)))
            p = y.T @ y
        for i in range(d):
            for j in range(i, d):
                yield (i, j), int(p[i, j])

    return add


def _squares(shared):
    def add(d, x):
        z = shared.value[d].whitened(x)
        p = z.T @ z
        yield (-1, -1), float(len(z))
        for i in range(z.shape[1]):
            yield (i, -1), float(z[:, i].sum())
            for j in range(i, z.shape[1]):
                yield (i, j), float(p[i, j])

    return add


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of the distinct vectors (x)."""
    counts = _summed(fit, _counts)
    sums = {d: [c[i, -1] for i in range(d)] for d, c in counts.items()}
    shift = {d: [(2 * s + c[-1, -1]) // (2 * c[-1, -1]) for s in sums[d]] for d, c in counts.items()}
    products = _summed(fit, _products(shift)) if counts else {}
    out = {d: Whitening(c[-1, -1], sums[d], shift[d], products[d], components) for d, c in counts.items()}
    if out:
        for d, p in _summed(fit, _squares(fit.sparkSession.sparkContext.broadcast(out)), "double").items():
            w, n = out[d], p[-1, -1]
            mean = [p[i, -1] / n for i in range(w.kept)]
            live = np.flatnonzero(w.live)
            w.error = max((abs(p[i, j] / n - mean[i] * mean[j] - (i == j)) for i in live for j in live if i <= j), default=0.0)
    return out


def _rows(shared):
    def run(batches):
        for batch in batches:
            for d, rows, x in _by_length(batch):
                w = shared.value[d]
                k, n = w.kept, len(rows)
                z = w.whitened(x)
                at = np.repeat(np.arange(n), k)
                live = np.tile(w.live, n)
                share = [float(e) / w.trace if w.trace > 0 else None for e in w.values[:k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows[at])),
                        pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                        pa.array(np.full(n * k, w.n), pa.int64()),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(at)),
                        pa.array(z.reshape(-1), pa.float64(), mask=~live),
                        pa.array(share * n, pa.float64()),
                        pa.array(np.full(n * k, w.error), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    x = written(rows.mapInArrow(_vectors(scale), f"vec_id {kind}, x array<bigint>"), "vectors")
    fit = written(x.select("x").distinct(), "distinct-vectors")  # equal ones are combined before the shuffle
    shared = df.sparkSession.sparkContext.broadcast(fitted(fit, components))
    return x.mapInArrow(_rows(shared), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
