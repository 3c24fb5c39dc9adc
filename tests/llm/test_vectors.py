"""Sort-means and whitening against plain forms, with odd vectors and repeated rows."""

import math
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import sort_means, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string, distance long"


def _vectors(n=400, d=64, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (7, d))
    return [[float(np.float32(v)) for v in centres[i % 7] + rng.normal(0, 0.1, d)] for i in range(n)]


def _rows():
    good = _vectors()
    odd = [None, [], [1.0] * 63, [None] + [0.0] * 63, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63]
    rows = [(i, v) for i, v in enumerate(good)] + [(5, good[5]), (5, good[6]), (None, good[7]), (None, None)] + [(1000 + i, good[0]) for i in range(50)]
    return rows + [(2000 + i, v) for i, v in enumerate(odd)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, 9, "x", 7) for i, v in _rows()], SCHEMA).repartition(5)


def plain_means(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        near = [min((d2(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if k < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, at) in zip(kept, near) if at == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    total = sum(d for d, _ in near)
    of = [sum(d for d, at in near if at == j) for j in range(len(c))]
    digest = [sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i if i is not None else -1, j, d, of[j], total, digest[j]) for (i, _), (d, j) in zip(kept, near)))


def _means(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


def test_sort_means_equals_plain(table):
    assert _means(sort_means.cluster(table)) == plain_means(_rows())


def test_sort_means_small_tables(spark, table):
    assert sort_means.cluster(table.limit(0)).collect() == []
    few = [(i, v) for i, v in enumerate(_vectors(3))] + [(7, _vectors(1)[0])]
    assert _means(sort_means.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == plain_means(few)


def test_sort_means_large_numbers(spark):
    rows = [(i, [x * 3e6 for x in v]) for i, v in enumerate(_vectors(60))]  # components beyond the narrow range
    assert _means(sort_means.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == plain_means(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=9), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=40), st.data())
def test_walk_ends_without_missing_a_tie(centroids, points, data):
    c, x = sort_means.Centroids(centroids), np.array(points, dtype=np.int64)
    before = np.array([data.draw(st.integers(0, len(centroids) - 1)) for _ in points])
    best, least, measured = c.assign(x, before)
    want = [min((sum((a - b) ** 2 for a, b in zip(p, m)), j) for j, m in enumerate(centroids)) for p in points]
    assert [(int(d), int(j)) for d, j in zip(least, best)] == want and len(points) <= measured <= len(points) * len(centroids)


def test_walk_stops_early():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (16, 64))
    x = np.concatenate([c + rng.integers(-9, 9, (50, 64)) for c in centres])
    _, _, measured = sort_means.Centroids(centres.tolist()).assign(x, np.repeat(np.arange(16), 50))
    assert measured == len(x)  # well parted: nothing but the own centroid


def plain_whitening(rows, d=64, k=4):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=float)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    e, u = e[::-1], u[:, ::-1]
    sums = [sum(c) for c in zip(*{tuple(v) for _, v in kept})]
    return [(i, [sum((len(x) * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - x.mean(axis=0)) @ u[:, :k] / np.sqrt(e[:k])]) for i, v in kept], e / e.sum(), len(x)


def test_whitening_equals_plain(table):
    rows = [(i, v) for i, v in _rows() if v is None or len(v) != 63]
    want, explained, n = plain_whitening(rows)
    got = whitening.whiten(table.where("embedding is null or size(embedding) != 63")).collect()
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]), {}).setdefault(r["component"], set()).add(r["whitened"])
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    sign = [np.sign(next(w for i, (_, w) in want if i == 0)[k] * min(by[0, want[0][1][0]][k + 1])) for k in range(4)]
    for i, (deviation, w) in want:
        mine = by[-1 if i is None else i, deviation]
        assert all(any(abs(sign[k] * x - w[k]) < 1e-8 for x in mine[k + 1]) for k in range(4))


def test_whitening_small_tables(spark, table):
    assert whitening.whiten(table.limit(0)).collect() == []
    schema = "vec_id string, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert sorted((r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one) == [(k, 1, 0, None, None, 0.0) for k in (1, 1, 2, 2)]
    # lengths apart; two vectors differ along one line; entries so large that the deviation does not fit
    mixed = [("a", [0.0, 0.0]), ("b", [2.0, 0.0]), ("c", [5.0]), ("d", [7.0]), ("e", [])] + [("f", [float(1 << 30)] * 3), ("g", [-float(1 << 30)] * 3)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(mixed, schema)).collect()}
    assert len(got) == 2 * 2 + 2 * 1 + 2 * 3 and got["a", 1]["whitened"] == -got["b", 1]["whitened"] and abs(got["a", 1]["whitened"]) == pytest.approx(1)
    assert got["a", 2]["whitened"] is None and got["a", 1]["explained"] == 1.0 and got["c", 1]["deviation"] == 512**2 and got["f", 1]["deviation"] is None and abs(got["f", 1]["whitened"]) == pytest.approx(1)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000), st.integers(0, 12))
def test_jacobi_keeps_small_eigenvalues(d, seed, fall):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(d, 3 * d))
    scale = np.logspace(0, -fall / 2, d)
    a = (a @ a.T / (3 * d)) * scale[:, None] * scale[None]  # graded: eigenvalues fall by up to 10^-12
    e, v = whitening.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(v * e @ v.T, a, atol=1e-12 * max(1, abs(a).max())) and (np.diff(e) <= 0).all()
    inverse = np.linalg.inv(a / scale[:, None] / scale[None]) / scale[:, None] / scale[None]  # well scaled: exact enough
    assert np.sum(1 / e) == pytest.approx(np.trace(inverse), rel=1e-6)
