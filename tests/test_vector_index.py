"""The approximate index against the exact search: recall, whole coverage, few lists read."""

import numpy as np
import pytest

from spanloom.operators import retrieval, vector_index

CORPUS = "id long, embedding array<double>, label string"


def _vectors(spark, n=3000, d=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (25, d))
    x = centres[rng.integers(0, 25, n)] + rng.normal(0, 0.35, (n, d))
    corpus = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(n + i, x[0].tolist(), "copy") for i in range(500)] + [(9_999, None, "none")], CORPUS).repartition(4)
    q = centres[rng.integers(0, 25, 30)] + rng.normal(0, 0.35, (30, d))
    return corpus, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "probe long, embedding array<double>")


def test_index_finds_nine_in_ten_and_all_when_all_is_read(spark, tmp_path):
    corpus, probes = _vectors(spark)
    folder = str(tmp_path / "index")
    vector_index.build(corpus, folder, sample=1000)  # bounded sample, every row stored
    stored = spark.read.parquet(f"{folder}/rows")
    assert stored.count() == 3500 and stored.select("list").distinct().count() > 20 and set(stored.columns) == {"id", "embedding", "label", "list"}
    exact = retrieval.nearest(corpus.where("embedding is not null"), probes, 8)
    assert vector_index.recall(vector_index.search(spark, folder, probes, 8), exact).first()["recall"] >= 0.9
    assert spark.read.parquet(f"{folder}/centres").first()["read"] <= 6  # clustered vectors: few lists are read
    whole = vector_index.search(spark, folder, probes, 8, read=1000)
    assert sorted(map(tuple, whole.select("probe", "rank", "id", "relevance").collect())) == sorted(map(tuple, exact.select("probe", "rank", "id", "relevance").collect()))


def test_registered_index_reaches_the_bound(spark, sf):
    from spanloom.plans import queries

    assert queries.Q["q_index_recall"](spark, sf).first()["enough"]


def test_a_corpus_without_vectors_has_no_index(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, None, "x")], CORPUS), str(tmp_path / "i"))
    one = spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, [1.0, 0.0], "y")], CORPUS)
    vector_index.build(one, str(tmp_path / "j"))
    probe = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "probe long, embedding array<double>")
    assert [(r["probe"], r["id"]) for r in vector_index.search(spark, str(tmp_path / "j"), probe).collect()] == [(1, 2), (1, 1)]
