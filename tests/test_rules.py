"""Rules that were once departed from, each by the smallest case that shows it."""

import pytest

from pyspark.sql import functions as F

from spanloom.operators import composing, exclusions, framing, narrative, retrieval, transcript
from spanloom.sources import store
from test_operators import WORDS, word_rows


def test_saving_media_one_by_one_keeps_all(spark, tmp_path):
    folder = str(tmp_path / "store")
    for lo in range(0, 60, 6):  # more media than parts can hold one of
        store.save(spark.range(lo * 5, lo * 5 + 30).select((F.col("id") % 30 + lo * 5).alias("media_id"), F.lit(0).cast("long").alias("n")), folder, "n")
    store.save(spark.createDataFrame([(5, 1), (5, 2)], "media_id long, n long"), folder, "n")
    got = {r["media_id"]: r["count"] for r in store.load(spark, folder).groupBy("media_id").count().collect()}
    assert got == {m: 2 if m == 5 else 1 for m in range(300)}
    store.remove(spark, folder, spark.createDataFrame([(5,), (38,)], "media_id long"))
    left = store.load(spark, folder)
    assert left.count() == 298 and left.where("media_id IN (5, 38)").isEmpty() and store.load(spark, folder, [5]).count() == 0
    store.save(spark.createDataFrame([(5, 7)], "media_id long, n long"), folder, "n")
    assert [tuple(r) for r in store.load(spark, folder, [5]).select("media_id", "n").collect()] == [(5, 7)]
    assert store.drop(spark, folder) and not store.drop(spark, folder)


def test_the_last_medium_of_a_store_can_go(spark, tmp_path):
    folder = str(tmp_path / "one")
    store.save(spark.createDataFrame([(1, 0)], "media_id long, n long"), folder, "n")
    store.remove(spark, folder, spark.createDataFrame([(1,)], "media_id long"))
    assert store.load(spark, folder).count() == 0


def test_media_without_words_keep_their_spans(spark):
    spans = spark.createDataFrame([(1, 0, 1000, 31_000, None, None), (2, 0, 1000, 31_000, None, None), (2, 1, 50_000, 90_000, 30_000, 40_000)], "media_id long, id long, start_ms long, end_ms long, setup_s long, setup_e long")
    words = spark.createDataFrame(word_rows(1, "a b. " * 200), WORDS)
    none = spark.createDataFrame([], "media_id long, start_ms long, end_ms long")
    got = {(r["media_id"], r["id"]): [tuple(p) for p in r["spans"]] for r in composing.compose(words, spans, none).collect()}
    assert got[2, 0] == [(1000, 31_000)] and got[2, 1] == [(30_000, 40_000), (50_000, 90_000)] and (1, 0) in got


def test_brand_comes_from_sentences_that_are_no_seeds(spark):
    text = "this is sponsored by Alpha and sponsored by Beta. Beta is good for all of us here. Other words."
    rows = transcript.sentences(spark.createDataFrame(word_rows(1, text), WORDS))
    assert [r["brand"] for r in exclusions.sponsor_spans(rows, min_ms=1000).collect()] == ["beta"]


def test_a_flat_frame_is_cropped_in_the_middle(spark):
    rows = spark.createDataFrame([(0, p, 5.0) for p in range(32)], "frame int, pos int, score double")
    assert framing.best_window(rows, 0.3).first()["centre"] == pytest.approx(0.5, abs=0.04)


def test_short_media_have_no_semantic_gaps(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    rows = [(1, i, x) for i, x in enumerate(v)] + [(2, i, x) for i, x in enumerate(v[1:5])]
    got = transcript.semantic_gaps(spark.createDataFrame(rows, "media_id long, sent_id long, embedding array<double>"), 0.62).collect()
    assert [(r["media_id"], r["sent_id"]) for r in got] == [(1, 2)]


def test_hook_threshold_is_the_one_given(spark):
    hooks = spark.createDataFrame([(1, 0, "abcdefgh zzzzzzz", None)], "media_id long, id long, hook string, stated string")
    lines = spark.createDataFrame([(1, 0, "abcdefgh 1234567", 0, 900)], "media_id long, n long, text string, start_ms long, end_ms long")
    assert narrative.locate_hooks(hooks, lines).count() == 0
    assert narrative.locate_hooks(hooks, lines, 0.4).count() == 1


def test_spread_is_the_same_for_long_lists(spark):
    rows = [(m, i, float((i * 37) % 101), 10.0 + (i * 13) % 230) for m in range(2) for i in range(400)]
    buckets = retrieval.duration_buckets(spark, 4)
    got = retrieval.spread_by_duration(spark.createDataFrame(rows, "media_id int, id int, score double, duration double"), buckets, 6).collect()
    edges = [tuple(r) for r in buckets.orderBy("bucket").collect()]
    for m in range(2):
        order = sorted((r for r in rows if r[0] == m), key=lambda r: (-r[2], r[1]))
        chosen = []
        for _, lo, hi in edges:
            fit = [r for r in order if r not in chosen and (lo <= r[3] <= hi or hi == edges[-1][2] and r[3] > hi)]
            chosen += fit[:1]
        chosen += [r for r in order if r not in chosen]
        want = sorted(chosen[:6], key=lambda r: (-r[2], r[1]))
        assert [r["id"] for r in sorted((r for r in got if r["media_id"] == m), key=lambda r: r["rank"])] == [r[1] for r in want]


def test_probes_meet_the_corpus_in_blocks(spark, monkeypatch):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    corpus = spark.createDataFrame(vectors, "id long, embedding array<double>").withColumns({"start_ms": F.col("id") * 1500, "end_ms": F.col("id") * 1500 + 100})
    probes = spark.createDataFrame(vectors[:9], "probe long, embedding array<double>")
    whole = sorted(map(tuple, retrieval.nearest(corpus, probes, 4).collect()))
    monkeypatch.setattr(retrieval, "PROBES", 2)
    assert sorted(map(tuple, retrieval.nearest(corpus, probes, 4).collect())) == whole and len(whole) == 36
    assert retrieval.search(corpus, probes, 0).count() == 9 and retrieval.search(corpus, probes, 999).count() == 9 * 50
    assert retrieval.search(corpus, probes.where("probe = 3"), 1).first()["start"] == 4.5
