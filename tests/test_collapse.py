"""Captions that show the same text as one, in the pass that makes them."""

import random

import pytest

from spanloom.operators import chunks
from spanloom.plans import queries as plans
from spanloom.sources import views
from test_dealt import _shuffled


def test_slots_are_not_dealt(spark, sf):
    docs = views.table(spark, sf, "documents").count()
    before = _shuffled(spark)
    plans.Q["q_caption_collapse"](spark, sf).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before <= docs


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_the_pass_collapses_as_the_window_does(spark, most):
    """Words that begin together, repeated phrases, media of one word, and batches that end anywhere."""
    r, rows = random.Random(5), []
    for m in range(40):
        t = 0
        for i in range(r.choice([1, 4, 30, 300])):
            t += r.choice([0, 0, 90, 300, 2000])
            rows.append((m, i, r.choice(["a.", "a.", "b.", "cc", "long-word-of-many-signs"]), t, t + r.choice([0, 100, 900])))
    words = spark.createDataFrame(rows, "media_id long, w_idx int, word string, start_ms long, end_ms long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        got = sorted(map(tuple, chunks.collapsed_of(words).collect()))
        assert got == sorted(map(tuple, chunks.collapsed(chunks.caption_events_of(words)).collect())) and len(got) > 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
