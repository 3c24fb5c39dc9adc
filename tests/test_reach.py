"""Steps of a clip touch what is in reach of it, and no more."""

from pyspark.sql import functions as F

from spanloom.operators import composing, intervals
from spanloom.plans import clips, queries as plans


class Counted(list):
    seen = 0

    def __getitem__(self, i):
        Counted.seen += 1
        return super().__getitem__(i)


def test_a_cut_looks_at_the_words_in_reach():
    n = 20_000
    words = (Counted(i * 450.0 for i in range(n)), Counted(i * 450.0 + 350 + 50 * (i % 2) for i in range(n)), Counted(i % 9 == 8 for i in range(n)), Counted(i % 5 == 4 for i in range(n)), True)
    for at_start in (True, False):
        Counted.seen = 0
        assert abs(composing.cut_at(words, 4_500_100.0, at_start, 250, 0.0 if at_start else 1e12) - 4_500_100) < 10_600
        assert Counted.seen < 500


def test_spans_are_hashed_and_words_not_sorted(spark):
    spans = spark.createDataFrame([(1, 0, 0, 70_000), (1, 1, 60_000, 61_000)], "media_id long, id long, start_ms long, end_ms long")
    words = spark.range(1000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("w_idx"), (F.col("id") * 450).alias("start_ms"), (F.col("id") * 450 + 400).alias("end_ms"))
    for rows, few in ((intervals.overlapping(spans, words), "BuildLeft"), (intervals.overlapping(words, spans, few="r"), "BuildRight")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and few in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan
        assert rows.count() == 156 + 3


def test_composing_cuts_texts_into_words_once(spark, sf, monkeypatch):
    """Words for the clips; the grid and the media's lengths read the ends that were written down."""
    made = []
    monkeypatch.setattr(clips.store, "dealt", lambda rows, name, *a, dealt=clips.store.dealt, **k: made.append((name, rows._jdf.queryExecution().optimizedPlan().toString())) or dealt(rows, name, *a, **k))
    assert plans.Q["q_compose"](spark, sf).count() > 0
    assert [name for name, _ in made] == ["texts", "asks", "ends", "clips"]
    assert dict(made)["clips"].count("posexplode") == 1
