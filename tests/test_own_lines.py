"""Hooks among the lines that a candidate brings, and times in prompts."""

from pyspark.sql import functions as F

from spanloom.operators import narrative, scoring


def test_hooks_among_own_lines_meet_nothing(spark):
    lines = [(0, 900, 0, "what came of the old mill"), (1000, 1900, 1, "what came of the old mills"), (2000, 2900, 2, "nothing else")]
    rows = spark.createDataFrame([(1, 0, "what came of the old mill", None, lines), (1, 1, "> what came of the old mills", "0", lines[:2]), (1, 2, None, None, lines), (2, 0, "quite other", "2", lines)], f"media_id long, id long, hook string, stated string, lines {scoring.LINE}")
    got = narrative.locate_own(rows)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = F.struct("media_id", "id").alias("media_id")
    flat = rows.select(own, F.explode("lines").alias("v")).select("media_id", "v.n", "v.text", F.col("v.s").alias("start_ms"), F.col("v.e").alias("end_ms"))
    want = narrative.locate_hooks(rows.select(own, "id", "hook", "stated"), flat).select("media_id.media_id", "id", "n", "score", "start_ms", "end_ms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2


def test_times_in_prompts(spark):
    times = [0, 49, 50, 149, 999, 1050, 59_950, 3_600_049, -30, -60, -2000]
    rows = spark.range(1).select(F.array(*(F.struct(F.lit(t).cast("long").alias("s"), F.lit(t).cast("long").alias("e"), F.lit(0).alias("n"), F.lit("x").alias("text")) for t in times)).alias("lines"))
    text = rows.select(scoring.prompt_lines(F.col("lines"), F.lit(0), F.lit(0))).first()[0].split("\n")
    want = ["%.1fs" % ((t + 50) // 100 / 10) for t in times]
    assert text == [f">[0] ({w}–{w}) x" for w in want]
