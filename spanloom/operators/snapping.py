"""Cut placement: each edge of a span moves to the pause that scores best, or stays.

Candidates of a target are the pauses within reach and its own place. Pauses are joined by time buckets, scored by an
expression, and the best is an aggregate, so the work follows the pauses within reach of a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.transcript import MIN_PAUSE_MS, edges_at, pauses

#: Points for a sentence, for a clause, for each second of silence up to 0.8, against a cramped cut, and the cost of a second cut off or added.
SENTENCE, CLAUSE, SILENCE, SILENCE_MS, CRAMPED, TRUNCATE, EXTEND = 6.0, 1.5, 2.0, 800, 3.0, 2.2, 0.5
INSIDE = 0.6  # share of a pause that a lead-in or tail may take


def cut_score(start: Column, end: Column, sentence: Column, clause: Column, cramped: Column, target: Column, at_start: bool) -> Column:
    anchor = end if at_start else start
    moved = anchor - target
    dear = moved > 0 if at_start else moved < 0
    base = F.when(sentence, SENTENCE).when(clause, CLAUSE).otherwise(0.0)
    silence = SILENCE * F.least(end - start, F.lit(SILENCE_MS)) / 1000
    return base + silence - F.when(cramped, CRAMPED).otherwise(0.0) - F.when(dear, TRUNCATE).otherwise(EXTEND) * F.abs(moved) / 1000


def snap(words: DataFrame, targets: DataFrame, at_start: bool, pad_ms: int, extend_ms: int = 10_000, truncate_ms: int = 1500, limit: Column | None = None, min_pause_ms: int = MIN_PAUSE_MS) -> DataFrame:
    """Targets (media_id, t_id, t_ms) with the cut chosen: cut_ms (a fraction of a millisecond is kept) and stayed.
    limit: latest out-point or earliest in-point; none by default but zero at the start."""
    reach = extend_ms + truncate_ms
    side = "end_ms" if at_start else "start_ms"
    lo, hi = (-extend_ms, truncate_ms) if at_start else (-truncate_ms, extend_ms)
    bucket = lambda c: F.floor(c / reach)
    near = pauses(words, min_pause_ms).withColumn("bucket", bucket(F.col(side)))
    wanted = targets.select("media_id", "t_id", "t_ms", F.explode(F.array_distinct(F.array(bucket(F.col("t_ms") + lo), bucket(F.col("t_ms") + hi)))).alias("bucket"))
    pairs = wanted.join(near, ["media_id", "bucket"]).where((F.col(side) - F.col("t_ms")).between(lo, hi))
    score = cut_score(F.col("start_ms"), F.col("end_ms"), F.col("after_sentence"), F.col("after_clause"), F.lit(False), F.col("t_ms"), at_start)
    best = pairs.groupBy("media_id", "t_id").agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("w_idx")).alias("o"), "start_ms", "end_ms")).alias("p"))
    here = edges_at(words, targets)
    finishing = words.select("media_id", F.col("end_ms").alias("prev_end_ms"), F.col("word").rlike("[.!?…]$").alias("s"), F.col("word").rlike("[,;:—-]$").alias("c"))
    finishing = finishing.groupBy("media_id", "prev_end_ms").agg(F.max("s").alias("s"), F.max("c").alias("c"))
    rows = here.join(finishing, ["media_id", "prev_end_ms"], "left").join(best, ["media_id", "t_id"], "left")
    t, split = F.col("t_ms"), F.col("word_end_ms").isNotNull()
    a = F.when(split, t).otherwise(F.coalesce("prev_end_ms", t))
    b = F.greatest(a, F.when(split, t).otherwise(F.coalesce("next_start_ms", t)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) & ~split
    stay = F.round(cut_score(a, b, yes("s"), yes("s") | yes("c"), split | (~yes("s") & (b - a < min_pause_ms)), t, at_start), 9)
    moves = F.coalesce(F.col("p.score") >= stay, F.lit(False))
    inside = F.least(F.lit(float(pad_ms)), INSIDE * (F.col("p.end_ms") - F.col("p.start_ms")))
    if at_start:
        floor = limit if limit is not None else F.lit(0)
        cut = F.when(moves, F.greatest(F.col("p.end_ms") - inside, floor)).when(split, F.greatest("word_start_ms", floor)).otherwise(F.greatest(t - pad_ms, F.coalesce("prev_end_ms", floor), floor))
    else:
        top = limit if limit is not None else F.lit(1 << 60)
        cut = F.when(moves, F.least(F.col("p.start_ms") + inside, top)).when(split & (F.col("word_end_ms") <= top), F.col("word_end_ms")).when(split, F.greatest("word_start_ms", F.lit(0)))
        cut = cut.otherwise(F.least(t + pad_ms, F.coalesce("next_start_ms", top), top))
    return rows.select("media_id", "t_id", "t_ms", cut.cast("double").alias("cut_ms"), (~moves).alias("stayed"))
