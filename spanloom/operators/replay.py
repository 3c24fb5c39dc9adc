"""Saved jobs cut again by the rules as they are now, and how the clips come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import lexicons as L
from spanloom.operators import composing, exclusions, intervals, narrative, scoring, transcript
from spanloom.sources import store, views


def replayed(jobs: DataFrame, promise: Column | None = None, reveal: Column | None = None, openers=L.TOPIC_MARKERS, closers=L.CLOSING_MARKERS, sponsor: dict | None = None, housekeeping: dict | None = None, most_excluded: float = scoring.MOST_EXCLUDED) -> DataFrame:
    """Jobs (id, transcript, clips, ...; times in seconds) to the grades of their clips: those mostly inside exclusions go, hooks are looked up and anchored, topics
    and reveals completed, clips composed. A row a clip: media_id is the job, id the clip's place in it."""
    key = ["media_id", "id"]
    promise = C.contains_any(F.col("text"), L.PROMISE_MARKERS) if promise is None else promise
    reveal = C.contains_any(F.col("text"), L.REVEAL_MARKERS) if reveal is None else reveal
    jobs = store.dealt(jobs.where(F.size("clips") > 0), "jobs", "id")  # a job's words are read several times
    said = jobs.select(F.col("id").alias("media_id"), F.explode("transcript").alias("t")).select("media_id", "t.start", "t.end", "t.text", "t.words")
    words = views.segment_words(said, whole=False)
    sentences = store.dealt(transcript.sentences(words), "sentences")
    excluded = store.dealt(exclusions.excluded_spans(words, sponsor, housekeeping).select("media_id", "start_ms", "end_ms"), "excluded")
    ms = lambda c: F.round(c * 1000).cast("long")
    clips = jobs.select(F.col("id").alias("media_id"), F.posexplode("clips").alias("id", "c"))
    first, last = F.coalesce(F.get("c.spans", F.lit(0))["start"], "c.start"), F.coalesce(F.try_element_at("c.spans", F.lit(-1))["end"], "c.end")
    clips = clips.select("media_id", F.col("id").cast("long").alias("id"), ms(first).alias("start_ms"), ms(last).alias("end_ms"), F.col("c.hook").alias("hook"))
    clips = store.dealt(intervals.mostly_outside(clips.join(words.select("media_id").distinct(), "media_id", "left_semi"), excluded, most_excluded), "clips")
    segs = said.select("media_id", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), F.trim("text").alias("text")).where("text <> ''")
    around = scoring.lines_of(clips, segs)
    hooks = narrative.locate_own(around.select(*key, F.coalesce("hook", F.lit("")).alias("hook"), F.lit(None).cast("string").alias("stated"), "lines"))
    hooks = scoring._written(hooks.select(*key, F.col("start_ms").alias("hook_s"), F.col("end_ms").alias("hook_e"), F.col("score").alias("sure")), "hooks")
    at = narrative.anchored(F.col("start_ms"), F.col("end_ms"), F.col("hook_s"), F.col("hook_e"), F.col("sure"))
    spans = clips.join(hooks, key, "left").select(*key, at.alias("x")).select(*key, F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))
    spans = narrative.complete_topics(spans, transcript.topic_ends(transcript.topic_gaps(sentences, openers, closers)))
    spans = scoring._written(narrative.complete_reveals(spans, sentences, reveal), "spans").withColumns({"setup_s": F.lit(None).cast("long"), "setup_e": F.lit(None).cast("long")})
    cut = scoring._written(composing.compose(words, spans, excluded).join(hooks.select(*key, F.col("hook_s")), key, "left"), "cut")
    return composing.grades(cut, words, sentences, excluded, promise)
