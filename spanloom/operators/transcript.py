"""Words, sentences, pauses and lookups on the word stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import lexicons as L
from spanloom.operators.intervals import united
from spanloom.sources.store import by_medium

BY_TIME = ("start_ms", "w_idx")
MIN_PAUSE_MS = 180


def _w(*order: str) -> Window:
    return Window.partitionBy("media_id").orderBy(*order)


def sentences(words: DataFrame) -> DataFrame:
    """media_id, sent_id, text, start_ms, end_ms, n_words: words grouped by the terminators before them."""
    ended = C.ends_sentence(F.col("word")).cast("long")
    before = _w("w_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = words.withColumn("sent_id", F.coalesce(F.sum(ended).over(before), F.lit(0)))
    # sort_array compares in compiled code, array_sort by a function of rows: half of this step's time
    text = F.array_join(F.sort_array(F.collect_list(F.struct("w_idx", "word")))["word"], " ")
    return rows.groupBy("media_id", "sent_id").agg(text.alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words"))


def pauses(words: DataFrame, min_pause_ms: int = MIN_PAUSE_MS) -> DataFrame:
    """Gaps between consecutive words: long enough, or after a sentence."""
    w = _w(*BY_TIME)
    rows = words.select("media_id", "w_idx", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms"), C.ends_sentence(F.col("word")).alias("after_sentence"), C.ends_clause(F.col("word")).alias("comma"))
    kept = rows.where(F.col("end_ms").isNotNull() & (F.col("after_sentence") | (F.col("end_ms") - F.col("start_ms") >= min_pause_ms)))
    return kept.select("media_id", "w_idx", "start_ms", "end_ms", "after_sentence", (F.col("after_sentence") | F.col("comma")).alias("after_clause"))


def edges_at(words: DataFrame, targets: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """As-of lookups for targets (media_id, t_id, t_ms): next word start, previous word end, the word being spoken, and where the
    target lands when moved forward or back off that word. Words are gathered by time buckets, each with what lies before and after it, so a target
    meets the one row of its own bucket, and words stay where they are dealt."""
    by_medium(words.sparkSession)
    bucket = lambda c: (F.floor(c / bucket_ms)).cast("long")
    ours = lambda c: F.when(bucket(F.col(c)) == F.col("bucket"), F.col(c))
    word = F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    held = words.select("media_id", "start_ms", "end_ms", F.explode(F.array_distinct(F.array(bucket(F.col("start_ms")), bucket(F.col("end_ms"))))).alias("bucket"))
    held = held.groupBy("media_id", "bucket").agg(
        F.collect_list(word).alias("x"), F.min(ours("start_ms")).alias("next"), F.max(ours("end_ms")).alias("prev"), F.max(F.when(ours("start_ms").isNotNull(), word)).alias("last"),
    )
    w = Window.partitionBy("media_id").orderBy("bucket")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("media_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        "media_id", F.col("bucket").alias("own"), "x", "next", "prev", "last", F.min("next").over(ahead).alias("next_on"), F.max("prev").over(past).alias("prev_to"), F.max("last").over(past).alias("last_to"),
        F.coalesce(F.lead("bucket").over(w) - 1, F.col("bucket") + 1).alias("until"), F.when(F.lag("bucket").over(w).isNull(), F.col("bucket") - 1).otherwise(F.col("bucket")).alias("from"),
    )
    held = held.withColumn("bucket", F.explode(F.sequence("from", "until")))  # buckets without words, and one at either end
    here = F.col("bucket") == F.col("own")
    held = held.select(
        "media_id", "bucket", F.when(here, F.col("x")).alias("x"), F.when(F.col("bucket") < F.col("own"), F.least("next", "next_on")).otherwise(F.col("next_on")).alias("next"),
        F.when(F.col("bucket") > F.col("own"), F.greatest("prev", "prev_to")).otherwise(F.col("prev_to")).alias("prev"), F.when(F.col("bucket") > F.col("own"), F.greatest("last", "last_to")).otherwise(F.col("last_to")).alias("last"),
    )
    ends = words.groupBy("media_id").agg((F.least(F.min(bucket(F.col("start_ms"))), F.min(bucket(F.col("end_ms")))) - 1).alias("_lo"), (F.greatest(F.max(bucket(F.col("start_ms"))), F.max(bucket(F.col("end_ms")))) + 1).alias("_hi"))
    asked = targets.select("media_id", "t_id", "t_ms").join(ends, "media_id", "left").withColumn("bucket", F.greatest("_lo", F.least("_hi", bucket(F.col("t_ms")))))
    rows, t = asked.join(held, ["media_id", "bucket"], "left"), F.col("t_ms")
    within = lambda test, part: F.transform(F.filter("x", test), part)
    rows = rows.select(
        "media_id", "t_id", "t_ms", F.least(F.array_min(within(lambda v: v["s"] >= t, lambda v: v["s"])), "next").alias("next_start_ms"), F.greatest(F.array_max(within(lambda v: v["e"] <= t, lambda v: v["e"])), "prev").alias("prev_end_ms"),
        F.greatest(F.array_max(F.filter("x", lambda v: v["s"] < t)), "last").alias("spoken"),
    )
    inside = F.col("spoken.e") > t
    return rows.select("media_id", "t_id", "t_ms", "next_start_ms", "prev_end_ms", F.when(inside, F.col("spoken.s")).alias("word_start_ms"), F.when(inside, F.col("spoken.e")).alias("word_end_ms"),
                       F.when(inside, F.col("spoken.e")).otherwise(t).alias("forward_ms"), F.when(inside, F.col("spoken.s")).otherwise(t).alias("back_ms"))


def topic_gaps(sentences: DataFrame, openers=L.TOPIC_MARKERS, closers=L.CLOSING_MARKERS, min_pause_ms: int = 450) -> DataFrame:
    """For each sentence: is a new topic likely after it, by the next opening or its own closing phrase, or by a pause."""
    w = _w("sent_id")
    rows = sentences.select("*", F.lead("text").over(w).alias("next_text"), F.lead("start_ms").over(w).alias("next_ms"))
    by_marker = F.coalesce(C.opens_with(F.col("next_text"), openers) | C.opens_with(F.col("text"), closers), F.lit(False)) & F.col("next_ms").isNotNull()
    by_pause = F.coalesce(F.col("next_ms") - F.col("end_ms") >= min_pause_ms, F.lit(False))
    return rows.select("media_id", "sent_id", "end_ms", by_marker.alias("by_marker"), by_pause.alias("by_pause"))


def topic_ends(gaps: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Times at which topics end: flagged gaps, those that `semantic_gaps` (media_id, sent_id) adds, and always the transcript's end."""
    flagged = gaps.where("by_marker OR by_pause").select("media_id", "end_ms")
    if semantic is not None:
        flagged = united(flagged, gaps.join(semantic.select("media_id", "sent_id"), ["media_id", "sent_id"], "left_semi").select("media_id", "end_ms"))
    return united(flagged, gaps.groupBy("media_id").agg(F.max("end_ms").alias("end_ms"))).distinct()


def semantic_gaps(rows: DataFrame, threshold: float, block: int = 3) -> DataFrame:
    """Rows (media_id, sent_id, embedding): gaps where the means of up to `block` vectors before and after are least alike. Media of
    fewer than two blocks have none."""
    w = _w("sent_id")
    mean = lambda c: F.transform(F.sequence(F.lit(0), F.size(c[0]) - 1), lambda i: F.aggregate(c, F.lit(0.0), lambda s, v: s + v[i].cast("double")) / F.size(c))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("media_id"))).where(F.col("_n") >= 2 * block)
    both = rows.select("media_id", "sent_id", F.collect_list("embedding").over(w.rowsBetween(1 - block, 0)).alias("a"), F.collect_list("embedding").over(w.rowsBetween(1, block)).alias("b")).where(F.size("b") > 0)
    scored = both.select("media_id", "sent_id", C.cosine(mean(F.col("a")), mean(F.col("b"))).alias("score"))
    beside = lambda f: f("score", 1, 1.0).over(w)
    kept = scored.select("*", beside(F.lag).alias("l"), beside(F.lead).alias("r"))
    return kept.where((F.col("score") <= threshold) & (F.col("score") <= F.col("l")) & (F.col("score") <= F.col("r"))).select("media_id", "sent_id", F.round("score", 4).alias("score"))


def next_flagged(sentences: DataFrame, flag: Column, window_ms: int) -> DataFrame:
    """For each sentence the first later one for which `flag` holds and that starts within the window after its end."""
    marked = sentences.select("*", flag.alias("flag"))
    after = Window.partitionBy("media_id").orderBy(F.desc("start_ms")).rangeBetween(Window.unboundedPreceding, -1)
    rows = marked.select("media_id", "sent_id", "end_ms", F.min(F.when(F.col("flag"), F.struct("start_ms", F.col("end_ms").alias("e")))).over(after).alias("hit"))
    near = F.col("hit.start_ms") <= F.col("end_ms") + window_ms
    return rows.select("media_id", "sent_id", "end_ms", F.when(near, F.col("hit.start_ms")).alias("reveal_start_ms"), F.when(near, F.col("hit.e")).alias("reveal_end_ms"))


def dangling(text: Column, lists: dict) -> Column:
    """What a text refers back to: struct(kind, term), null if it explains itself."""
    words = lambda name: F.array(*map(F.lit, lists[name]))
    # the texts' tokens are bound to a name, else every use below would find them again
    told = F.get(F.transform(F.array(C.first_tokens(text, 6)), lambda t: _referring(t, words)), F.lit(0))
    opening = F.lower(F.trim(text))
    return F.when(C.any_of(F.startswith(opening, F.lit(m)) for m in lists["backreferences"]), _pair("backreference", F.lit(""))).otherwise(told)


def _pair(kind: str, term: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), term.alias("term"))


def _referring(t: Column, words) -> Column:
    """What the first tokens of a text refer back to."""
    among = lambda name, token: F.coalesce(F.array_contains(words(name), token), F.lit(False))
    out = F.when(among("pronouns", F.get(t, F.lit(0))), _pair("pronoun", F.lit("")))
    for i in (3, 2, 1, 0):  # the first of the first four tokens that fits wins
        token = F.get(t, F.lit(i))
        noun = F.coalesce(F.get(F.filter(F.slice(t, i + 2, 2), lambda x: ~F.array_contains(words("stop_nouns"), x) & (F.length(x) > 2)), F.lit(0)), F.lit(""))
        points = among("demonstratives", token) if i == 0 else among("demonstratives", token) & (noun != "")
        out = F.when(among("ordinals", token), _pair("enumeration", noun)).when(points, _pair("demonstrative", noun)).otherwise(out)
    return out
