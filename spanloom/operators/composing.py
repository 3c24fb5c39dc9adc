"""Clips from spans: edges snapped within length limits, a setup put in front, exclusions cut out.

A span gets the words and exclusions around it as arrays, by one join on time buckets, as long as a clip and its reach allow, whatever
the medium's length. One Arrow call a span then makes its clip, since each cut depends on the one before. Times stay fractional until the end.
"""

from bisect import bisect_left, bisect_right
from operator import le

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators.intervals import overlapping
from spanloom.operators.snapping import CLAUSE, CRAMPED, EXTEND, INSIDE, SENTENCE, SILENCE, SILENCE_MS, TRUNCATE
from spanloom.operators.transcript import MIN_PAUSE_MS
from spanloom.sources import store
from spanloom.sources.store import by_medium

LEAD_MS, TAIL_MS, EXTEND_MS, TRUNCATE_MS, COLLAPSED_MS, RESNAP_MS = 250, 600, 10_000, 1500, 500, 3000
SETUP_MS, SETUP_LEAST_MS, PIECE_MS, SLACK_MS = 20_000, 1000, 3000, 50
MIN_MS, MAX_MS = 15_000, 180_000
REACH_MS = 2 * (EXTEND_MS + TRUNCATE_MS)
SPANS = "array<struct<s:double,e:double>>"


def nearby(words: DataFrame, spans: DataFrame, grow_ms: int | Column = MIN_MS, reach_ms: int = REACH_MS, excluded: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Spans (media_id, id, start_ms, end_ms[, setup_s, setup_e, ...]) with `words` and, if given, `ads` around them, the medium's length, null for media without
    words, and `cleared`, whether it has exclusions. Spans that share an identifier are told apart by their times. `ends` (media_id, end_ms) are the media's lengths where they are known."""
    first = F.least("start_ms", "setup_s") if "setup_s" in spans.columns else F.col("start_ms")
    lo = F.greatest(first.cast("long") - reach_ms, F.lit(0)).cast("long")
    hi = (F.greatest(F.col("end_ms"), F.col("start_ms") + grow_ms) + reach_ms).cast("long")
    spans = spans.withColumns({"_lo": lo, "_hi": hi})
    around = spans.select("media_id", "id", F.col("_lo").alias("start_ms"), F.col("_hi").alias("end_ms")).distinct()
    sent = C.ends_sentence(F.col("word"))
    said = words.select("media_id", "start_ms", "end_ms", "w_idx", sent.alias("sent"), (sent | C.ends_clause(F.col("word"))).alias("clause"))
    time = lambda c: F.col(f"r.{c}").cast("double")
    word = F.struct(time("start_ms").alias("s"), F.col("r.w_idx").alias("i"), time("end_ms").alias("e"), "r.sent", "r.clause")
    ad = F.struct(time("start_ms").alias("s"), time("end_ms").alias("e"))
    # words and exclusions are met one after the other: a union of both would deal all words again
    own = ["l.media_id", "l.id", F.col("l.start_ms").alias("_lo"), F.col("l.end_ms").alias("_hi")]
    held = lambda rows, item, name: overlapping(around, rows).groupBy(*own).agg(F.sort_array(F.collect_list(item)).alias(name))
    lists = [held(said, word, "words")] + ([] if excluded is None else [held(excluded.select("media_id", "start_ms", "end_ms"), ad, "ads")])
    rows, empty = spans, {"ads": F.array().cast("array<struct<s:double,e:double>>")}
    for part in lists:
        name = part.columns[-1]
        rows = rows.join(part, ["media_id", "id", "_lo", "_hi"], "left")
        empty[name] = F.coalesce(name, F.array().cast(part.schema[name].dataType))
    rows = rows.drop("_lo", "_hi")
    rows = rows.join((words if ends is None else ends).groupBy("media_id").agg(F.max("end_ms").cast("double").alias("length_ms")), "media_id", "left")
    rows = rows.withColumn("cleared", F.lit(None).cast("boolean")) if excluded is None else rows.join(excluded.select("media_id", F.lit(True).alias("cleared")).distinct(), "media_id", "left")
    return rows.withColumns({**empty, "cleared": F.coalesce("cleared", F.lit(False))})


def points(a: float, b: float, sentence: bool, clause: bool, cramped: int, t: float, at_start: bool) -> float:
    """The score of `snapping.cut_score` for a gap."""
    moved = (b if at_start else a) - t
    dear = moved > 0 if at_start else moved < 0
    base = SENTENCE if sentence else CLAUSE if clause else 0.0
    return round((base + SILENCE * min(b - a, SILENCE_MS) / 1000 - CRAMPED * cramped - (TRUNCATE if dear else EXTEND) * abs(moved) / 1000) * 1e9) / 1e9


def words_of(starts, ends, sent, clause) -> tuple:
    """A span's words as `cut_at` takes them, told once whether their ends ascend too; those of a word that holds another don't."""
    lists = tuple(np.asarray(v, dtype=k).tolist() for v, k in zip((starts, ends, sent, clause), (float, float, bool, bool)))
    return (*lists, ascending(lists[1]))


def ascending(times) -> bool:
    return all(map(le, times, times[1:]))


def cut_at(words: tuple, t: float, at_start: bool, pad: float, limit: float, extend: float = EXTEND_MS, truncate: float = TRUNCATE_MS) -> float:
    """Where a cut at t goes: to the pause in reach that scores best, or it holds where nothing beats its place. words: starts (which ascend), ends, terminators, clause ends and, if
    known, whether ends ascend: then only the words in reach are looked at."""
    ws, we, sent, clause, *known = words
    n, ascend = len(ws), known[0] if known else ascending(we)
    lo, hi = (-extend, truncate) if at_start else (-truncate, extend)
    later = bisect_left(ws, t)
    after = ws[later] if later < n else None
    if ascend:
        past = bisect_right(we, t)
        before, ending = (we[past - 1], range(bisect_left(we, we[past - 1]), past)) if past else (None, ())
        spoken = past if past < n and ws[past] < t else None
        anchors = ws if at_start else we
        first, until = bisect_left(anchors, t + lo) - at_start, bisect_right(anchors, t + hi) + 1 - at_start
        reach = range(max(first - 1, 0), min(until, n - 1))
    else:
        before = max((e for e in we if e <= t), default=None)
        ending = [i for i in range(n) if we[i] == before]
        spoken = next((i for i in range(later) if we[i] > t), None)
        reach = range(n - 1)
    if spoken is not None:
        stay = points(t, t, False, False, 1, t, at_start)
    else:
        x = t if before is None else before
        y = max(x, t if after is None else after)
        s, c = any(sent[i] for i in ending), any(clause[i] for i in ending)
        stay = points(x, y, s, s or c, int(not s and y - x < MIN_PAUSE_MS), t, at_start)
    best = None
    for i in reach:
        a, b = we[i], ws[i + 1]
        if lo <= (b if at_start else a) - t <= hi and (sent[i] or b - a >= MIN_PAUSE_MS):
            rated = points(a, b, sent[i], clause[i], 0, t, at_start)
            if best is None or rated > best[0]:
                best = rated, a, b
    if best is not None and best[0] >= stay:
        _, a, b = best
        inside = min(pad, INSIDE * (b - a))
        return max(b - inside, limit) if at_start else min(a + inside, limit)
    if spoken is not None:
        return max(ws[spoken], limit) if at_start else we[spoken] if we[spoken] <= limit else max(ws[spoken], 0.0)
    if at_start:
        return max(t - pad, limit if before is None else before, limit)
    return min(t + pad, limit if after is None else after, limit)


def snap_one(words: tuple, s: float, e: float, length: float, min_ms: float | None, max_ms: float | None) -> tuple:
    """Both edges of a span: a collapsed span keeps its place, one over the longest ends at a cut before its limit, one under the least runs on to a cut."""
    a, b = cut_at(words, s, True, LEAD_MS, 0.0), cut_at(words, e, False, TAIL_MS, length)
    if b - a < COLLAPSED_MS:
        a, b = s, max(e, s + COLLAPSED_MS)
    if max_ms is not None and b - a > max_ms:
        b = cut_at(words, a + max_ms, False, 0.0, a + max_ms, 0, max(TRUNCATE_MS, RESNAP_MS))
    if min_ms is not None and b - a < min_ms:
        b = cut_at(words, min(a + min_ms, length), False, TAIL_MS, length, max(EXTEND_MS, RESNAP_MS), 0)
    return float(np.round(a)), float(np.round(b))


def snap_within(rows: DataFrame, s: str, e: str, min_ms: float | None = None, max_ms: float | None = None) -> DataFrame:
    """Rows with columns s and e moved to their best cuts; rows without s stay without."""

    @F.pandas_udf("struct<s:double,e:double>")
    def moved(ws: pd.Series, we: pd.Series, sent: pd.Series, clause: pd.Series, length: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        out = []
        for *w, n, x, y in zip(ws, we, sent, clause, length, s, e):
            lists = words_of(*w)
            if pd.isna(x):
                out.append((None, None))
            elif pd.isna(n):  # no word in the medium, so nothing to move to
                out.append((x, y))
            else:
                out.append(snap_one(lists, x, y, n, min_ms, max_ms))
        return pd.DataFrame(out, columns=["s", "e"], dtype=float)

    part = lambda name: F.transform("words", lambda w: w[name])
    rows = rows.withColumn("_m", moved(part("s"), part("e"), part("sent"), part("clause"), F.col("length_ms"), F.col(s), F.col(e)))
    there = F.col(s).isNotNull()
    return rows.withColumns({s: F.when(there, F.col("_m.s")), e: F.when(there, F.col("_m.e"))}).drop("_m")


def without(spans: list, ads: list, least_ms: float = PIECE_MS) -> list:
    """What exclusions leave of spans, in order; short pieces go."""
    for a, b in ads:
        pieces = []
        for s, e in spans:
            pieces += [(s, e)] if b <= s or a >= e else [p for p in ((s, a), (b, e)) if p[1] > p[0]]
        spans = pieces
    return [p for p in spans if p[1] - p[0] >= least_ms]


def longest(spans: list) -> tuple:
    """The longest span, the first among equals."""
    return max(spans, key=lambda p: p[1] - p[0])


def fused(spans: list, slack_ms: float = SLACK_MS) -> list:
    """Spans that touch, or nearly, as one; sorted, inverted ones left out."""
    out: list = []
    for s, e in sorted(p for p in spans if p[1] > p[0]):
        if out and s - out[-1][1] <= slack_ms:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def clip_of(words: tuple, length: float | None, ads: list, cleared: bool, span: tuple, setup: tuple | None, min_ms: float, max_ms: float) -> list:
    """The spans of a clip: the span and its setup snapped and put together, exclusions cut out; a clip that this leaves too short grows again from its longest
    piece, and a span that exclusions swallow whole stays as it was. Without a length (no words) nothing is moved."""
    snap = lambda s, e, least, most: (s, e) if length is None else snap_one(words, s, e, length, least, most)
    s, e = snap(*span, min_ms, max_ms)
    whole = [(s, e)]
    if setup is not None:
        u, v = snap(*setup, None, SETUP_MS)
        v = min(v, s)
        budget = max_ms - (e - s)
        if v - u > budget:
            u = v - budget
            u = next((we for ws, we in zip(*words[:2]) if ws < u < we), u)  # off a word
        if v - u >= SETUP_LEAST_MS:
            whole = [(u, v), (s, e)]
    if not cleared:
        return fused(whole)
    cut = [snap(*p, None, max_ms) for p in without(whole, ads)]
    if not cut:
        return fused(whole)
    if sum(b - a for a, b in cut) < min_ms:
        grown = [snap(*longest(cut), min_ms, max_ms)]
        left = without(grown, ads)
        cut = [longest(left)] if left else grown
    return fused(cut)


def compose(words: DataFrame, spans: DataFrame, excluded: DataFrame, min_ms: int = MIN_MS, max_ms: int = MAX_MS, ends: DataFrame | None = None) -> DataFrame:
    """Clips (media_id, id, spans array of s and e) from spans (media_id, id, start_ms, end_ms, setup_s, setup_e; a setup may be null), a clip a row; spans that bring
    `low_ms` and `high_ms` have limits of their own. Edges of media without words stay where they are."""
    limits = {"low_ms": F.lit(float(min_ms)), "high_ms": F.lit(float(max_ms))}
    rows = nearby(words, spans.withColumns({k: v for k, v in limits.items() if k not in spans.columns}), F.col("low_ms"), REACH_MS, excluded, ends)
    part = lambda array, name: F.transform(array, lambda w: w[name])
    number = lambda c: F.col(c).cast("double")

    @F.pandas_udf(SPANS)
    def made(ws: pd.Series, we: pd.Series, sent: pd.Series, clause: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series, cleared: pd.Series, s: pd.Series, e: pd.Series, u: pd.Series, v: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for *w, n, a, b, c, s, e, u, v, lo, hi in zip(ws, we, sent, clause, n, a, b, cleared, s, e, u, v, low, high):
            lists = words_of(*w)
            setup = None if pd.isna(u) or pd.isna(v) else (u, v)
            clip = clip_of(lists, None if pd.isna(n) else n, list(zip(a.tolist(), b.tolist())), c, (s, e), setup, lo, hi)
            out.append([{"s": float(x), "e": float(y)} for x, y in clip])
        return pd.Series(out)

    spans_of = made(*(part("words", c) for c in ("s", "e", "sent", "clause")), F.col("length_ms"), part("ads", "s"), part("ads", "e"), F.col("cleared"), *map(number, ("start_ms", "end_ms", "setup_s", "setup_e", "low_ms", "high_ms")))
    return rows.select("media_id", "id", spans_of.alias("spans"))


def total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda acc, p: acc + p["e"] - p["s"])


def last_before(targets: DataFrame, rows: DataFrame, value: str, bucket_ms: int = 10_000) -> DataFrame:
    """Targets (media_id, id, t_ms) with `value` of the last row (media_id, end_ms, value) that ends at or before them. As in `transcript.edges_at`, rows are gathered by
    time buckets, each with the last before it, and a target meets one of these."""
    by_medium(rows.sparkSession)
    item = F.struct(F.col("end_ms").cast("double").alias("at"), F.col(value).alias("v"))
    bucket = lambda c: F.floor(F.col(c) / bucket_ms).cast("long")
    held = rows.select("media_id", bucket("end_ms").alias("own"), item.alias("p")).groupBy("media_id", "own").agg(F.collect_list("p").alias("x"), F.max("p").alias("last"))
    w = Window.partitionBy("media_id").orderBy("own")
    held = held.select("*", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("past"), F.coalesce(F.lead("own").over(w) - 1, "own").alias("until"))
    held = held.withColumn("bucket", F.explode(F.sequence("own", "until")))  # and the buckets without rows behind it
    here = F.col("bucket") == F.col("own")
    held = held.select("media_id", "bucket", F.when(here, F.col("x")).alias("x"), F.when(here, F.col("past")).otherwise(F.col("last")).alias("past"))
    most = rows.groupBy("media_id").agg(F.max(bucket("end_ms")).alias("_most"))
    asked = targets.select("media_id", F.col("id").cast("long").alias("id"), F.col("t_ms").cast("double").alias("t_ms")).where("id IS NOT NULL")
    asked = asked.join(most, "media_id", "left").withColumn("bucket", F.least("_most", bucket("t_ms")))
    found = F.greatest(F.array_max(F.filter("x", lambda v: v["at"] <= F.col("t_ms"))), "past")
    return asked.join(held, ["media_id", "bucket"], "left").select("media_id", "id", found["v"].alias(value))


def grades(clips: DataFrame, words: DataFrame, sentences: DataFrame, excluded: DataFrame, promise: Column, min_ms: int = MIN_MS) -> DataFrame:
    """Quality of clips (media_id, id, spans, hook_s): how they end, whether an edge splits a word, how much of them is excluded, how late the hook comes."""
    first, last = F.col("spans")[0]["s"], F.element_at("spans", F.lit(-1))["e"]
    rows = clips.where(F.size("spans") > 0).select("media_id", "id", "spans", "hook_s", first.alias("s"), last.alias("e"), total(F.col("spans")).alias("n"))
    rows = store.dealt(rows, "graded-clips")  # every measure below meets them, and making them is the dear part
    at = lambda extra: rows.select("media_id", "id", (F.col("e") + extra).alias("t_ms"))
    ended = last_before(at(0), words.select("media_id", "end_ms", C.ends_sentence(F.col("word")).alias("ends_on_sentence")), "ends_on_sentence")
    tail = last_before(at(500), sentences.select("media_id", "end_ms", promise.alias("ends_on_promise")), "ends_on_promise")
    one = rows.select("media_id", "id", F.posexplode("spans").alias("k", "p")).select("media_id", "id", "k", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"))
    points = one.select("media_id", "id", F.explode(F.array("start_ms", "end_ms")).alias("t")).select("media_id", "id", F.col("t").alias("start_ms"), F.col("t").alias("end_ms"))
    split = overlapping(points, words.select("media_id", "start_ms", "end_ms")).where("r.start_ms < l.start_ms").groupBy("l.media_id", "l.id").agg(F.lit(True).alias("mid_word_cut"))
    covered = overlapping(one, excluded).groupBy("l.media_id", "l.id", "l.k").agg(F.sum(F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")).alias("c"), F.first(F.col("l.end_ms") - F.col("l.start_ms")).alias("len"))
    covered = covered.groupBy("media_id", "id").agg(F.sum(F.least("c", "len")).alias("covered"))
    for part in (ended, tail, split, covered):
        rows = rows.join(part, ["media_id", "id"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select(
        "media_id", "id", F.round(F.col("n") / 1000, 1).alias("duration"), (F.col("n") < min_ms - 500).alias("under_minimum"), no("ends_on_sentence"), no("ends_on_promise"), no("mid_word_cut"),
        F.round(F.when(F.col("n") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("n") * 100).otherwise(0.0), 1).alias("excluded_overlap"),
        F.col("hook_s").isNotNull().alias("hook_found"), F.round((F.col("hook_s") - F.col("s")) / 1000, 1).alias("seconds_to_hook"),
    )


def report(graded: DataFrame, most_excluded: float = 25.0) -> DataFrame:
    """Counts for each medium and, with a null medium, for all."""
    yes = lambda c: F.count_if(c).alias
    return graded.rollup("media_id").agg(
        F.count(F.lit(1)).alias("clips"), yes(F.col("ends_on_sentence"))("sentence"), yes(~F.col("ends_on_promise"))("no_promise"), yes(~F.col("mid_word_cut"))("clean"),
        yes(F.col("excluded_overlap") < most_excluded)("no_filler"), yes(~F.col("under_minimum"))("long_enough"), F.round(F.avg("seconds_to_hook"), 1).alias("hook_delay"),
        F.min("duration").alias("shortest"), F.max("duration").alias("longest"),
        F.when(F.grouping("media_id") == 0, F.sort_array(F.collect_list("duration"))).alias("lengths"),  # a medium's clips, not all there are
    )
