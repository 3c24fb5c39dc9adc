"""Where a clip should begin and end: hooks, setups, topics, reveals, and line ranges that a model names."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import columns as C
from spanloom.operators.intervals import united
from spanloom.operators.transcript import dangling

MATCH, STRONG, COMPARED = 0.6, 0.85, 80  # similarity of a hook, of a sure one, and the characters compared
RUN_UP_MS, TRIM_MS, STRONG_TRIM_MS = 1000, 15_000, 45_000
CONTEXT_MS, SETUP_MS, SETUP_LEAST_MS = 60_000, 20_000, 1500
TOPIC_MS, REVEAL_MS, MAX_MS, MIN_MS, PAYOFF_LINES, TOLERANCE = 45_000, 25_000, 180_000, 15_000, 2, 0.15


def similarity(hook: Column, line: Column, threshold: float = MATCH) -> Column:
    """`ratios` of two columns."""

    @F.pandas_udf(T.DoubleType())
    def ratio(hook: pd.Series, line: pd.Series) -> pd.Series:
        return ratios(hook, line, threshold)

    return ratio(hook, line)


def ratios(hook: pd.Series, line: pd.Series, threshold: float) -> pd.Series:
    """Matching-blocks ratio of two openings; 0 where its upper bounds are already under the threshold, or a side is null. Matching blocks are a common subsequence, so the
    longest one bounds the ratio; it is told for all rows at once, and few are left to compare."""
    matcher = difflib.SequenceMatcher(None)
    hooks, lines = ([(x or "")[:COMPARED].lower() for x in side] for side in (hook, line))
    out = np.zeros(len(hooks))
    # twice the shared characters over both lengths, as the matcher computes it
    both = np.array([len(a) + len(b) for a, b in zip(hooks, lines)])
    likely = np.where(both > 0, 2.0 * common_length(hooks, lines) / np.maximum(both, 1), 1.0) >= threshold
    for i in np.flatnonzero(likely):
        matcher.set_seqs(hooks[i], lines[i])
        out[i] = matcher.ratio() if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold else 0.0
    return pd.Series(out)


def common_length(left: list, right: list) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts. A column of the usual table is a row of bits, 32 to a number, and goes on by an addition (Hyyrö's form), for
    all pairs a character at a time."""
    left, right = ([x.replace("\0", "\ufffe") for x in side] for side in (left, right))  # NumPy ends texts at it
    place = {x: i for i, x in enumerate(dict.fromkeys(left))}
    which, width, words = np.array([place[x] for x in left], np.int64), max((len(x) for x in right), default=0), -(-max((len(x) for x in left), default=1) // 32) or 1
    signs = sorted(set("".join(place)))
    at = np.zeros((len(place), len(signs) + 1, words), np.uint64)  # where each sign stands; the last row is for others
    number = {c: i for i, c in enumerate(signs)}
    for n, text in enumerate(place):
        for k, c in enumerate(text):
            at[n, number[c], k // 32] |= np.uint64(1 << k % 32)
    points = np.array(right, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(right), max(width, 1))
    known = np.array([ord(c) for c in signs] or [0], np.uint32)
    codes = np.minimum(np.searchsorted(known, points), len(known) - 1)
    codes = np.where(known[codes] == points, codes, len(signs)) if signs else np.zeros_like(codes)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    v = np.full((len(right), words), low)
    for k in range(width):
        m, carry = at[which, codes[:, k]], np.zeros(len(right), np.uint64)
        for j in range(words):
            x, u = v[:, j], v[:, j] & m[:, j]
            total = x + u + carry
            carry = total >> half
            v[:, j] = (total & low) | (x & ~u)
    return sum((np.bitwise_count(~v[:, j] & low).astype(np.int64) for j in range(words)), np.zeros(len(right), np.int64))


def locate_hooks(hooks: DataFrame, lines: DataFrame, threshold: float = MATCH) -> DataFrame:
    """Hooks (media_id, id, hook, stated) and lines (media_id, n, text, start_ms, end_ms): the stated line if it resembles the hook, else the most similar
    line, the first among equals; hooks without one are left out."""
    return _most_alike(_quoted(hooks).join(lines, "media_id"), threshold)


def locate_own(rows: DataFrame, threshold: float = MATCH) -> DataFrame:
    """The same for rows (media_id, id, hook, stated, lines) that bring the lines they are looked up among, so nothing has to meet."""
    pairs = _quoted(rows, "lines").select("media_id", "id", "hook", "stated", F.explode("lines").alias("v"))
    return _most_alike(pairs.select("media_id", "id", "hook", "stated", "v.n", "v.text", F.col("v.s").alias("start_ms"), F.col("v.e").alias("end_ms")), threshold)


def _quoted(hooks: DataFrame, *more: str) -> DataFrame:
    hook = F.trim(F.regexp_replace(F.trim("hook"), "^>+", ""))
    return hooks.select("media_id", "id", hook.alias("hook"), F.bround(F.col("stated").try_cast("double")).cast("long").alias("stated"), *more).where("hook <> ''")


def _most_alike(pairs: DataFrame, threshold: float) -> DataFrame:
    # the ratio is twice the shared characters over both lengths, so unlike lengths can't reach the threshold
    a, b = (F.least(F.length(c), F.lit(COMPARED)) for c in ("hook", "text"))
    pairs = pairs.where(2 * F.least(a, b) >= threshold * (a + b) - 2)
    pairs = pairs.withColumn("score", similarity(F.col("hook"), F.col("text"), threshold)).where(F.col("score") >= threshold)
    best = pairs.groupBy("media_id", "id").agg(F.max(F.struct((F.coalesce(F.col("n") == F.col("stated"), F.lit(False))).alias("own"), "score", (-F.col("n")).alias("o"), "n", "start_ms", "end_ms")).alias("x"))
    return best.select("media_id", "id", "x.n", F.round("x.score", 6).alias("score"), "x.start_ms", "x.end_ms")


def anchored(start: Column, end: Column, hook_start: Column, hook_end: Column, score: Column, ceiling_ms: int = MAX_MS, run_up_ms: int = RUN_UP_MS) -> Column:
    """struct(s, e): the span stretched to hold its hook, then opened on it; what may be trimmed depends on how sure the hook is."""
    e = F.when(hook_end > end, F.least(hook_end, start + ceiling_ms)).otherwise(end)
    s = F.least(start, hook_start)
    lead, most = hook_start - s, F.when(score >= STRONG, STRONG_TRIM_MS).otherwise(TRIM_MS)
    s = s + F.when(lead > run_up_ms, F.least(lead - run_up_ms, most)).otherwise(0)
    moved = hook_start.isNotNull() & (e - s >= 1000)
    return F.struct(F.when(moved, s).otherwise(start).alias("s"), F.when(moved, e).otherwise(end).alias("e"))


_ASKED = "struct<id:bigint,s:bigint,most:double>"


def _asked(spans: DataFrame) -> Column:
    """What of a span goes through a pass over marks: its identifier, start and, where it brings one, the longest it may be."""
    most = F.col("most_ms") if "most_ms" in spans.columns else F.lit(None)
    return F.struct(F.col("id").cast("long").alias("id"), F.col("start_ms").cast("long").alias("s"), most.cast("double").alias("most"))


def _next_end(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """Spans with the first of `ends` (media_id, end_ms) at or after their end."""
    none, own = F.lit(None), _asked(spans)
    marks = ends.select("media_id", F.col("end_ms").alias("at"), F.col("end_ms").alias("hit"), none.cast(_ASKED).alias("x"))
    marks = united(marks, spans.select("media_id", F.col("end_ms").alias("at"), none.cast("long").alias("hit"), own.alias("x")))
    w = Window.partitionBy("media_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("hit", F.min("hit").over(w)).where("x IS NOT NULL")
    return rows.select("media_id", "x.id", F.col("x.s").alias("start_ms"), F.col("at").alias("end_ms"), "hit", F.col("x.most").alias("most_ms"))


def complete_topics(spans: DataFrame, ends: DataFrame, extend_ms: int = TOPIC_MS, max_ms: int = MAX_MS) -> DataFrame:
    """Spans run on to the end of their topic, where that is near enough and not too long: `max_ms`, or the span's own `most_ms`."""
    near = (F.col("hit") - F.col("end_ms") <= extend_ms) & (F.col("hit") - F.col("start_ms") <= F.coalesce("most_ms", F.lit(float(max_ms))))
    return _next_end(spans, ends).select("media_id", "id", "start_ms", F.when(near, F.col("hit")).otherwise(F.col("end_ms")).alias("end_ms"))


def complete_reveals(spans: DataFrame, sentences: DataFrame, reveal: Column, window_ms: int = REVEAL_MS, max_ms: int = MAX_MS) -> DataFrame:
    """Spans run on through a reveal that starts soon after their end, and the sentence behind it if that still fits."""
    w = Window.partitionBy("media_id").orderBy("sent_id")
    shown = sentences.select("media_id", reveal.alias("reveal"), "start_ms", "end_ms", F.lead("end_ms").over(w).alias("more")).where("reveal")
    marks = shown.select("media_id", F.col("start_ms").alias("at"), F.struct("start_ms", F.col("end_ms").alias("e"), "more").alias("hit"), F.lit(None).cast(_ASKED).alias("x"))
    marks = united(marks, spans.select("media_id", F.col("end_ms").alias("at"), F.lit(None).cast(marks.schema["hit"].dataType).alias("hit"), _asked(spans).alias("x")))
    onward = Window.partitionBy("media_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("hit", F.min("hit").over(onward)).where("x IS NOT NULL")
    s, e, h, most = F.col("x.s"), F.col("at"), F.col("hit"), F.coalesce("x.most", F.lit(float(max_ms)))
    fits = (h["start_ms"] - e <= window_ms) & (h["e"] - s <= most) & (h["e"] > e)
    return rows.select("media_id", "x.id", s.alias("start_ms"), F.when(fits & (h["more"] - s <= most), h["more"]).when(fits, h["e"]).otherwise(e).alias("end_ms"))


def setups(sentences: DataFrame, targets: DataFrame, lists: dict, lookback_ms: int = CONTEXT_MS, max_ms: int = SETUP_MS, min_ms: int = SETUP_LEAST_MS) -> DataFrame:
    """For targets (media_id, id, t_ms) that open by referring back: the passage (s, e) shortly before that says to what."""
    w = Window.partitionBy("media_id").orderBy("sent_id")
    opening = F.concat_ws(" ", "text", F.lead("text").over(w))
    # the first sentence that ends after the target opens the clip; what it refers to is told of these alone
    marks = sentences.select("media_id", F.col("end_ms").alias("at"), F.struct("end_ms", "sent_id", opening.alias("text")).alias("x"), F.lit(None).cast("long").alias("id"))
    marks = united(marks, targets.select("media_id", F.col("t_ms").alias("at"), F.lit(None).cast(marks.schema["x"].dataType).alias("x"), F.col("id").cast("long")))
    after = Window.partitionBy("media_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    asked = marks.withColumn("x", F.min("x").over(after)).where("id IS NOT NULL AND x IS NOT NULL")
    told = F.explode(F.array(dangling(F.col("x.text"), lists)))  # a column of its own row, else the filter behind it would tell it a second time
    asked = asked.select("media_id", "id", F.col("at").alias("t_ms"), told.alias("ref")).where("ref IS NOT NULL").select("media_id", "id", "t_ms", "ref.term")
    bucket = lambda c: F.floor(c / lookback_ms)
    asked = asked.withColumn("bucket", F.explode(F.array(bucket(F.col("t_ms")), bucket(F.col("t_ms")) - 1)))
    near = sentences.select("media_id", "sent_id", "start_ms", "end_ms", "text", bucket(F.col("start_ms")).alias("bucket"))
    pairs = asked.join(near, ["media_id", "bucket"]).where((F.col("end_ms") <= F.col("t_ms") + 10) & (F.col("start_ms") >= F.col("t_ms") - lookback_ms))
    named = (F.col("term") != "") & C.mentions(F.col("text"), F.col("term"))
    rows = pairs.groupBy("media_id", "id", "t_ms").agg(F.array_sort(F.collect_list(F.struct("sent_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), named.alias("named")))).alias("b"))
    said = F.filter(F.transform("b", lambda x, i: F.when(x["named"], i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.coalesce(F.array_max(said), F.size("b") - 1)).withColumn("s", F.get("b", "at")["s"])
    onward = F.slice("b", F.col("at") + 1, F.size("b"))
    enough = F.get(F.filter(onward, lambda x: x["e"] - F.col("s") >= min_ms + 1000), F.lit(0))["e"]
    rows = rows.withColumn("e", F.coalesce(enough, F.element_at("b", F.lit(-1))["e"])).withColumn("s", F.greatest(F.col("s"), F.col("e") - max_ms))
    return rows.where(F.col("e") - F.col("s") >= min_ms).select("media_id", "id", "s", F.least("e", "t_ms").alias("e"))


def clamp_index(value: Column, lo: Column, hi: Column, default: Column) -> Column:
    """A number, or text that holds one, as an index; halves go to the even side."""
    number = F.coalesce(F.bround(value.try_cast("double"), 0).cast("int"), default.cast("int"))
    return F.greatest(lo, F.least(hi, number))


def ceiling(high_ms: Column, max_ms: int = MAX_MS) -> Column:
    """The longest a clip of a length class may be."""
    return F.least(high_ms * (1 + TOLERANCE), F.lit(float(max_ms)))


def refine(rows: DataFrame, low_ms: int | Column = MIN_MS, high_ms: int | Column = MAX_MS, slack: int = PAYOFF_LINES) -> DataFrame:
    """Rows with `lines` (array of s and e, by time), d0 and d1 (the lines found by retrieval), start_line and end_line (what a model asks for):
    s_idx and e_idx kept near what was found, grown to the least length and cut back to the longest."""
    lines = F.col("lines")
    end = lambda i: F.get(lines, i)["e"]
    begin = lambda i: F.get(lines, i)["s"]
    last = F.size("lines") - 1
    rows = rows.withColumn("_lo", F.greatest(F.lit(0), F.least("d0", "d1") - slack)).withColumn("_hi", F.least(last, F.greatest("d0", "d1") + slack))
    within = F.size(F.filter(lines, lambda x: x["e"] <= begin(F.col("_lo")) + high_ms)) - 1  # ends ascend
    rows = rows.withColumn("_hi", F.greatest("_hi", F.least(last, within)))
    rows = rows.withColumn("_a", clamp_index(F.col("start_line"), F.col("_lo"), F.col("_hi"), F.col("d0"))).withColumn("_b", clamp_index(F.col("end_line"), F.col("_lo"), F.col("_hi"), F.col("d1")))
    rows = rows.withColumns({"s_idx": F.least("_a", "_b"), "e_idx": F.greatest("_a", "_b")})
    on = F.filter(F.sequence("e_idx", "_hi"), lambda i: end(i) - begin(F.col("s_idx")) >= low_ms)
    rows = rows.withColumn("e_idx", F.coalesce(F.array_min(on), "_hi"))
    back = F.filter(F.sequence("_lo", "s_idx"), lambda i: end(F.col("e_idx")) - begin(i) >= low_ms)
    rows = rows.withColumn("s_idx", F.coalesce(F.array_max(back), "_lo"))
    fit = F.filter(F.sequence("s_idx", "e_idx"), lambda i: end(i) - begin(F.col("s_idx")) <= high_ms)
    rows = rows.withColumn("e_idx", F.coalesce(F.array_max(fit), "s_idx"))
    return rows.withColumns({"s": begin(F.col("s_idx")), "e": end(F.col("e_idx"))}).drop("_lo", "_hi", "_a", "_b")


def model_setup(lines: Column, first: Column, last: Column, main_start: Column, max_ms: int = SETUP_MS, min_ms: int = 1000) -> Column:
    """struct(s, e) of the lines a model wants in front, cut off at the clip's start, their last part kept; null if too short or not asked for."""
    top, none = F.size(lines) - 1, F.lit(0)
    i, j = clamp_index(first, none, top, none), clamp_index(last, none, top, none)
    s, e = F.get(lines, F.least(i, j))["s"], F.least(F.get(lines, F.greatest(i, j))["e"], main_start)
    asked = first.isNotNull() & last.isNotNull() & (e - s >= min_ms)
    return F.when(asked, F.struct(F.greatest(s, e - max_ms).alias("s"), e.alias("e")))


def final_score(virality: Column, retrieval: Column) -> Column:
    """Three quarters the model's judgement, one quarter retrieval; retrieval alone where there is no judgement."""
    return F.coalesce(F.round(0.75 * virality + 25.0 * retrieval, 2), F.round(retrieval * 100, 2))


def upheld(verdict: Column, clip: Column) -> Column:
    """A critic's complaints that the clip's own measures (delay in ms or null, promise, reveal_near, filler in ms) bear out, sorted."""
    late = ~verdict["opens_on_hook"] & (clip["delay"].isNull() | (clip["delay"] > 2000))
    missing = ~verdict["contains_payoff"] & (clip["promise"] | clip["reveal_near"])
    filler = verdict["has_housekeeping"] & (clip["filler"] >= 1000)
    return F.array_compact(F.array(F.when(missing, F.lit("contains_payoff")), F.when(filler, F.lit("has_housekeeping")), F.when(late, F.lit("opens_on_hook"))))


def improves(before: Column, after: Column) -> Column:
    """A recut that wins on hook, promise or filler and loses on none. Delays are null where the hook is outside."""
    had, has = before["delay"].isNotNull(), after["delay"].isNotNull()
    later, less = F.coalesce(after["delay"] - before["delay"], F.lit(0)), after["filler"] - before["filler"]
    loses = (had & ~has) | (after["promise"] & ~before["promise"]) | (less > 500) | (later > 1000)
    wins = (has & ~had) | (later < -1000) | (before["promise"] & ~after["promise"]) | (less < -500)
    return ~loses & wins


def adopted(complaints: Column, before: Column, after: Column, proposed_ms: Column, total_ms: Column, overlap: Column, min_ms: int = MIN_MS, max_ms: int = MAX_MS) -> Column:
    """Is a critic's recut taken: a complaint stands, the proposal is a clip of legal length, mostly free of exclusions, and better."""
    return (F.size(complaints) > 0) & (proposed_ms >= min_ms / 2) & total_ms.between(min_ms, max_ms) & (overlap < 0.25) & improves(before, after)
