"""A candidate from its lines to a scored clip, the measures of a clip, and the review that may recut it.

Every step is a DataFrame of spans (media_id, id, ...) that meets words, sentences or exclusions by the joins of the other modules. Models are
handed in (`models.json_replies`); what they say is written down once, so nothing is asked twice. A candidate without lines, or
whose model gives no JSON object, keeps its place and the score that retrieval gave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import composing, intervals, models, narrative
from spanloom.sources import store

BEFORE_MS, AFTER_MS, CLEAR_MS, MOST_EXCLUDED = 60_000, 90_000, 2000, 0.25
ASK = "Grade this excerpt as a short clip of {low} to {high} seconds; lines marked > are the moment that was found. Reply with a JSON object with start_line, end_line, setup_start_line, setup_end_line, hook, hook_line, title, summary, reason, tags, virality_score, hook_strength, emotional_impact, standalone_clarity and shareability.\n\n"
INSIST = "\n\nReply with the JSON object and nothing else."
LINE = "array<struct<s:bigint,e:bigint,n:int,text:string>>"
GRADES = ("hook_strength", "emotional_impact", "standalone_clarity", "shareability")


def lines_of(spans: DataFrame, sentences: DataFrame, before_ms: int = BEFORE_MS, after_ms: int | Column = AFTER_MS) -> DataFrame:
    """Spans with `lines`: the numbered sentences around them, an array as long as a span and its surroundings."""
    around = spans.select("media_id", "id", (F.col("start_ms") - before_ms).cast("long").alias("start_ms"), (F.col("end_ms") + after_ms).cast("long").alias("end_ms"))
    item = F.struct(F.col("r.start_ms").cast("long").alias("s"), F.col("r.end_ms").cast("long").alias("e"), F.col("r.text").alias("text"))
    lists = intervals.overlapping(around, sentences.select("media_id", "start_ms", "end_ms", "text")).groupBy("l.media_id", "l.id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    numbered = F.transform("x", lambda v, i: F.struct(v["s"].alias("s"), v["e"].alias("e"), i.cast("int").alias("n"), v["text"].alias("text"))).cast(LINE)
    return spans.join(lists, ["media_id", "id"], "left").withColumn("lines", F.coalesce(numbered, F.array().cast(LINE))).drop("x")


def prompt_lines(lines: Column, first: Column, last: Column) -> Column:
    """Lines as a model reads them, one a row, those from first to last marked."""
    # a tenth of a second is put together from its digits, as a formatter a number took most of a prompt's time
    tenths = lambda ms: F.floor((ms + 50) / 100)
    digits = lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("s"))
    second = lambda ms: F.when(ms >= 0, digits(tenths(ms))).otherwise(F.format_string("%.1fs", (tenths(ms) / 10).cast("double")))
    line = lambda v, own: F.concat(F.when(v["n"].between(own["first"], own["last"]), ">").otherwise(" "), F.lit("["), v["n"].cast("string"), F.lit("] ("), second(v["s"]), F.lit("–"), second(v["e"]), F.lit(") "), F.coalesce(v["text"], F.lit("")))
    # first and last go along as values, in the lambda every line would find them again
    own = F.array_repeat(F.struct(first.alias("first"), last.alias("last")), F.size(lines))
    return F.array_join(F.zip_with(lines, own, line), "\n")


def as_text(value: Column) -> Column:
    """A value as trimmed text, empty for none."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def message_text(content: Column) -> Column:
    """A message as text: a JSON string or array of blocks (strings, or objects with `text`) joined, anything else as it stands."""
    v = F.try_parse_json(content)
    blocks = F.from_json(content, "array<string>")
    block = lambda b: F.when(b.startswith("{"), F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(F.coalesce(b, F.lit("")))
    joined = F.array_join(F.transform(blocks, block), "")
    return F.coalesce(F.when(F.trim(content).startswith("["), joined), F.when(F.trim(content).startswith('"'), F.try_variant_get(v, "$", "string")), content, F.lit(""))


def full_text(sentences: DataFrame, order: str = "sent_id") -> DataFrame:
    """(media_id, text): a medium's sentences in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return sentences.groupBy("media_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def excluded_seconds(excluded: DataFrame) -> DataFrame:
    """(media_id, seconds) of what must not become a clip."""
    return excluded.groupBy("media_id").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 1).alias("seconds"))


def covered_text(lines: Column, spans: Column) -> Column:
    """Text of the lines that any span of an array touches."""
    touched = F.filter(lines, lambda v: F.exists(spans, lambda p: (v["e"] > p["s"]) & (v["s"] < p["e"])))
    return F.array_join(F.transform(touched, lambda v: v["text"]), " ")


def clear_of(spans: DataFrame, excluded: DataFrame, least_ms: int = CLEAR_MS) -> DataFrame:
    """Spans (media_id, id, start_ms, end_ms) trimmed clear of exclusions; one that would vanish stays as it was."""
    cleared = intervals.clamp_outside(spans, excluded, least_ms).select("media_id", "id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    rows = spans.join(cleared, ["media_id", "id"], "left")
    return rows.select("media_id", "id", F.coalesce("_s", "start_ms").alias("start_ms"), F.coalesce("_e", "end_ms").alias("end_ms"))


def finish_thought(spans: DataFrame, topic_ends: DataFrame, excluded: DataFrame, max_ms: int = narrative.MAX_MS) -> DataFrame:
    """Spans run on to the end of their topic, then clear of exclusions."""
    return clear_of(narrative.complete_topics(spans, topic_ends, max_ms=max_ms), excluded)


def fallback(rows: DataFrame, words: DataFrame, why: Column) -> DataFrame:
    """Records of candidates (media_id, id, start_ms, end_ms, text, retrieval_score) that retrieval alone scores: snapped, with a title and hook from their text."""
    spans = rows.select("media_id", "id", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"))
    near = composing.nearby(words, spans).withColumns({"s": F.col("start_ms"), "e": F.col("end_ms")})
    placed = composing.snap_within(near, "s", "e", composing.MIN_MS, composing.MAX_MS).select("media_id", "id", F.array(F.struct("s", "e")).cast(composing.SPANS).alias("spans"))
    none = lambda kind: F.lit(None).cast(kind)
    title = C.clean_title(F.substring("text", 1, 60))
    return rows.join(placed, ["media_id", "id"]).select(
        "media_id", "id", "spans", F.when(title == "", "Untitled clip").otherwise(title).alias("title"), F.substring("text", 1, 140).alias("hook"), F.lit("").alias("summary"),
        F.concat(F.lit("Retrieval-only score ("), why, F.lit(").")).alias("reason"), F.array().cast("array<string>").alias("tags"), "text",
        F.round(F.col("retrieval_score") * 100, 1).alias("virality"), none("struct<hook_strength:double,emotional_impact:double,standalone_clarity:double,shareability:double>").alias("breakdown"),
        narrative.final_score(none("double"), F.col("retrieval_score")).alias("final_score"), F.lit("retrieval").alias("scored_by"), none("string").alias("setup_source"), none("bigint").alias("hook_ms"),
    )


_written = store.dealt


def score_candidates(candidates: DataFrame, words: DataFrame, sentences: DataFrame, excluded: DataFrame, topic_ends: DataFrame, ask: Callable, reveal: Column, lists: dict, low_ms: int = composing.MIN_MS, high_ms: int = composing.MAX_MS) -> DataFrame:
    """Candidates (media_id, id, start_ms, end_ms, text, retrieval_score) as scored clips: lines for a model, its range refined, the hook anchored, the
    topic and a reveal completed, a setup found, the clip composed, the rest of its answer brought into limits. Candidates that bring low_ms and high_ms
    (`retrieval.length_classes`) are cut to these lengths and see lines as far ahead as their longest clip may reach."""
    key = ["media_id", "id"]
    classed = "high_ms" in candidates.columns
    limits = ["low_ms", "high_ms", "most_ms"]
    asked = candidates if classed else candidates.withColumns({"low_ms": F.lit(low_ms), "high_ms": F.lit(high_ms)})
    most = F.least(F.col("high_ms") * (1 + narrative.TOLERANCE), F.lit(float(composing.MAX_MS)))
    asked = asked.withColumn("most_ms", F.floor(most).cast("long")).select(*key, "start_ms", "end_ms", "text", "retrieval_score", *limits)
    rows = lines_of(asked, sentences, after_ms=F.greatest(F.lit(10_000), F.col("high_ms")) if classed else AFTER_MS)
    touched = F.filter("lines", lambda v: (v["e"] > F.col("start_ms")) & (v["s"] < F.col("end_ms")))
    touched = F.when(F.size(touched) > 0, touched).otherwise(F.col("lines"))
    rows = rows.withColumns({"d0": F.get(touched, F.lit(0))["n"], "d1": F.try_element_at(touched, F.lit(-1))["n"]})
    seconds = lambda c: F.floor(F.col(c) / 1000).cast("string")
    request = F.replace(F.replace(F.lit(ASK), F.lit("{low}"), seconds("low_ms")), F.lit("{high}"), seconds("high_ms"))
    prompt = F.concat(request, prompt_lines(F.col("lines"), F.col("d0"), F.col("d1")))
    rows = _written(rows.withColumn("reply", models.json_replies(F.when(F.size("lines") > 0, prompt), ask, INSIST)), "replies")
    said = rows.withColumn("j", C.json_object(F.col("reply")))
    value = lambda name: F.try_variant_get("j", f"$.{name}", "string")
    fields = ("start_line", "end_line", "setup_start_line", "setup_end_line", "hook", "hook_line", "title", "summary", "reason", "tags", "virality_score", *GRADES)
    good = said.where("j IS NOT NULL").withColumns({f"r_{n}": value(n) for n in fields}).drop("j")
    spans = narrative.refine(good.withColumns({"start_line": F.col("r_start_line"), "end_line": F.col("r_end_line")}), F.col("low_ms"), F.col("high_ms"))
    whole = F.col("e") > F.col("s")
    spans = spans.select(*key, "most_ms", F.when(whole, F.col("s")).otherwise(F.col("start_ms")).cast("long").alias("start_ms"), F.when(whole, F.col("e")).otherwise(F.col("end_ms")).cast("long").alias("end_ms"))
    # a hook is looked up among the candidate's own lines
    hooks = narrative.locate_own(good.select(*key, F.col("r_hook").alias("hook"), F.col("r_hook_line").alias("stated"), "lines"))
    hooks = _written(hooks.select(*key, F.col("start_ms").alias("hook_s"), F.col("end_ms").alias("hook_e"), F.col("score").alias("sure")), "hooks")
    at = narrative.anchored(F.col("start_ms"), F.col("end_ms"), F.col("hook_s"), F.col("hook_e"), F.col("sure"), F.col("most_ms"))
    spans = spans.join(hooks, key, "left").select(*key, "most_ms", at.alias("x")).select(*key, "most_ms", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))
    longest = good.select(*key, "most_ms")
    spans = finish_thought(spans, topic_ends, excluded).join(longest, key)
    spans = _written(clear_of(narrative.complete_reveals(spans, sentences, reveal), excluded), "spans")
    found = narrative.setups(sentences, spans.select(*key, F.col("start_ms").alias("t_ms")), lists).select(*key, F.col("s").alias("auto_s"), F.col("e").alias("auto_e"))
    rows = good.drop("start_ms", "end_ms").join(spans, key).join(found, key, "left").join(hooks.select(*key, F.col("hook_s").alias("hook_ms")), key, "left")
    rows = rows.withColumn("m", narrative.model_setup(F.col("lines"), F.col("r_setup_start_line"), F.col("r_setup_end_line"), F.col("start_ms")))
    rows = rows.withColumns({"setup_s": F.coalesce("m.s", "auto_s"), "setup_e": F.coalesce("m.e", "auto_e"), "setup_source": F.when(F.col("m").isNotNull(), "model").when(F.col("auto_s").isNotNull(), "auto")})
    rows = _written(rows.drop("m", "auto_s", "auto_e"), "graded")
    clips = composing.compose(words, rows.select(*key, "start_ms", "end_ms", "setup_s", "setup_e", F.col("low_ms").cast("double").alias("low_ms"), F.col("most_ms").cast("double").alias("high_ms")), excluded, low_ms)
    rows = rows.join(clips, key)
    text, title, virality = covered_text(F.col("lines"), F.col("spans")), C.clean_title(F.col("r_title")), C.clamp(F.col("r_virality_score"), 0, 100, 50)
    scored = rows.select(
        *key, "spans", F.when(title == "", "Untitled clip").otherwise(title).alias("title"), as_text(F.col("r_hook")).alias("hook"), as_text(F.col("r_summary")).alias("summary"), as_text(F.col("r_reason")).alias("reason"),
        C.tags(F.col("r_tags")).alias("tags"), F.when(text == "", F.col("text")).otherwise(text).alias("text"), virality.alias("virality"), F.struct(*(C.clamp(F.col(f"r_{g}"), 0, 10, 5).alias(g) for g in GRADES)).alias("breakdown"),
        narrative.final_score(virality, F.col("retrieval_score")).alias("final_score"), F.lit("model").alias("scored_by"), F.when(F.size("spans") > 1, F.col("setup_source")).alias("setup_source"), "hook_ms",
    )
    why = F.when(F.size("lines") == 0, "no transcript lines in range").otherwise("model did not return parseable JSON")
    left = said.where("j IS NULL").select(*key, "start_ms", "end_ms", "text", "retrieval_score", why.alias("why"))
    return intervals.united(scored, fallback(left, words, F.col("why")))


REVIEW = "Review this clip of lines {first} to {last}; its hook is said to be: {hook}. A clip has {low} to {high} seconds. Reply with a JSON object with opens_on_hook, contains_payoff, has_housekeeping (true or false), suggested_start_line, suggested_end_line and verdict, one short sentence.\n\n"


def review(clips: DataFrame, sentences: DataFrame, ask: Callable, low_ms: int = composing.MIN_MS, high_ms: int = composing.MAX_MS) -> DataFrame:
    """Reviews (media_id, id, reply) that a model gives of clips (media_id, id, spans, hook): the lines around a clip, its own marked. Null where the model fails, or a clip has no
    lines or spans."""
    key = ["media_id", "id"]
    rows = lines_of(_outer(clips).select(*key, "start_ms", "end_ms", "hook"), sentences)
    inside = F.filter("lines", lambda v: (v["e"] > F.col("start_ms")) & (v["s"] < F.col("end_ms")))
    rows = rows.withColumns({"d0": F.get(inside, F.lit(0))["n"], "d1": F.try_element_at(inside, F.lit(-1))["n"]})
    hook = F.when(as_text(F.col("hook")) == "", F.lit("(none given)")).otherwise(F.substring(as_text(F.col("hook")), 1, 200))
    request = F.lit(REVIEW.replace("{low}", str(low_ms // 1000)).replace("{high}", str(high_ms // 1000)))
    for name, value in (("first", F.col("d0").cast("string")), ("last", F.col("d1").cast("string")), ("hook", hook)):
        request = F.replace(request, F.lit("{" + name + "}"), value)
    prompt = F.concat(request, prompt_lines(F.col("lines"), F.col("d0"), F.col("d1")))
    return _written(rows.select(*key, models.replies(F.when(F.col("d0").isNotNull(), prompt), ask, 1).alias("reply")), "asked-reviews")


def _outer(clips: DataFrame) -> DataFrame:
    """Clips with the first start and last end of their spans, null without spans."""
    return clips.withColumns({"start_ms": F.get("spans", F.lit(0))["s"].cast("long"), "end_ms": F.try_element_at("spans", F.lit(-1))["e"].cast("long")})


def profile(clips: DataFrame, hooks: DataFrame, sentences: DataFrame, excluded: DataFrame, promise: Column, reveal: Column, window_ms: int = narrative.REVEAL_MS) -> DataFrame:
    """Measures of clips (media_id, id, spans) against their hooks (media_id, id, hook_s, hook_e; may be absent): delay in ms, null where the hook is
    outside; does it end on a promise; is a reveal near behind it; filler and length in ms."""
    key = ["media_id", "id"]
    rows = clips.where(F.size("spans") > 0).select(*key, "spans", F.col("spans")[0]["s"].alias("s"), F.element_at("spans", F.lit(-1))["e"].alias("e")).join(hooks.select(*key, "hook_s", "hook_e"), key, "left")
    inside = F.coalesce(F.exists("spans", lambda p: (p["s"] <= F.col("hook_s")) & (F.col("hook_e") <= p["e"] + 500)), F.lit(False))
    tail = composing.last_before(rows.select(*key, (F.col("e") + 500).alias("t_ms")), sentences.select("media_id", "end_ms", promise.alias("promise")), "promise")
    shown = sentences.where(reveal).select("media_id", F.col("start_ms").cast("double").alias("end_ms"))
    ahead = narrative._next_end(rows.select(*key, F.col("s").alias("start_ms"), F.col("e").alias("end_ms")), shown).select(*key, (F.col("hit") - F.col("end_ms") <= window_ms).alias("reveal_near"))
    one = rows.select(*key, F.explode("spans").alias("p")).select(*key, F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"))
    filler = intervals.overlapping(one, excluded.select("media_id", "start_ms", "end_ms")).groupBy("l.media_id", "l.id").agg(F.sum(F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")).alias("filler"))
    for part in (tail, ahead, filler):
        rows = rows.join(part, key, "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select(*key, F.when(inside, F.col("hook_s") - F.col("s")).cast("double").alias("delay"), no("promise"), no("reveal_near"), F.coalesce("filler", F.lit(0.0)).alias("filler"), composing.total(F.col("spans")).alias("length"))


def apply_critique(clips: DataFrame, reviews: DataFrame, words: DataFrame, sentences: DataFrame, excluded: DataFrame, promise: Column, reveal: Column, low_ms: int = composing.MIN_MS, high_ms: int = composing.MAX_MS) -> DataFrame:
    """Clips (media_id, id, spans, hook) after their reviews (media_id, id, reply): media_id, id, spans, upheld, applied. A review's range is taken where a
    complaint holds against the clip's own measures and the recut is a legal clip that measures better."""
    key = ["media_id", "id"]
    bounds = _outer(clips).select(*key, "start_ms", "end_ms", "spans", "hook")
    rows = lines_of(bounds, sentences).join(reviews.select(*key, C.json_object(F.col("reply")).alias("j")), key, "left")
    flag = lambda name, default: F.coalesce(F.try_variant_get("j", f"$.{name}", "boolean"), F.lit(default)).alias(name)
    index = lambda name: F.try_variant_get("j", f"$.{name}", "string")
    rows = rows.withColumns({"verdict": F.struct(flag("opens_on_hook", True), flag("contains_payoff", True), flag("has_housekeeping", False)), "a": index("suggested_start_line"), "b": index("suggested_end_line"), "reviewed": F.col("j").isNotNull() & (F.size("lines") > 0) & (F.size("spans") > 0)}).drop("j")
    rows = _written(rows, "reviews")
    hooks = narrative.locate_own(rows.select(*key, "hook", F.lit(None).cast("string").alias("stated"), "lines")).select(*key, F.col("start_ms").alias("hook_s"), F.col("end_ms").alias("hook_e"))
    hooks = _written(hooks, "hooks")
    measured = lambda of, name: profile(of, hooks, sentences, excluded, promise, reveal).select(*key, F.struct("delay", "promise", "reveal_near", "filler", "length").alias(name))
    rows = _written(rows.join(measured(rows, "before"), key, "left"), "measured")  # a clip without spans has no measures and stays as it is
    rows = rows.withColumn("upheld", F.when(F.col("reviewed"), narrative.upheld(F.col("verdict"), F.col("before"))).otherwise(F.array().cast("array<string>")))
    top, none = F.size("lines") - 1, F.lit(0)
    i, j = narrative.clamp_index(F.col("a"), none, top, none), narrative.clamp_index(F.col("b"), none, top, top)
    asked = rows.where(F.size("upheld") > 0).select(*key, F.get("lines", F.least(i, j))["s"].alias("start_ms"), F.get("lines", F.greatest(i, j))["e"].alias("end_ms"))
    wide = asked.where(F.col("end_ms") - F.col("start_ms") >= low_ms / 2).withColumns({"setup_s": F.lit(None).cast("long"), "setup_e": F.lit(None).cast("long")})
    recut = _written(composing.compose(words, wide, excluded, low_ms, high_ms), "recut")
    outer = _outer(recut).select(*key, "start_ms", "end_ms")
    free = intervals.overlap_fraction(outer, excluded.select("media_id", "start_ms", "end_ms")).select(*key, "fraction")
    trial = asked.select(*key, (F.col("end_ms") - F.col("start_ms")).alias("proposed")).join(recut.withColumnRenamed("spans", "again"), key).join(free, key).join(measured(recut, "after"), key)
    rows = rows.join(trial, key, "left")
    applied = F.coalesce(narrative.adopted(F.col("upheld"), F.col("before"), F.col("after"), F.col("proposed"), F.col("after.length"), F.col("fraction"), low_ms, high_ms), F.lit(False))
    return rows.select(*key, F.when(applied, F.col("again")).otherwise(F.col("spans")).alias("spans"), "upheld", applied.alias("applied"), "before")
