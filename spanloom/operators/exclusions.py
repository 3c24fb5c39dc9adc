"""Sponsor passages and channel housekeeping on the word stream."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import lexicons as L
from spanloom.operators.intervals import merge_touching, united
from spanloom.operators.transcript import sentences

#: The edge of an ASCII word, as in the SQL; Java's own takes every letter for part of a word.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def brand_names(text: Column, templates: Sequence[str] = L.BRAND_TEMPLATES, domain: str = L.BRAND_DOMAIN, stoplist: Sequence[str] = L.BRAND_STOPLIST) -> Column:
    # without case, two more signs are forms of s and k
    cased = [t.replace(r"\w", r"[\wſ\u212a]") for t in templates]
    found = [F.regexp_extract_all(text, F.lit("(?iu)" + t), F.lit(1)) for t in cased] + [F.regexp_extract_all(text, F.lit(domain), F.lit(1))]
    bare = F.transform(F.flatten(F.array(*found)), lambda b: C.lowered(F.btrim(b, F.lit(".,'’\""))))
    return F.array_except(F.filter(bare, lambda b: F.length(b) >= 3), F.array(*map(F.lit, stoplist)))


def _mentions(rows: DataFrame, strong: Sequence[str], weak: Sequence[str] = (), ahead: int = 8, spread_ms: int = 150_000, spread_share: float = 0.35, **patterns) -> DataFrame:
    """Sentences with a strong marker or a name, one row for each name they hold (null: none): media_id, sent_id, start_ms, end_ms, seed, after (the next sentence), brand,
    said (the name is mentioned), named (it stands as a name does) and kept. Names come from sentences at most `ahead` after a strong marker; those whose mentions stay close
    together are kept. Everything is a window over a medium, so sentences are made and read once; most are left out before names meet their mentions."""
    w, whole = Window.partitionBy("media_id").orderBy("sent_id"), Window.partitionBy("media_id")
    after = F.lead(F.struct("sent_id", "end_ms", (C.contains_any(F.col("text"), weak) if weak else F.lit(False)).alias("weak"))).over(w)
    rows = rows.select("media_id", "sent_id", "start_ms", "end_ms", "text", C.contains_any(F.col("text"), strong).alias("seed"))
    rows = rows.select("*", after.alias("after"), F.max(F.col("seed").cast("int")).over(w.rowsBetween(-ahead, 0)).alias("near"))
    rows = rows.withColumn("found", F.when(F.col("near") == 1, brand_names(F.col("text"), **patterns)))
    total = F.max_by("end_ms", "sent_id").over(whole) - F.min_by("start_ms", "sent_id").over(whole)
    rows = rows.select("media_id", "sent_id", "start_ms", "end_ms", "text", "seed", "after", total.alias("total"), F.array_distinct(F.flatten(F.collect_list("found").over(whole))).alias("names"))
    rows = rows.withColumn("lowered", F.when(F.size("names") > 0, C.lowered(F.col("text"))))
    said = F.filter("names", lambda b: F.contains("lowered", b) & F.regexp_like("lowered", F.concat(F.lit(EDGE + "\\Q"), b, F.lit("\\E" + EDGE))))
    rows = rows.withColumn("mentions", said).where(F.col("seed") | (F.size("mentions") > 0))
    rows = rows.withColumn("stands", F.when(F.size("names") > 0, F.array_intersect(brand_names(F.col("text"), **patterns), "names")).otherwise(F.array().cast("array<string>")))
    rows = rows.select("media_id", "sent_id", "start_ms", "end_ms", "seed", "after", "total", "mentions", "stands", F.explode_outer(F.array_union("mentions", "stands")).alias("brand"))
    rows = rows.withColumns({"said": F.coalesce(F.array_contains("mentions", F.col("brand")), F.lit(False)), "named": F.coalesce(F.array_contains("stands", F.col("brand")), F.lit(False))})
    place, each = F.when(F.col("said"), F.col("sent_id")), Window.partitionBy("media_id", "brand")
    rows = rows.withColumn("spread", F.max_by("end_ms", place).over(each) - F.min_by("start_ms", place).over(each))
    # a share in decimals: 0.35 as a double is a little less, so mentions that reach just as far would go
    most = F.greatest(F.lit(Decimal(spread_ms)), F.col("total") * F.lit(Decimal(str(spread_share))))
    kept = F.coalesce(F.col("spread") <= most, F.lit(False))
    return rows.select("media_id", "sent_id", "start_ms", "end_ms", "seed", "after", "brand", "said", "named", kept.alias("kept"))


def find_brands(rows: DataFrame, strong: Sequence[str] = L.STRONG_MARKERS, ahead: int = 8, spread_ms: int = 150_000, spread_share: float = 0.35, **patterns) -> DataFrame:
    """(media_id, brand): names from sentences at most `ahead` after a strong marker, whose mentions stay close together."""
    return _mentions(rows, strong, (), ahead, spread_ms, spread_share, **patterns).where("kept AND said").select("media_id", "brand").distinct()


def sponsor_spans(rows: DataFrame, strong: Sequence[str] = L.STRONG_MARKERS, weak: Sequence[str] = L.WEAK_MARKERS, gap_ms: int = 30_000, min_ms: int = 6000, pad_ms: int = 0, **patterns) -> DataFrame:
    """Passages around sponsor sentences: media_id, start_ms, end_ms, n_sentences, brand."""
    of = lambda flag: F.min(F.when(F.col("kept") & F.col(flag), F.col("brand")))
    same = lambda c: F.first(c).alias(c)
    rated = _mentions(rows, strong, weak, **patterns).groupBy("media_id", "sent_id").agg(same("start_ms"), same("end_ms"), same("seed"), same("after"), of("said").alias("own"), of("named").alias("named"))
    w = Window.partitionBy("media_id").orderBy("sent_id")
    members = rated.where(F.col("seed") | F.col("own").isNotNull())
    apart = (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms).cast("int")
    members = members.withColumn("cluster", F.sum(F.coalesce(apart, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = members.groupBy("media_id", "cluster").agg(
        F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min("sent_id").alias("lo"), F.max("sent_id").alias("hi"), F.max("seed").alias("seeded"),
        F.max_by("after", "sent_id").alias("after"), F.min_by("own", F.when(F.col("own").isNotNull() & ~F.col("seed"), F.col("sent_id"))).alias("first_own"), F.min("named").alias("least_named"),
    ).where("seeded")
    more = F.coalesce(F.col("after.weak"), F.lit(False))
    end, last = F.when(more, F.col("after.end_ms")).otherwise(F.col("e")) + pad_ms, F.when(more, F.col("after.sent_id")).otherwise(F.col("hi"))
    out = found.select("media_id", (F.col("s") - pad_ms).alias("s"), end.alias("end_ms"), (last - F.col("lo") + 1).alias("n_sentences"), F.coalesce("first_own", "least_named").alias("brand"))
    return out.where(F.col("end_ms") - F.col("s") >= min_ms).select("media_id", F.greatest(F.col("s"), F.lit(0)).alias("start_ms"), "end_ms", "n_sentences", "brand")


def housekeeping_spans(words: DataFrame, markers: Sequence[str] = L.HOUSEKEEPING_MARKERS, longest_ms: int = 14_000, lookback_ms: int = 6000, breath_ms: int = 200, min_ms: int = 500, slack_ms: int = 250) -> DataFrame:
    """Channel asks at word level: from the clause that holds the marker to the end of its sentence, at most `longest_ms`."""
    w, key = Window.partitionBy("media_id").orderBy("w_idx"), ["media_id", "w_idx", "hit_ms", "sent_end"]
    ends = C.ends_sentence(F.col("word"))
    rows = words.select("media_id", "w_idx", "start_ms", "end_ms", F.lower(F.trim("word")).alias("token"), ends.alias("ends"), (ends | C.ends_clause(F.col("word"))).alias("breaks"))
    # a marker of n words is told by n words
    more = min(5, max((m.count(" ") for m in markers), default=0))
    rows = rows.select("*", F.concat_ws(" ", "token", *(F.lead("token", k).over(w) for k in range(1, more + 1))).alias("opening"), F.lead("start_ms").over(w).alias("next_ms"))
    said = reduce(or_, (F.startswith("opening", F.lit(m)) for m in markers), F.lit(False))
    breaks = F.col("breaks") | (F.col("next_ms") - F.col("end_ms") >= breath_ms)
    rows = rows.select("media_id", "w_idx", "start_ms", "end_ms", "ends", said.alias("hit"), F.when(breaks, F.col("next_ms")).alias("resume"))
    # the sentence a word lies in ends at the first terminator from it on; sorted from the end, that frame only grows
    from_end = Window.partitionBy("media_id").orderBy(F.desc("w_idx"))
    upto, all_of = from_end.rowsBetween(Window.unboundedPreceding, 0), from_end.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sent_end = F.coalesce(F.min(F.when(F.col("ends"), F.col("end_ms"))).over(upto), F.max("end_ms").over(all_of))
    next_hit = F.min(F.when(F.col("hit"), F.col("start_ms"))).over(from_end.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("media_id", "w_idx", "start_ms", "end_ms", "hit", "resume", sent_end.alias("sent_end"), next_hit.alias("next_hit"))
    # few words open with a marker; these and the words of their lookback, and no others, meet in time buckets
    bucket = lambda c: F.floor(F.col(c) / lookback_ms)
    near = F.coalesce(F.col("end_ms") >= F.col("next_hit") - lookback_ms, F.lit(False))
    at = lambda b, asks: F.struct(b.alias("bucket"), F.lit(asks).alias("asks"))
    places = F.concat(F.when(near, F.array(at(bucket("end_ms"), False))).otherwise(F.array()), F.when(F.col("hit"), F.array(at(bucket("start_ms"), True), at(bucket("start_ms") - 1, True))).otherwise(F.array()))
    rows = rows.where(F.col("hit") | near).select("*", F.inline(places))
    word, ask = F.struct("w_idx", "start_ms", "end_ms", "resume"), F.struct("w_idx", F.col("start_ms").alias("hit_ms"), "sent_end")
    met = rows.groupBy("media_id", "bucket").agg(F.collect_list(F.when(~F.col("asks"), word)).alias("b"), F.collect_list(F.when(F.col("asks"), ask)).alias("h")).select("media_id", "b", F.inline("h"))
    before = F.filter("b", lambda v: (v["w_idx"] < F.col("w_idx")) & (v["end_ms"] >= F.col("hit_ms") - lookback_ms))
    met = met.select(*key, before.alias("b")).select(*key, F.array_max(F.transform("b", lambda v: v["resume"])).alias("resume"), F.array_min(F.transform("b", lambda v: v["start_ms"])).alias("first"))
    spans = met.groupBy(*key).agg(F.max("resume").alias("resume"), F.min("first").alias("first")).withColumn("start_ms", F.coalesce("resume", "first", "hit_ms"))
    spans = spans.select("media_id", "start_ms", F.least(F.col("sent_end"), F.col("start_ms") + longest_ms).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    return merge_touching(spans, slack_ms)


def excluded_spans(words: DataFrame, sponsor: dict | None = None, housekeeping: dict | None = None) -> DataFrame:
    """Everything that must not become a clip, tagged by kind."""
    ads = sponsor_spans(sentences(words), **(sponsor or {})).select("media_id", "start_ms", "end_ms", F.lit("sponsor").alias("kind"), "brand")
    asks = housekeeping_spans(words, **(housekeeping or {})).select("media_id", "start_ms", "end_ms", F.lit("housekeeping").alias("kind"), F.lit(None).cast("string").alias("brand"))
    return united(ads, asks)
