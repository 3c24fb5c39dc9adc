"""Where a frame is cropped: scores of its columns over sampled frames, the best window, the crop box, and shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import united

CENTRE_BIAS, SMOOTH_SHARE, LONG_SHOT_MS = 0.12, 0.06, 4000


def window_fraction(src_w: Column, src_h: Column, out_w: int, out_h: int) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), src_h * out_w / out_h / src_w))


def best_window(scores: DataFrame, fraction: float) -> DataFrame:
    """Column scores (frame, pos, score): centre of the window with the largest sum, less a penalty for leaving the middle; first wins."""
    per = Window.partitionBy("frame")
    rows = scores.withColumn("n", F.count(F.lit(1)).over(per))
    width = F.greatest(F.lit(1), F.bround(F.col("n") * fraction, 0).cast("int"))
    rows = rows.withColumn("width", width)
    running = F.sum("score").over(per.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", running)
    ends = rows.select("frame", (F.col("pos") - F.col("width") + 1).alias("at"), "n", "width", "upto")
    before = rows.select(F.col("frame").alias("f"), (F.col("pos") + 1).alias("p"), F.col("upto").alias("skip"))
    totals = ends.where("at >= 0").join(before, (F.col("frame") == F.col("f")) & (F.col("at") == F.col("p")), "left").select("frame", "at", "n", "width", (F.col("upto") - F.coalesce("skip", F.lit(0.0))).alias("total"))
    spread = F.max("total").over(Window.partitionBy("frame")) - F.min("total").over(Window.partitionBy("frame"))
    spread = F.when(spread == 0, 1.0).otherwise(spread)  # in a flat frame the middle wins
    centre = (F.col("at") + F.col("width") / 2) / F.col("n")
    rated = totals.select("frame", "at", "n", "width", F.round(F.col("total") - CENTRE_BIAS * spread * F.abs(centre - 0.5) * 2, 6).alias("rated"))
    best = rated.groupBy("frame").agg(F.max_by(F.struct("at", "n", "width"), F.struct("rated", -F.col("at"))).alias("b"))
    return best.select("frame", F.when(F.col("b.width") >= F.col("b.n"), 0.5).otherwise((F.col("b.at") + F.col("b.width") / 2) / F.col("b.n")).alias("centre"))


def shots(cuts: DataFrame, shortest: int = 1500) -> DataFrame:
    """Cut times (media_id, length_ms, cut_ms) to shots; a shot shorter than the least joins the one before it."""
    lists = cuts.groupBy("media_id").agg(F.max("length_ms").alias("length"), F.array_sort(F.collect_set(F.when((F.col("cut_ms") > 0) & (F.col("cut_ms") < F.col("length_ms")), F.col("cut_ms")))).alias("cuts"))
    # a piece opens a shot if it is long enough, the first always; a short first shot takes in the second
    edges = lists.select("media_id", F.concat(F.array(F.lit(0).cast("long")), F.col("cuts").cast("array<bigint>"), F.array(F.col("length").cast("long"))).alias("e"))
    opens = F.filter(F.slice("e", 1, F.size("e") - 1), lambda x, i: (i == 0) | (F.get("e", i + 1) - x >= shortest))
    rows = edges.select("media_id", "e", opens.alias("s"))
    rows = rows.withColumn("s", F.when((F.size("s") > 1) & (F.get("s", F.lit(1)) < shortest), F.concat(F.slice("s", 1, 1), F.slice("s", 3, F.size("s")))).otherwise(F.col("s")))
    nxt = F.coalesce(F.get("s", F.col("i") + 1), F.element_at("e", F.lit(-1)))
    return rows.select("media_id", "e", "s", F.posexplode("s").alias("i", "start_ms")).select("media_id", F.col("i").alias("shot"), "start_ms", nxt.alias("end_ms"))


def sample_times(spans: Column, count: int) -> Column:
    """Times of `count` samples, evenly spaced over the joined length of an array of spans (s, e), half a step off its ends."""
    kept = F.array_sort(F.filter(spans, lambda p: p["e"] > p["s"]))
    length = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, p: acc + (p["e"] - p["s"]))
    placed = F.transform(kept, lambda p, i: F.struct(length(F.slice(kept, F.lit(1), i)).alias("before"), p["s"].cast("double").alias("s"), p["e"].cast("double").alias("e")))

    def at(i):
        position = (i + 0.5) / count * length(kept)
        p = F.try_element_at(F.filter(placed, lambda q: q["before"] < position), F.lit(-1))
        return p["s"] + position - p["before"]

    return F.when(F.size(kept) > 0, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)).otherwise(F.array().cast("array<double>"))


def unit(values: Column) -> Column:
    """Values of an array scaled to 0 .. 1; all 0 where they are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(0.0))


def smooth(values: Column, window: Column) -> Column:
    """Mean over a window around each value, as if zeros stood beyond the ends; an even window reaches one further back."""
    behind, ahead = F.floor(window / 2).cast("int"), F.floor((window - 1) / 2).cast("int")

    def mean(_, i):
        first = F.greatest(F.lit(0), i - behind)
        part = F.slice(values, first + 1, F.least(F.size(values), i + ahead + 1) - first)
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / window

    return F.when(window <= 1, values).otherwise(F.transform(values, mean))


def column_scores(pixels: DataFrame) -> DataFrame:
    """Grey rows (clip, sample, y, row array) of sampled frames to (clip, scores, samples): how much each column changes downwards and from sample to
    sample, each scaled, halved and joined, then smoothed over a share of the width. An array is as long as a frame is wide."""
    width = pixels.groupBy("clip").agg(F.min(F.size("row")).alias("width"), F.countDistinct("sample").alias("samples"))
    down, onward = Window.partitionBy("clip", "sample").orderBy("y"), Window.partitionBy("clip", "y").orderBy("sample")
    change = lambda w: F.zip_with(F.lag("row").over(w), "row", lambda a, b: F.abs(b.cast("double") - a.cast("double")))
    rows = pixels.select("clip", change(down).alias("detail"), change(onward).alias("motion"))
    none = F.array().cast("array<double>")
    # a value's place in both arrays is its column
    both = rows.select("clip", F.posexplode(F.arrays_zip(F.coalesce("detail", none).alias("d"), F.coalesce("motion", none).alias("m"))).alias("x", "v"))
    sums = both.groupBy("clip", "x").agg(F.coalesce(F.sum("v.d"), F.lit(0.0)).alias("detail"), F.coalesce(F.sum("v.m"), F.lit(0.0)).alias("motion"))
    kept = width.join(sums, "clip", "left").where("x IS NULL OR x < width")
    # each row is scaled before they are gathered: arrays scaled inside arrays are worked out anew for every place once a filter on them is pushed down
    per = Window.partitionBy("clip")
    low, high = lambda c: F.min(c).over(per), lambda c: F.max(c).over(per)
    scaled = lambda c: F.when(high(c) > low(c), (F.col(c) - low(c)) / (high(c) - low(c))).otherwise(0.0)
    kept = kept.select("clip", "width", "samples", "x", (0.5 * scaled("detail") + 0.5 * scaled("motion")).alias("score"))
    scores = F.transform(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x", "score")))), lambda v: v["score"])
    lists = kept.groupBy("clip", "width", "samples").agg(scores.alias("raw"))
    window = F.greatest(F.lit(3), F.floor(F.col("width") * SMOOTH_SHARE).cast("int"))
    return lists.select("clip", smooth(F.col("raw"), window).alias("scores"), "samples")


def subject_x(pixels: DataFrame, fraction: float) -> DataFrame:
    """(clip, centre): one crop centre over all samples of a clip; none for a clip of fewer than two."""
    scored = column_scores(pixels).where("samples >= 2")
    rows = scored.select(F.col("clip").alias("frame"), F.posexplode("scores").alias("pos", "score"))
    return best_window(rows, fraction).withColumnRenamed("frame", "clip")


def crop_box(src_w: Column, src_h: Column, out_w: int, out_h: int, centre: Column) -> Column:
    """struct(width, height, x, y) in whole, even pixels of the crop that fills the output's shape; null where the source isn't wider than that."""
    wide = F.least(F.greatest(F.bround(src_h * F.lit(out_w) / out_h, 0).cast("int"), F.lit(2)), src_w)
    wide = wide - wide % 2
    x = F.bround(F.least(F.greatest(F.coalesce(centre, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)) * src_w - wide / 2, 0).cast("int")
    x = F.greatest(F.lit(0), F.least(x, src_w - wide))
    fits = (src_w > 0) & (src_h > 0) & (src_w / src_h > out_w / out_h + 1e-6)
    return F.when(fits, F.struct(wide.alias("width"), src_h.alias("height"), (x - x % 2).alias("x"), F.lit(0).alias("y")))


def refined_shots(track: DataFrame, speakers: DataFrame, long_ms: int = LONG_SHOT_MS) -> DataFrame:
    """A clip's shots (media_id, shot, start_ms, end_ms, x), the long ones cut by who speaks in them (media_id, shot, start_ms, end_ms, x; times from the
    shot's start) where that is known."""
    own = speakers.select("media_id", "shot", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("x").alias("_x"))
    long_ = track.where(F.col("end_ms") - F.col("start_ms") >= long_ms).join(own, ["media_id", "shot"])
    cut = long_.select("media_id", "shot", (F.col("start_ms") + F.col("_s")).alias("start_ms"), (F.col("start_ms") + F.col("_e")).alias("end_ms"), F.col("_x").alias("x"))
    return united(track.join(cut.select("media_id", "shot").distinct(), ["media_id", "shot"], "left_anti").select(*cut.columns), cut)


def cut_times(logs: DataFrame) -> DataFrame:
    """Scene cuts (media_id, cut_ms) from log text (media_id, log, length_ms), inside the clip, each once."""
    found = F.explode(F.regexp_extract_all("log", F.lit(r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    rows = logs.select("media_id", "length_ms", found.alias("t")).withColumn("cut_ms", F.round(F.col("t").cast("double") * 1000).cast("long"))
    return rows.where("cut_ms > 0 AND cut_ms < length_ms").select("media_id", "cut_ms").distinct()
