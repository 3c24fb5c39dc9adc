"""Who is in the picture and who talks: faces grouped by place, mouth motion, and crop tracks that follow.

A fold whose next step depends on the last one (running means, turns) is an aggregate over a shot's sorted array; it is as long as the shot has
samples or faces. Everything else is windows and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME_X, CONFIDENCE, PRESENCE, MARGIN, HOLD_MS, WINDOW_MS, SPEECH_FRAMES, SHIFT = 0.08, 0.5, 0.3, 0.25, 1200, 2000, 3, 0.02
PEOPLE = "array<struct<x:double,n:int,times:array<bigint>>>"
TRACK = "array<struct<s:bigint,e:bigint,x:double>>"


def detected(frames: DataFrame, boxes: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Frames (shot, t_ms, name) with their faces (name, x, w, score) that are sure enough; a frame without keeps a null face."""
    sure = boxes.where(F.col("score") >= confidence).select("name", "x", "w")
    return frames.join(sure, "name", "left").select("shot", "t_ms", "x", "w")


def group_people(faces: DataFrame, same: float = SAME_X, presence: float = PRESENCE) -> DataFrame:
    """Faces (shot, t_ms, x, w) in order of time and place to people (shot, person, x, share): a face joins the first person near it and moves that
    person's place, the mean of its faces; people seen too seldom are left out."""
    centre = F.col("x") + F.col("w") / 2
    lists = faces.groupBy("shot").agg(F.countDistinct("t_ms").alias("frames"), F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("t_ms", centre.alias("c"))))).alias("faces"))

    def step(people, face):
        at = F.array_position(F.transform(people, lambda p: F.abs(p["x"] - face["c"]) <= same), True)
        new = F.struct(face["c"].alias("x"), F.lit(1).alias("n"), F.array(face["t_ms"]).alias("times"))

        def moved(p, i):
            times = F.array_union(p["times"], F.array(face["t_ms"]))
            n = F.size(times)
            return F.when(i + 1 == at, F.struct(((p["x"] * (n - 1) + face["c"]) / n).alias("x"), n.alias("n"), times.alias("times"))).otherwise(p)

        return F.when(at > 0, F.transform(people, moved)).otherwise(F.concat(people, F.array(new))).cast(PEOPLE)

    rows = lists.select("shot", "frames", F.aggregate("faces", F.array().cast(PEOPLE), step).alias("people"))
    often = F.filter("people", lambda p: p["n"] / F.col("frames") >= presence)
    placed = F.array_sort(F.transform(often, lambda p: F.struct(p["x"].alias("x"), (p["n"] / F.col("frames")).alias("share"))))
    return rows.select("shot", F.posexplode(placed).alias("person", "p")).select("shot", "person", "p.x", "p.share")


def motion(patches: DataFrame) -> DataFrame:
    """Patches (shot, person, region, t_ms, pixels): mean change against the patch before, over the brightness of that one."""
    w = Window.partitionBy("shot", "person", "region").orderBy("t_ms")
    pair = patches.select("shot", "person", "region", "t_ms", "pixels", F.lag("pixels").over(w).alias("before")).where("before IS NOT NULL")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(c)
    change = mean(F.zip_with("pixels", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    bright = mean(F.col("before"))
    return pair.select("shot", "person", "region", "t_ms", (change / F.when(bright == 0, 1.0).otherwise(bright)).alias("moved"))


def articulation(moved: DataFrame) -> DataFrame:
    """Mouth motion damped by head motion while words are spoken (shot, win, person, region, moved, speaking)."""
    over = lambda r: F.avg(F.when(F.col("speaking") & (F.col("region") == r), F.col("moved")))
    rows = moved.groupBy("shot", "win", "person").agg(over("mouth").alias("mouth"), F.coalesce(over("face"), F.lit(0.0)).alias("face"))
    return rows.where("mouth IS NOT NULL").select("shot", "win", "person", (F.col("mouth") / (1 + F.col("face"))).alias("score"))


def clear_speakers(scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Scores (shot, win, person, x, score): the best of each window, where it beats the next clearly."""
    w = Window.partitionBy("shot", "win").orderBy(F.desc("score"), "person")
    rows = scores.select("*", F.row_number().over(w).alias("rank"), F.lead("score").over(w).alias("next")).where("rank = 1 AND next IS NOT NULL AND score > 0")
    return rows.where(F.col("score") - F.greatest("next", F.lit(0.0)) >= margin * F.greatest(F.abs("next"), F.lit(1e-6))).select("shot", "win", "person", "x", "score")


def _one(s: Column, e: Column, x: Column) -> Column:
    return F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"), x.cast("double").alias("x"))


def _onto_last(acc: Column, entry: Column, joins) -> Column:
    """acc with its last entry stretched over `entry` if joins(last, entry), else with entry behind it."""
    last = F.get(acc, F.size(acc) - 1)
    longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_one(last["s"], entry["e"], last["x"])))
    return F.when((F.size(acc) > 0) & joins(last, entry), longer).otherwise(F.concat(acc, F.array(entry))).cast(TRACK)


def merge_same(track: Column, same: float = SAME_X) -> Column:
    """Neighbours that name the same place, by the first place of their run, as one."""
    return F.aggregate(track, F.array().cast(TRACK), lambda acc, t: _onto_last(acc, t, lambda last, x: F.abs(last["x"] - x["x"]) < same))


def speaker_track(turns: DataFrame, hold_ms: int = HOLD_MS) -> DataFrame:
    """Turns (shot, length_ms, start_ms, end_ms, x) to a track that covers the shot: same speakers merged, turns too short to hold given to the one before."""
    lists = turns.groupBy("shot").agg(F.max("length_ms").cast("bigint").alias("length"), F.array_sort(F.collect_list(_one(F.col("start_ms"), F.col("end_ms"), F.col("x")))).alias("t"))
    rows = lists.withColumn("t", merge_same(F.col("t")))
    brief = lambda t: t["e"] - t["s"] < hold_ms
    rows = rows.withColumn("t", F.aggregate("t", F.array().cast(TRACK), lambda acc, t: _onto_last(acc, t, lambda last, x: brief(x))))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    rows = rows.withColumn("t", F.when((F.size("t") > 1) & brief(first), F.concat(F.array(_one(first["s"], second["e"], second["x"])), F.slice("t", 3, F.size("t")))).otherwise(F.col("t")))
    rows = rows.withColumn("t", merge_same(F.col("t")))
    begin = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("t", i)["s"])
    cover = F.transform("t", lambda t, i: _one(begin(i), F.coalesce(F.get("t", i + 1)["s"], F.col("length")), t["x"]))
    return rows.select("shot", F.posexplode(cover).alias("turn", "p")).select("shot", "turn", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"), "p.x")


def crop_track(shots: DataFrame, shift: float = SHIFT) -> DataFrame:
    """Shots (media_id, shot, start_ms, end_ms, x) to one crop track a medium: a shot without a subject keeps the place before (the middle at first), and a
    move too small to matter isn't made."""
    lists = shots.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("shot", "start_ms", "end_ms", "x"))).alias("t"))

    def step(acc, t):
        x = F.coalesce(t["x"], F.get(acc, F.size(acc) - 1)["x"], F.lit(0.5))
        return _onto_last(acc, _one(t["start_ms"], t["end_ms"], x), lambda last, e: F.abs(e["x"] - last["x"]) < shift)

    return lists.select("media_id", F.aggregate("t", F.array().cast(TRACK), step).alias("track"))


def average_x(track: Column) -> Column:
    """Mean place, by duration; null for a track without any."""
    length = lambda t: F.greatest(t["e"] - t["s"], F.lit(0))
    weight = F.aggregate(track, F.lit(0.0), lambda s, t: s + length(t))
    return F.when(weight > 0, F.aggregate(track, F.lit(0.0), lambda s, t: s + length(t) * t["x"]) / weight)


def step_expression(track: Column, width: Column) -> Column:
    """The track as nested conditions on the time in seconds; each place is a whole pixel."""
    pixel = lambda t: F.floor(t["x"] * width).cast("string")
    whens = F.transform(F.slice(track, 2, F.size(track)), lambda t, i: F.concat(F.lit("if(lt(t,"), F.format_string("%.3f", (t["s"] / 1000).cast("double")), F.lit("),"), pixel(F.get(track, i)), F.lit(",")))
    return F.concat(F.array_join(whens, ""), pixel(F.element_at(track, F.lit(-1))), F.repeat(F.lit(")"), F.size(track) - 1))


def boxes(raw: DataFrame) -> DataFrame:
    """Raw detections (name, values, width, height; values: x, y, w, h, five landmarks as pairs, score) as shares of the frame."""
    v, w, h = (lambda i: F.get("values", F.lit(i)).cast("double")), F.col("width"), F.col("height")
    corner = lambda i: F.struct((v(i) / w).alias("x"), (v(i + 1) / h).alias("y"))
    return raw.where("width > 0 AND height > 0").select("name", (v(0) / w).alias("x"), (v(1) / h).alias("y"), (v(2) / w).alias("w"), (v(3) / h).alias("h"), F.array(corner(10), corner(12)).alias("mouth"), v(14).alias("score"))


def slices(shots: DataFrame, step_ms: int = WINDOW_MS) -> DataFrame:
    """Shots (shot, length_ms) in equal slices (shot, win, start_ms, end_ms), the last one as long as is left."""
    rows = shots.where("length_ms > 0").select("shot", "length_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length_ms") - 1) / step_ms))).alias("win"))
    return rows.select("shot", "win", (F.col("win") * step_ms).alias("start_ms"), F.least((F.col("win") + 1) * step_ms, "length_ms").alias("end_ms"))


def follow_speakers(shots: DataFrame, frames: DataFrame, moved: DataFrame, places: DataFrame, least_frames: int = 4, step_ms: int = WINDOW_MS, speech: int = SPEECH_FRAMES) -> DataFrame:
    """Who to follow in shots (shot, length_ms): frames (shot, t_ms, speaking), motion of regions (shot, person, region, t_ms, moved) and people's places (shot,
    person, x) to a track (shot, turn, start_ms, end_ms, x). Only slices with enough frames and enough of them with speech name a speaker, and only
    shots with frames enough and two people or more have a track."""
    wins = slices(shots, step_ms)
    number = F.floor(F.col("t_ms") / step_ms)
    both = F.when(F.col("t_ms") % step_ms == 0, F.array(number, number - 1)).otherwise(F.array(number))  # a frame on an edge is in both slices
    seen = frames.select("shot", "t_ms", "speaking", F.explode(both).alias("win")).join(wins, ["shot", "win"]).select("shot", "win", "t_ms", "speaking")
    enough = seen.groupBy("shot", "win").agg(F.count(F.lit(1)).alias("n"), F.count_if("speaking").alias("said")).where((F.col("n") >= 3) & (F.col("said") >= speech)).select("shot", "win")
    able = frames.groupBy("shot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_frames).join(places.groupBy("shot").agg(F.count(F.lit(1)).alias("p")).where("p >= 2"), "shot").select("shot")
    rated = articulation(moved.join(seen.join(enough, ["shot", "win"]).join(able, "shot"), ["shot", "t_ms"])).join(places, ["shot", "person"])
    turns = clear_speakers(rated.select("shot", "win", "person", "x", "score")).join(wins, ["shot", "win"]).join(shots, "shot")
    return speaker_track(turns.select("shot", "length_ms", "start_ms", "end_ms", "x"))
