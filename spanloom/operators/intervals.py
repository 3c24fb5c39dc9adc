"""Interval algebra on rows (media_id, start_ms, end_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.store import by_medium

BUCKET_MS = 60_000


def united(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both frames' rows. Spark 4.1 takes a union of two sides that are dealt alike for dealt by that key itself, but adaptive execution merges the partitions of each
    side as it sees fit, so windows and groups over such a union miss rows (seen here; a repartition by the key is optimised away for the same reason). The
    setting that turns this off is therefore set for the session, as every plan that holds such a union needs it when it runs."""
    left.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return left.unionByName(right)


def merge_touching(spans: DataFrame, slack_ms: int = 50) -> DataFrame:
    """Spans of a medium that overlap or lie within the slack become one."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where("end_ms > start_ms").withColumn("fresh", F.coalesce((F.col("start_ms") - reach > slack_ms).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("media_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def overlapping(left: DataFrame, right: DataFrame, bucket_ms: int = BUCKET_MS, by: tuple = ("media_id",), few: str = "l") -> DataFrame:
    """Pairs (l, r) of one medium (or whatever `by` names) that overlap, ends open. Both sides are cut by time buckets, so the join has equal keys and its
    work follows the overlaps; a pair is reported in the bucket in which its overlap begins. The medium of `l` is the join's own column, so that groups
    by it are known to lie together already. The side of which there are `few`, spans rather than words, is hashed where it lies: a merge would sort all words, and
    a broadcast, which Spark would take by the size of a file, would bring every span to the driver."""
    by_medium(left.sparkSession)
    buckets = F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.greatest(F.col("end_ms") - 1, F.col("start_ms"))) / bucket_ms)))
    a = left.select(F.struct(*left.columns).alias("l"), *by, buckets.alias("bucket"))
    b = right.select(F.struct(*right.columns).alias("r"), *by, buckets.alias("bucket"))
    a, b = (a.hint("shuffle_hash"), b) if few == "l" else (a, b.hint("shuffle_hash"))
    both = a.join(b, [*by, "bucket"]).where("l.end_ms > r.start_ms AND l.start_ms < r.end_ms")
    return both.where(F.floor(F.greatest("l.start_ms", "r.start_ms") / bucket_ms) == F.col("bucket")).select(F.struct(*(F.col(c) if c in by else F.col(f"l.{c}") for c in left.columns)).alias("l"), "r")


def overlap_fraction(spans: DataFrame, excluded: DataFrame) -> DataFrame:
    """Spans (media_id, id, start_ms, end_ms) with the share of their length under exclusions, counted once for each and capped at one."""
    shared = overlapping(spans, excluded).groupBy("l.media_id", "l.id").agg(F.sum(F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")).alias("covered_ms"))
    rows = spans.join(shared, ["media_id", "id"], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
    return rows.withColumn("fraction", F.least(F.lit(1.0), F.when(F.col("end_ms") > F.col("start_ms"), F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms"))).otherwise(F.lit(0.0))))


def mostly_outside(spans: DataFrame, excluded: DataFrame, most: float = 0.25) -> DataFrame:
    """Spans (media_id, id, start_ms, end_ms, ...) of which less than the share `most` lies under exclusions."""
    rows = overlap_fraction(spans, excluded)
    return rows.where(F.col("fraction") < most).drop("covered_ms", "fraction")


def keep_unless_empty(rows: DataFrame, flag: str) -> DataFrame:
    """Rows with the flag; all rows of a medium where none has it."""
    some = F.max(F.col(flag).cast("int")).over(Window.partitionBy("media_id"))
    return rows.withColumn("_some", some).where(F.col(flag) | (F.col("_some") == 0)).drop("_some")


def subtract(spans: DataFrame, excluded: DataFrame, min_piece_ms: int = 2000) -> DataFrame:
    """Pieces of each span (media_id, id, ...) outside the exclusions that are long enough."""
    piece = F.struct(F.col("r.start_ms").cast("long").alias("a"), F.col("r.end_ms").cast("long").alias("b"))
    held = overlapping(spans.select("media_id", "id", "start_ms", "end_ms"), merge_touching(excluded, 0)).groupBy("l.media_id", "l.id").agg(F.array_sort(F.collect_list(piece)).alias("x"))
    rows = spans.join(held, ["media_id", "id"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    starts = F.concat(F.array(F.col("start_ms").cast("long")), F.transform("x", lambda p: p["b"]))
    ends = F.concat(F.transform("x", lambda p: p["a"]), F.array(F.col("end_ms").cast("long")))
    left = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["e"] - p["s"] >= min_piece_ms)
    return rows.select("media_id", "id", F.explode(left).alias("p")).select("media_id", "id", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"))


def clamp_outside(spans: DataFrame, excluded: DataFrame, min_ms: int = 1000) -> DataFrame:
    """Each span trimmed clear of exclusions taken by start: one that begins inside it ends the span there, one that covers its start moves the start. Swallowed or too short spans are left out."""
    hits = overlapping(spans, excluded).groupBy("l.media_id", "l.id").agg(F.array_sort(F.collect_list(F.struct(F.col("r.start_ms").alias("a"), F.col("r.end_ms").alias("b")))).alias("ads"))
    rows = spans.join(hits, ["media_id", "id"], "left")
    begin = F.struct(F.col("start_ms").cast("long").alias("s"), F.col("end_ms").cast("long").alias("e"))

    def step(acc, ad):
        apart = acc["e"].isNull() | (ad["b"] <= acc["s"]) | (ad["a"] >= acc["e"])
        cut = F.when(acc["s"] < ad["a"], F.struct(acc["s"].alias("s"), ad["a"].alias("e"))).when(acc["e"] > ad["b"], F.struct(ad["b"].alias("s"), acc["e"].alias("e")))
        gone = F.struct(F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
        return F.when(apart, acc).otherwise(F.coalesce(cut, gone))

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    out = rows.select("media_id", "id", F.aggregate(F.coalesce("ads", none), begin, step).alias("x"))
    return out.where(F.col("x.e") - F.col("x.s") >= min_ms).select("media_id", "id", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))


def offsets(spans: DataFrame) -> DataFrame:
    """Ordered spans of a clip with the clip time at which each begins."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return spans.where("end_ms > start_ms").withColumn("ord", F.row_number().over(w)).withColumn("offset_ms", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(before), F.lit(0)))


def rebased(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (words or segments) inside the clip's spans, cut to them and moved onto the clip's time."""
    both = overlapping(rows, offsets(spans), few="r")
    at = lambda c: F.col("r.offset_ms") + c - F.col("r.start_ms")
    return both.select("l.*", at(F.greatest("l.start_ms", "r.start_ms")).alias("clip_start_ms"), at(F.least("l.end_ms", "r.end_ms")).alias("clip_end_ms"))


def clip_times(times: DataFrame, spans: DataFrame) -> DataFrame:
    """Source times (media_id, t_id, t_ms) on the time of their clip, whose spans (media_id, start_ms, end_ms) don't overlap: clip_ms, null outside the spans, and
    clamped_ms, which is moved to the nearest edge (the earlier of two, 0 without spans). One sorted pass carries the last span begun and, from the other side, the next one."""
    none = F.lit(None)
    span = F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("offset_ms").alias("o"))
    marks = offsets(spans).select("media_id", F.col("start_ms").alias("t_ms"), span.alias("span"), none.cast(times.schema["t_id"].dataType).alias("t_id"), F.lit(False).alias("asked"))
    asked = times.select("media_id", "t_ms", none.cast(marks.schema["span"].dataType).alias("span"), "t_id", F.lit(True).alias("asked"))
    rows = united(marks, asked)
    upto = Window.partitionBy("media_id").orderBy("t_ms").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("media_id").orderBy(F.desc("t_ms")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.select("media_id", "t_id", "t_ms", "asked", F.max("span").over(upto).alias("a"), F.min("span").over(after).alias("b")).where("asked")
    t = F.col("t_ms")
    inside = F.when(t <= F.col("a.e"), F.col("a.o") + t - F.col("a.s"))
    behind, ahead = F.col("a.o") + F.col("a.e") - F.col("a.s"), F.col("b.o")
    nearest = F.when(t - F.col("a.e") <= F.col("b.s") - t, behind).otherwise(F.coalesce(ahead, behind))
    return rows.select("media_id", "t_id", "t_ms", inside.alias("clip_ms"), F.coalesce(inside, nearest, F.lit(0).cast("long")).alias("clamped_ms"))
