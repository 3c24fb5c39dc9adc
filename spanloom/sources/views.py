"""Timed-transcript views over the driver tables. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.sources import store

WORD_MS = 350


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """A word stream per document: media_id, w_idx, word, start_ms, end_ms. Of ten words in a row one is followed by a pause of 200 ms and
    one by a pause of 600 ms, so a word's time follows from its place and no rows have to meet. Texts are dealt by medium before they are cut into words, so
    what follows by medium finds the words in place and only texts are shuffled; `kept` ones are dealt into a table, for plans of several jobs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), "text")
    parts = store.parts(spark, f"{sf_dir}/documents.parquet")
    docs = store.dealt(docs, "texts", parts=parts) if kept else docs.repartition(parts, "media_id")
    split = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    rows = docs.select("media_id", F.posexplode(split).alias("w_idx", "word"))
    after = lambda turn, ms: F.when(F.pmod((turn - 13 * F.col("media_id")) * 3, F.lit(10)) < F.col("w_idx") % 10, ms).otherwise(0)
    start = (F.col("w_idx") * WORD_MS + F.floor(F.col("w_idx") / 10) * 800 + after(8, 200) + after(9, 600)).cast("long")
    return rows.select("media_id", "w_idx", "word", start.alias("start_ms"), (start + WORD_MS).alias("end_ms"))


def segments_of_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Finished jobs from JSON files; files that don't parse are skipped."""
    schema = "id string, source string, status string, transcript array<struct<id:int,start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>>, clips array<struct<id:string,title:string,start:double,end:double,hook:string,spans:array<struct<start:double,end:double>>>>, stats struct<duration:double>, _corrupt_record string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


def media_probe(probes: DataFrame) -> DataFrame:
    """Probe documents (id, body) to typed rows: first video and audio stream, first duration that parses, frame rate."""
    stream = "struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,duration:string>"
    p = F.from_json("body", f"struct<streams:array<{stream}>,format:struct<duration:string,size:string>>")
    rows = probes.select("id", p.alias("p"))
    first = lambda kind: F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    rows = rows.select("id", "p", first("video").alias("v"), first("audio").alias("a"))
    rate = F.split("v.r_frame_rate", "/")
    top, bottom = rate[0].try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    return rows.select(
        "id",
        F.round(F.coalesce(*(F.col(c).try_cast("double") for c in ("p.format.duration", "v.duration", "a.duration")), F.lit(0.0)), 3).alias("duration"),
        F.col("v").isNotNull().alias("has_video"),
        F.col("a").isNotNull().alias("has_audio"),
        F.coalesce("v.width", F.lit(0)).alias("width"),
        F.coalesce("v.height", F.lit(0)).alias("height"),
        F.round(F.when(bottom != 0, top / bottom), 3).alias("fps"),
        F.col("v.codec_name").alias("video_codec"),
        F.coalesce(F.col("p.format.size").try_cast("long"), F.lit(0)).alias("size_bytes"),
    )


def usable(media: DataFrame) -> DataFrame:
    """Media that can be processed: with sound and of positive length."""
    return media.where("has_audio AND duration > 0")


def segments(raw: DataFrame) -> DataFrame:
    """A decoder's segments (media_id, id, start, end, text, words, duration; seconds) as they are kept: times to a thousandth, text trimmed, untimed words
    and segments without text left out, with the share of the medium that is done."""
    second = lambda c: F.round(c.cast("double"), 3)
    timed = F.filter(F.coalesce("words", F.array()), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    word = F.transform(timed, lambda w: F.struct(w["word"].alias("word"), second(w["start"]).alias("start"), second(w["end"]).alias("end"), F.round(F.coalesce(w["prob"].cast("double"), F.lit(0.0)), 4).alias("prob")))
    end = second(F.col("end"))
    rows = raw.select("media_id", "id", second(F.col("start")).alias("start"), end.alias("end"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), word.alias("words"), F.when(F.col("duration") > 0, F.least(end / F.col("duration"), F.lit(1.0))).alias("progress"))
    return rows.where("text <> ''")


def segment_words(rows: DataFrame, whole: bool = True) -> DataFrame:
    """Words in time order (media_id, w_idx, word, start_ms, end_ms) of segments (media_id, start, end, text, words). A segment without timed words is one word if
    `whole`, else it has none."""
    timed = F.filter(F.coalesce("words", F.array()), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    own = F.transform(timed, lambda w: F.struct(w["word"].alias("word"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end")))
    one = F.array(F.struct(F.col("text").alias("word"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))
    none = F.slice(one, 1, 0)
    said = F.when(F.size(own) > 0, own).when(F.lit(whole) & (F.coalesce("text", F.lit("")) != ""), one).otherwise(none)
    words = rows.select("media_id", F.posexplode(said).alias("_k", "w"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    order = Window.partitionBy("media_id").orderBy("w.start", "w.end", "_k")
    return words.select("media_id", (F.row_number().over(order) - 1).alias("w_idx"), F.trim("w.word").alias("word"), ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"))


def metadata(windows: DataFrame) -> DataFrame:
    """What is kept beside a window's vector: plain numbers."""
    second = lambda c: F.col(c) / 1000.0
    return windows.select("media_id", "w_index", second("start_ms").alias("start"), second("end_ms").alias("end"), ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration"), F.coalesce(F.col("n_words").cast("int"), F.lit(0)).alias("n_words"))


def as_spans(start: Column, end: Column, spans: Column) -> Column:
    """One pair or many as an array of spans (s, e) in order, inverted and incomplete ones left out."""
    item = lambda a, b: F.struct(a.cast("double").alias("s"), b.cast("double").alias("e"))
    many = F.transform(spans, lambda p: item(p["s"], p["e"]))
    return F.array_sort(F.filter(F.coalesce(many, F.array(item(start, end))), lambda p: p["e"] > p["s"]))
