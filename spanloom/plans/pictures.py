"""Registered queries on pictures, captions, spans as values, uploads and job lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import chunks, composing, framing, people
from spanloom.plans.queries import _events, query
from spanloom.sources import store, views


@query()
def q_caption_wrap(spark, sf_dir):
    """Documents wrapped to 24 characters."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    d = views.table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    lines = chunks.wrapped(F.col("words"), F.lit(24))
    rows = d.select("doc_id", lines.alias("l")).select("doc_id", F.posexplode_outer("l").alias("line", "x")).where("x IS NOT NULL")  # an inner one would run the pass twice
    return rows.select("doc_id", "line", F.col("x")[0].alias("first"), F.size("x").alias("n"))


@query(
    """WITH e AS (SELECT l_orderkey AS media_id, (l_linenumber * 1000 + l_partkey % 500) AS s, l_suppkey % 100 + 60 AS h FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, h) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM e)
    SELECT media_id, string_agg('[' || CASE WHEN i = 0 THEN 'in' ELSE 'cap' || (i - 1) END || '][' || (i + 1) || ':v]overlay=x=(W-w)/2:y=' || greatest(0, 1613 - h) || ':enable=''between(t,' || printf('%.3f', s / 1000) || ',' || printf('%.3f', (s + 900) / 1000) || ')''[' || CASE WHEN i + 1 = n THEN 'out' ELSE 'cap' || i END || ']', ';' ORDER BY i) AS chain
    FROM n GROUP BY media_id"""
)
def q_caption_windows(spark, sf_dir):
    """Line items of an order as caption pictures."""
    s = F.col("l_linenumber") * 1000 + F.col("l_partkey") % 500
    e = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), s.alias("start_ms"), (s + 900).alias("end_ms"), (F.col("l_suppkey") % 100 + 60).alias("height"))
    return chunks.enable_windows(e)


def faces(spark, sf_dir):
    """A vector as a shot of 64 frames: its components shake three faces about their places, and some are unsure."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shot"), F.posexplode("embedding").alias("f", "c"))
    e = e.select("shot", (F.col("f") * 200).cast("long").alias("t_ms"), F.concat_ws("-", "shot", "f").alias("name"), F.col("c").cast("double").alias("c"))
    shake = F.round(F.col("c") % 1 * 0.05, 4)
    boxes = F.explode(F.array(*[F.struct((F.lit(0.15 + 0.3 * k) + shake).alias("x"), F.lit(0.1).alias("w"), F.round(F.abs(F.sin(F.col("t_ms") * (k + 1))) + 0.2, 6).alias("score")) for k in range(3)]))
    return e.select("shot", "t_ms", "name"), e.select("name", boxes.alias("b")).select("name", "b.*")


@query()
def q_people(spark, sf_dir):
    return people.group_people(people.detected(*faces(spark, sf_dir))).withColumns({"x": F.round("x", 6), "share": F.round("share", 6)})


@query()
def q_speaker_track(spark, sf_dir):
    """Two people a shot, scored in windows of two seconds by a vector's components; the clear speakers become turns."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shot"), F.posexplode("embedding").alias("i", "c"))
    person = F.col("i") % 2
    scores = e.select("shot", F.floor(F.col("i") / 2).alias("win"), person.alias("person"), (F.lit(0.3) + person * 0.4).alias("x"), F.abs("c").cast("double").alias("score"))
    turns = people.clear_speakers(scores).select("shot", F.lit(64_000).alias("length_ms"), (F.col("win") * 2000).alias("start_ms"), (F.col("win") * 2000 + 2000).alias("end_ms"), "x")
    return people.speaker_track(turns)


@query(
    """WITH v AS (SELECT vec_id // 10 AS shot, vec_id % 10 * 200 AS t_ms, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS p FROM embeddings), w AS (SELECT *, lag(p) OVER (PARTITION BY shot ORDER BY t_ms) AS b FROM v)
    SELECT shot, t_ms, round(list_avg(list_transform(range(1, len(p) + 1), lambda i: abs(p[i] - b[i]))) / CASE WHEN list_avg(b) = 0 THEN 1 ELSE list_avg(b) END, 6) AS moved FROM w WHERE b IS NOT NULL"""
)
def q_mouth_motion(spark, sf_dir):
    """Vectors as patches of pixels, ten a shot."""
    e = views.table(spark, sf_dir, "embeddings")
    pixels = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = e.select(F.floor(F.col("vec_id") / 10).alias("shot"), F.lit(0).alias("person"), F.lit("mouth").alias("region"), (F.col("vec_id") % 10 * 200).alias("t_ms"), pixels.alias("pixels"))
    return people.motion(rows).select("shot", "t_ms", F.round("moved", 6).alias("moved"))


@query(
    """WITH v AS (SELECT vec_id // 10 AS shot, vec_id % 2 AS person, CASE WHEN vec_id % 3 = 0 THEN 'face' ELSE 'mouth' END AS region, vec_id % 5 <> 0 AS speaking, abs(CAST(embedding[1] AS DOUBLE)) AS m FROM embeddings)
    SELECT shot, person, round(avg(m) FILTER (speaking AND region = 'mouth') / (1 + coalesce(avg(m) FILTER (speaking AND region = 'face'), 0)), 6) AS score FROM v GROUP BY shot, person HAVING count(*) FILTER (speaking AND region = 'mouth') > 0"""
)
def q_articulation(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 10).alias("shot"), F.lit(0).alias("win"), (F.col("vec_id") % 2).alias("person"), F.when(F.col("vec_id") % 3 == 0, "face").otherwise("mouth").alias("region"), F.abs(F.col("embedding")[0].cast("double")).alias("moved"), (F.col("vec_id") % 5 != 0).alias("speaking"))
    return people.articulation(rows).select("shot", "person", F.round("score", 6).alias("score"))


@query()
def q_crop_track(spark, sf_dir):
    """Shots cut by an order's line items; every fifth has no subject."""
    cuts = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.lit(60_000).alias("length_ms"), (F.col("l_partkey") % 60_000).alias("cut_ms"))
    x = F.when((F.col("media_id") + F.col("shot")) % 5 != 0, (F.col("media_id") * 7 + F.col("shot") * 13) % 20 / 20.0)
    track = people.crop_track(framing.shots(cuts).withColumn("x", x))
    return track.select("media_id", F.size("track").alias("n"), F.round(people.average_x(F.col("track")) + 1e-9, 6).alias("average_x"), people.step_expression(F.col("track"), F.lit(1000)).alias("steps"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS suffix FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'com', 'example', 'test', 'org', 'htm', 'php') AND length(html) > 0".replace("\\\\", "\\"))
def q_uploads(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("length"))
    return store.uploads(p, ("html", "com", "example", "test", "org", "htm", "php")).select("page_id", "suffix")


_PAIRS = "l_orderkey AS clip, CAST(l_partkey % 300 AS DOUBLE) AS s, CAST(l_partkey % 300 + l_suppkey % 40 - 5 AS DOUBLE) AS e"


@query(f"SELECT clip, count(*) FILTER (e > s) AS n, coalesce(sum(e - s) FILTER (e > s), 0) AS total, min(s) FILTER (e > s) AS first FROM (SELECT {_PAIRS} FROM lineitem) GROUP BY clip")
def q_span_normalize(spark, sf_dir):
    """Pairs of numbers, some inverted, as a clip's sorted spans and their length."""
    t = views.table(spark, sf_dir, "lineitem").selectExpr(*_PAIRS.split(", ")[:1], "CAST(l_partkey % 300 AS DOUBLE) AS s", "CAST(l_partkey % 300 + l_suppkey % 40 - 5 AS DOUBLE) AS e")
    spans = F.array_sort(F.filter(F.collect_list(F.struct("s", "e")), lambda p: p["e"] > p["s"]))
    rows = t.groupBy("clip").agg(spans.alias("p"))
    return rows.select("clip", F.size("p").cast("long").alias("n"), composing.total(F.col("p")).alias("total"), F.get("p", F.lit(0))["s"].alias("first"))


_SPANS = [(10_000, 20_000), (30_000, 45_000), (60_000, 61_000)]


@query(
    """WITH p(i, s, e, o) AS (VALUES (0, 10000, 20000, 0), (1, 30000, 45000, 10000), (2, 60000, 61000, 25000)), t AS (SELECT event_id, event_id * 37 % 80000 AS t FROM events),
    d AS (SELECT event_id, t, i, s, e, o, CASE WHEN t BETWEEN s AND e THEN 0 WHEN t < s THEN s - t ELSE t - e END AS d, CASE WHEN t < s THEN o WHEN t > e THEN o + e - s ELSE o + t - s END AS m FROM t, p)
    SELECT event_id, min_by(CASE WHEN d = 0 THEN m END, i) FILTER (d = 0) AS clip_ms, CAST(arg_min(m, d * 10 + i) AS BIGINT) AS clamped_ms FROM d GROUP BY event_id"""
)
def q_clip_time(spark, sf_dir):
    """Source times on a clip's time: null outside its spans, or moved to the nearest edge."""
    before = [sum(e - s for s, e in _SPANS[:i]) for i in range(len(_SPANS))]
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e"), F.lit(o).cast("long").alias("o")) for i, ((s, e), o) in enumerate(zip(_SPANS, before))])
    rows = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 80_000).alias("t"))
    away = F.array_min(F.transform(spans, lambda p: F.struct(F.greatest(p["s"] - F.col("t"), F.col("t") - p["e"], F.lit(0)).alias("d"), p["i"].alias("i"), (p["o"] + F.least(F.greatest(F.col("t"), p["s"]), p["e"]) - p["s"]).alias("m"))))
    return rows.withColumn("x", away).select("event_id", F.when(F.col("x.d") == 0, F.col("x.m")).alias("clip_ms"), F.col("x.m").alias("clamped_ms"))


@query("SELECT user_id AS job, event_id AS seq, value FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def q_job_lookup(spark, sf_dir):
    """Everything of one job, found by its key."""
    e = _events(spark, sf_dir)
    first = e.agg(F.min("job").alias("job"))
    return e.join(F.broadcast(first), "job", "left_semi").select("job", "seq", "value")  # one row
