"""Registered queries on scored candidates, records, pictures as numbers, captions, saved jobs and late joiners."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import chunks, composing, exclusions, framing, intervals, jobs, people, replay, retrieval, scoring, transcript
from spanloom.plans.clips import _says, composed, staged
from spanloom.plans.queries import _events, _grid, _sentences, _vectors, ASK_SQL, ASKS, BRANDS, GRID, KNN, LISTS, OPENERS, CLOSERS, Q, SENT, SQL, STRONG, TX, WEAK, query
from spanloom.sources import store, views
from spanloom.streaming import live


def _candidates(ends):
    """Grid spans with the text of the sentence that begins at or before them, as retrieval hands them on."""
    g = _grid(ends).withColumns({"retrieval_score": (F.col("id") % 11) / 10.0, "text": F.concat(F.lit("span "), F.col("id").cast("string"))})
    return g.select("media_id", "id", "start_ms", "end_ms", "text", "retrieval_score")


def _judge():
    def ask(prompt):
        n = len(prompt)
        if n % 5 == 0:
            return "I would rather not."
        return f'{{"start_line": {n % 9}, "end_line": "{n % 9 + 6}", "hook": "of the", "title": "Take {n % 7}", "virality_score": {n % 120}, "tags": "a, b"}}'

    return ask


@query()
def q_candidate(spark, sf_dir):
    """Every candidate of the grid scored by a stub that at times gives no JSON."""
    words, sentences, asks, ends = staged(spark, sf_dir)
    topics = transcript.topic_ends(transcript.topic_gaps(sentences, OPENERS, CLOSERS))
    out = scoring.score_candidates(_candidates(ends), words, sentences, asks, topics, _judge, _says("in "), LISTS)
    return out.select("media_id", "id", F.size("spans").alias("n_spans"), F.col("spans")[0]["s"].cast("long").alias("start_ms"), F.element_at("spans", F.lit(-1))["e"].cast("long").alias("end_ms"), "title", "virality", "final_score", "scored_by", "setup_source")


def _reviewer(ends):
    g = _grid(ends).select("media_id", "id")
    fields = ['"opens_on_hook": false', '"contains_payoff": false', '"has_housekeeping": true']
    lines = F.concat(F.lit('", "suggested_start_line": '), (F.col("id") % 5).cast("string"), F.lit(', "suggested_end_line": '), (F.col("id") % 5 + 9).cast("string"), F.lit("}"))
    return g.withColumn("reply", F.concat(F.lit("{" + ", ".join(fields) + ', "verdict": "'), F.col("id").cast("string"), lines))


@query()
def q_candidate_classes(spark, sf_dir):
    """Candidates of each medium dealt over five length classes, scored within them, and the clips of it that are shown."""
    words, sentences, asks, ends = staged(spark, sf_dir)
    classed = store.dealt(retrieval.length_classes(_candidates(ends)), "classed")
    topics = transcript.topic_ends(transcript.topic_gaps(sentences, OPENERS, CLOSERS))
    out = scoring._written(scoring.score_candidates(classed, words, sentences, asks, topics, _judge, _says("in "), LISTS), "scored")
    span = F.col("spans")
    clips = out.select("media_id", "id", span[0]["s"].cast("long").alias("start_ms"), F.element_at(span, F.lit(-1))["e"].cast("long").alias("end_ms"), F.col("final_score").alias("score"), (composing.total(span) / 1000).alias("duration"))
    shown = retrieval.select_clips(clips).withColumnRenamed("rank", "shown")
    return clips.join(shown, ["media_id", "id"], "left")


@query()
def q_review(spark, sf_dir):
    """Composed clips under a review that complains of everything: what the clip's own measures bear out, and what is recut."""
    words, sentences, asks, ends, clips = composed(spark, sf_dir)
    clips = clips.withColumn("hook", F.lit("of the"))
    out = scoring.apply_critique(clips, _reviewer(ends), words, sentences, asks, _says("that "), _says("in "))
    return out.select("media_id", "id", F.concat_ws(",", "upheld").alias("upheld"), "applied", F.size("spans").alias("n_spans"), F.col("before.filler").cast("long").alias("filler_ms"))


@query()
def q_finish_thought(spark, sf_dir):
    words, sentences, asks, ends = staged(spark, sf_dir)
    return scoring.finish_thought(_grid(ends), transcript.topic_ends(transcript.topic_gaps(sentences, OPENERS, CLOSERS)), asks)


@query(f"WITH {SENT} SELECT media_id, string_agg(text, ' ' ORDER BY sent_id) AS text FROM tx_sentences GROUP BY media_id")
def q_full_text(spark, sf_dir):
    return scoring.full_text(_sentences(spark, sf_dir))


@query(f"WITH {SENT}, {ASK_SQL} SELECT media_id, round(sum(end_ms - start_ms) / 1000, 1) AS seconds FROM ask_spans GROUP BY media_id")
def q_excluded_seconds(spark, sf_dir):
    return scoring.excluded_seconds(exclusions.housekeeping_spans(views.words(spark, sf_dir), ASKS))


@query(f"WITH o AS ({SQL['q_overlap_fraction']}) SELECT media_id, id, id * 40000 AS start_ms, id * 40000 + 30000 AS end_ms FROM o WHERE covered_ms < 0.25 * 30000")
def q_mostly_outside(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return intervals.mostly_outside(_grid(w), exclusions.housekeeping_spans(w, ASKS))


@query(
    f"""WITH {SENT}, {GRID} SELECT g.media_id, g.id, string_agg((CASE WHEN s.start_ms < g.end_ms AND s.end_ms > g.start_ms THEN '>' ELSE ' ' END) || '[' || s.n || '] (' || printf('%.1f', (s.start_ms + 50) // 100 / 10) || 's–' || printf('%.1f', (s.end_ms + 50) // 100 / 10) || 's) ' || s.text, chr(10) ORDER BY s.n) AS prompt
    FROM grid g JOIN (SELECT g.media_id, g.id, s.*, row_number() OVER (PARTITION BY g.media_id, g.id ORDER BY s.start_ms, s.end_ms) - 1 AS n FROM grid g JOIN tx_sentences s ON g.media_id = s.media_id AND s.end_ms > g.start_ms AND s.start_ms < g.end_ms + 20000) s
      ON g.media_id = s.media_id AND g.id = s.id GROUP BY g.media_id, g.id""".replace("SELECT g.media_id, g.id, s.*, row_number", "SELECT g.media_id, g.id, s.start_ms, s.end_ms, s.text, row_number")
)
def q_prompt_lines(spark, sf_dir):
    """The numbered lines around a span, its own marked."""
    w = views.words(spark, sf_dir)
    rows = scoring.lines_of(_grid(w), transcript.sentences(w), 0, 20_000).where(F.size("lines") > 0)
    own = F.filter("lines", lambda v: (v["e"] > F.col("start_ms")) & (v["s"] < F.col("end_ms")))
    first, last = F.coalesce(F.get(own, F.lit(0))["n"], F.lit(0)), F.coalesce(F.try_element_at(own, F.lit(-1))["n"], F.lit(-1))
    return rows.select("media_id", "id", scoring.prompt_lines(F.col("lines"), first, last).alias("prompt"))


@query(f"WITH {TX}, {GRID} SELECT media_id, id AS w_index, start_ms / 1000.0::DOUBLE AS start, end_ms / 1000.0::DOUBLE AS \"end\", 30.0::DOUBLE AS duration, CAST(id % 7 AS INTEGER) AS n_words FROM grid")
def q_metadata(spark, sf_dir):
    return views.metadata(_grid(views.words(spark, sf_dir)).select("media_id", F.col("id").alias("w_index"), "start_ms", "end_ms", (F.col("id") % 7).alias("n_words")))


@query("SELECT conv_id AS media_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS w_idx, trim(text, ' ') AS word, turn * 1500 AS start_ms, turn * 1500 + 1250 AS end_ms FROM conversations WHERE trim(coalesce(text, ''), ' ') <> ''")
def q_segment_words(spark, sf_dir):
    """Turns as segments without word times: each becomes one word."""
    c = views.table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("array<struct<word:string,start:double,end:double,prob:double>>")
    raw = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("id"), (F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1.25).alias("end"), "text", none.alias("words"), F.lit(60.0).alias("duration"))
    return views.segment_words(views.segments(raw)).withColumn("w_idx", F.col("w_idx").cast("int"))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size + 100 AS w, p_partkey % 90 + 60 AS h, p_partkey % 11 / 10.0 AS c FROM part), q AS (SELECT *, least(greatest(CAST(round_even(h * 1080 / 1920, 0) AS INTEGER), 2), w) AS b FROM p WHERE w / h > 1080 / 1920 + 1e-6),
    r AS (SELECT *, b - b % 2 AS width FROM q), s AS (SELECT *, greatest(0, least(CAST(round_even(c * w - width / 2, 0) AS INTEGER), w - width)) AS x FROM r)
    SELECT id, CAST(width AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CAST(x - x % 2 AS INTEGER) AS x FROM s"""
)
def q_crop_box(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).cast("int").alias("w"), (F.col("p_partkey") % 90 + 60).cast("int").alias("h"), (F.col("p_partkey") % 11 / 10.0).alias("c"))
    rows = p.select("id", framing.crop_box(F.col("w"), F.col("h"), 1080, 1920, F.col("c")).alias("b")).where("b IS NOT NULL")
    return rows.select("id", "b.width", "b.height", "b.x")


@query("SELECT l_orderkey * 10 + l_linenumber AS shot, CAST(k AS BIGINT) AS win, k * 2000 AS start_ms, least((k + 1) * 2000, n) AS end_ms FROM (SELECT *, l_partkey % 9000 AS n, unnest(range((l_partkey % 9000 + 1999) // 2000)) AS k FROM lineitem)")
def q_slices(spark, sf_dir):
    t = views.table(spark, sf_dir, "lineitem")
    return people.slices(t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("shot"), (F.col("l_partkey") % 9000).alias("length_ms")))


@query("SELECT DISTINCT l_orderkey AS media_id, l_partkey % 60000 + l_linenumber AS cut_ms FROM lineitem WHERE l_partkey % 60000 + l_linenumber BETWEEN 1 AND 49999")
def q_cut_times(spark, sf_dir):
    """Cut times scraped from a log line for each order's item."""
    t = views.table(spark, sf_dir, "lineitem")
    log = F.concat(F.lit("[showinfo] n:1 pts_time:"), F.format_string("%.3f", ((F.col("l_partkey") % 60_000 + F.col("l_linenumber")) / 1000).cast("double")), F.lit(" fmt:yuv"))
    return framing.cut_times(t.select(F.col("l_orderkey").alias("media_id"), F.lit(50_000).alias("length_ms"), log.alias("log")))


@query("SELECT CAST(vec_id AS VARCHAR) AS name, CAST(embedding[1] AS DOUBLE) / 320 AS x, CAST(embedding[2] AS DOUBLE) / 180 AS y, CAST(embedding[3] AS DOUBLE) / 320 AS w, CAST(embedding[4] AS DOUBLE) / 180 AS h, CAST(embedding[13] AS DOUBLE) / 320 AS corner, CAST(embedding[15] AS DOUBLE) AS score FROM embeddings")
def q_boxes(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("values"), F.lit(320).alias("width"), F.lit(180).alias("height"))
    return people.boxes(e).select("name", "x", "y", "w", "h", F.col("mouth")[1]["x"].alias("corner"), "score")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v))) AS v FROM e)
    SELECT vec_id, CAST(i AS INTEGER) AS pos, round((CASE WHEN i >= 1 THEN v[i] ELSE 0 END + v[i + 1] + CASE WHEN i < 63 THEN v[i + 2] ELSE 0 END + CASE WHEN i >= 2 THEN v[i - 1] ELSE 0 END) / 4, 6) AS score FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM u)"""
)
def q_smooth(spark, sf_dir):
    """Vectors scaled to 0 .. 1, then smoothed over four places."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", framing.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return e.select("vec_id", F.posexplode(framing.smooth(F.col("v"), F.lit(4))).alias("pos", "score")).withColumn("score", F.round("score", 6))


@query()
def q_subject(spark, sf_dir):
    """Sixteen vectors as the rows of four frames of a clip: where its crop is centred."""
    e = views.table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    pixels = e.select(F.floor(n / 16).alias("clip"), (F.floor(n / 4) % 4).alias("sample"), (n % 4).alias("y"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("row"))
    return framing.subject_x(pixels, 0.3).withColumn("centre", F.round("centre", 6))


@query("WITH p AS (SELECT event_id, event_id % 9 AS n, value FROM events) SELECT event_id, CAST(i AS INTEGER) AS pos, round(CASE WHEN t <= 10 THEN 5 + t ELSE 40 + t - 10 END, 6) AS at FROM (SELECT event_id, i, (i + 0.5) / 6 * (10 + n + 1) AS t FROM (SELECT *, unnest(range(6)) AS i FROM p))")
def q_sample_times(spark, sf_dir):
    """Six samples over two spans, the second of a length of its own."""
    n = F.col("event_id") % 9
    spans = F.array(F.struct(F.lit(40.0).alias("s"), (n + 41).cast("double").alias("e")), F.struct(F.lit(5.0).alias("s"), F.lit(15.0).alias("e")))
    rows = views.table(spark, sf_dir, "events").select("event_id", F.posexplode(framing.sample_times(spans, 6)).alias("pos", "at"))
    return rows.withColumn("at", F.round("at", 6))


@query(
    """SELECT event_id AS id, round(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE (event_id % 6 + event_id % 128 / 128) / 6 END, 4) AS progress, round(event_id % 128 / 128, 4) AS stage_progress FROM events"""
)
def q_public_jobs(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    stage = F.get(F.array(*map(F.lit, jobs.STAGES)), (F.col("event_id") % 6).cast("int"))
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"), stage.alias("stage"), (F.col("event_id") % 128 / 128).alias("stage_progress"), F.lit("text").alias("transcript"))
    return jobs.public(rows).select("id", "progress", "stage_progress")


@query(f"WITH {KNN.format(k=50)} SELECT probe, rank, id, relevance, round(id * 20, 3)::DOUBLE AS start, round(id * 20 + 45, 3)::DOUBLE AS \"end\" FROM hits")
def q_search(spark, sf_dir):
    """More hits are asked for than are given out."""
    corpus, probes = _vectors(spark, sf_dir)
    return retrieval.search(corpus.withColumns({"start_ms": F.col("id") * 20_000, "end_ms": F.col("id") * 20_000 + 45_000}), probes, 80)


@query(
    """WITH h AS (SELECT user_id AS job, event_type AS kind, event_id AS seq, value FROM events), o AS (SELECT job, max(seq) FILTER (seq % 10 < 7) AS upto, min(seq) FILTER (seq % 10 < 7 AND kind = 'purchase') AS ended FROM h GROUP BY job),
    s AS (SELECT job, 'snapshot' AS part, max(seq) AS seq, kind, max_by(value, seq) AS value FROM h JOIN o USING (job) WHERE seq % 10 < 7 AND (ended IS NULL OR seq <= ended) GROUP BY job, kind),
    l AS (SELECT h.*, min(CASE WHEN kind = 'purchase' THEN seq END) OVER (PARTITION BY job) AS stop FROM h JOIN o USING (job) WHERE ended IS NULL AND (upto IS NULL OR seq > upto))
    SELECT * FROM s UNION ALL SELECT job, 'event', seq, kind, value FROM l WHERE stop IS NULL OR seq <= stop"""
)
def q_snapshot_tail(spark, sf_dir):
    """One who has seen seven events of ten of each job, then its tail, as it comes, up to a purchase."""
    history = _events(spark, sf_dir).drop("ts").where("seq % 10 < 7")
    stream = live.event_stream(spark, sf_dir, views.table(spark, sf_dir, "events").schema)
    events = stream.select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), "value")
    tail = live.drained(live.tail_stream(history, events, ("purchase",)), stateful=True)
    part = lambda rows, name: rows.select("job", F.lit(name).alias("part"), "seq", "kind", "value")
    return intervals.united(part(live.snapshot(history, ("purchase",)), "snapshot"), part(tail, "event"))


@query()
def q_caption_document(spark, sf_dir):
    """Captions of each medium's first two minutes as a subtitle document."""
    w = views.words(spark, sf_dir)
    clips = w.groupBy("media_id").agg(F.least(F.max("end_ms"), F.lit(120_000)).alias("length_ms"))
    slots = chunks.caption_events_of(w).where("start_ms < 120000")  # no clip is longer; what begins behind its end goes anyway, here before it is dealt
    events = chunks.caption_events(slots, clips)
    return chunks.ass_document(events, clips).select("media_id", F.length("document").alias("n_chars"), F.sha2("document", 256).alias("digest"))


@query()
def q_caption_collapse(spark, sf_dir):
    return chunks.collapsed_of(views.words(spark, sf_dir))


@query()
def q_windows_split(spark, sf_dir):
    found = Q["q_windows_chain"](spark, sf_dir).select("media_id", "w_index", "start_ms", "end_ms")
    return chunks.split_windows(found, views.words(spark, sf_dir))


@query()
def q_window_stream(spark, sf_dir):
    """Turns of conversations as they come, closed at the end of each."""
    c = views.table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    rows = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") * 12_000).alias("start_ms"), (F.col("turn") * 12_000 + 11_000).alias("end_ms"), F.lit(False).alias("final"))
    last = rows.groupBy("media_id").agg(F.max("seg_id").alias("seg_id"), F.max("end_ms").alias("end_ms"))
    rows = rows.unionByName(last.select("media_id", F.col("seg_id") + 1, F.lit(None).cast("string").alias("text"), F.col("end_ms").alias("start_ms"), "end_ms", F.lit(True).alias("final")).toDF("media_id", "seg_id", "text", "start_ms", "end_ms", "final"))
    folder = store.scratch(spark, "segments")
    rows.write.parquet(folder)
    return live.drained(live.window_stream(spark.readStream.schema(rows.schema).parquet(folder)), stateful=True)


@query()
def q_replay(spark, sf_dir):
    """Grid spans as the clips of saved jobs, cut again by the rules and reported."""
    w = views.words(spark, sf_dir)
    second = lambda c: F.col(c) / 1000.0
    said = transcript.sentences(w).select("media_id", "sent_id", second("start_ms").alias("start"), second("end_ms").alias("end"), "text")
    # the words of a sentence, by the same running count that makes sentences
    from pyspark.sql import Window

    before = Window.partitionBy("media_id").orderBy("w_idx").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.trim("word").rlike(r"[.!?…]$").cast("long")
    words = w.withColumn("sent_id", F.coalesce(F.sum(ended).over(before), F.lit(0))).groupBy("media_id", "sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w_idx", "word", second("start_ms").alias("start"), second("end_ms").alias("end")))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"))).alias("words"))
    item = F.struct(F.col("sent_id").cast("int").alias("id"), "start", "end", "text", "words")
    talks = said.join(words, ["media_id", "sent_id"]).groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("transcript"))
    clip = F.struct(F.col("id").cast("string").alias("id"), F.lit("clip").alias("title"), second("start_ms").alias("start"), second("end_ms").alias("end"), F.lit("of the").alias("hook"), F.lit(None).cast("array<struct<start:double,end:double>>").alias("spans"))
    clips = _grid(w).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", clip.alias("c")))).alias("c")).select("media_id", F.transform("c", lambda x: x["c"]).alias("clips"))
    saved = talks.join(clips, "media_id").withColumnRenamed("media_id", "id")
    graded = replay.replayed(saved, _says("that "), _says("in "), OPENERS, CLOSERS, {"strong": STRONG, "weak": WEAK, **BRANDS}, {"markers": ASKS})
    return graded.select("media_id", "id", "duration", "ends_on_sentence", "mid_word_cut", "excluded_overlap")


