"""Registered queries on what is picked: suppression over large media, retrieval, the final clips, and times inside stitched clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import framing, intervals, narrative, retrieval, scoring, vector_index
from spanloom.plans.queries import _grid, _sentences, GRID, KNN, SENT, TX, query
from spanloom.plans.rules import SPREAD_SQL, WALK_SQL
from spanloom.sources import store, views

_SCORE = "(id * 7919 + media_id * 104729) % 1000"


@query(f"WITH RECURSIVE {SENT}, cand AS (SELECT media_id, sent_id AS id, start_ms AS s, end_ms + 6000 AS e, (sent_id * 7919 + media_id * 104729) % 1000 AS score FROM tx_sentences), {WALK_SQL.format(most=0.5)} SELECT * FROM stays")
def q_suppress(spark, sf_dir):
    """Every sentence, run on for six seconds, as a candidate; media of over 20 are settled as they go by."""
    rows = _sentences(spark, sf_dir).select("media_id", F.col("sent_id").alias("id"), "start_ms", (F.col("end_ms") + 6000).alias("end_ms")).withColumn("score", F.expr(_SCORE))
    return retrieval.suppress(rows, "score", 0.5, fold=20)


@query(
    f"""WITH RECURSIVE {KNN.format(k=6)}, m AS (SELECT id, max(relevance) AS relevance, count(*) AS match_count, round(0.75 * max(relevance) + 0.25 * least(count(*) / 4, 1), 4) AS retrieval_score FROM hits GROUP BY id),
    cand AS (SELECT CAST(label AS BIGINT) AS media_id, id, retrieval_score AS score, id * 20000 AS s, id * 20000 + 45000 AS e FROM m JOIN embeddings ON vec_id = id), {WALK_SQL.format(most=0.6)}
    SELECT media_id, id, rank, relevance, round(1 - relevance, 4) AS distance, match_count, retrieval_score, id * 20000 AS start_ms FROM stays JOIN m USING (id) WHERE rank <= 14"""
)
def q_retrieve(spark, sf_dir):
    """Vectors of a label as the chunks of a medium, asked by eight probes."""
    e = views.table(spark, sf_dir, "embeddings")
    corpus = e.where("vec_id >= 8").select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") * 20_000).alias("start_ms"), (F.col("vec_id") * 20_000 + 45_000).alias("end_ms"))
    found = retrieval.retrieve(corpus, e.where("vec_id < 8").select(F.col("vec_id").alias("probe"), "embedding"))
    return found.select("media_id", "id", "rank", "relevance", "distance", "match_count", "retrieval_score", "start_ms")


@query(
    f"""WITH RECURSIVE {TX}, {GRID}, made AS (SELECT media_id, id, (id * 7919 + media_id * 104729) % 1000 AS score, start_ms AS s, start_ms + 5000 + (id * 37 + media_id * 11) % 190 * 1000 AS e FROM grid),
    long_ AS (SELECT *, (e - s) / 1000.0 >= 14.5 AS fits, bool_or((e - s) / 1000.0 >= 14.5) OVER (PARTITION BY media_id) AS any_fits FROM made),
    cand AS (SELECT media_id, id, score, s, e FROM long_ WHERE fits OR NOT any_fits), {WALK_SQL.format(most=0.35)},
    clips AS (SELECT c.media_id, c.id, c.score, CAST((c.e - c.s) / 1000.0 AS DOUBLE) AS duration FROM cand c JOIN stays USING (media_id, id)), {SPREAD_SQL.replace('{{', '{').replace('}}', '}')} SELECT * FROM spread"""
)
def q_selected(spark, sf_dir):
    """Spans of five seconds to over three minutes, one begun every 40: the five of each medium that are shown."""
    g = _grid(views.words(spark, sf_dir)).withColumn("end_ms", F.col("start_ms") + 5000 + (F.col("id") * 37 + F.col("media_id") * 11) % 190 * 1000)
    clips = g.select("media_id", "id", "start_ms", "end_ms", F.expr(_SCORE).alias("score"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration"))
    return retrieval.select_clips(clips)


_ITEM = "SELECT l_orderkey AS media_id, l_linenumber AS t_id, min(l_partkey) AS p, min(l_suppkey) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(
    f"""WITH i AS ({_ITEM}), s AS (SELECT media_id, t_id * 20000 + p % 5000 AS s, t_id * 20000 + p % 5000 + 4000 + q % 9000 AS e FROM i), o AS (SELECT *, CAST(coalesce(sum(e - s) OVER (PARTITION BY media_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM s),
    t AS (SELECT media_id, t_id, p * 37 % 170000 AS t_ms FROM i),
    d AS (SELECT t.*, s, CASE WHEN t_ms BETWEEN s AND e THEN 0 WHEN t_ms < s THEN s - t_ms ELSE t_ms - e END AS d, CASE WHEN t_ms < s THEN o WHEN t_ms > e THEN o + e - s ELSE o + t_ms - s END AS m FROM t JOIN o USING (media_id))
    SELECT media_id, t_id, t_ms, arg_min(CASE WHEN d = 0 THEN m END, s) FILTER (d = 0) AS clip_ms, CAST(arg_min(m, [d, s]) AS BIGINT) AS clamped_ms FROM d GROUP BY ALL"""
)
def q_clip_times(spark, sf_dir):
    """An order's line items as the spans of a clip, and as times to find on it."""
    t = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("t_id")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"))
    start = F.col("t_id") * 20_000 + F.col("p") % 5000
    spans = t.select("media_id", start.alias("start_ms"), (start + 4000 + F.col("q") % 9000).alias("end_ms"))
    return intervals.clip_times(t.select("media_id", "t_id", (F.col("p") * 37 % 170_000).alias("t_ms")), spans)


@query(
    r"""SELECT doc_id, substring(regexp_replace(trim(trim(text, ' '), '"'' '), '\s+', ' ', 'g'), 1, 80) AS title, CASE WHEN n_chars // 3600 > 0 THEN printf('%d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) ELSE printf('%d:%02d', n_chars // 60, n_chars % 60) END AS length,
    array_to_string(list_filter(list_transform(string_split_regex(text, '[,;]'), lambda t: lower(regexp_replace(trim(t, ' '), '^#+', ''))), lambda t: t <> '')[1:5], '|') AS tags FROM (SELECT doc_id, n_chars, coalesce(text, '') AS text FROM documents)"""
)
def q_titles(spark, sf_dir):
    """A document's text as a model might give a title and tags, and its length as a time."""
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", C.clean_title(F.col("text")).alias("title"), C.short_time(F.col("n_chars")).alias("length"), F.array_join(C.tags(F.col("text")), "|").alias("tags"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type || '-' || user_id WHEN 2 THEN event_type || user_id WHEN 3 THEN '{"a": ' || user_id || '}' ELSE '' END AS message,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS text FROM events"""
)
def q_messages(spark, sf_dir):
    """Contents of a model's message, made from events: a JSON string, two kinds of blocks, an object, and none."""
    e, kind, user = views.table(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id").cast("string")
    block = lambda t: F.concat(F.lit('{"type": "text", "text": "'), t, F.lit('"}'))
    made = [
        F.concat(F.lit('"'), kind, F.lit('"')), F.concat(F.lit("["), block(F.concat(kind, F.lit("-"))), F.lit(", "), block(user), F.lit("]")),
        F.concat(F.lit('["'), kind, F.lit('", "'), user, F.lit('"]')), F.concat(F.lit('{"a": '), user, F.lit("}")), F.lit(None).cast("string"),
    ]
    content = F.get(F.array(*made), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", scoring.message_text(content).alias("message"), scoring.as_text(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("  "), kind, F.lit(" ")))).alias("text"))


@query(
    """SELECT event_id AS id, CASE WHEN asked AND least(e, t) - s >= 1000 THEN greatest(s, least(e, t) - 20000) END AS s, CASE WHEN asked AND least(e, t) - s >= 1000 THEN least(e, t) END AS e
    FROM (SELECT event_id, event_id % 4 <> 0 AS asked, least(a, b) * 3000 AS s, greatest(a, b) * 3000 + 2500 AS e, event_id % 31 * 1000 AS t
      FROM (SELECT event_id, greatest(0, least(9, event_id % 13 - 2)) AS a, greatest(0, least(9, event_id % 7)) AS b FROM events))"""
)
def q_model_setup(spark, sf_dir):
    """Ten lines, of which an event names two as the setup of what begins at its own time; a quarter names none."""
    e = views.table(spark, sf_dir, "events")
    n = F.col("event_id")
    lines = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 3000).cast("long").alias("s"), (i * 3000 + 2500).cast("long").alias("e")))
    asked = lambda c: F.when(n % 4 != 0, c.cast("string"))
    setup = narrative.model_setup(lines, asked(n % 13 - 2), asked(n % 7), (n % 31 * 1000).cast("long"))
    return e.select(n.alias("id"), setup.alias("m")).select("id", "m.s", "m.e")


@query(
    """WITH t AS (SELECT l_orderkey AS media_id, l_linenumber AS shot, min(l_partkey) % 8000 + 500 AS n, min(l_suppkey) AS k FROM lineitem GROUP BY ALL)
    SELECT media_id, shot, shot * 10000 AS start_ms, shot * 10000 + n AS end_ms, 0.5::DOUBLE AS x FROM t WHERE n < 4000 OR k % 3 = 0
    UNION ALL SELECT media_id, shot, shot * 10000, shot * 10000 + n // 2, 0.25 FROM t WHERE n >= 4000 AND k % 3 <> 0 UNION ALL SELECT media_id, shot, shot * 10000 + n // 2, shot * 10000 + n, 0.75 FROM t WHERE n >= 4000 AND k % 3 <> 0"""
)
def q_refined_shots(spark, sf_dir):
    """Line items as shots; in two of three two people speak, one in each half."""
    t = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("shot")).agg((F.min("l_partkey") % 8000 + 500).alias("n"), F.min("l_suppkey").alias("k"))
    start, half = F.col("shot") * 10_000, F.floor(F.col("n") / 2)
    turn = lambda s, e, x: F.struct(s.cast("long").alias("start_ms"), e.cast("long").alias("end_ms"), F.lit(x).alias("x"))
    speakers = t.where("k % 3 != 0").select("media_id", "shot", F.inline(F.array(turn(F.lit(0), half, 0.25), turn(half, F.col("n"), 0.75))))
    shots = t.select("media_id", "shot", start.cast("long").alias("start_ms"), (start + F.col("n")).cast("long").alias("end_ms"), F.lit(0.5).alias("x"))
    return framing.refined_shots(shots, speakers)


@query("SELECT p_partkey AS id, round(greatest(0.05, least(1.0, CAST(p_size * 20 + 50 AS DOUBLE) * 1080 / 1920 / (p_partkey % 1900 + 20))), 9) AS fraction FROM part")
def q_window_fraction(spark, sf_dir):
    """Parts as frames of many shapes: the share of the width that an upright crop takes."""
    p = views.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(framing.window_fraction(F.col("p_partkey") % 1900 + 20, (F.col("p_size") * 20 + 50).cast("double"), 1080, 1920), 9).alias("fraction"))


@query()
def q_index_search(spark, sf_dir):
    """Eight nearest vectors by an index of which a probe reads the nearest lists; `q_knn` is the exact way."""
    e = views.table(spark, sf_dir, "embeddings")
    folder = store.scratch(spark, "index")
    vector_index.build(e.where("vec_id >= 8").select(F.col("vec_id").alias("id"), "embedding"), folder)
    return vector_index.search(spark, folder, e.where("vec_id < 8").select(F.col("vec_id").alias("probe"), "embedding"))


@query("SELECT CAST(least(8, (SELECT count(*) FROM embeddings WHERE vec_id >= 8)) * (SELECT count(*) FROM embeddings WHERE vec_id < 8) AS BIGINT) AS wanted, true AS enough")
def q_index_recall(spark, sf_dir):
    """Of the exact hits, the index finds nine in ten at least."""
    from spanloom.plans.queries import Q

    found = vector_index.recall(q_index_search(spark, sf_dir), Q["q_knn"](spark, sf_dir))
    return found.select("wanted", (F.col("recall") >= 0.9).alias("enough"))
