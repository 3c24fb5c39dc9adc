"""Registered queries on clips: setups, hooks, refinement, scores, critique, composition and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import lexicons as L
from spanloom.operators import chunks, composing, exclusions, intervals, models, narrative, transcript
from spanloom.plans.queries import _CASES, _grid, _sentences, _sql_list, ASK_SQL, ASKS, GRID, LISTS, SENT, SQL, TX, query
from spanloom.sources import store, views

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"


def _says(marker: str):
    return C.contains_any(F.col("text"), [marker])


@query(
    f"""WITH {SENT}, o AS (SELECT *, text || coalesce(' ' || lead(text) OVER (PARTITION BY media_id ORDER BY sent_id), '') AS opening FROM tx_sentences),
    k AS (SELECT media_id, sent_id, start_ms, {_TOKENS.format('opening')} AS t, lower(trim(opening)) AS x FROM o),
    r AS (SELECT media_id, sent_id, start_ms, CASE WHEN {' OR '.join(f"starts_with(x, '{w}')" for w in L.BACKREFERENCES)} THEN 'backreference|' {_CASES} WHEN t[1] IN {_sql_list(L.DANGLING_PRONOUNS)} THEN 'pronoun|' END AS ref FROM k),
    a AS (SELECT media_id, sent_id, start_ms AS t, split_part(ref, '|', 2) AS term FROM r WHERE ref IS NOT NULL),
    p AS (SELECT a.media_id, a.sent_id, a.t, b.sent_id AS n, b.start_ms, b.end_ms, term <> '' AND list_has_any({_TOKENS.format('b.text')}, [term, term || 's', rtrim(term, 's')]) AS named
          FROM a JOIN tx_sentences b ON a.media_id = b.media_id AND b.end_ms <= a.t + 10 AND b.start_ms >= a.t - 60000),
    c AS (SELECT media_id, sent_id, coalesce(max(n) FILTER (named), max(n)) AS c FROM p GROUP BY ALL),
    s AS (SELECT p.*, c.c, max(CASE WHEN n = c.c THEN start_ms END) OVER (PARTITION BY p.media_id, p.sent_id) AS s FROM p JOIN c USING (media_id, sent_id)),
    e AS (SELECT media_id, sent_id, t, s, coalesce(min(end_ms) FILTER (n >= c AND end_ms - s >= 2500), max(end_ms)) AS e FROM s GROUP BY ALL)
    SELECT media_id, sent_id AS id, greatest(s, e - 20000) AS s, least(e, t) AS e FROM e WHERE e - greatest(s, e - 20000) >= 1500"""
)
def q_setup(spark, sf_dir):
    """A setup for every sentence taken as the opening of a clip."""
    s = _sentences(spark, sf_dir)
    return narrative.setups(s, s.select("media_id", F.col("sent_id").alias("id"), F.col("start_ms").alias("t_ms")), LISTS)


@query()
def q_hook(spark, sf_dir):
    """Each medium's third sentence, quoted in part, is looked up among its lines; the stated line is often wrong."""
    s = _sentences(spark, sf_dir)
    hooks = s.where("sent_id = 2").select("media_id", F.lit(0).alias("id"), F.concat(F.lit("> "), F.substring("text", 1, 60)).alias("hook"), (F.col("media_id") % 4).cast("string").alias("stated"))
    return narrative.locate_hooks(hooks, s.select("media_id", F.col("sent_id").alias("n"), "text", "start_ms", "end_ms"))


_HOOK = "start_ms + (id * 7919 + media_id * 104729) % 70000 - 10000"


@query(
    f"""WITH {TX}, {GRID}, h AS (SELECT media_id, id, start_ms, end_ms, CASE WHEN id % 5 <> 0 THEN {_HOOK} END AS hs, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.7 END AS score FROM grid),
    x AS (SELECT *, CASE WHEN hs + 3000 > end_ms THEN least(hs + 3000, start_ms + 180000) ELSE end_ms END AS e, least(start_ms, hs) AS b FROM h),
    y AS (SELECT *, b + CASE WHEN hs - b > 1000 THEN least(hs - b - 1000, CASE WHEN score >= 0.85 THEN 45000 ELSE 15000 END) ELSE 0 END AS s FROM x)
    SELECT media_id, id, CASE WHEN hs IS NOT NULL AND e - s >= 1000 THEN s ELSE start_ms END AS s, CASE WHEN hs IS NOT NULL AND e - s >= 1000 THEN e ELSE end_ms END AS e FROM y"""
)
def q_hook_anchor(spark, sf_dir):
    g = _grid(views.words(spark, sf_dir)).withColumn("hs", F.when(F.expr("id % 5 <> 0"), F.expr(_HOOK)))
    x = narrative.anchored(F.col("start_ms"), F.col("end_ms"), F.col("hs"), F.col("hs") + 3000, F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.7))
    return g.select("media_id", "id", x.alias("x")).select("media_id", "id", "x.s", "x.e")


@query(
    f"""WITH {TX}, {GRID}, ends AS ({SQL['q_topic_boundaries']}), n AS (SELECT g.*, (SELECT min(b.end_ms) FROM ends b WHERE b.media_id = g.media_id AND b.end_ms >= g.end_ms) AS hit FROM grid g)
    SELECT media_id, id, start_ms, CASE WHEN hit - end_ms <= 45000 AND hit - start_ms <= 180000 THEN hit ELSE end_ms END AS end_ms FROM n"""
)
def q_topic_completion(spark, sf_dir):
    from spanloom.plans.queries import Q

    return narrative.complete_topics(_grid(views.words(spark, sf_dir)), Q["q_topic_boundaries"](spark, sf_dir).select("media_id", "end_ms"))


@query(
    f"""WITH {SENT}, {GRID}, l AS (SELECT *, lead(end_ms) OVER (PARTITION BY media_id ORDER BY sent_id) AS more FROM tx_sentences),
    h AS (SELECT g.media_id, g.id, g.start_ms, g.end_ms, min_by({{'s': l.start_ms, 'e': l.end_ms, 'm': l.more}}, l.start_ms) AS h FROM grid g LEFT JOIN l ON l.media_id = g.media_id AND l.start_ms >= g.end_ms AND contains(lower(l.text), 'in ') GROUP BY ALL)
    SELECT media_id, id, start_ms, CASE WHEN h.s - end_ms <= 25000 AND h.e - start_ms <= 180000 AND h.e > end_ms THEN CASE WHEN h.m - start_ms <= 180000 THEN h.m ELSE h.e END ELSE end_ms END AS end_ms FROM h"""
)
def q_reveal_completion(spark, sf_dir):
    return narrative.complete_reveals(_grid(views.words(spark, sf_dir)), _sentences(spark, sf_dir), _says("in "))


_REFINE = f"""{SENT}, {GRID}, p AS (SELECT g.media_id, g.id, g.start_ms AS gs, g.end_ms AS ge, x.sent_id, x.start_ms, x.end_ms FROM grid g JOIN tx_sentences x ON x.media_id = g.media_id AND x.end_ms > g.start_ms - 60000 AND x.start_ms < g.end_ms + 90000),
    l AS (SELECT media_id, id, list({{'s': start_ms, 'e': end_ms}} ORDER BY start_ms, end_ms) AS l, count(*) FILTER (end_ms <= gs) AS d0, greatest(count(*) FILTER (end_ms <= gs), count(*) FILTER (start_ms < ge) - 1) AS d1, count(*) - 1 AS last FROM p GROUP BY ALL HAVING count(*) FILTER (end_ms <= gs) <= count(*) - 1),
    a AS (SELECT *, greatest(0, d0 - 2) AS lo, least(last, d1 + 2) AS h0 FROM l),
    b AS (SELECT *, greatest(h0, least(last, len(list_filter(l, lambda x: x.e <= l[lo + 1].s + 60000)) - 1)) AS hi FROM a),
    c AS (SELECT *, greatest(lo, least(hi, d0 + id % 7 - 3)) AS x, greatest(lo, least(hi, d1 + id % 3 - 1)) AS y FROM b),
    d AS (SELECT *, least(x, y) AS s0, greatest(x, y) AS e0 FROM c),
    e AS (SELECT *, coalesce(list_min(list_filter(range(e0, hi + 1), lambda i: l[i + 1].e - l[s0 + 1].s >= 15000)), hi) AS e1 FROM d),
    f AS (SELECT *, coalesce(list_max(list_filter(range(lo, s0 + 1), lambda i: l[e1 + 1].e - l[i + 1].s >= 15000)), lo) AS s1 FROM e),
    z AS (SELECT *, coalesce(list_max(list_filter(range(s1, e1 + 1), lambda i: l[i + 1].e - l[s1 + 1].s <= 60000)), s1) AS e2 FROM f)"""


@query(f"WITH {_REFINE} SELECT media_id, id, CAST(s1 AS INTEGER) AS s_idx, CAST(e2 AS INTEGER) AS e_idx, l[s1 + 1].s AS s, l[e2 + 1].e AS e FROM z")
def q_refine(spark, sf_dir):
    """Line ranges near each grid span, as a model might ask for them, brought back inside the limits."""
    g = _grid(views.words(spark, sf_dir))
    around = g.select("media_id", "id", (F.col("start_ms") - 60_000).alias("start_ms"), (F.col("end_ms") + 90_000).alias("end_ms"))
    pairs = intervals.overlapping(around, _sentences(spark, sf_dir).drop("text"))
    gs, ge = F.col("l.start_ms") + 60_000, F.col("l.end_ms") - 90_000
    lines = F.array_sort(F.collect_list(F.struct(F.col("r.start_ms").alias("s"), F.col("r.end_ms").alias("e"))))
    rows = pairs.groupBy("l.media_id", "l.id").agg(lines.alias("lines"), F.count_if(F.col("r.end_ms") <= gs).cast("int").alias("d0"), F.count_if(F.col("r.start_ms") < ge).cast("int").alias("d1"))
    rows = rows.where(F.col("d0") < F.size("lines")).withColumn("d1", F.greatest("d0", F.col("d1") - 1))
    asked = rows.withColumns({"start_line": (F.col("d0") + F.col("id") % 7 - 3).cast("string"), "end_line": F.col("d1") + F.col("id") % 3 - 1})
    return narrative.refine(asked, high_ms=60_000).select("media_id", "id", "s_idx", "e_idx", "s", "e")


@query(
    f"""WITH cand AS ({SQL['q_multi_probe']}), r AS (SELECT id, retrieval_score, CASE WHEN id % 4 <> 0 THEN least(100, greatest(0, id * 37 % 131 - 10)) END AS v FROM cand)
    SELECT id, CAST(v AS DOUBLE) AS virality, CAST(coalesce(round(0.75 * v + 25 * CAST(retrieval_score AS DECIMAL(10, 4)), 2), round(retrieval_score * 100, 2)) AS DOUBLE) AS final_score, CASE WHEN v IS NULL THEN 'retrieval' ELSE 'model' END AS scored_by FROM r"""
)
def q_score_final(spark, sf_dir):
    """Candidates and the replies of a stub model, a quarter of which is no JSON."""
    from spanloom.plans.queries import Q

    reply = F.when(F.col("id") % 4 != 0, F.concat(F.lit('Here: {"virality_score": "'), (F.col("id") * 37 % 131 - 10).cast("string"), F.lit('"} ok'))).otherwise(F.lit("I can't."))
    rows = Q["q_multi_probe"](spark, sf_dir).select("id", "retrieval_score", C.json_object(reply).alias("j"))
    said = F.expr("try_variant_get(j, '$.virality_score', 'string')")
    rows = rows.withColumn("virality", F.when(F.col("j").isNotNull(), C.clamp(said, 0, 100, 50)))
    return rows.select("id", "virality", narrative.final_score(F.col("virality"), F.col("retrieval_score")).alias("final_score"), F.when(F.col("virality").isNull(), "retrieval").otherwise("model").alias("scored_by"))


def _stub(p: int) -> dict:
    return {"delay": f"CASE WHEN event_id % {p} <> 0 THEN event_id * {p + 4} % 9001 END", "promise": f"event_id % {p + 2} = 1", "filler": f"event_id * {p} % 4003"}


_B, _A = _stub(3), _stub(5)


@query(
    f"""WITH v AS (SELECT event_id AS id, event_id % 2 = 0 AS opens, event_id % 3 = 0 AS payoff, event_id % 5 <> 0 AS house, {_B['delay']} AS bd, {_B['promise']} AS bp, {_B['filler']} AS bf, {_A['delay']} AS ad, {_A['promise']} AS ap, {_A['filler']} AS af,
      event_id % 7 = 0 AS reveal, event_id * 97 % 40000 AS prop, event_id * 89 % 200000 AS tot, event_id % 10 / 20.0 AS ov FROM events),
    c AS (SELECT *, NOT opens AND (bd IS NULL OR bd > 2000) AS c1, NOT payoff AND (bp OR reveal) AS c2, house AND bf >= 1000 AS c3,
      (bd IS NOT NULL AND ad IS NULL) OR (ap AND NOT bp) OR af - bf > 500 OR coalesce(ad - bd, 0) > 1000 AS loses, (ad IS NOT NULL AND bd IS NULL) OR coalesce(ad - bd, 0) < -1000 OR (bp AND NOT ap) OR af - bf < -500 AS wins FROM v)
    SELECT id, concat_ws(',', CASE WHEN c2 THEN 'contains_payoff' END, CASE WHEN c3 THEN 'has_housekeeping' END, CASE WHEN c1 THEN 'opens_on_hook' END) AS upheld,
      (c1 OR c2 OR c3) AND prop >= 7500 AND tot BETWEEN 15000 AND 180000 AND ov < 0.25 AND NOT loses AND wins AS applied FROM c"""
)
def q_critic(spark, sf_dir):
    """Verdicts and clip measures made from event numbers."""
    e = views.table(spark, sf_dir, "events")
    profile = lambda p, reveal: F.struct(F.expr(p["delay"]).alias("delay"), F.expr(p["promise"]).alias("promise"), F.expr(p["filler"]).alias("filler"), F.expr(reveal).alias("reveal_near"))
    verdict = F.struct(F.expr("event_id % 2 = 0").alias("opens_on_hook"), F.expr("event_id % 3 = 0").alias("contains_payoff"), F.expr("event_id % 5 <> 0").alias("has_housekeeping"))
    rows = e.select("event_id", verdict.alias("v"), profile(_B, "event_id % 7 = 0").alias("b"), profile(_A, "false").alias("a"))
    rows = rows.withColumn("c", narrative.upheld(F.col("v"), F.col("b")))
    taken = narrative.adopted(F.col("c"), F.col("b"), F.col("a"), F.expr("event_id * 97 % 40000"), F.expr("event_id * 89 % 200000"), F.expr("event_id % 10 / 20.0"))
    return rows.select(F.col("event_id").alias("id"), F.concat_ws(",", "c").alias("upheld"), taken.alias("applied"))


def staged(spark, sf_dir):
    """Words, sentences, channel asks and the ends of media: the steps of a clip meet them again and again, so texts, sentences, asks and ends are written down once, dealt by medium.
    Words are cut from their texts where they are needed, as they are many times as large; a grid needs the ends alone."""
    words = views.words(spark, sf_dir, kept=True)
    return words, store.dealt(transcript.sentences(words), "sentences"), *_asked(words)


def _asked(words):
    return store.dealt(exclusions.housekeeping_spans(words, ASKS), "asks"), store.dealt(words.groupBy("media_id").agg(F.max("end_ms").alias("end_ms")), "ends")


def _clips(words, asks, ends):
    early = lambda d: F.when((F.col("id") % 2 == 1) & (F.col("id") > 0), F.col("start_ms") - d)
    spans = _grid(ends).withColumns({"setup_s": early(14_000), "setup_e": early(4_000)})
    return store.dealt(composing.compose(words, spans, asks, 15_000, 60_000, ends), "clips")


def composed(spark, sf_dir):
    words, sentences, asks, ends = staged(spark, sf_dir)
    return words, sentences, asks, ends, _clips(words, asks, ends)


@query()
def q_compose(spark, sf_dir):
    """Clips from a grid of spans, every other one with a setup, clear of channel asks. No sentence is needed here."""
    words = views.words(spark, sf_dir, kept=True)
    rows = _clips(words, *_asked(words)).select("media_id", "id", F.posexplode("spans").alias("k", "p"))
    return rows.select("media_id", "id", "k", F.col("p.s").cast("long").alias("start_ms"), F.col("p.e").cast("long").alias("end_ms"))


_GRADE = f"""{SENT}, {ASK_SQL}, {GRID}, g AS (SELECT *, CASE WHEN id % 3 = 0 THEN start_ms + 4000 END AS hs FROM grid),
    o AS (SELECT g.media_id, g.id, sum(least(g.end_ms, a.end_ms) - greatest(g.start_ms, a.start_ms)) AS c FROM g JOIN ask_spans a ON g.media_id = a.media_id AND g.end_ms > a.start_ms AND g.start_ms < a.end_ms GROUP BY ALL),
    m AS (SELECT DISTINCT g.media_id, g.id FROM g JOIN tx_words w ON w.media_id = g.media_id AND ((w.start_ms < g.start_ms AND w.end_ms > g.start_ms) OR (w.start_ms < g.end_ms AND w.end_ms > g.end_ms))),
    ws AS (SELECT media_id, end_ms, regexp_matches(word, '[.!?…]$') AS f FROM tx_words), ts AS (SELECT media_id, end_ms - 500 AS at, contains(lower(text), 'that ') AS f FROM tx_sentences)"""


@query(
    f"""WITH {_GRADE} SELECT g.media_id, g.id, 30.0::DOUBLE AS duration, false AS under_minimum, coalesce(w.f, false) AS ends_on_sentence, coalesce(t.f, false) AS ends_on_promise, m.id IS NOT NULL AS mid_word_cut,
    round(least(30000, coalesce(o.c, 0)) / 30000 * 100, 1) AS excluded_overlap, g.hs IS NOT NULL AS hook_found, round((g.hs - g.start_ms) / 1000, 1) AS seconds_to_hook
    FROM g ASOF LEFT JOIN ws w ON w.media_id = g.media_id AND w.end_ms <= g.end_ms ASOF LEFT JOIN ts t ON t.media_id = g.media_id AND t.at <= g.end_ms
    LEFT JOIN o ON o.media_id = g.media_id AND o.id = g.id LEFT JOIN m ON m.media_id = g.media_id AND m.id = g.id"""
)
def q_grade(spark, sf_dir):
    words, sentences, asks, ends = staged(spark, sf_dir)
    spans = F.array(F.struct(F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e")))
    clips = _grid(ends).select("media_id", "id", spans.alias("spans"), F.when(F.col("id") % 3 == 0, F.col("start_ms") + 4000).alias("hook_s"))
    return composing.grades(clips, words, sentences, asks, _says("that "))


@query()
def q_quality(spark, sf_dir):
    """The report over composed clips, a row a medium and one for all."""
    words, sentences, asks, _, clips = composed(spark, sf_dir)
    clips = clips.withColumn("hook_s", F.when(F.col("id") % 3 == 0, F.col("spans")[0]["s"] + 4000))
    return composing.report(composing.grades(clips, words, sentences, asks, _says("that ")))


@query()
def q_chunk_split(spark, sf_dir):
    return chunks.split_long(views.words(spark, sf_dir))


@query(f"WITH {SENT} SELECT media_id, sent_id, text, start_ms, end_ms, n_words FROM tx_sentences")
def q_store_roundtrip(spark, sf_dir):
    """Sentences written in batches and read back."""
    folder = store.scratch(spark, "sentences")
    store.save(_sentences(spark, sf_dir), folder, "sent_id")
    return store.load(spark, folder)


@query(f"WITH {SENT} SELECT media_id, sent_id, CASE WHEN media_id % 3 = 0 THEN 'again' ELSE text END AS text, start_ms, end_ms, n_words FROM tx_sentences WHERE media_id % 5 <> 0 AND (media_id % 3 <> 0 OR sent_id < 4)")
def q_store_changes(spark, sf_dir):
    """All sentences saved, a third of the media saved again with less, a fifth removed, runs merged, and read back."""
    folder, s = store.scratch(spark, "sentences"), store.written(_sentences(spark, sf_dir), "sentences")
    store.save(s, folder, "sent_id")
    store.save(s.where("media_id % 3 = 0 AND sent_id < 4").withColumn("text", F.lit("again")), folder, "sent_id")
    store.remove_everywhere(spark, [folder], s.select("media_id").where("media_id % 5 = 0"))
    store.compact(spark, folder)
    return store.load(spark, folder)


def _letters():
    return lambda texts: [[float(t.count(c)) for c in "aei"] + [float(len(t))] for t in texts]


def _echo():
    def ask(prompt):
        if len(prompt) % 3 == 0:
            raise RuntimeError("busy")
        return f'{{"n": {len(prompt)}}}'

    return ask


@query(
    """SELECT doc_id, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e, CAST(length(text) AS DOUBLE) AS n,
    CASE WHEN length(text) % 3 <> 0 THEN '{"n": ' || length(text) || '}' END AS reply FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""
)
def q_plug_stub(spark, sf_dir):
    """A stub embedder and a stub chat model that fails on every third length."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    v = d.select("doc_id", models.embedded(F.col("text"), _letters).alias("v"), models.replies(F.col("text"), _echo).alias("reply"))
    return v.select("doc_id", *(F.col("v")[i].cast("double").alias(n) for i, n in ((0, "a"), (1, "e"), (3, "n"))), "reply")


@query(
    f"""WITH {TX}, {GRID}, w AS (SELECT g.media_id, g.id, g.start_ms AS t, max(CASE WHEN x.end_ms <= g.start_ms THEN x.end_ms END) AS p, min(CASE WHEN x.start_ms >= g.start_ms THEN x.start_ms END) AS n, max(CASE WHEN x.start_ms < g.start_ms AND x.end_ms > g.start_ms THEN x.start_ms END) AS s,
    max(CASE WHEN x.start_ms < g.start_ms AND x.end_ms > g.start_ms THEN x.end_ms END) AS e FROM grid g JOIN tx_words x ON x.media_id = g.media_id GROUP BY ALL)
    SELECT media_id, id, coalesce(s, t) AS back_ms, coalesce(e, t) AS forward_ms, CASE WHEN s IS NOT NULL THEN 0 ELSE greatest(0, coalesce(n, t) - coalesce(p, t)) END AS stay_ms FROM w"""
)
def q_stay_align(spark, sf_dir):
    """The gap that a target lies in, and where it lands when moved off its word."""
    w = views.words(spark, sf_dir)
    e = transcript.edges_at(w, _grid(w).select("media_id", F.col("id").alias("t_id"), F.col("start_ms").alias("t_ms")))
    stay = F.when(F.col("word_start_ms").isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.coalesce("next_start_ms", "t_ms") - F.coalesce("prev_end_ms", "t_ms")))
    return e.select("media_id", F.col("t_id").alias("id"), "back_ms", "forward_ms", stay.alias("stay_ms"))
