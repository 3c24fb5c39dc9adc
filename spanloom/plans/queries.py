"""Registered queries over the driver tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import lexicons as L
from spanloom.operators import chunks, exclusions, framing, intervals, jobs, retrieval, snapping, transcript
from spanloom.sources import views
from spanloom.streaming import live

STRONG, WEAK, ASKS, OPENERS, CLOSERS = ["license", "@"], ["deal", "and the"], ["and the", "of the"], ["and ", "of "], ["is "]
BRANDS = {"templates": [r"under (?:the )?(\w+)"], "domain": r"(\w+)\.example"}
CLIP = [(60_000, 90_000), (100_000, 130_000), (129_000, 140_000)]

# --- pieces of SQL ---
TX = r"""
 tx_list AS (SELECT doc_id AS media_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS l FROM documents),
 tx_flat AS (SELECT media_id, unnest(l) AS word, unnest(range(len(l))) AS w_idx FROM tx_list),
 tx_step AS (SELECT *, CASE (w_idx * 7 + media_id * 13) % 10 WHEN 8 THEN 550 WHEN 9 THEN 950 ELSE 350 END AS step FROM tx_flat),
 tx_words AS (SELECT media_id, CAST(w_idx AS INTEGER) AS w_idx, word, CAST(sum(step) OVER w - step AS BIGINT) AS start_ms, CAST(sum(step) OVER w - step + 350 AS BIGINT) AS end_ms
              FROM tx_step WINDOW w AS (PARTITION BY media_id ORDER BY w_idx))"""
SENT = (
    TX
    + r""",
 tx_num AS (SELECT *, CAST(coalesce(sum(CAST(regexp_matches(word, '[.!?…]$') AS INTEGER)) OVER (PARTITION BY media_id ORDER BY w_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_id FROM tx_words),
 tx_sentences AS (SELECT media_id, sent_id, string_agg(word, ' ' ORDER BY w_idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM tx_num GROUP BY ALL)"""
)


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _opens(text: str, words) -> str:
    bare = f"regexp_replace(lower(trim({text})), '^[^a-z0-9]+', '')"
    return "(" + " OR ".join(f"starts_with({bare}, '{w}')" for w in words) + ")"


MERGE = """SELECT media_id, CAST(min(start_ms) AS BIGINT) AS start_ms, CAST(max(end_ms) AS BIGINT) AS end_ms FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {slack} THEN 0 ELSE 1 END AS fresh
  FROM {src})) GROUP BY media_id, island"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.sentences(views.words(spark, sf_dir))


@query(f"WITH {TX} SELECT * FROM tx_words")
def q_words(spark, sf_dir):
    return views.words(spark, sf_dir)


@query(f"WITH {SENT} SELECT * FROM tx_sentences")
def q_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query(
    rf"""WITH {TX}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY w_idx) AS nx, regexp_matches(word, '[.!?…]$') AS s, regexp_matches(word, '[,;:—-]$') AS c FROM tx_words)
    SELECT media_id, w_idx, end_ms AS start_ms, nx AS end_ms, s AS after_sentence, s OR c AS after_clause FROM n WHERE nx IS NOT NULL AND (s OR nx - end_ms >= 180)"""
)
def q_pauses(spark, sf_dir):
    return transcript.pauses(views.words(spark, sf_dir))


WINDOWS_SQL = """seg AS (SELECT media_id, sent_id, CAST(row_number() OVER w - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY media_id) AS INTEGER) AS n, start_ms AS s, end_ms AS e, text, n_words
   FROM tx_sentences WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, sent_id)),
 ends AS (SELECT media_id, e, min(i) AS i FROM seg GROUP BY ALL),
 fill AS (SELECT seg.*, coalesce(x.i, n - 1) AS j FROM seg ASOF LEFT JOIN ends x ON seg.media_id = x.media_id AND seg.s + 45000 <= x.e),
 turn AS (SELECT f.*, greatest(f.i + 1, least(f.j, coalesce(x.i, f.j))) AS nx FROM (SELECT *, s + 22500 + 1 AS t FROM fill) f ASOF LEFT JOIN (SELECT media_id, e AS xe, i AS i FROM ends) x ON f.media_id = x.media_id AND f.t <= x.xe),
 span AS (SELECT media_id, i, n, s, j, nx, greatest(i, least(j, coalesce(x_k, i))) AS k FROM (SELECT t.*, x.k AS x_k FROM turn t ASOF LEFT JOIN (SELECT media_id, e AS xe, max(i) AS k FROM seg GROUP BY ALL) x ON t.media_id = x.media_id AND t.s + 90000 >= x.xe)),
 rows_ AS (SELECT media_id, any_value(n) AS n, list(s ORDER BY i) AS s, list(j ORDER BY i) AS j, list(nx ORDER BY i) AS nx, list(k ORDER BY i) AS k FROM span GROUP BY media_id),
 e_ AS (SELECT media_id, list(e ORDER BY i) AS e FROM seg GROUP BY media_id),
 walk AS (
   SELECT media_id, 0 AS pos, -1 AS lo, -1 AS hi, CAST(NULL AS BIGINT) AS ls, CAST(NULL AS BIGINT) AS le, -1 AS number, false AS given FROM rows_
   UNION ALL
   SELECT media_id, CASE WHEN scrap THEN n ELSE nx END, CASE WHEN ok THEN pos ELSE -1 END, CASE WHEN ok THEN k ELSE -1 END, CASE WHEN ok THEN s ELSE ls END, CASE WHEN ok THEN e ELSE le END, CASE WHEN ok THEN number + 1 ELSE number END, ok
   FROM (SELECT *, NOT scrap AND NOT (ls IS NOT NULL AND greatest(0, least(le, e) - greatest(ls, s)) > 0.9 * (greatest(le, e) - least(ls, s))) AND NOT (e - s < 15000 AND number >= 0) AS ok
     FROM (SELECT w.media_id, w.pos, w.ls, w.le, w.number, r.n, r.s[pos + 1] AS s, r.nx[pos + 1] AS nx, r.k[pos + 1] AS k, x.e[r.k[pos + 1] + 1] AS e, x.e[r.j[pos + 1] + 1] - r.s[pos + 1] < 15000 AND w.number >= 0 AS scrap
           FROM walk w JOIN rows_ r USING (media_id) JOIN e_ x USING (media_id) WHERE w.pos < r.n)))"""


@query(
    f"""WITH RECURSIVE {SENT}, {WINDOWS_SQL} SELECT w.media_id, printf('chunk-%05d', number) AS chunk_id, number AS w_index, string_agg(text, ' ' ORDER BY seg.i) AS text, min_by(seg.s, seg.i) AS start_ms, max_by(seg.e, seg.i) AS end_ms,
    CAST(sum(n_words) AS BIGINT) AS n_words, min_by(sent_id, seg.i) AS first_seg, max_by(sent_id, seg.i) AS last_seg FROM (SELECT * FROM walk WHERE given) w JOIN seg ON seg.media_id = w.media_id AND seg.i BETWEEN w.lo AND w.hi GROUP BY w.media_id, number"""
)
def q_windows_chain(spark, sf_dir):
    return chunks.windows(_sentences(spark, sf_dir).withColumnRenamed("sent_id", "seg_id"))


def _vectors(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    return e.where("vec_id >= 8").select(F.col("vec_id").alias("id"), "embedding"), e.where("vec_id < 8").select(F.col("vec_id").alias("probe"), "embedding")


KNN = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 s AS (SELECT p.vec_id AS probe, c.vec_id AS id, round(greatest(0, list_cosine_similarity(c.e, p.e)), 4) AS relevance FROM v p JOIN v c ON p.vec_id < 8 AND c.vec_id >= 8),
 hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY probe ORDER BY relevance DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= {k})"""


@query(f"WITH {KNN.format(k=8)} SELECT * FROM hits")
def q_knn(spark, sf_dir):
    return retrieval.nearest(*_vectors(spark, sf_dir), k=8)


@query(
    f"""WITH {KNN.format(k=6)}, m AS (SELECT id, max(relevance) AS relevance, count(*) AS match_count, string_agg(probe, ',' ORDER BY probe) AS matched FROM hits GROUP BY id)
    SELECT id, relevance, match_count, matched, round(0.75 * relevance + 0.25 * least(match_count / 4, 1), 4) AS retrieval_score FROM m"""
)
def q_multi_probe(spark, sf_dir):
    merged = retrieval.merge_probes(retrieval.nearest(*_vectors(spark, sf_dir), k=6), 8)
    return merged.withColumn("matched", F.concat_ws(",", F.col("matched").cast("array<string>"))).drop("distance")


@query()
def q_candidates_nms(spark, sf_dir):
    merged = retrieval.merge_probes(retrieval.nearest(*_vectors(spark, sf_dir), k=6), 8)
    spans = merged.select(F.lit(0).alias("media_id"), "id", "retrieval_score", (F.col("id") * 20_000).alias("start_ms"), (F.col("id") * 20_000 + 45_000).alias("end_ms"))
    return retrieval.suppress(spans, "retrieval_score", 0.6).where("rank <= 14")


@query(
    f"""WITH {SENT} SELECT a.media_id, a.sent_id, b.sent_id AS other_id, CAST(greatest(0, least(a.end_ms + 2000, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS BIGINT) AS overlap_ms,
    round(greatest(0, least(a.end_ms + 2000, b.end_ms) - greatest(a.start_ms, b.start_ms)) / (greatest(a.end_ms + 2000, b.end_ms) - least(a.start_ms, b.start_ms)), 6) AS iou,
    round(greatest(0, least(a.end_ms + 2000, b.end_ms) - greatest(a.start_ms, b.start_ms)) / least(a.end_ms + 2000 - a.start_ms, b.end_ms - b.start_ms), 6) AS ratio
    FROM tx_sentences a JOIN tx_sentences b ON a.media_id = b.media_id AND b.sent_id = a.sent_id + 1"""
)
def q_iou_pairs(spark, sf_dir):
    """Each sentence stretched by two seconds against the next."""
    s = _sentences(spark, sf_dir)
    nxt = F.lead(F.struct("sent_id", "start_ms", "end_ms")).over(Window.partitionBy("media_id").orderBy("sent_id"))
    p = s.select("media_id", "sent_id", "start_ms", (F.col("end_ms") + 2000).alias("end_ms"), nxt.alias("n")).where("n IS NOT NULL")
    args = (F.col("start_ms"), F.col("end_ms"), F.col("n.start_ms"), F.col("n.end_ms"))
    return p.select("media_id", "sent_id", F.col("n.sent_id").alias("other_id"), C.overlap(*args).cast("long").alias("overlap_ms"), F.round(C.envelope_iou(*args), 6).alias("iou"), F.round(C.overlap_ratio(*args), 6).alias("ratio"))


@query(
    """WITH b AS (SELECT CAST(i + 1 AS INTEGER) AS bucket, round(15 * pow(12, i / 5), 2) AS lo, CASE WHEN i = 4 THEN 180.0 ELSE round(15 * pow(12, (i + 1) / 5), 2) END AS hi FROM range(5) t(i))
    SELECT bucket, min(lo) AS lo, min(hi) AS hi, count(doc_id) AS n FROM b LEFT JOIN documents ON n_chars / 20.0 >= lo AND n_chars / 20.0 < hi GROUP BY bucket"""
)
def q_duration_buckets(spark, sf_dir):
    """The five length ranges of a clip, with the documents whose length falls in each."""
    length = views.table(spark, sf_dir, "documents").select((F.col("n_chars") / 20).alias("d"))
    classes = F.broadcast(retrieval.duration_buckets(spark, 5))  # five rows
    n = length.join(classes, (F.col("d") >= F.col("lo")) & (F.col("d") < F.col("hi"))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return classes.join(n, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def q_spread(spark, sf_dir):
    clips = views.table(spark, sf_dir, "documents").select(F.col("lang").alias("media_id"), F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("score"), (F.col("n_chars") / 20).alias("duration"))
    return retrieval.spread_by_duration(clips, retrieval.duration_buckets(spark, 5), 5)


@query(f"WITH {SENT} SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms) - 1 AS INTEGER) AS n, start_ms, end_ms, text FROM tx_sentences WHERE end_ms > 30000 AND start_ms < 90000")
def q_lines(spark, sf_dir):
    rows = _sentences(spark, sf_dir).where("end_ms > 30000 AND start_ms < 90000")
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms")) - 1
    return rows.select("media_id", n.alias("n"), "start_ms", "end_ms", "text")


def _clip(spark, rows):
    """The same spans for every medium."""
    spans = spark.createDataFrame(CLIP, "start_ms long, end_ms long")
    return rows.select("media_id").distinct().crossJoin(F.broadcast(spans))  # a few literal rows


SPANS = "clip AS (SELECT *, CAST(coalesce(sum(e - s) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM (VALUES " + ", ".join(f"({s}, {e})" for s, e in CLIP) + ") t(s, e))"


@query(f"WITH {TX}, {SPANS} SELECT media_id, w_idx, word, o + greatest(start_ms, s) - s AS clip_start_ms, o + least(end_ms, e) - s AS clip_end_ms FROM tx_words JOIN clip ON end_ms > s AND start_ms < e")
def q_words_in_spans(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return intervals.rebased(w, _clip(spark, w)).select("media_id", "w_idx", "word", "clip_start_ms", "clip_end_ms")


@query(f"WITH {SENT}, {SPANS} SELECT media_id, sent_id, o + greatest(start_ms, s) - s AS clip_start_ms, o + least(end_ms, e) - s AS clip_end_ms FROM tx_sentences JOIN clip ON end_ms > s AND start_ms < e")
def q_segments_in_spans(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    return intervals.rebased(s, _clip(spark, s)).select("media_id", "sent_id", "clip_start_ms", "clip_end_ms")


@query(
    f"""WITH {SENT}, t AS (SELECT media_id, sent_id AS t_id, start_ms + 100 AS t_ms FROM tx_sentences)
    SELECT media_id, t_id, t_ms, (SELECT min(start_ms) FROM tx_words w WHERE w.media_id = t.media_id AND w.start_ms >= t_ms) AS next_start_ms,
      (SELECT max(end_ms) FROM tx_words w WHERE w.media_id = t.media_id AND w.end_ms <= t_ms) AS prev_end_ms,
      (SELECT min(start_ms) FROM tx_words w WHERE w.media_id = t.media_id AND w.start_ms < t_ms AND w.end_ms > t_ms) AS word_start_ms,
      (SELECT min(end_ms) FROM tx_words w WHERE w.media_id = t.media_id AND w.start_ms < t_ms AND w.end_ms > t_ms) AS word_end_ms,
      coalesce((SELECT min(end_ms) FROM tx_words w WHERE w.media_id = t.media_id AND w.start_ms < t_ms AND w.end_ms > t_ms), t_ms) AS forward_ms,
      coalesce((SELECT min(start_ms) FROM tx_words w WHERE w.media_id = t.media_id AND w.start_ms < t_ms AND w.end_ms > t_ms), t_ms) AS back_ms FROM t"""
)
def q_asof_words(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return transcript.edges_at(w, transcript.sentences(w).select("media_id", F.col("sent_id").alias("t_id"), (F.col("start_ms") + 100).alias("t_ms")))


GAPS = f"""gaps AS (SELECT media_id, sent_id, end_ms, coalesce(({_opens('nt', OPENERS)} OR {_opens('text', CLOSERS)}) AND ns IS NOT NULL, false) AS by_marker, coalesce(ns - end_ms >= 450, false) AS by_pause
 FROM (SELECT *, lead(text) OVER w AS nt, lead(start_ms) OVER w AS ns FROM tx_sentences WINDOW w AS (PARTITION BY media_id ORDER BY sent_id)))"""


@query(f"WITH {SENT}, {GAPS} SELECT * FROM gaps")
def q_topic_gaps(spark, sf_dir):
    return transcript.topic_gaps(_sentences(spark, sf_dir), OPENERS, CLOSERS)


@query(f"WITH {SENT}, {GAPS} SELECT media_id, end_ms FROM gaps WHERE by_marker OR by_pause UNION SELECT media_id, max(end_ms) FROM gaps GROUP BY media_id")
def q_topic_boundaries(spark, sf_dir):
    return transcript.topic_ends(transcript.topic_gaps(_sentences(spark, sf_dir), OPENERS, CLOSERS))


def _mean(side: str) -> str:
    return f"list_transform(range(1, 65), lambda i: list_sum(list_transform({side}, lambda v: CAST(v[i] AS DOUBLE))) / len({side}))"


@query(
    f"""WITH w AS (SELECT CAST(label AS BIGINT) AS media_id, vec_id AS sent_id, list(embedding) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a,
      list(embedding) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    s AS (SELECT media_id, sent_id, list_cosine_similarity({_mean('a')}, {_mean('b')}) AS score FROM w WHERE len(b) > 0 AND n >= 6),
    k AS (SELECT *, lag(score, 1, 1.0) OVER (PARTITION BY media_id ORDER BY sent_id) AS l, lead(score, 1, 1.0) OVER (PARTITION BY media_id ORDER BY sent_id) AS r FROM s)
    SELECT media_id, sent_id, round(score, 4) AS score FROM k WHERE score <= 0.62 AND score <= l AND score <= r"""
)
def q_topic_semantic(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").alias("sent_id"), "embedding")
    return transcript.semantic_gaps(rows, 0.62)


BRAND_SQL = r"""named AS (SELECT DISTINCT media_id, b AS brand FROM (SELECT media_id, unnest(list_transform(list_concat(regexp_extract_all(text, '(?i)under (?:the )?(\w+)', 1), regexp_extract_all(text, '(\w+)\.example', 1)), lambda x: lower(trim(x, '.,''’"')))) AS b FROM (
   SELECT *, max(CAST({strong} AS INTEGER)) OVER (PARTITION BY media_id ORDER BY sent_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS near FROM tx_sentences) WHERE near = 1) WHERE length(b) >= 3 AND b NOT IN ({stop})),
 said AS (SELECT s.media_id, brand, max_by(end_ms, sent_id) - min_by(start_ms, sent_id) AS spread FROM tx_sentences s JOIN named n ON s.media_id = n.media_id AND regexp_matches(lower(text), '\b' || regexp_escape(brand) || '\b') GROUP BY ALL),
 total AS (SELECT media_id, max_by(end_ms, sent_id) - min_by(start_ms, sent_id) AS total FROM tx_sentences GROUP BY media_id),
 brands AS (SELECT media_id, brand FROM said JOIN total USING (media_id) WHERE spread <= greatest(150000, total * 0.35))""".format(
    strong=_any("text", STRONG), stop=", ".join(f"'{w}'" for w in L.BRAND_STOPLIST)
)


@query(f"WITH {SENT}, {BRAND_SQL} SELECT * FROM brands")
def q_brands(spark, sf_dir):
    return exclusions.find_brands(_sentences(spark, sf_dir), STRONG, **BRANDS)


@query()
def q_ad_spans(spark, sf_dir):
    return exclusions.sponsor_spans(_sentences(spark, sf_dir), STRONG, WEAK, **BRANDS)


ASK_SQL = rf"""tok AS (SELECT *, lower(word) AS t, lead(start_ms) OVER w AS nx, regexp_matches(word, '[.!?…,;:—-]$') AS p FROM tx_num WINDOW w AS (PARTITION BY media_id ORDER BY w_idx)),
 opening AS (SELECT *, concat_ws(' ', t, lead(t) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w, lead(t, 4) OVER w, lead(t, 5) OVER w) AS o FROM tok WINDOW w AS (PARTITION BY media_id ORDER BY w_idx)),
 hit AS (SELECT h.media_id, h.w_idx, h.start_ms, s.end_ms AS sent_end FROM opening h JOIN tx_sentences s USING (media_id, sent_id) WHERE starts_with(o, 'and the') OR starts_with(o, 'of the')),
 back AS (SELECT h.media_id, h.w_idx, max(CASE WHEN b.p OR b.nx - b.end_ms >= 200 THEN b.nx END) AS resume, min(b.start_ms) AS first FROM hit h JOIN tok b ON h.media_id = b.media_id AND b.w_idx < h.w_idx AND b.end_ms >= h.start_ms - 6000 GROUP BY ALL),
 asks AS (SELECT media_id, s AS start_ms, least(sent_end, s + 14000) AS end_ms FROM (SELECT h.media_id, coalesce(resume, first, start_ms) AS s, sent_end FROM hit h LEFT JOIN back USING (media_id, w_idx)) WHERE least(sent_end, s + 14000) - s >= 500),
 ask_spans AS ({MERGE.format(slack=250, src='asks')})"""


@query(f"WITH {SENT}, {ASK_SQL} SELECT * FROM ask_spans")
def q_housekeeping(spark, sf_dir):
    return exclusions.housekeeping_spans(views.words(spark, sf_dir), ASKS)


@query()
def q_excluded(spark, sf_dir):
    return exclusions.excluded_spans(views.words(spark, sf_dir), {"strong": STRONG, "weak": WEAK, **BRANDS}, {"markers": ASKS})


def _grid(words: DataFrame) -> DataFrame:
    """A 30-second span every 40 seconds of each medium."""
    until = words.groupBy("media_id").agg(F.max("end_ms").alias("m"))
    return until.select("media_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 40_000))).alias("id")).select("media_id", "id", (F.col("id") * 40_000).alias("start_ms"), (F.col("id") * 40_000 + 30_000).alias("end_ms"))


GRID = "grid AS (SELECT media_id, id, id * 40000 AS start_ms, id * 40000 + 30000 AS end_ms FROM (SELECT media_id, unnest(range(max(end_ms) // 40000 + 1)) AS id FROM tx_words GROUP BY media_id))"


@query(
    f"""WITH {SENT}, {ASK_SQL}, {GRID}, x AS (SELECT g.media_id, g.id, sum(least(g.end_ms, a.end_ms) - greatest(g.start_ms, a.start_ms)) AS c FROM grid g JOIN ask_spans a ON g.media_id = a.media_id AND g.end_ms > a.start_ms AND g.start_ms < a.end_ms GROUP BY ALL)
    SELECT g.media_id, g.id, CAST(coalesce(c, 0) AS BIGINT) AS covered_ms, round(least(1, coalesce(c, 0) / 30000), 6) AS fraction FROM grid g LEFT JOIN x USING (media_id, id)"""
)
def q_overlap_fraction(spark, sf_dir):
    w = views.words(spark, sf_dir)
    rows = intervals.overlap_fraction(_grid(w), exclusions.housekeeping_spans(w, ASKS))
    return rows.select("media_id", "id", "covered_ms", F.round("fraction", 6).alias("fraction"))


@query(
    f"""WITH {SENT}, {ASK_SQL}, {GRID}, x AS (SELECT g.media_id, g.id, g.start_ms, g.end_ms, a.start_ms AS a, a.end_ms AS b FROM grid g LEFT JOIN ask_spans a ON g.media_id = a.media_id AND g.end_ms > a.start_ms AND g.start_ms < a.end_ms),
    p AS (SELECT media_id, id, coalesce(lag(b) OVER (PARTITION BY media_id, id ORDER BY a), start_ms) AS start_ms, coalesce(a, end_ms) AS end_ms FROM x
          UNION ALL SELECT media_id, id, max(b), max(end_ms) FROM x WHERE a IS NOT NULL GROUP BY ALL)
    SELECT * FROM p WHERE end_ms - start_ms >= 2000"""
)
def q_subtract(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return intervals.subtract(_grid(w), exclusions.housekeeping_spans(w, ASKS))


@query()
def q_clamp_outside(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return intervals.clamp_outside(_grid(w), exclusions.housekeeping_spans(w, ASKS))


LISTS = {"ordinals": L.ORDINALS, "demonstratives": L.DEMONSTRATIVES, "pronouns": L.DANGLING_PRONOUNS, "backreferences": L.BACKREFERENCES, "stop_nouns": L.STOP_NOUNS}


def _sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _noun(i: int) -> str:
    return f"coalesce(list_filter(t[{i + 2}:{i + 3}], lambda x: x NOT IN {_sql_list(L.STOP_NOUNS)} AND length(x) > 2)[1], '')"


_CASES = " ".join(
    f"WHEN t[{i + 1}] IN {_sql_list(L.ORDINALS)} THEN 'enumeration|' || {_noun(i)} WHEN t[{i + 1}] IN {_sql_list(L.DEMONSTRATIVES)}{'' if i == 0 else f' AND {_noun(i)} <> {chr(39) * 2}'} THEN 'demonstrative|' || {_noun(i)}" for i in range(4)
)


@query(
    f"""WITH {SENT}, k AS (SELECT media_id, sent_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t, lower(trim(text)) AS x FROM tx_sentences),
    r AS (SELECT media_id, sent_id, CASE WHEN {' OR '.join(f"starts_with(x, '{w}')" for w in L.BACKREFERENCES)} THEN 'backreference|' {_CASES} WHEN t[1] IN {_sql_list(L.DANGLING_PRONOUNS)} THEN 'pronoun|' END AS ref FROM k)
    SELECT media_id, sent_id, ref FROM r WHERE ref IS NOT NULL"""
)
def q_dangling(spark, sf_dir):
    rows = _sentences(spark, sf_dir).select("media_id", "sent_id", transcript.dangling(F.col("text"), LISTS).alias("r"))
    return rows.where("r IS NOT NULL").select("media_id", "sent_id", F.concat_ws("|", "r.kind", "r.term").alias("ref"))


@query(
    f"""WITH {SENT}, n AS (SELECT a.media_id, a.sent_id, a.end_ms, (SELECT min(b.start_ms) FROM tx_sentences b WHERE b.media_id = a.media_id AND b.start_ms > a.start_ms AND contains(lower(b.text), 'in ')) AS s FROM tx_sentences a),
    k AS (SELECT media_id, sent_id, end_ms, CASE WHEN s <= end_ms + 25000 THEN s END AS reveal_start_ms FROM n)
    SELECT k.*, b.end_ms AS reveal_end_ms FROM k LEFT JOIN tx_sentences b ON b.media_id = k.media_id AND b.start_ms = reveal_start_ms"""
)
def q_promise_reveal(spark, sf_dir):
    return transcript.next_flagged(_sentences(spark, sf_dir), C.contains_any(F.col("text"), ["in "]), 25_000)


def _grid_targets(words, side):
    return _grid(words).select("media_id", F.col("id").alias("t_id"), F.col(side).alias("t_ms"))


@query()
def q_snap(spark, sf_dir):
    """Both edges of a grid of spans moved to their best cuts."""
    w = views.words(spark, sf_dir)
    a = snapping.snap(w, _grid_targets(w, "start_ms"), True, 250).select("media_id", "t_id", F.round("cut_ms").cast("long").alias("start_ms"), F.col("stayed").alias("start_stayed"))
    b = snapping.snap(w, _grid_targets(w, "end_ms"), False, 600).select("media_id", "t_id", F.round("cut_ms").cast("long").alias("end_ms"), F.col("stayed").alias("end_stayed"))
    return a.join(b, ["media_id", "t_id"])


@query(f"WITH {SENT}, q AS (SELECT media_id, sent_id AS id, start_ms, end_ms FROM tx_sentences WHERE sent_id % 2 = 0) {MERGE.format(slack=4000, src='q')}")
def q_merge_touching(spark, sf_dir):
    rows = _sentences(spark, sf_dir).where("sent_id % 2 = 0")  # every other sentence: gaps to bridge
    return intervals.merge_touching(rows, 4000)


@query(f"WITH {SENT} {MERGE.format(slack=250, src='tx_sentences')}")
def q_merge_touching_all(spark, sf_dir):
    """All sentences; longer pauses stay open."""
    return intervals.merge_touching(_sentences(spark, sf_dir), 250)


@query(
    f"""WITH {SENT}, {GRID} SELECT g.media_id, g.id, CAST(row_number() OVER (PARTITION BY g.media_id, g.id ORDER BY s.start_ms, s.sent_id) - 1 AS INTEGER) AS n, s.start_ms, s.end_ms, s.text
    FROM grid g JOIN tx_sentences s ON g.media_id = s.media_id AND s.end_ms > g.start_ms AND s.start_ms < g.end_ms"""
)
def q_lines_grid(spark, sf_dir):
    """Numbered lines of every span of the grid, over the whole of each medium."""
    w = views.words(spark, sf_dir)
    both = intervals.overlapping(_grid(w), transcript.sentences(w))
    n = F.row_number().over(Window.partitionBy("l.media_id", "l.id").orderBy("r.start_ms", "r.sent_id")) - 1
    return both.select("l.media_id", "l.id", n.alias("n"), "r.start_ms", "r.end_ms", "r.text")


PHRASES_SQL = r"""cap AS (SELECT media_id, w_idx, word, start_ms, end_ms, regexp_matches(word, '[.!?]$') AS stop, length(word) + 1 AS c FROM tx_words),
 far AS (SELECT *, 1 + CASE WHEN c2 IS NULL OR c + c2 > 24 THEN 0 WHEN s2 THEN 1 WHEN c3 IS NULL OR c + c2 + c3 > 24 THEN 1 WHEN s3 THEN 2 WHEN c4 IS NULL OR c + c2 + c3 + c4 > 24 THEN 2 ELSE 3 END AS n
   FROM (SELECT *, lead(c) OVER w AS c2, lead(stop) OVER w AS s2, lead(c, 2) OVER w AS c3, lead(stop, 2) OVER w AS s3, lead(c, 3) OVER w AS c4 FROM cap WINDOW w AS (PARTITION BY media_id ORDER BY w_idx))),
 steps AS (SELECT media_id, list(CAST(n AS INTEGER) ORDER BY w_idx) AS n FROM far GROUP BY media_id),
 hops AS (SELECT media_id, 0 AS lo, n[1] AS hi, 1 AS phrase FROM steps UNION ALL SELECT media_id, hi, hi + n[hi + 1], phrase + 1 FROM hops JOIN steps USING (media_id) WHERE hi < len(n)),
 phrases AS (SELECT c.media_id, c.w_idx, word, start_ms, end_ms, CAST(phrase AS BIGINT) AS phrase, CAST(c.w_idx - lo + 1 AS INTEGER) AS place, max(end_ms) OVER (PARTITION BY c.media_id, phrase) AS phrase_end_ms
   FROM cap c JOIN (SELECT media_id, phrase, lo, unnest(range(lo, hi)) AS w_idx FROM hops) h ON h.media_id = c.media_id AND h.w_idx = c.w_idx)"""
SLOTS_SQL = """held AS (SELECT *, greatest(first_value(start_ms) OVER w, max(nx) OVER w) AS e FROM (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY media_id, phrase ORDER BY place), phrase_end_ms) AS nx FROM phrases)
   WINDOW w AS (PARTITION BY media_id, phrase ORDER BY place ROWS UNBOUNDED PRECEDING)),
 cut AS (SELECT *, coalesce(lag(e) OVER w, start_ms) AS b, place = 1 OR e - lag(e) OVER w >= 130 AS opens FROM held WINDOW w AS (PARTITION BY media_id, phrase ORDER BY place)),
 slot AS (SELECT media_id, phrase, k, min(b) AS b, max(e) AS e, min(place) - 1 AS active FROM (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY media_id, phrase ORDER BY place ROWS UNBOUNDED PRECEDING) AS k FROM cut) GROUP BY ALL),
 whole AS (SELECT media_id, phrase, CASE WHEN k = 1 AND e - b < 130 AND n > 1 THEN 2 ELSE k END AS k, min(b) AS b, max(e) AS e, max_by(active, k) AS active FROM (SELECT *, count(*) OVER (PARTITION BY media_id, phrase) AS n FROM slot) GROUP BY 1, 2, 3),
 slots AS (SELECT media_id, phrase, text, CAST(b AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, CAST(active AS INTEGER) AS active, k = min(k) OVER p AS is_first, k = max(k) OVER p AS is_last
   FROM whole JOIN (SELECT media_id, phrase, string_agg(word, ' ' ORDER BY place) AS text FROM phrases GROUP BY ALL) USING (media_id, phrase) WINDOW p AS (PARTITION BY media_id, phrase))"""


@query(f"WITH RECURSIVE {TX}, {PHRASES_SQL} SELECT * FROM phrases")
def q_captions(spark, sf_dir):
    return chunks.caption_phrases(views.words(spark, sf_dir))


@query(f"WITH RECURSIVE {TX}, {PHRASES_SQL}, {SLOTS_SQL} SELECT * FROM slots")
def q_caption_slots(spark, sf_dir):
    return chunks.caption_events_of(views.words(spark, sf_dir))


def _sql_time(ms: str, pattern: str) -> str:
    return f"printf('{pattern}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(
    f"""WITH {SENT} SELECT media_id, string_agg(CAST(sent_id + 1 AS VARCHAR) || chr(10) || {_sql_time('start_ms', '%02d:%02d:%02d,%03d')} || ' --> ' || {_sql_time('end_ms', '%02d:%02d:%02d,%03d')} || chr(10) || text || chr(10), chr(10) ORDER BY sent_id) AS srt
    FROM tx_sentences GROUP BY media_id"""
)
def q_srt(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    block = F.concat((F.col("sent_id") + 1).cast("string"), F.lit("\n"), C.srt_time(F.col("start_ms")), F.lit(" --> "), C.srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("sent_id", block.alias("b"))))
    return s.groupBy("media_id").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n").alias("srt"))


@query(
    f"""WITH {SENT}, c AS (SELECT *, CAST(round_even(start_ms / 10, 0) AS BIGINT) AS a, CAST(round_even(end_ms / 10, 0) AS BIGINT) AS b FROM tx_sentences)
    SELECT media_id, sent_id, 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 360000, a // 6000 % 60, a // 100 % 60, a % 100) || ',' || printf('%d:%02d:%02d.%02d', b // 360000, b // 6000 % 60, b // 100 % 60, b % 100) || ',Pop,,0,0,0,,' ||
    replace(replace(replace(text, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}') AS line FROM c""".replace("\\\\", "\\")
)
def q_ass(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    line = F.concat(F.lit("Dialogue: 0,"), C.ass_time(F.col("start_ms")), F.lit(","), C.ass_time(F.col("end_ms")), F.lit(",Pop,,0,0,0,,"), C.ass_escape(F.col("text")))
    return s.select("media_id", "sent_id", line.alias("line"))


@query(f"WITH {TX}, {GRID} SELECT g.media_id, g.id, EXISTS (SELECT 1 FROM tx_words w WHERE w.media_id = g.media_id AND w.start_ms - 50 <= g.start_ms AND w.end_ms + 50 >= g.start_ms) AS speaking FROM grid g")
def q_speech_mask(spark, sf_dir):
    w = views.words(spark, sf_dir)
    t = _grid(w).select("media_id", F.col("id").alias("t_id"), F.col("start_ms").alias("t_ms"))
    e = transcript.edges_at(w, t)
    near = F.col("word_start_ms").isNotNull() | (F.col("next_start_ms") - F.col("t_ms") <= 50) | (F.col("t_ms") - F.col("prev_end_ms") <= 50)
    return e.select("media_id", F.col("t_id").alias("id"), F.coalesce(near, F.lit(False)).alias("speaking"))


@query(
    """WITH f AS (SELECT vec_id AS frame, list_transform(embedding, lambda x: round(abs(CAST(x AS DOUBLE)), 6)) AS v FROM embeddings), t AS (SELECT frame, i AS p, list_sum(v[i + 1:i + 19]) AS total FROM (SELECT frame, v, unnest(range(46)) AS i FROM f)),
    r AS (SELECT frame, p, round(total - 0.12 * CASE WHEN s = 0 THEN 1 ELSE s END * abs((p + 9.5) / 64 - 0.5) * 2, 6) AS rated FROM (SELECT *, max(total) OVER (PARTITION BY frame) - min(total) OVER (PARTITION BY frame) AS s FROM t))
    SELECT frame, (arg_min(p, [-rated, p]) + 9.5) / 64 AS centre FROM r GROUP BY frame"""
)
def q_crop_window(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "x"))
    return framing.best_window(e.select("frame", "pos", F.round(F.abs("x").cast("double"), 6).alias("score")), 0.3)


@query()
def q_shots(spark, sf_dir):
    """Line items of an order as cuts of a clip of 60 s."""
    cuts = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.lit(60_000).alias("length_ms"), (F.col("l_partkey") % 60_000).alias("cut_ms"))
    return framing.shots(cuts)


def _events(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.col("value"), "ts")


@query("SELECT user_id AS job, event_type AS kind, max_by(value, event_id) AS value, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY ALL")
def q_jobs_latest(spark, sf_dir):
    return jobs.latest(_events(spark, sf_dir))


@query("SELECT user_id AS job, max(event_id) AS created_at FROM events GROUP BY user_id ORDER BY created_at DESC, job LIMIT 20")
def q_jobs_list(spark, sf_dir):
    return jobs.newest_first(_events(spark, sf_dir).groupBy("job").agg(F.max("seq").alias("created_at")), 20)


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE round((event_id % 6 + least(greatest(value / 100, 0), 1)) / 6, 9) END AS progress FROM events"""
)
def q_job_progress(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    stage = F.get(F.array(*map(F.lit, jobs.STAGES)), (F.col("event_id") % 6).cast("int"))
    status = F.when(F.col("event_type") == "purchase", "done").otherwise("running")
    return e.select("event_id", F.round(jobs.overall_progress(status, stage, F.col("value") / 100), 9).alias("progress"))


@query("SELECT user_id AS job, count(*) AS n, 'data: {\"job\":' || user_id || ',\"n\":' || count(*) || '}' || chr(10) || chr(10) AS payload FROM events GROUP BY user_id")
def q_sse(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("job").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("job", "n", jobs.payload(F.struct("job", "n")).alias("payload"))


@query("SELECT bool_and(value >= 0) AS ok, count_if(NOT value >= 0) AS failed, count(*) AS checks FROM events")
def q_health(spark, sf_dir):
    return jobs.health(_events(spark, sf_dir).select((F.col("value") >= 0).alias("ok")))


_FPS = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN round(30000 / 1001, 3) WHEN event_id % 4 = 2 THEN NULL ELSE 25.0 END"


@query(
    f"""WITH e AS (SELECT event_id AS id, event_id % 5 AS kind, 100 + event_id % 900 AS w, 50 + event_id % 700 AS h, round(value, 2) AS d, {_FPS} AS f FROM events)
    SELECT id, CASE WHEN kind = 4 THEN 0 WHEN kind = 2 THEN 12.25 ELSE round(d, 3) END::DOUBLE AS duration, kind IN (0, 1, 3) AS has_video, kind IN (0, 2) AS has_audio, CAST(CASE WHEN kind IN (0, 1) THEN w ELSE 0 END AS INTEGER) AS width, CAST(CASE WHEN kind IN (0, 1) THEN h ELSE 0 END AS INTEGER) AS height,
      CASE WHEN kind IN (0, 1, 3) THEN f END::DOUBLE AS fps, CASE WHEN kind IN (0, 1) THEN 'h264' END AS video_codec, CASE WHEN kind IN (0, 3) THEN id * 10 ELSE 0 END AS size_bytes FROM e"""
)
def q_probe_media(spark, sf_dir):
    """Events as probe documents: video with and without sound, sound alone, a stream without sizes, and text that is no JSON."""
    e = views.table(spark, sf_dir, "events")
    n, d = F.col("event_id"), F.format_string("%.2f", F.round("value", 2))
    rate = F.get(F.array(F.lit("x/1"), F.lit("30000/1001"), F.lit("25/0"), F.lit("25")), (n % 4).cast("int"))
    part = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    video = part('{"codec_type":"video","codec_name":"h264","width":', 100 + n % 900, ',"height":', 50 + n % 700, ',"r_frame_rate":"', rate, '","duration":"', d, '"}')
    bare = part('{"codec_type":"video","r_frame_rate":"', rate, '"}')
    sound = '{"codec_type":"audio","duration":"12.25"}'
    bodies = [
        part('{"streams":[', video, ",", sound, '],"format":{"duration":"', d, '","size":"', n * 10, '"}}'),
        part('{"streams":[', video, '],"format":{"duration":"N/A"}}'),
        part('{"streams":[', sound, "]}"),
        part('{"streams":[', bare, '],"format":{"duration":"', d, '","size":"', n * 10, '"}}'),
        F.lit("not json"),
    ]
    return views.media_probe(e.select(n.alias("id"), F.get(F.array(*bodies), (n % 5).cast("int")).alias("body")))


@query("SELECT page_id, coalesce(regexp_matches(trim(url), '(?i)^https?://'), false) AS is_url FROM pages")
def q_is_url(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", C.is_url(F.col("url")).alias("is_url"))


@query("SELECT doc_id, substring(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM documents")
def q_slug(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", C.slug(F.col("text")).alias("slug"))


@query(
    r"""SELECT conv_id, CAST(count(*) AS BIGINT) AS segment_count, CAST(sum(len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS BIGINT) AS word_count
    FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id"""
)
def q_segment_ingest(spark, sf_dir):
    rows = views.table(spark, sf_dir, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    n = F.size(F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != ""))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("segment_count"), F.sum(n).cast("long").alias("word_count"))


@query(
    """SELECT event_id, event_id % 6 IN (0, 1, 5) AS parsed, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN CAST(user_id AS VARCHAR) END AS a FROM events"""
)
def q_json_parse(spark, sf_dir):
    """Replies of a model, made from events: an object, one inside prose, an array, prose, a broken object, and one over two lines."""
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    made = [
        F.concat(F.lit('{"a": '), n, F.lit("}")), F.concat(F.lit('Sure! {"a": {"b": '), n, F.lit("}} done")), F.concat(F.lit("["), n, F.lit("]")), F.concat(F.lit("no json "), n),
        F.concat(F.lit("{broken "), n), F.concat(F.lit('Here:\n{\n "a": '), u, F.lit("\n}")),
    ]
    rows = views.table(spark, sf_dir, "events").select("event_id", C.json_object(F.get(F.array(*made), (F.col("event_id") % 6).cast("int"))).alias("j"))
    return rows.select("event_id", F.col("j").isNotNull().alias("parsed"), F.expr("try_cast(try_variant_get(j, '$.a', 'int') AS string)").alias("a"))


@query(
    """SELECT n_name, o_orderpriority, CAST(count(*) AS BIGINT) AS n_orders, CAST(sum(CAST(o_totalprice * 100 AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)"""
)
def q_relational_baseline(spark, sf_dir):
    t = lambda n: views.table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    return live.drained(live.counts_by_window(live.event_stream(spark, sf_dir, schema)), "complete")


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM i GROUP BY user_id, k"""
)
def q_stream_sessions(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    return live.all_sessions(live.event_stream(spark, sf_dir, schema))
