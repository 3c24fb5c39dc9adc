"""SQL of queries whose rules walk along their rows: a step of a recursive query is one row of the walk."""

from __future__ import annotations

from spanloom.operators.chunks import ACTIVE, ASS_HEADER, IDLE
from spanloom.plans.queries import _any, ASK_SQL, BRAND_SQL, GRID, KNN, PHRASES_SQL, SENT, SLOTS_SQL, SQL, STRONG, TX, WEAK, WINDOWS_SQL

#: Greedy suppression: candidates in falling score, one a step; `kept` holds what stays.
WALK_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, id) AS n FROM cand),
 walk AS (SELECT DISTINCT media_id, 0 AS n, CAST([] AS STRUCT(id BIGINT, s BIGINT, e BIGINT)[]) AS kept FROM cand
   UNION ALL SELECT media_id, n, CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.e, e) - greatest(k.s, s)) > {most} * least(k.e - k.s, e - s))) > 0 THEN kept ELSE list_append(kept, {{'id': CAST(id AS BIGINT), 's': CAST(s AS BIGINT), 'e': CAST(e AS BIGINT)}}) END
   FROM (SELECT w.media_id, r.n, w.kept, r.id, r.s, r.e FROM walk w JOIN ranked r ON r.media_id = w.media_id AND r.n = w.n + 1)),
 final AS (SELECT media_id, arg_max(kept, n) AS kept FROM walk GROUP BY media_id),
 stays AS (SELECT media_id, CAST(i AS INTEGER) AS rank, kept[i].id AS id FROM (SELECT media_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM final))"""

SQL["q_candidates_nms"] = f"""WITH RECURSIVE {KNN.format(k=6)}, m AS (SELECT id, round(0.75 * max(relevance) + 0.25 * least(count(*) / 4, 1), 4) AS score FROM hits GROUP BY id),
 cand AS (SELECT 0 AS media_id, id, score, id * 20000 AS s, id * 20000 + 45000 AS e FROM m), {WALK_SQL.format(most=0.6)} SELECT * FROM stays WHERE rank <= 14"""

#: The best unused clip of each length class in turn, then by score.
SPREAD_SQL = """classes AS (SELECT CAST(i + 1 AS INTEGER) AS b, round(15 * pow(12, i / 5), 2) AS lo, CASE WHEN i = 4 THEN 180.0 ELSE round(15 * pow(12, (i + 1) / 5), 2) END AS hi FROM range(5) t(i)),
 best AS (SELECT c.media_id, b, list({{'id': id, 'o': -score}} ORDER BY score DESC, id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY media_id, b ORDER BY score DESC, id) AS r FROM clips JOIN classes ON duration BETWEEN lo AND hi OR (b = 5 AND duration > hi)) c WHERE r <= 10 GROUP BY c.media_id, b),
 turns AS (SELECT DISTINCT media_id, 0 AS b, CAST([] AS BIGINT[]) AS used FROM clips
   UNION ALL SELECT t.media_id, t.b + 1, CASE WHEN l IS NULL THEN used ELSE list_concat(used, list_transform(list_filter(l, lambda x: NOT list_contains(used, x.id))[1:1], lambda x: x.id)) END FROM turns t LEFT JOIN best ON best.media_id = t.media_id AND best.b = t.b + 1 WHERE t.b < 5),
 chosen AS (SELECT c.*, CASE WHEN list_contains(u.used, c.id) THEN 0 ELSE 1 END AS late FROM clips c JOIN turns u ON u.media_id = c.media_id AND u.b = 5),
 spread AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY score DESC, id) AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY late, score DESC, id) AS r FROM chosen) WHERE r <= 5)"""

SQL["q_spread"] = f"""WITH RECURSIVE clips AS (SELECT lang AS media_id, doc_id AS id, doc_id % 97 AS score, CAST(n_chars AS DOUBLE) / 20 AS duration FROM documents), {SPREAD_SQL.replace('{{', '{').replace('}}', '}')} SELECT * FROM spread"""

SHOTS_SQL = """cuts AS (SELECT l_orderkey AS media_id, coalesce(list_sort(list(DISTINCT l_partkey % 60000) FILTER (l_partkey % 60000 > 0)), []) AS c FROM lineitem GROUP BY l_orderkey),
 edges AS (SELECT media_id, list_concat([CAST(0 AS BIGINT)], c, [CAST(60000 AS BIGINT)]) AS e FROM cuts),
 opens AS (SELECT media_id, list_transform(list_filter(range(1, len(e)), lambda i: i = 1 OR e[i + 1] - e[i] >= 1500), lambda i: e[i]) AS s FROM edges),
 starts AS (SELECT media_id, CASE WHEN len(s) > 1 AND s[2] < 1500 THEN list_concat(s[1:1], s[3:]) ELSE s END AS s FROM opens),
 shots AS (SELECT media_id, CAST(i AS INTEGER) AS shot, s[i + 1] AS start_ms, coalesce(s[i + 2], 60000) AS end_ms FROM (SELECT media_id, s, unnest(range(len(s))) AS i FROM starts))"""
SQL["q_shots"] = f"WITH {SHOTS_SQL} SELECT * FROM shots"

SQL["q_crop_track"] = f"""WITH RECURSIVE {SHOTS_SQL}, seen AS (SELECT *, CASE WHEN (media_id + shot) % 5 <> 0 THEN (media_id * 7 + shot * 13) % 20 / 20.0::DOUBLE END AS x FROM shots),
 walk AS (SELECT DISTINCT media_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s BIGINT, e BIGINT, x DOUBLE)[]) AS t FROM seen
   UNION ALL SELECT media_id, n, CASE WHEN len(t) > 0 AND abs(x - t[-1].x) < 0.02 THEN list_append(t[1:len(t) - 1], {{'s': t[-1].s, 'e': end_ms, 'x': t[-1].x}}) ELSE list_append(t, {{'s': start_ms, 'e': end_ms, 'x': x}}) END
   FROM (SELECT w.media_id, w.n + 1 AS n, w.t, v.start_ms, v.end_ms, coalesce(v.x, w.t[-1].x, 0.5) AS x FROM walk w JOIN seen v ON v.media_id = w.media_id AND v.shot = w.n)),
 track AS (SELECT media_id, arg_max(t, n) AS t FROM walk GROUP BY media_id)
 SELECT media_id, CAST(len(t) AS INTEGER) AS n, round(list_sum(list_transform(t, lambda p: (p.e - p.s) * p.x)) / list_sum(list_transform(t, lambda p: p.e - p.s)) + 1e-9, 6) AS average_x,
   array_to_string(list_transform(range(2, len(t) + 1), lambda i: 'if(lt(t,' || printf('%.3f', t[i].s / 1000) || '),' || CAST(floor(t[i - 1].x * 1000) AS BIGINT) || ','), '') || CAST(floor(t[-1].x * 1000) AS BIGINT) || repeat(')', len(t) - 1) AS steps FROM track"""

#: Each span cut by the exclusions that touch it, in order.
CLAMP_SQL = """touch AS (SELECT g.media_id, g.id, g.start_ms, g.end_ms, list({{'a': x.start_ms, 'b': x.end_ms}} ORDER BY x.start_ms, x.end_ms) FILTER (x.start_ms IS NOT NULL) AS ads
   FROM {spans} g LEFT JOIN {ads} x ON g.media_id = x.media_id AND g.end_ms > x.start_ms AND g.start_ms < x.end_ms GROUP BY ALL),
 trim_ AS (SELECT media_id, id, 0 AS n, start_ms AS s, end_ms AS e, ads FROM touch
   UNION ALL SELECT media_id, id, n + 1, CASE WHEN apart OR s < a THEN s WHEN e > b THEN b END, CASE WHEN apart THEN e WHEN s < a THEN a WHEN e > b THEN e END, ads
   FROM (SELECT *, e IS NULL OR b <= s OR a >= e AS apart FROM (SELECT *, ads[n + 1].a AS a, ads[n + 1].b AS b FROM trim_ WHERE n < coalesce(len(ads), 0)))),
 clamped AS (SELECT media_id, id, s AS start_ms, e AS end_ms FROM (SELECT *, row_number() OVER (PARTITION BY media_id, id ORDER BY n DESC) AS r FROM trim_) WHERE r = 1 AND e - s >= {least})"""
SQL["q_clamp_outside"] = f"WITH RECURSIVE {SENT}, {ASK_SQL}, {GRID}, {CLAMP_SQL.format(spans='grid', ads='ask_spans', least=1000)} SELECT * FROM clamped"

SQL["q_finish_thought"] = f"""WITH RECURSIVE {SENT}, {ASK_SQL}, {GRID}, whole AS ({SQL['q_topic_completion']}), {CLAMP_SQL.format(spans='whole', ads='ask_spans', least=2000)}
 SELECT w.media_id, w.id, coalesce(c.start_ms, w.start_ms) AS start_ms, coalesce(c.end_ms, w.end_ms) AS end_ms FROM whole w LEFT JOIN clamped c USING (media_id, id)"""

#: Sponsor passages: sentences that a strong marker or a brand marks, in clusters, with one weak sentence behind.
_NAMES = r"""list_transform(list_concat(regexp_extract_all(text, '(?i)under (?:the )?(\w+)', 1), regexp_extract_all(text, '(\w+)\.example', 1)), lambda x: lower(trim(x, '.,''’"')))"""
AD_SQL = f"""of_medium AS (SELECT media_id, list(brand) AS brands FROM brands GROUP BY media_id),
 rated AS (SELECT s.media_id, sent_id, start_ms, end_ms, {_any('text', STRONG)} AS seed, list_min(list_filter(coalesce(brands, []), lambda b: regexp_matches(lower(text), '\\b' || regexp_escape(b) || '\\b'))) AS own,
   list_min(list_intersect({_NAMES}, coalesce(brands, []))) AS named, lead(end_ms) OVER w AS n_end, lead(sent_id) OVER w AS n_id, lead({_any('text', WEAK)}) OVER w AS n_weak FROM tx_sentences s LEFT JOIN of_medium USING (media_id) WINDOW w AS (PARTITION BY s.media_id ORDER BY sent_id)),
 member AS (SELECT *, coalesce(CAST(start_ms - lag(end_ms) OVER w > 30000 AS INTEGER), 0) AS apart FROM rated WHERE seed OR own IS NOT NULL WINDOW w AS (PARTITION BY media_id ORDER BY sent_id)),
 clustered AS (SELECT *, sum(apart) OVER (PARTITION BY media_id ORDER BY sent_id ROWS UNBOUNDED PRECEDING) AS c FROM member),
 found AS (SELECT media_id, c, min(start_ms) AS s, max(end_ms) AS e, min(sent_id) AS lo, max(sent_id) AS hi, max_by(n_end, sent_id) AS n_end, max_by(n_id, sent_id) AS n_id, coalesce(arg_max({{'w': n_weak}}, sent_id).w, false) AS more,
   min_by(own, sent_id) FILTER (own IS NOT NULL AND NOT seed) AS first_own, min(named) AS least_named FROM clustered GROUP BY media_id, c HAVING bool_or(seed)),
 ad_spans AS (SELECT media_id, greatest(s, 0) AS start_ms, CASE WHEN more THEN n_end ELSE e END AS end_ms, CASE WHEN more THEN n_id ELSE hi END - lo + 1 AS n_sentences, coalesce(first_own, least_named) AS brand FROM found WHERE CASE WHEN more THEN n_end ELSE e END - s >= 6000)"""
SQL["q_ad_spans"] = f"WITH {SENT}, {BRAND_SQL}, {AD_SQL} SELECT * FROM ad_spans"
SQL["q_excluded"] = f"WITH {SENT}, {BRAND_SQL}, {AD_SQL}, {ASK_SQL} SELECT media_id, start_ms, end_ms, 'sponsor' AS kind, brand FROM ad_spans UNION ALL SELECT media_id, start_ms, end_ms, 'housekeeping', NULL FROM ask_spans"

#: A cut: pauses in reach scored against the target's own place.
_SCORE = "CASE WHEN {s} THEN 6.0 WHEN {c} THEN 1.5 ELSE 0 END + 2.0 * least({b} - {a}, 800) / 1000 - CASE WHEN {cramped} THEN 3.0 ELSE 0 END - CASE WHEN {dear} THEN 2.2 ELSE 0.5 END * abs({m}) / 1000"


def snap_sql(side: str, pad: int, name: str) -> str:
    start = side == "start_ms"
    anchor, lo, hi = ("b", "t - 10000", "t + 1500") if start else ("a", "t - 1500", "t + 10000")
    gain = _SCORE.format(s="s", c="c", a="a", b="b", cramped="false", dear=f"{anchor} - t {'>' if start else '<'} 0", m=f"{anchor} - t")
    stay = _SCORE.format(s="ps", c="(ps OR pc)", a="sa", b="sb", cramped="(split OR (NOT ps AND sb - sa < 180))", dear=f"{'sb' if start else 'sa'} - t {'>' if start else '<'} 0", m=f"{'sb' if start else 'sa'} - t")
    moved = f"greatest(pb - least({pad}, 0.6 * (pb - pa)), 0)" if start else f"pa + least({pad}, 0.6 * (pb - pa))"
    left = "CASE WHEN split THEN ws ELSE greatest(t - {0}, coalesce(pe, 0), 0) END" if start else "CASE WHEN split THEN we ELSE least(t + {0}, coalesce(ns, 1152921504606846976)) END"
    return f"""{name}_t AS (SELECT media_id, id, {side} AS t FROM grid),
 {name}_p AS (SELECT t.media_id, t.id, arg_max({{'a': a, 'b': b, 'v': v}}, [v, -w_idx]) AS p FROM (SELECT t.*, p.a, p.b, p.w_idx, round({gain}, 9) AS v FROM {name}_t t JOIN pause p ON p.media_id = t.media_id AND p.{anchor} BETWEEN {lo} AND {hi}) t GROUP BY ALL),
 {name}_h AS (SELECT t.media_id, t.id, t.t, n.start_ms AS ns, p.end_ms AS pe, coalesce(p.s, false) AS ps0, coalesce(p.c, false) AS pc0, CASE WHEN w.end_ms > t.t THEN w.start_ms END AS ws, CASE WHEN w.end_ms > t.t THEN w.end_ms END AS we FROM {name}_t t
   ASOF LEFT JOIN said n ON n.media_id = t.media_id AND n.start_ms >= t.t ASOF LEFT JOIN said p ON p.media_id = t.media_id AND p.end_ms <= t.t ASOF LEFT JOIN said w ON w.media_id = t.media_id AND w.start_ms < t.t),
 {name}_s AS (SELECT *, we IS NOT NULL AS split, ps0 AND we IS NULL AS ps, pc0 AND we IS NULL AS pc, CASE WHEN we IS NOT NULL THEN t ELSE coalesce(pe, t) END AS sa FROM {name}_h),
 {name}_r AS (SELECT s.*, p.p.a AS pa, p.p.b AS pb, p.p.v AS v FROM (SELECT *, greatest(sa, CASE WHEN split THEN t ELSE coalesce(ns, t) END) AS sb FROM {name}_s) s LEFT JOIN {name}_p p USING (media_id, id)),
 {name} AS (SELECT media_id, id, CAST(round(CASE WHEN moves THEN {moved} ELSE {left.format(pad)} END) AS BIGINT) AS cut, NOT moves AS stayed FROM (SELECT *, coalesce(v >= round({stay}, 9), false) AS moves FROM {name}_r))"""


SQL["q_snap"] = f"""WITH {TX}, {GRID}, said AS (SELECT *, regexp_matches(word, '[.!?…]$') AS s, regexp_matches(word, '[,;:—-]$') AS c FROM tx_words),
 pause AS (SELECT media_id, w_idx, end_ms AS a, nx AS b, s, s OR c AS c FROM (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY w_idx) AS nx FROM said) WHERE nx IS NOT NULL AND (s OR nx - end_ms >= 180)),
 {snap_sql('start_ms', 250, 'a')}, {snap_sql('end_ms', 600, 'b')} SELECT a.media_id, a.id AS t_id, a.cut AS start_ms, a.stayed AS start_stayed, b.cut AS end_ms, b.stayed AS end_stayed FROM a JOIN b USING (media_id, id)"""

SQL["q_caption_collapse"] = f"""WITH RECURSIVE {TX}, {PHRASES_SQL}, {SLOTS_SQL}, o AS (SELECT *, coalesce(CAST(lag(text) OVER w <> text AS INTEGER), 1) AS fresh FROM slots WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, phrase)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, phrase ROWS UNBOUNDED PRECEDING) AS n FROM o)
 SELECT media_id, CAST(n AS BIGINT) AS n, text, min(start_ms) AS start_ms, arg_max(end_ms, [start_ms, end_ms, phrase]) AS end_ms FROM g GROUP BY media_id, n, text"""

#: Lines of at most 24 characters: the line from a word ends before the first word that no longer fits.
SQL["q_caption_wrap"] = r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), lambda w: w <> '') AS l FROM documents),
 w AS (SELECT doc_id, unnest(range(len(l))) AS i, len(l) AS n, unnest(list_transform(l, lambda x: length(x) + 1)) AS c FROM l),
 p AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS until FROM w),
 x AS (SELECT a.doc_id, a.i, greatest(coalesce(b.i, a.n), a.i + 1) AS nx FROM (SELECT *, until - c + 25 + 1 AS most FROM p) a ASOF LEFT JOIN p b ON b.doc_id = a.doc_id AND a.most <= b.until),
 steps AS (SELECT doc_id, list(CAST(nx AS INTEGER) ORDER BY i) AS nx FROM x GROUP BY doc_id),
 hops AS (SELECT doc_id, 0 AS line, 0 AS lo, nx[1] AS hi FROM steps UNION ALL SELECT doc_id, line + 1, hi, nx[hi + 1] FROM hops JOIN steps USING (doc_id) WHERE hi < len(nx))
 SELECT doc_id, line, lo AS first, hi - lo AS n FROM hops"""

#: Turns of conversations as segments of twelve seconds, each medium closed at its end.
SQL["q_window_stream"] = f"""WITH RECURSIVE tx_sentences AS (SELECT conv_id AS media_id, turn AS sent_id, coalesce(text, '') AS text, turn * 12000 AS start_ms, turn * 12000 + 11000 AS end_ms, 1 AS n_words FROM conversations WHERE conv_id IS NOT NULL), {WINDOWS_SQL}
 SELECT w.media_id, number AS w_index, string_agg(text, ' ' ORDER BY seg.i) AS text, min_by(seg.s, seg.i) AS start_ms, max_by(seg.e, seg.i) AS end_ms, min_by(sent_id, seg.i) AS first_seg, max_by(sent_id, seg.i) AS last_seg
 FROM (SELECT * FROM walk WHERE given) w JOIN seg ON seg.media_id = w.media_id AND seg.i BETWEEN w.lo AND w.hi GROUP BY w.media_id, number"""


def _ass(c: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {c} // 360000, {c} // 6000 % 60, {c} // 100 % 60, {c} % 100)"


_DOCUMENT = r"""WITH RECURSIVE @words, @phrases, @slots, n AS (SELECT media_id, greatest(100, least(max(end_ms), 120000)) AS n FROM tx_words GROUP BY media_id),
 shown AS (SELECT *, CAST(round_even(b / 10, 0) AS BIGINT) AS p, CAST(round_even(e / 10, 0) AS BIGINT) AS q FROM (SELECT media_id, phrase, text, active, is_first, is_last, b, greatest(b + 40, least(end_ms, n)) AS e
   FROM (SELECT s.*, n, greatest(0, least(start_ms, n)) AS b FROM slots s JOIN n USING (media_id)) WHERE b < n)),
 lines AS (SELECT media_id, b, phrase, e, 'Dialogue: 0,' || @from || ',' || @to || ',Pop,,0,0,0,,' || CASE WHEN is_first OR is_last THEN printf('{\fad(%d,%d)}', CASE WHEN is_first THEN 90 ELSE 0 END, CASE WHEN is_last THEN 90 ELSE 0 END) ELSE '' END ||
   array_to_string(list_transform(list_transform(string_split(text, ' '), lambda w: replace(replace(replace(w, '\', '\\'), '{', '\{'), '}', '\}')), lambda w, i: CASE WHEN i - 1 = active THEN '{\c@active}' || w || '{\c@idle}' ELSE w END), ' ') AS line FROM shown),
 docs AS (SELECT n.media_id, '@header' || coalesce(string_agg(line || chr(10), '' ORDER BY b, phrase, e, line), '') AS d FROM n LEFT JOIN lines ON lines.media_id = n.media_id GROUP BY n.media_id)
 SELECT media_id, CAST(length(d) AS INTEGER) AS n_chars, sha256(d) AS digest FROM docs"""
_HEADER = ASS_HEADER.format(width=1080, height=1920, font="Arial Black", size=92, outline=8, margin_h=97, margin_v=307)
for _name, _text in (("words", TX), ("phrases", PHRASES_SQL), ("slots", SLOTS_SQL), ("from", _ass("p")), ("to", _ass("q")), ("active", ACTIVE), ("idle", IDLE), ("header", _HEADER)):
    _DOCUMENT = _DOCUMENT.replace(f"@{_name}", _text)
SQL["q_caption_document"] = _DOCUMENT

#: Faces in order of time and place; each joins the first person near it and moves that person's place.
SQL["q_people"] = """WITH RECURSIVE e AS (SELECT vec_id AS shot, unnest(range(len(embedding))) AS f, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS c FROM embeddings),
 b AS (SELECT shot, f * 200 AS t, 0.15::DOUBLE + 0.3::DOUBLE * k + round(c % 1 * 0.05::DOUBLE, 4) AS x, round(abs(sin(f * 200 * (k + 1))) + 0.2::DOUBLE, 6) AS score FROM e, range(3) r(k)),
 faces AS (SELECT shot, t, x + 0.1::DOUBLE / 2 AS c, row_number() OVER (PARTITION BY shot ORDER BY t, x) AS i FROM b WHERE score >= 0.5),
 lists AS (SELECT shot, list({'t': t, 'c': c} ORDER BY i) AS l FROM faces GROUP BY shot),
 walk AS (SELECT shot, 0 AS i, CAST([] AS STRUCT(x DOUBLE, n BIGINT, t BIGINT)[]) AS p FROM lists
   UNION ALL SELECT shot, i + 1, CASE WHEN hit = 0 THEN list_append(p, {'x': c, 'n': CAST(1 AS BIGINT), 't': CAST(t AS BIGINT)})
     ELSE list_concat(p[1:hit - 1], [{'x': (p[hit].x * (n - 1) + c) / n, 'n': n, 't': CAST(t AS BIGINT)}], p[hit + 1:]) END
   FROM (SELECT *, CASE WHEN hit > 0 THEN p[hit].n + CASE WHEN p[hit].t = t THEN 0 ELSE 1 END END AS n FROM (SELECT shot, i, p, f.t AS t, f.c AS c, coalesce(list_position(list_transform(p, lambda q: abs(q.x - f.c) <= 0.08), true), 0) AS hit
     FROM (SELECT w.shot, w.i, w.p, l[w.i + 1] AS f FROM walk w JOIN lists USING (shot) WHERE w.i < len(l))))),
 final AS (SELECT shot, arg_max(p, i) AS p FROM walk GROUP BY shot),
 seen AS (SELECT shot, unnest(p) AS p FROM final)
 SELECT shot, CAST(row_number() OVER (PARTITION BY shot ORDER BY p.x, p.n) - 1 AS INTEGER) AS person, round(p.x, 6) AS x, round(p.n / 64, 6) AS share FROM seen WHERE p.n / 64 >= 0.3"""

#: The clear speaker of each window; windows in a row with one speaker are a turn, and turns cover the shot.
SQL["q_speaker_track"] = """WITH e AS (SELECT vec_id AS shot, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS score FROM embeddings),
 r AS (SELECT shot, i // 2 AS win, i % 2 AS person, score, row_number() OVER w AS rank, lead(score) OVER w AS nx FROM e WINDOW w AS (PARTITION BY shot, i // 2 ORDER BY score DESC, i % 2)),
 clear AS (SELECT shot, win, CASE WHEN person = 0 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS x FROM r WHERE rank = 1 AND nx IS NOT NULL AND score > 0 AND score - greatest(nx, 0) >= 0.25::DOUBLE * greatest(abs(nx), 1e-6)),
 o AS (SELECT *, coalesce(CAST(x <> lag(x) OVER (PARTITION BY shot ORDER BY win) AS INTEGER), 1) AS fresh FROM clear),
 t AS (SELECT shot, k, min(win) * 2000 AS s, any_value(x) AS x FROM (SELECT *, sum(fresh) OVER (PARTITION BY shot ORDER BY win ROWS UNBOUNDED PRECEDING) AS k FROM o) GROUP BY shot, k)
 SELECT shot, CAST(row_number() OVER w - 1 AS INTEGER) AS turn, CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE s END AS BIGINT) AS start_ms, CAST(coalesce(lead(s) OVER w, 64000) AS BIGINT) AS end_ms, x FROM t WINDOW w AS (PARTITION BY shot ORDER BY k)"""

#: Columns rated by how much they change downwards and from frame to frame, smoothed over three places; then the best window as in q_crop_window.
SQL["q_subject"] = """WITH p AS (SELECT vec_id // 16 AS clip, vec_id // 4 % 4 AS sample, vec_id % 4 AS y, unnest(range(64)) AS x, unnest(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))) AS v FROM embeddings),
 d AS (SELECT clip, x, abs(v - lag(v) OVER (PARTITION BY clip, sample, x ORDER BY y)) AS d, abs(v - lag(v) OVER (PARTITION BY clip, y, x ORDER BY sample)) AS m FROM p),
 s AS (SELECT clip, x, sum(d) AS d, coalesce(sum(m), 0) AS m FROM d WHERE clip IN (SELECT clip FROM p GROUP BY clip HAVING count(DISTINCT sample) >= 2) GROUP BY clip, x),
 u AS (SELECT clip, x, 0.5 * (d - min(d) OVER c) / (max(d) OVER c - min(d) OVER c) + 0.5 * (m - min(m) OVER c) / (max(m) OVER c - min(m) OVER c) AS v FROM s WINDOW c AS (PARTITION BY clip)),
 f AS (SELECT clip AS frame, x, coalesce(lag(v) OVER o, 0) / 3 + v / 3 + coalesce(lead(v) OVER o, 0) / 3 AS v FROM u WINDOW o AS (PARTITION BY clip ORDER BY x)),
 l AS (SELECT frame, list(v ORDER BY x) AS v FROM f GROUP BY frame),
 t AS (SELECT frame, i AS p, list_sum(v[i + 1:i + 19]) AS total FROM (SELECT frame, v, unnest(range(46)) AS i FROM l)),
 r AS (SELECT frame, p, round(total - 0.12 * CASE WHEN s = 0 THEN 1 ELSE s END * abs((p + 9.5) / 64 - 0.5) * 2, 6) AS rated FROM (SELECT *, max(total) OVER (PARTITION BY frame) - min(total) OVER (PARTITION BY frame) AS s FROM t))
 SELECT frame AS clip, round((arg_min(p, [-rated, p]) + 9.5) / 64, 6) AS centre FROM r GROUP BY frame"""
