"""Operators whose state depends on the data, against plain Python, and cases written out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import lexicons as L
from spanloom.operators import chunks, exclusions, framing, intervals, retrieval, snapping, transcript
from spanloom.plans.queries import LISTS
from spanloom.sources import views


def word_rows(media, text, step=300, gaps=None):
    at, out = 0, []
    for i, w in enumerate(text.split()):
        out.append((media, i, w, at, at + step))
        at += step + (gaps or {}).get(i, 0)
    return out


WORDS = "media_id long, w_idx int, word string, start_ms long, end_ms long"


def test_windows_follow_the_chain_rule():
    """A window's first segment determines the next one's: the first that ends behind the step, at most the one that fills the target. Of the
    chain, windows are kept that are long enough (the first always) and don't repeat the last kept one, and a scrap at the end closes it."""
    rng, target, longest, shortest = random.Random(1), 45_000, 90_000, 15_000
    for _ in range(500):
        at, segs = 0, []
        for _ in range(rng.randrange(1, 40)):
            n = rng.choice([500, 4000, 9000, 30_000, 120_000])
            segs.append((at, at + n))
            at += n + rng.choice([0, 200, 5000])
        last = len(segs) - 1
        fills = [min([j for j in range(i, last + 1) if segs[j][1] - s >= target], default=last) for i, (s, _) in enumerate(segs)]
        onward = [max(i + 1, min([k for k in range(i, fills[i]) if segs[k][1] > s + target / 2], default=fills[i])) for i, (s, _) in enumerate(segs)]
        chain = [0]
        while chain[-1] <= last:
            chain.append(onward[chain[-1]])
        s, e = (np.array(c) for c in zip(*segs))
        got = chunks.window_bounds(s, e, target, 0.5, longest, shortest)
        assert [i for i, _ in got] == sorted({i for i, _ in got}) and {i for i, _ in got} <= set(chain) and got[0][0] == 0
        for i, k in got:  # as far as the target, less what the longest allows
            assert k == max([j for j in range(i, fills[i] + 1) if segs[j][1] - segs[i][0] <= longest], default=i)
            assert segs[k][1] - segs[i][0] >= shortest or i == 0
        kept = dict(got)
        for i in set(chain[:-1]) - set(kept):
            k = max([j for j in range(i, fills[i] + 1) if segs[j][1] - segs[i][0] <= longest], default=i)
            earlier = max(x for x in kept if x < i)
            shared = min(segs[kept[earlier]][1], segs[k][1]) - segs[i][0]
            repeats = shared > 0.9 * (max(segs[kept[earlier]][1], segs[k][1]) - segs[earlier][0])
            scrap = any(segs[fills[x]][1] - segs[x][0] < shortest for x in chain[:-1] if x <= i)
            assert repeats or scrap or segs[k][1] - segs[i][0] < shortest


def test_caption_phrases_and_slots(spark):
    text = "one two three four five. six a. extraordinarily longwordshere end"
    rows = chunks.caption_phrases(spark.createDataFrame(word_rows(1, text, 100), WORDS))
    got: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r["w_idx"]):
        got.setdefault(r["phrase"], []).append(r["word"])
    assert list(got.values()) == [["one", "two", "three", "four"], ["five.", "six", "a."], ["extraordinarily"], ["longwordshere", "end"]]
    slots = chunks.caption_slots(rows).orderBy("phrase", "start_ms").collect()
    by: dict = {}
    for s in slots:
        by.setdefault(s["phrase"], []).append((s["start_ms"], s["end_ms"]))
    for spans in by.values():  # tiled, and none but a lone one is too short to see
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (len(spans) == 1 or all(e - s >= 130 for s, e in spans))


def test_phrase_starts_by_hand():
    assert chunks.phrase_starts("a b c d e f. g h".split()) == [1, 0, 0, 0, 1, 0, 1, 0]
    assert chunks.phrase_starts(["abcdefghijkl", "mnopqrstuvwx", "y"]) == [1, 1, 0]
    assert chunks.phrase_starts(["Yes.", "No.", "Maybe"]) == [1, 0, 1]


def test_suppression_and_spread(spark):
    rng = random.Random(2)
    rows = [(m, i, rng.random(), s := rng.randrange(0, 200_000), s + rng.randrange(1000, 60_000)) for m in range(3) for i in range(40)]
    got = retrieval.suppress(spark.createDataFrame(rows, "media_id int, id int, score double, start_ms long, end_ms long"), "score", 0.5).collect()
    for m in range(3):
        kept: list = []
        for _, i, _, s, e in sorted((r for r in rows if r[0] == m), key=lambda r: -r[2]):
            if all(max(0, min(e, y) - max(s, x)) / min(e - s, y - x) <= 0.5 for _, x, y in kept):
                kept.append((i, s, e))
        assert [r["id"] for r in sorted((r for r in got if r["media_id"] == m), key=lambda r: r["rank"])] == [k[0] for k in kept]
    clips = spark.createDataFrame([(1, 1, 9.0, 20.0), (1, 2, 8.0, 21.0), (1, 3, 7.0, 100.0), (1, 4, 6.0, 400.0), (1, 5, 5.0, 22.0)], "media_id int, id int, score double, duration double")
    chosen = retrieval.spread_by_duration(clips, retrieval.duration_buckets(spark, 3), 3).orderBy("rank").collect()
    assert [r["id"] for r in chosen] == [1, 2, 3]


def spans(spark, rows):
    return spark.createDataFrame(rows, "media_id long, id long, start_ms long, end_ms long")


def test_interval_algebra(spark):
    rng = random.Random(3)
    a = [(m, i, s := rng.randrange(0, 300_000), s + rng.randrange(1, 90_000)) for m in range(2) for i in range(20)]
    b = [(m, i, s := rng.randrange(0, 300_000), s + rng.randrange(1, 20_000)) for m in range(2) for i in range(6)]
    pairs = intervals.overlapping(spans(spark, a), spans(spark, b)).collect()
    want = {(x, y) for x in a for y in b if x[0] == y[0] and x[3] > y[2] and x[2] < y[3]}
    assert len(pairs) == len(want) and {(tuple(p["l"]), tuple(p["r"])) for p in pairs} == want
    pieces = {tuple(r) for r in intervals.subtract(spans(spark, a), spans(spark, b), 2000).collect()}
    expect = set()
    for m, i, s, e in a:
        left = [(s, e)]
        for _, _, x, y in (r for r in b if r[0] == m):
            left = [p for u, v in left for p in ([(u, v)] if y <= u or x >= v else [(u, min(v, x)), (max(u, y), v)]) if p[1] > p[0]]
        expect |= {(m, i, u, v) for u, v in left if v - u >= 2000}
    assert pieces == expect
    clamped = {(r["media_id"], r["id"]): (r["start_ms"], r["end_ms"]) for r in intervals.clamp_outside(spans(spark, a), spans(spark, b)).collect()}
    for m, i, s, e in a:
        for _, _, x, y in sorted((r for r in b if r[0] == m), key=lambda r: (r[2], r[3])):
            if s is None or y <= s or x >= e:
                continue
            s, e = (s, x) if s < x else (y, e) if e > y else (None, None)
        assert clamped.get((m, i)) == ((s, e) if s is not None and e - s >= 1000 else None)


def test_exclusions_by_hand(spark):
    text = "Welcome back to the show. This video is sponsored by Ridge. Ridge makes slim wallets. Go to Ridge .com for a discount. Anyway we go on. Nothing else here at all."
    rows = transcript.sentences(spark.createDataFrame(word_rows(1, text), WORDS))
    assert [tuple(r) for r in exclusions.find_brands(rows).collect()] == [(1, "ridge")]
    got = exclusions.sponsor_spans(rows, min_ms=1000).collect()
    assert [(r["start_ms"], r["end_ms"], r["n_sentences"], r["brand"]) for r in got] == [(1500, 6600, 3, "ridge")]
    ask = "we like it, please subscribe to us now. then more"
    found = exclusions.housekeeping_spans(spark.createDataFrame(word_rows(1, ask), WORDS)).collect()
    assert [(r["start_ms"], r["end_ms"]) for r in found] == [(900, 2400)]


def check_cut(words, t, at_start, cut, pad, extend=10_000, truncate=1500, least=180):
    """A cut is in the pause within reach that has most points, a little inside it, or stays with its target where none has as many."""
    frame = [(a[4], b[3], a[2][-1]) for a, b in zip(words, words[1:])]
    reach = (t - extend, t + truncate) if at_start else (t - truncate, t + extend)
    edge = lambda p: p[1] if at_start else p[0]
    rating = {".": 6.0, "!": 6.0, "?": 6.0, ",": 1.5}

    def points(p):
        cost = 2.2 if (edge(p) > t) == at_start and edge(p) != t else 0.5
        return round(rating.get(p[2], 0.0) + min(p[1] - p[0], 800) / 500 - cost * abs(edge(p) - t) / 1000, 9)

    best = max((points(p) for p in frame if reach[0] <= edge(p) <= reach[1] and (p[1] - p[0] >= least or rating.get(p[2]) == 6.0)), default=-math.inf)
    inside = [w for w in words if w[3] < t < w[4]]
    ended, begins = max((w[4] for w in words if w[4] <= t), default=None), min((w[3] for w in words if w[3] >= t), default=None)
    lo, hi = (t, t) if inside else (t if ended is None else ended, t if begins is None else begins)
    said = next((w[2][-1] for w in words if w[4] == ended), "") if not inside else ""
    stay = points((lo, max(lo, hi), said)) - (3 if inside or rating.get(said) != 6.0 and hi - lo < least else 0)
    held = [p for p in frame if p[0] <= cut <= p[1] and points(p) == best and best >= stay]
    if best >= stay:
        assert held and any(abs(cut - edge(p)) == pytest.approx(min(pad, 0.6 * (p[1] - p[0]))) or cut == 0 for p in held)
    elif inside:
        assert cut == inside[0][3 if at_start else 4]
    else:
        assert cut == pytest.approx(max(t - pad, ended or 0, 0) if at_start else min(t + pad, math.inf if begins is None else begins))


@pytest.mark.parametrize("at_start", [True, False])
def test_snap_takes_the_best_cut(spark, at_start):
    rng, pad = random.Random(4), 250 if at_start else 600
    text = " ".join(rng.choice(["a", "b,", "c", "d.", "e", "f"]) for _ in range(120))
    gaps = {i: rng.choice([0, 0, 0, 100, 200, 700, 1200]) for i in range(120)}
    words = word_rows(1, text, 300, gaps)
    targets = [(1, i, rng.randrange(0, words[-1][4] + 500)) for i in range(60)]
    got = {r["t_id"]: r["cut_ms"] for r in snapping.snap(spark.createDataFrame(words, WORDS), spark.createDataFrame(targets, "media_id long, t_id long, t_ms long"), at_start, pad).collect()}
    for _, i, t in targets:
        check_cut(words, t, at_start, got[i], pad)
    assert len({got[i] - t for _, i, t in targets}) > 20


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    ref = lambda t: (lambda r: r and tuple(r))(one(transcript.dangling(F.lit(t), LISTS)))
    assert ref("The third move is best") == ("enumeration", "move")
    assert ref("This phone is great") == ("demonstrative", "phone")
    assert ref("It is great") == ("pronoun", "") and ref("They left") == ("pronoun", "")
    assert ref("That is why we win") == ("backreference", "") and ref("Phones are great") is None and ref("") is None
    assert one(C.srt_time(F.lit(3_723_004))) == "01:02:03,004" and one(C.ass_time(F.lit(3_723_005))) == "1:02:03.00"
    assert one(C.short_time(F.lit(3723))) == "1:02:03" and one(C.short_time(F.lit(63))) == "1:03"
    assert one(C.slug(F.lit("  Hello, World! "))) == "hello-world" and one(C.clean_title(F.lit('"A   b"'))) == "A b"
    assert one(C.tags(F.lit("#One, two;;#THREE,4,5,6"))) == ["one", "two", "three", "4", "5"]
    assert one(C.clamp(F.lit("12.5"), 0, 10, 3)) == 10.0 and one(C.clamp(F.lit("x"), 0, 10, 3)) == 3.0
    assert one(C.contains_any(F.lit("An IDEAL day"), L.WEAK_MARKERS)) and one(C.opens_with(F.lit("...So, then"), L.TOPIC_MARKERS))
    assert one(C.mentions(F.lit("two moves here"), F.lit("move"))) and not one(C.mentions(F.lit("moving"), F.lit("move")))


def test_shots_by_hand(spark):
    rows = [(1, 10_000, c) for c in (500, 4000, 4500, 9000)] + [(2, 10_000, None), (3, 10_000, 9500)]
    got: dict = {}
    for r in framing.shots(spark.createDataFrame(rows, "media_id int, length_ms int, cut_ms int")).orderBy("media_id", "shot").collect():
        got.setdefault(r["media_id"], []).append((r["start_ms"], r["end_ms"]))
    assert got == {1: [(0, 4500), (4500, 10_000)], 2: [(0, 10_000)], 3: [(0, 10_000)]}


def test_crop_window_against_plain_rule(spark):
    rng = random.Random(5)
    rows = [(f, p, float(rng.randrange(100))) for f in range(8) for p in range(32)]
    got = {r["frame"]: r["centre"] for r in framing.best_window(spark.createDataFrame(rows, "frame int, pos int, score double"), 0.3).collect()}
    for f in range(8):
        v, w = [x[2] for x in rows if x[0] == f], round(32 * 0.3)
        totals = [sum(v[i : i + w]) for i in range(32 - w + 1)]
        rated = [round(t - 0.12 * (max(totals) - min(totals)) * abs((i + w / 2) / 32 - 0.5) * 2, 6) for i, t in enumerate(totals)]
        assert got[f] == pytest.approx((rated.index(max(rated)) + w / 2) / 32)


def test_restore_skips_unreadable_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "status": "done", "clips": [{"id": "c", "start": 1.0, "end": 2.0}]}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["id"] for r in views.segments_of_jobs(spark, f"file://{tmp_path}").collect()] == ["a"]
    media = views.media_probe(spark.createDataFrame([(1, '{"streams":[{"codec_type":"audio"}],"format":{"duration":"3"}}'), (2, "{}")], "id int, body string"))
    assert [r["id"] for r in views.usable(media).collect()] == [1]


def test_stream_sessions_equal_batch(spark, sf, tmp_path):
    from collections import Counter

    from spanloom.plans import queries as plans
    from spanloom.streaming import live

    def batch(folder):
        return live.sessions(spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))

    got = plans.Q["q_stream_sessions"](spark, sf)
    assert got.columns == batch(sf).columns and Counter(got.collect()) == Counter(batch(sf).collect())
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").limit(40).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = live.event_stream(spark, str(tmp_path), events.schema, "part-*.parquet")
    assert Counter(live.all_sessions(stream).collect()) == Counter(batch(tmp_path).collect())


def test_merge_and_lines_take_all_sentences(spark, sf):
    from spanloom.plans import queries as plans

    every = transcript.sentences(views.words(spark, sf)).collect()
    merged = plans.Q["q_merge_touching_all"](spark, sf).collect()
    media: dict = {}
    for r in merged:
        media.setdefault(r["media_id"], []).append((r["start_ms"], r["end_ms"]))
    assert all(any(a <= r["start_ms"] and r["end_ms"] <= b for a, b in media[r["media_id"]]) for r in every)
    assert len(media) < len(merged) < len(every)  # some gaps are open and some are bridged
    lines = plans.Q["q_lines_grid"](spark, sf).collect()
    assert max(r["start_ms"] for r in lines) > 90_000
    spans = lambda r: sum(k * 40_000 < r["end_ms"] and r["start_ms"] < k * 40_000 + 30_000 for k in range(r["start_ms"] // 40_000, r["end_ms"] // 40_000 + 1))
    assert len(lines) == sum(map(spans, every))
