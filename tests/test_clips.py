"""Clip operators without an SQL form, against plain Python on small tables, and cases written out by hand."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, check_cut, word_rows

from spanloom.operators import chunks, composing, narrative, people
from spanloom.sources import store


def talk(media, seed, n=260):
    rng = random.Random(seed)
    text = " ".join(rng.choice(["a", "b,", "c", "d.", "e", "f"]) for _ in range(n))
    return word_rows(media, text, 300, {i: rng.choice([0, 0, 0, 100, 200, 700, 1200]) for i in range(n)})


def lists(words):
    col = lambda f, k: np.array([f(w) for w in words], dtype=k)
    return col(lambda w: w[3], float), col(lambda w: w[4], float), col(lambda w: w[2][-1] in ".!?", bool), col(lambda w: w[2][-1] in ".!?,", bool)


@pytest.mark.parametrize("at_start", [True, False])
def test_cut_is_the_best_in_reach(at_start):
    words, rng, pad = talk(1, 4), random.Random(5), 250 if at_start else 600
    for _ in range(300):
        t = rng.randrange(0, words[-1][4] + 500)
        check_cut(words, t, at_start, composing.cut_at(lists(words), t, at_start, pad, 0.0 if at_start else 1e12), pad)


def test_span_limits():
    w = lists(talk(1, 6))
    end = w[1].max()
    for s in range(0, 60_000, 1700):
        a, b = composing.snap_one(w, s, s + 50_000, end, None, 20_000)
        assert b - a <= 20_000
        a, b = composing.snap_one(w, s, s + 2000, end, 15_000, None)
        assert b - a >= 15_000 - 1


def test_compose_and_grades(spark):
    media = {1: talk(1, 7), 2: talk(2, 8)}
    rng, rows = random.Random(9), []
    for m, words in media.items():
        for i in range(10):
            s = rng.randrange(15_000, words[-1][4] - 10_000)
            u = None if i % 2 else s - rng.randrange(5_000, 14_000)
            rows.append((m, i, s, s + rng.randrange(5_000, 45_000), u, None if u is None else u + 4_000))
    ads = [(1, 30_000, 36_000), (1, 50_000, 52_000), (1, 51_000, 60_000)]
    w = spark.createDataFrame([r for m in media.values() for r in m], WORDS)
    asked = spark.createDataFrame(rows, "media_id long, id long, start_ms long, end_ms long, setup_s long, setup_e long")
    excluded = spark.createDataFrame(ads, "media_id long, start_ms long, end_ms long")
    clips = composing.compose(w, asked, excluded, 15_000, 40_000).cache()
    got = {(r["media_id"], r["id"]): [tuple(p) for p in r["spans"]] for r in clips.collect()}
    assert set(got) == {(m, i) for m, i, *_ in rows}
    for m, i, s, e, u, v in rows:
        spans, mine = got[m, i], [a[1:] for a in ads if a[0] == m]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(x[1] + 50 < y[0] for x, y in zip(spans, spans[1:]))
        assert 3000 <= sum(b - a for a, b in spans) <= 40_000 + 2000
        # it holds on to what was asked for: pieces lie around the span or its setup
        assert all(min(s, u if u is not None else s) - 12_000 <= a and b <= max(e, s + 15_000) + 24_000 for a, b in spans)
        if not mine:  # nothing to cut out: the span, and at most a setup of 20 s before it
            assert len(spans) <= (1 if u is None else 2) and spans[-1][1] - spans[-1][0] >= 14_999 or u is not None
            assert len(spans) == 1 or 1000 <= spans[0][1] - spans[0][0] <= 20_000
            for a, b in spans:  # never inside a word
                assert not any(x[3] < t < x[4] for t in (a, b) for x in media[m])
        for a, b in spans:  # what reaches into an exclusion got there by its last move to a cut, or is the longest piece left
            deep = sum(max(0, min(b, y) - max(a, x)) for x, y in ((30_000, 36_000), (50_000, 60_000)) if m == 1)
            assert deep <= 2 * (10_000 + 600)  # each edge moves by its reach at most
    # a span that no exclusion touches is the same as without any
    free = {(r["media_id"], r["id"]): [tuple(p) for p in r["spans"]] for r in composing.compose(w, asked, excluded.where("false"), 15_000, 40_000).collect()}
    assert all(free[k] == got[k] for k in got if k[0] == 2) and any(free[k] != got[k] for k in got if k[0] == 1)
    assert any(len(x) > 1 for x in got.values())
    sentences = spark.createDataFrame([(1, 0, "wait that is", 0, 20_000)], "media_id long, sent_id long, text string, start_ms long, end_ms long")
    graded = composing.grades(clips.withColumn("hook_s", F.lit(None).cast("double")), w, sentences, excluded, F.contains("text", F.lit("that"))).cache()
    for r in graded.collect():
        x, words = got[r["media_id"], r["id"]], media[r["media_id"]]
        assert r["mid_word_cut"] == any(a[3] < t < a[4] for p in x for t in p for a in words) and r["duration"] == pytest.approx(sum(b - a for a, b in x) / 1000, abs=0.051)
        last = max((a for a in words if a[4] <= x[-1][1]), key=lambda a: a[4])
        assert r["ends_on_sentence"] == (last[2][-1] == ".") and r["ends_on_promise"] == (r["media_id"] == 1)
    every = [r for r in composing.report(graded).collect() if r["media_id"] is None]
    assert len(every) == 1 and every[0]["clips"] == 20


def test_hooks(spark):
    lines = [(1, i, t, i * 1000, i * 1000 + 900) for i, t in enumerate(["we begin here", "the best trick of all", "the best trick of them all", "bye"])]
    hooks = [(1, 0, "> The best trick of all", "2"), (1, 1, "the best trick of all", None), (1, 2, "nothing alike xyz", "1"), (1, 3, "", "1"), (1, 4, None, "0"), (1, 5, "bye", "junk")]
    got = {r["id"]: (r["n"], r["score"]) for r in narrative.locate_hooks(spark.createDataFrame(hooks, "media_id long, id long, hook string, stated string"), spark.createDataFrame(lines, "media_id long, n long, text string, start_ms long, end_ms long")).collect()}
    near = difflib.SequenceMatcher(None, "the best trick of all", lines[2][2]).ratio()
    assert got == {0: (2, round(near, 6)), 1: (1, 1.0), 5: (3, 1.0)}


def test_split_and_wrap(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta.", "gamma,", "delta;"]) for _ in range(900))
    pieces = chunks.split_text(text, 400, 60)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= 400 for a, b in pieces)
    assert all(a[0] < b[0] <= a[1] and a[1] - b[0] <= 60 for a, b in zip(pieces, pieces[1:]))
    assert chunks.split_text("x" * 900, 400, 60) == [(0, 900)] and chunks.split_text("", 400, 60) == [(0, 0)]
    words = [["aa", "bb", "ccccccccc", "d"], []]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    assert [r[0] for r in rows.orderBy("i").select(chunks.wrapped(F.col("w"), F.lit(5))).collect()] == [[[0, 1], [2], [3]], []]


def test_people_and_tracks(spark):
    rng = random.Random(1)
    faces = [(s, t * 200, x, 0.1) for s in range(3) for t in range(30) for x in (0.1 + rng.random() * 0.1, 0.6 + rng.random() * 0.1) if rng.random() < 0.8] + [(3, 0, None, None)]
    got = {}
    for r in people.group_people(spark.createDataFrame(faces, "shot long, t_ms long, x double, w double")).collect():
        got.setdefault(r["shot"], []).append((round(r["x"], 9), round(r["share"], 9)))
    for s in range(3):
        found, frames = [], len({f[1] for f in faces if f[0] == s})
        for t, c in sorted((f[1], f[2] + f[3] / 2) for f in faces if f[0] == s):
            p = next((p for p in found if abs(p[0] - c) <= 0.08), None)
            if p is None:
                found.append([c, {t}])
            else:
                p[1].add(t)
                p[0] = (p[0] * (len(p[1]) - 1) + c) / len(p[1])
        want = sorted((round(x, 9), round(len(ts) / frames, 9)) for x, ts in found if len(ts) / frames >= 0.3)
        assert sorted(got[s]) == want
    assert 3 not in got
    turns = [(1, 20_000, 2000, 3000, 0.2), (1, 20_000, 4000, 8000, 0.7), (1, 20_000, 8000, 9000, 0.2), (1, 20_000, 10_000, 14_000, 0.71), (1, 20_000, 14_000, 18_000, 0.2)]
    track = people.speaker_track(spark.createDataFrame(turns, "shot long, length_ms long, start_ms long, end_ms long, x double")).orderBy("turn").collect()
    assert [tuple(r)[2:] for r in track] == [(0, 14_000, 0.7), (14_000, 20_000, 0.2)]
    shots = [(1, 0, 0, 2000, None), (1, 1, 2000, 4000, 0.51), (1, 2, 4000, 9000, 0.8), (1, 3, 9000, 9500, None)]
    rows = people.crop_track(spark.createDataFrame(shots, "media_id long, shot int, start_ms long, end_ms long, x double"))
    r = rows.select("track", people.average_x(F.col("track")).alias("a"), people.step_expression(F.col("track"), F.lit(1000)).alias("s")).first()
    assert [tuple(t) for t in r["track"]] == [(0, 4000, 0.5), (4000, 9500, 0.8)] and r["a"] == pytest.approx((4000 * 0.5 + 5500 * 0.8) / 9500) and r["s"] == "if(lt(t,4.000),500,800)"
    scores = [(1, 0, 0, 0.2, 1.0), (1, 0, 1, 0.7, 0.9), (1, 1, 0, 0.2, 1.0), (1, 1, 1, 0.7, 0.5), (1, 2, 0, 0.2, 1.0)]
    assert [r["win"] for r in people.clear_speakers(spark.createDataFrame(scores, "shot long, win long, person int, x double, score double")).collect()] == [1]


def test_model_setup_and_store(spark, tmp_path):
    lines = [(0, 5000), (5000, 9000), (9000, 40_000)]
    rows = spark.createDataFrame([(lines, "0", "1", 8000), (lines, "2", "0", 60_000), (lines, None, "1", 8000), (lines, "1", "1", 5500)], "lines array<struct<s:long,e:long>>, a string, b string, m long")
    got = [r[0] and tuple(r[0]) for r in rows.select(narrative.model_setup(F.col("lines"), F.col("a"), F.col("b"), F.col("m"))).collect()]
    assert got == [(0, 8000), (20_000, 40_000), None, None]
    folder = str(tmp_path / "kept")
    store.save(spark.range(40).select((F.col("id") % 2).alias("media_id"), "id"), folder, "id")
    store.save(spark.range(3).select(F.lit(1).cast("long").alias("media_id"), "id"), folder, "id")
    assert store.load(spark, folder, [1]).count() == 3 and store.load(spark, folder, [0]).count() == 20
    spark.conf.set("spanloom.hook_anchor", "off")
    spark.conf.set("spanloom.min_ms", "9000")
    assert store.Settings.read(spark) == store.Settings(min_ms=9000, hook_anchor=False)
    spark.conf.unset("spanloom.hook_anchor")
    spark.conf.unset("spanloom.min_ms")


def test_caption_wrap_covers_whole_texts(spark, sf):
    from spanloom.plans import queries as plans

    got = {}
    for r in plans.Q["q_caption_wrap"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["line"], r["first"], r["n"]))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("w")).collect():
        lines = []
        for i, w in enumerate(r["w"]):
            if lines and len(" ".join(r["w"][lines[-1][0] : i + 1])) <= 24:
                lines[-1][1] += 1
            else:
                lines.append([i, 1])
        if lines:
            want[r["doc_id"]] = [(k, a, n) for k, (a, n) in enumerate(lines)]
    assert {k: sorted(v) for k, v in got.items()} == want and max(len(x) for x in want.values()) > 40
