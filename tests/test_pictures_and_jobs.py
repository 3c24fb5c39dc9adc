"""Pictures, captions, saved jobs and streams against numpy, plain Python or hand-made cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import chunks, framing, jobs, people, replay, retrieval
from spanloom.sources import store, views
from spanloom.streaming import live
from test_operators import WORDS, word_rows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def spans_of(pairs):
    return F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(e)).alias("e")) for s, e in pairs])


def test_sample_times(spark):
    got = one(spark, framing.sample_times(spans_of([(10, 20), (40, 50)]), 4))
    assert got == pytest.approx([12.5, 17.5, 42.5, 47.5])
    assert one(spark, framing.sample_times(spans_of([(5, 5)]), 3)) == []


@pytest.mark.parametrize("size", [1, 3, 4, 7])
def test_smooth_and_unit(spark, size):
    v = [0.0, 1.0, 4.0, 2.0, 8.0, 3.0, 1.0, 9.0]
    col = F.array(*map(F.lit, v))
    assert one(spark, framing.smooth(col, F.lit(size))) == pytest.approx(list(np.convolve(v, np.ones(size) / size, mode="same")))
    assert one(spark, framing.unit(col)) == pytest.approx([x / 9 for x in v]) and one(spark, framing.unit(F.array(F.lit(2.0), F.lit(2.0)))) == [0, 0]


def test_column_scores_and_subject(spark):
    rng = np.random.default_rng(3)
    rows, grey = [], {}
    for clip in range(3):
        frames = rng.integers(0, 20, (4, 6, 40)).astype(float)
        frames[:, :, 28:34] += rng.integers(0, 200, (4, 6, 6))
        grey[clip] = frames
        rows += [(clip, t, y, [float(x) for x in frames[t, y]]) for t in range(4) for y in range(6)]
    rows += [(9, 0, 0, [1.0, 2.0, 3.0]), (9, 0, 1, [1.0, 5.0, 3.0])]
    pixels = spark.createDataFrame(rows, "clip int, sample int, y int, row array<double>")
    got = {r["clip"]: r["scores"] for r in framing.column_scores(pixels).collect()}
    scale = lambda v: (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else v * 0
    for clip, f in grey.items():
        want = 0.5 * scale(np.abs(np.diff(f, axis=1)).sum((0, 1))) + 0.5 * scale(np.abs(np.diff(f, axis=0)).sum((0, 1)))
        assert got[clip] == pytest.approx(list(np.convolve(want, np.ones(3) / 3, mode="same")))
    centres = {r["clip"]: r["centre"] for r in framing.subject_x(pixels, 0.3).collect()}
    assert set(centres) == {0, 1, 2} and all(0.6 < x < 0.9 for x in centres.values())  # one sample says nothing


def test_crop_box(spark):
    box = lambda w, h, c: one(spark, framing.crop_box(F.lit(w), F.lit(h), 1080, 1920, F.lit(c).cast("double")))
    assert tuple(box(1920, 1080, None)) == (608, 1080, 656, 0) and tuple(box(1920, 1080, 0.0))[2] == 0 and tuple(box(1920, 1080, 1.0))[2] == 1312
    assert box(1080, 1920, 0.5) is None and box(0, 10, 0.5) is None


def test_shots_and_cuts(spark):
    track = spark.createDataFrame([(1, 0, 0, 3000, 0.5), (1, 1, 3000, 9000, 0.5), (1, 2, 9000, 15_000, 0.4)], "media_id long, shot int, start_ms long, end_ms long, x double")
    found = spark.createDataFrame([(1, 0, 0, 3000, 0.9), (1, 1, 0, 2000, 0.2), (1, 1, 2000, 6000, 0.8)], "media_id long, shot int, start_ms long, end_ms long, x double")
    got = sorted(tuple(r)[1:] for r in framing.refined_shots(track, found).collect())
    assert got == [(0, 0, 3000, 0.5), (1, 3000, 5000, 0.2), (1, 5000, 9000, 0.8), (2, 9000, 15_000, 0.4)]
    logs = spark.createDataFrame([(1, 9000, "x pts_time:1.5 y pts_time:12 pts_time:0 pts_time: 3.25 pts_time:1.5"), (2, 9000, None)], "media_id long, length_ms long, log string")
    assert sorted(r["cut_ms"] for r in framing.cut_times(logs).collect()) == [1500, 3250]


def test_boxes_slices_and_speakers(spark):
    v = [10.0, 20.0, 30.0, 40.0, *map(float, range(10)), 0.9]
    b = people.boxes(spark.createDataFrame([("f", v, 100, 200), ("g", v, 0, 200)], "name string, values array<double>, width int, height int")).collect()
    assert len(b) == 1 and (b[0]["x"], b[0]["y"], b[0]["w"], b[0]["h"], b[0]["score"]) == (0.1, 0.1, 0.3, 0.2, 0.9) and tuple(b[0]["mouth"][1]) == (0.08, 9 / 200)
    shots = spark.createDataFrame([(1, 5000), (2, 4000), (3, 0), (4, 6000)], "shot long, length_ms long")
    assert sorted(tuple(r) for r in people.slices(shots).collect() if r["shot"] < 3) == [(1, 0, 0, 2000), (1, 1, 2000, 4000), (1, 2, 4000, 5000), (2, 0, 0, 2000), (2, 1, 2000, 4000)]
    # shot 1: person 0 talks, then person 1; shot 2: nobody speaks; shot 4: one person only
    frames, moved = [], []
    for shot, until in ((1, 5000), (2, 4000), (4, 6000)):
        for t in range(0, until, 250):
            frames.append((shot, t, shot != 2))
            for person in (0, 1) if shot != 4 else (0,):
                talks = (t < 2000) == (person == 0)
                moved += [(shot, person, "mouth", t, 0.8 if talks else 0.1), (shot, person, "face", t, 0.1)]
    places = [(1, 0, 0.2), (1, 1, 0.7), (2, 0, 0.2), (2, 1, 0.7), (4, 0, 0.5)]
    got = people.follow_speakers(
        shots, spark.createDataFrame(frames, "shot long, t_ms long, speaking boolean"), spark.createDataFrame(moved, "shot long, person int, region string, t_ms long, moved double"), spark.createDataFrame(places, "shot long, person int, x double")
    ).orderBy("shot", "turn").collect()
    assert [tuple(r)[:1] + tuple(r)[2:] for r in got] == [(1, 0, 2000, 0.2), (1, 2000, 5000, 0.7)]


def test_caption_events_and_document(spark):
    rows = chunks.caption_phrases(spark.createDataFrame(word_rows(1, "one {two} three four five six", 300), WORDS))
    slots = chunks.caption_slots(rows)
    clips = spark.createDataFrame([(1, 1450), (2, 900)], "media_id long, length_ms long")
    events = chunks.caption_events(slots, clips)
    got = events.orderBy("start_ms").collect()
    assert max(r["end_ms"] for r in got) <= 1450 and all(r["end_ms"] - r["start_ms"] >= 40 for r in got) and len(got) < slots.count()
    flat = chunks.collapsed(events).orderBy("n").collect()
    assert [r["text"] for r in flat] == ["one {two} three four", "five six"] and flat[0]["start_ms"] == 0 and flat[-1]["end_ms"] == got[-1]["end_ms"]
    docs = {r["media_id"]: r["document"] for r in chunks.ass_document(events, clips).collect()}
    head, body = docs[1].split("Effect, Text\n")
    assert "PlayResX: 1080" in head and "Style: Pop,Arial Black,92," in head and docs[2] == head + "Effect, Text\n"
    lines = body.splitlines()
    assert lines[0] == r"Dialogue: 0,0:00:00.00,0:00:00.30,Pop,,0,0,0,,{\fad(90,0)}{\c&H0047E3FF&}one{\c&H00FFFFFF&} \{two\} three four"
    assert r"{\c&H0047E3FF&}\{two\}{\c&H00FFFFFF&}" in lines[1] and "fad" not in lines[1] and len(lines) == len(got)


def test_windows_split_inside(spark):
    text = " ".join(f"word{k:03d}" for k in range(500))
    words = spark.createDataFrame(word_rows(1, text, 300), WORDS)
    found = spark.createDataFrame([(1, 0, 0, 120_000), (1, 1, 120_000, 150_000)], "media_id long, w_index int, start_ms long, end_ms long")
    got = {}
    for r in chunks.split_windows(found, words, 1200, 100).collect():
        got.setdefault(r["w_index"], []).append((r["piece"], r["first_word"], r["last_word"]))
    assert got[1] == [(0, 400, 499)] and len(got[0]) == 3
    pieces = sorted(got[0])
    assert pieces[0][1] == 0 and pieces[-1][2] == 399 and all(a[1] < b[1] <= a[2] + 1 and 8 * (a[2] - a[1] + 1) <= 1208 for a, b in zip(pieces, pieces[1:]))


def test_segments_and_their_words(spark):
    schema = "media_id long, id int, start double, end double, text string, words array<struct<word:string,start:double,end:double,prob:double>>, duration double"
    raw = spark.createDataFrame([(1, 0, 0.00049, 1.23456, " hi you ", [("hi", 0.0, 0.4004, 0.99999), (" you", 0.5, None, 0.5)], 4.0), (1, 1, 2.0, 3.0, "all in one", None, 4.0), (1, 2, 3.0, 9.0, "  ", [], 4.0)], schema)
    rows = views.segments(raw).orderBy("id").collect()
    assert [(r["start"], r["end"], r["text"], r["progress"]) for r in rows] == [(0.0, 1.235, "hi you", 1.235 / 4), (2.0, 3.0, "all in one", 0.75)]
    assert [tuple(w) for w in rows[0]["words"]] == [("hi", 0.0, 0.4, 1.0)]
    said = views.segment_words(views.segments(raw)).orderBy("w_idx").collect()
    assert [tuple(r)[1:] for r in said] == [(0, "hi", 0, 400), (1, "all in one", 2000, 3000)]
    assert views.segment_words(views.segments(raw), whole=False).count() == 1
    kept = views.metadata(spark.createDataFrame([(1, 0, 1500, 4000, None)], "media_id long, w_index int, start_ms long, end_ms long, n_words int")).first()
    assert tuple(kept)[2:] == (1.5, 4.0, 2.5, 0)
    pair = one(spark, views.as_spans(F.lit(1), F.lit(2), F.lit(None).cast("array<struct<s:double,e:double>>")))
    many = one(spark, views.as_spans(F.lit(None), F.lit(None), spans_of([(5, 9), (1, 2), (4, 3)])))
    assert [tuple(p) for p in pair] == [(1, 2)] and [tuple(p) for p in many] == [(1, 2), (5, 9)]


def test_saved_jobs_are_cut_again(spark, tmp_path):
    rng, t, segments = random.Random(2), 0.0, []
    for k in range(40):
        words = [{"word": w, "start": round(t + i * 0.3, 3), "end": round(t + i * 0.3 + 0.3, 3)} for i, w in enumerate([rng.choice(["we", "go", "on"]) for _ in range(7)] + [f"n{k}."])]
        segments.append({"id": k, "start": words[0]["start"], "end": words[-1]["end"], "text": " ".join(w["word"] for w in words), "words": words})
        t = words[-1]["end"] + 0.6
    hook = segments[10]["text"]
    clips = [{"id": "a", "title": "A", "start": segments[6]["start"] + 1, "end": segments[14]["end"] - 1, "hook": hook}, {"id": "b", "title": "B", "start": 0, "end": 1, "spans": [{"start": segments[20]["start"], "end": segments[27]["end"]}]}]
    job = {"id": "job1", "source": "s", "status": "running", "transcript": segments, "clips": clips, "stats": {"duration": t}}
    folder = f"file://{tmp_path}/jobs"
    path = tmp_path / "raw.json"
    path.write_text(json.dumps(job) + "\n" + json.dumps({**job, "id": "job2", "transcript": []}) + "\n")
    schema = views.segments_of_jobs(spark, f"file://{path}").schema
    store.save_jobs(spark.read.schema(schema).json(f"file://{path}"), folder)
    rows = spark.read.schema(schema).json(folder)
    assert {r["status"] for r in rows.collect()} == {"done"} and rows.count() == 2
    never = C.contains_any(F.col("text"), ["no such phrase"])
    got = {r["id"]: r for r in replay.replayed(rows, never, never).collect()}
    assert set(got) == {0, 1}  # job2 has no words
    assert got[0]["ends_on_sentence"] and not got[0]["mid_word_cut"] and not got[0]["under_minimum"] and got[0]["hook_found"] and 0 <= got[0]["seconds_to_hook"] <= 5
    assert got[1]["ends_on_sentence"] and not got[1]["hook_found"] and got[1]["duration"] == pytest.approx(segments[27]["end"] - segments[20]["start"], abs=1.5)
    from spanloom.operators import composing

    report = {r["media_id"]: r for r in composing.report(replay.replayed(rows, never, never)).collect()}
    assert report[None]["clips"] == 2 and report["job1"]["lengths"] == sorted([got[0]["duration"], got[1]["duration"]]) and report[None]["lengths"] is None


def test_public_jobs(spark):
    rows = spark.createDataFrame([("a", "running", "index", 0.123456, "t"), ("b", "done", None, None, "t")], "id string, status string, stage string, stage_progress double, transcript string")
    got = {r["id"]: r for r in jobs.public(rows).collect()}
    assert got["a"]["progress"] == round((2 + 0.123456) / 6, 4) and got["b"]["progress"] == 1.0 and "transcript" not in got["a"].asDict()
    assert "transcript" in jobs.public(rows, True).columns


def test_texts_are_files(spark, tmp_path):
    store.save_texts(spark.createDataFrame([(1, "a\nb"), (2, "c")], "media_id long, doc string"), f"file://{tmp_path}/t", "doc")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["media_id=1", "media_id=2"]
    assert next((tmp_path / "t" / "media_id=1").glob("*.txt")).read_text() == "a\nb\n"


def test_window_stream_equals_the_batch_form(spark, tmp_path):
    rng, rows = random.Random(6), []
    for m in range(4):
        at = 0
        for i in range(rng.randrange(3, 40)):
            n = rng.choice([500, 4000, 9000, 30_000, 120_000])
            rows.append((m, i, f"s{m}-{i}", at, at + n, False))
            at += n + rng.choice([0, 200, 5000])
        rows.append((m, 10_000, None, at, at, True))
    schema = "media_id long, seg_id long, text string, start_ms long, end_ms long, final boolean"
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([], schema).write.parquet(folder)
    out = f"file://{tmp_path}/out"
    for k in range(0, len(rows), 9):  # files come one after another, as a medium is decoded
        spark.createDataFrame(rows[k : k + 9], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = live.window_stream(spark.readStream.schema(schema).parquet(folder))
        live.drained(stream, folder=out, stateful=True)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/rows").collect())
    batch = chunks.windows(spark.createDataFrame([r[:5] + (1,) for r in rows if not r[5]], "media_id long, seg_id long, text string, start_ms long, end_ms long, n_words int"))
    want = sorted((r["media_id"], r["w_index"], r["text"], r["start_ms"], r["end_ms"], r["first_seg"], r["last_seg"]) for r in batch.collect())
    assert got == want and len(want) > 8


def test_append_batches_index_each_row_once(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.range(10).write.parquet(folder)
    run = lambda: live.append_batches(spark.readStream.schema("id long").parquet(folder), f"file://{tmp_path}/index", f"file://{tmp_path}/state", lambda df: df.withColumn("v", F.col("id") * 2))
    run()
    spark.range(10, 15).write.mode("append").parquet(folder)
    run()
    run()
    got = spark.read.parquet(f"file://{tmp_path}/index")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(i, 2 * i) for i in range(15)]


def test_snapshot_then_tail(spark):
    schema = "job string, seq long, kind string, value string"
    history = spark.createDataFrame([("a", 1, "progress", "0.1"), ("a", 3, "progress", "0.5"), ("a", 2, "message", "x"), ("b", 1, "done", "ok")], schema)
    tail = spark.createDataFrame([("a", 3, "progress", "0.5"), ("a", 4, "progress", "0.9"), ("a", 5, "done", "ok"), ("a", 6, "message", "late"), ("b", 2, "message", "late"), ("c", 1, "progress", "0")], schema)
    got = sorted((r["job"], r["part"], r["seq"], r["kind"]) for r in live.snapshot_then_tail(history, tail).collect())
    assert got == [("a", "event", 4, "progress"), ("a", "event", 5, "done"), ("a", "snapshot", 2, "message"), ("a", "snapshot", 3, "progress"), ("b", "snapshot", 1, "done"), ("c", "event", 1, "progress")]


def test_final_suppression(spark):
    rows = [(1, 0, 90.0, 0, 60_000), (1, 1, 80.0, 40_000, 100_000), (1, 2, 70.0, 55_000, 115_000)]
    got = retrieval.suppress(spark.createDataFrame(rows, "media_id int, id int, score double, start_ms long, end_ms long"), "score", 0.35)
    assert sorted((r["rank"], r["id"]) for r in got.collect()) == [(1, 0), (2, 1)]
