"""Streams with state: windows under any split into files, late and silent media, a tail with a snapshot, an index that is stopped and started again."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chunks
from spanloom.streaming import live

SEGMENTS = "media_id long, seg_id long, text string, start_ms long, end_ms long, final boolean, ts timestamp"
COLUMNS = ["media_id", "w_index", "text", "start_ms", "end_ms", "first_seg", "last_seg"]


def _talks(seed, media=4):
    rng, rows = random.Random(seed), []
    for m in range(media):
        t = 0
        for i in range(rng.choice([3, 30, 60])):
            n = rng.choice([2000, 9000, 30_000])
            rows.append([m, i, f"s{m}.{i}", t, t + n])
            t += n + 300
    return rows


def _write(spark, rows, folder, name, final=(), at="2024-01-01 00:00:00"):
    rows = [(*r, False) for r in rows] + [(m, 10_000, None, 10**9, 10**9, True) for m in final]
    spark.createDataFrame(rows, SEGMENTS.rsplit(", ", 1)[0]).withColumn("ts", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _read(spark, folder):
    return spark.readStream.schema(SEGMENTS).option("recursiveFileLookup", "true").parquet(folder)


def _batch(spark, rows):
    segs = spark.createDataFrame([(*r, 1) for r in rows], "media_id long, seg_id long, text string, start_ms long, end_ms long, n_words long")
    return sorted(map(tuple, chunks.windows(segs).select(COLUMNS).collect()))


@pytest.mark.parametrize("cuts", [[], [40], [10, 11, 75]])
def test_windows_equal_batch_under_any_split(spark, tmp_path, cuts):
    rows = _talks(len(cuts))
    random.Random(7).shuffle(rows)  # media come mixed, each in order
    rows.sort(key=lambda r: r[1])
    media = {r[0] for r in rows}
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        _write(spark, rows[a:b], f"{tmp_path}/in", f"f{k}", media if b == len(rows) else ())
        out = live.drained(live.window_stream(_read(spark, f"{tmp_path}/in")), folder=f"{tmp_path}/out", stateful=True)
    assert sorted(map(tuple, out.select(COLUMNS).collect())) == _batch(spark, rows)


def test_a_late_segment_takes_its_place_and_a_silent_medium_is_closed(spark, tmp_path):
    rows = [[1, i, f"s{i}", i * 5000, i * 5000 + 4800] for i in range(6)] + [[2, i, f"t{i}", i * 9000, i * 9000 + 8000] for i in range(3)]
    early = [r for r in rows if r[:2] != [1, 2]]
    kind = dict(silent="1 minute", silent_ms=120_000)
    _write(spark, early, f"{tmp_path}/in", "a")
    run = lambda: live.drained(live.window_stream(_read(spark, f"{tmp_path}/in"), **kind), folder=f"{tmp_path}/out", stateful=True)
    assert run().count() == 0  # nothing is filled yet
    _write(spark, [r for r in rows if r[:2] == [1, 2]], f"{tmp_path}/in", "b", at="2024-01-01 00:00:30")
    run()
    _write(spark, [[3, 0, "u", 0, 50_000]], f"{tmp_path}/in", "c", at="2024-01-01 01:00:00")  # an hour later the watermark passes both
    run()
    _write(spark, [[3, 1, "u", 51_000, 52_000]], f"{tmp_path}/in", "d", at="2024-01-01 01:00:01")
    got = sorted(map(tuple, run().where("media_id < 3").select(COLUMNS).collect()))
    assert got == _batch(spark, rows) and "s1 s2 s3" in got[0][2]


def test_tail_begins_behind_its_snapshot_and_ends_with_the_job(spark, tmp_path):
    kind = "job long, seq long, kind string, value double"
    events = [(1, 1, "log", 0.1), (1, 2, "log", 0.2), (1, 3, "done", 1.0), (1, 4, "log", 9.0), (2, 1, "log", 0.5), (2, 5, "log", 0.6), (2, 6, "error", 0.7), (2, 7, "log", 0.8), (3, 9, "log", 0.9)]
    history = spark.createDataFrame([e for e in events if e[:2] in ((1, 1), (1, 2), (1, 3), (2, 1))], kind)
    for k, part in enumerate((events[:6], events[6:])):
        spark.createDataFrame(part, kind).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = live.drained(live.tail_stream(history, stream), folder=f"{tmp_path}/out", stateful=True)
    assert sorted((r["job"], r["seq"]) for r in out.collect()) == [(2, 5), (2, 6), (3, 9)]
    assert sorted((r["job"], r["seq"], r["kind"]) for r in live.snapshot(history).collect()) == [(1, 2, "log"), (1, 3, "done"), (2, 1, "log")]


def test_index_is_written_once_across_a_stop(spark, tmp_path):
    def lengths():
        return lambda texts: [[float(len(t))] for t in texts]

    def fails():
        def embed(texts):
            raise RuntimeError("no model")

        return embed

    rows, index = _talks(3), f"{tmp_path}/index"
    media = {r[0] for r in rows}
    _write(spark, rows[:50], f"{tmp_path}/in", "a")
    live.index_stream(_read(spark, f"{tmp_path}/in"), index, f"{tmp_path}/state", lengths)
    # a batch that was written but not marked done runs again and replaces itself
    import shutil
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state" / "commits").glob(f"*{last}*"):
        p.unlink()
    live.index_stream(_read(spark, f"{tmp_path}/in"), index, f"{tmp_path}/state", lengths)
    _write(spark, rows[50:], f"{tmp_path}/in", "b", media)
    live.index_stream(_read(spark, f"{tmp_path}/in"), index, f"{tmp_path}/state", lengths)
    stored = spark.read.parquet(index)
    assert sorted(map(tuple, stored.select(COLUMNS).collect())) == _batch(spark, rows)
    assert all(r["embedding"] == [float(len(r["text"]))] for r in stored.collect())
    live.index_stream(_read(spark, f"{tmp_path}/in"), f"{tmp_path}/blind", f"{tmp_path}/state2", fails)
    blind = spark.read.parquet(f"{tmp_path}/blind")
    assert blind.count() == stored.count() and blind.where("embedding is not null").count() == 0
    shutil.rmtree(tmp_path / "blind")
