"""A store as a log of runs: what is written, what a reader sees, removals, merging, and writers that meet."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.sources import store


def _rows(spark, media, text, n=3):
    return spark.createDataFrame([(m, i, text) for m in media for i in range(n)], "media_id long, seg long, text string")


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def _held(spark, folder, media=None):
    return sorted((r["media_id"], r["seg"], r["text"]) for r in store.load(spark, folder, media).collect())


@pytest.mark.parametrize("seed", range(2))
def test_store_equals_a_dictionary(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(store, "MOST_RUNS", 4)
    rng, folder, want = random.Random(seed), str(tmp_path / "s"), {}
    for step in range(9):
        media = rng.sample(range(8), rng.randint(1, 4))
        if rng.random() < 0.3 and want:
            store.remove(spark, folder, spark.createDataFrame([(m,) for m in media], "media_id long"))
            want = {m: v for m, v in want.items() if m not in media}
        else:
            n = rng.randint(1, 3)
            store.save(_rows(spark, media, f"t{step}", n), folder, "seg")
            want |= {m: [(m, i, f"t{step}") for i in range(n)] for m in media}
    assert _held(spark, folder) == sorted(r for v in want.values() for r in v)
    some = list(want)[:2]
    assert _held(spark, folder, some) == sorted(r for m in some for r in want[m])
    assert len(store._live(spark, folder)[1]) <= 5


def test_a_save_writes_only_its_rows_and_readers_see_old_or_new(spark, tmp_path):
    folder = str(tmp_path / "s")
    first = _rows(spark, range(3000), "old").withColumn("text", F.concat(F.lit("old "), *(F.sha2(F.concat_ws(" ", "media_id", "seg", F.lit(k)), 256) for k in range(4))))
    store.save(first, folder, "seg")
    size = _bytes(folder)
    old = store.load(spark, folder)  # a reader that began before
    store.save(_rows(spark, [1], "new"), folder, "seg")
    assert _bytes(folder) - size < size / 20
    assert all(r["text"].startswith("old ") for r in old.where("media_id = 1").collect()) and {r["text"] for r in store.load(spark, folder, [1]).collect()} == {"new"}
    # a run that was never named, and a manifest that was cut off, are as if they weren't there
    _rows(spark, [1], "torn").withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{folder}/rows/run=torn")
    with open(f"{folder}/manifest/{99:012d}", "w") as f:
        f.write("torn\n")
    assert {r["text"] for r in store.load(spark, folder, [1]).collect()} == {"new"}
    store.save(_rows(spark, [2], "after"), folder, "seg")
    assert {r["text"] for r in store.load(spark, folder, [1, 2]).collect()} == {"new", "after"}


def test_of_two_writers_one_is_first(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    store.save(_rows(spark, [1], "a"), folder, "seg")
    version, runs = store._live(spark, folder)
    assert store._publish(spark, folder, version + 1, [*runs]) and not store._publish(spark, folder, version + 1, [])
    real, meddled = store._publish, []

    def publish(*a):
        if not meddled:  # another writer commits between reading the manifest and writing it
            meddled.append(1)
            store.save(_rows(spark, [2], "b"), folder, "seg")
        return real(*a)

    monkeypatch.setattr(store, "_publish", publish)
    store.save(_rows(spark, [3], "c"), folder, "seg")
    monkeypatch.undo()
    assert {r[2] for r in _held(spark, folder)} == {"a", "b", "c"}
    before = _held(spark, folder)
    store.compact(spark, folder)
    assert len(store._live(spark, folder)[1]) == 1 and _held(spark, folder) == before


def test_a_deletion_reaches_every_table_and_new_columns_are_kept(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("segments", "windows", "never")]
    for f in folders[:2]:
        store.save(_rows(spark, [1, 2], f[-3:]), f, "seg")
    store.save(_rows(spark, [4], "x").withColumn("extra", F.lit(7)), folders[0], "seg")
    store.remove_everywhere(spark, folders, spark.createDataFrame([(1,), (1,), (9,)], "media_id long"))
    assert {r[0] for r in _held(spark, folders[0])} == {2, 4} and {r[0] for r in _held(spark, folders[1])} == {2}
    assert {r["extra"] for r in store.load(spark, folders[0]).collect()} == {None, 7}
    with pytest.raises(FileNotFoundError):
        store.load(spark, folders[2])
