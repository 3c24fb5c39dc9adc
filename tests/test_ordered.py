"""Chains over the rows of a medium: the same rows as a pass over whole lists, in the memory of a window or a phrase."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import chunks
from spanloom.operators.ordered import ordered

SEGMENTS = "media_id long, seg_id long, text string, start_ms long, end_ms long, n_words long"


def _segments(seed, media=6):
    rng, rows = random.Random(seed), []
    for m in [*range(media), None]:
        t = 0
        for i in range(rng.choice([0, 1, 2, 40, 400])):
            t += rng.choice([0, 0, 200, 700, 30_000])
            n = rng.choice([500, 2_000, 9_000, 50_000, 120_000])
            rows.append((m, i, f"s{i}", t, t + n, rng.randint(1, 9)))
            t += n
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_whole_lists(spark, seed):
    rows = _segments(seed)
    got = sorted((str(r["media_id"]), r["w_index"], r["chunk_id"], r["text"], r["start_ms"], r["end_ms"], r["n_words"], r["first_seg"], r["last_seg"]) for r in chunks.windows(spark.createDataFrame(rows, SEGMENTS).repartition(3)).collect())
    want = []
    for m in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == m]
        found = chunks.window_bounds(np.array([r[3] for r in mine]), np.array([r[4] for r in mine]), 45_000, 0.5, 90_000, 15_000)
        want += [(str(m), k, f"chunk-{k:05d}", " ".join(r[2] for r in mine[a : b + 1]), mine[a][3], mine[b][4], sum(r[5] for r in mine[a : b + 1]), a, b) for k, (a, b) in enumerate(found)]
    assert got == sorted(want)


def test_long_media_take_the_memory_of_a_window():
    chain, phrases = chunks.WindowChain(45_000, 0.5, 90_000, 15_000), chunks.SlotChain()
    tracemalloc.start()
    given = slots = 0
    for i in range(150_000):
        given += len(chain.add(i * 3000, i * 3000 + 2800, "a sentence of words", 4, i))
        slots += len(phrases.add(i * 300, i * 300 + 250, i, "word" if i % 9 else "end."))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert given > 15_000 and slots > 140_000 and len(chain.start) < 40 and most < 5_000_000
    assert len(chain.close()) >= 1 and len(phrases.close()) >= 1


@pytest.mark.parametrize("seed", range(3))
def test_slots_tile_their_phrase(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 20, 90, 400])
        n = rng.choice([30, 100, 300])
        rows.append((1, i, rng.choice(["a", "word", "sentence.", "no!", "considerable"]), t, t + n))
        t += n if rng.random() < 0.8 else n // 2
    words = spark.createDataFrame(rows, "media_id long, w_idx int, word string, start_ms long, end_ms long")
    one = sorted(map(tuple, chunks.caption_events_of(words).collect()))
    assert one == sorted(map(tuple, chunks.caption_slots(chunks.caption_phrases(words)).collect()))  # in one pass or in two
    phrases = {r["phrase"]: r for r in chunks.caption_phrases(words).groupBy("phrase").agg(F.min("start_ms").alias("s"), F.max("phrase_end_ms").alias("e"), F.count("*").alias("n")).collect()}
    for p, r in phrases.items():
        mine = sorted((x for x in one if x[1] == p), key=lambda x: x[3])
        assert mine[0][3] == r["s"] and mine[-1][4] >= r["e"] and all(a[4] == b[3] for a, b in zip(mine, mine[1:]))
        assert [x[6] for x in mine] == [True] + [False] * (len(mine) - 1) and [x[7] for x in mine][::-1] == [True] + [False] * (len(mine) - 1)
        assert len(mine) == 1 or all(x[4] - x[3] >= chunks.SHORTEST_MS for x in mine[:1])


def test_ordered_keeps_keys_apart_and_in_order(spark):
    class Chain:
        def __init__(self):
            self.seen = []

        def add(self, v):
            self.seen.append(v)
            return [(len(self.seen), v)] if v % 2 else []

        def close(self):
            yield -1, sum(self.seen)

    rows = [(k, v) for k in ["a", "b", None] for v in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = ordered(df, "k", [F.desc("v")], ["v"], Chain, "n int, v long").collect()
    for k in ["a", "b", None]:
        mine = [(r["n"], r["v"]) for r in got if r["k"] == k]
        assert mine == [(i + 1, 999 - i) for i in range(0, 1000, 2)] + [(-1, 499_500)]
    assert ordered(df.limit(0), "k", ["v"], ["v"], Chain, "n int, v long").count() == 0


class _Counted(chunks.SlotPass):
    """Holds what the pass holds at most."""

    def step(self, batch, names):
        out = super().step(batch, names)
        assert self.rest is None or self.rest.num_rows <= self.most_words
        return out


@pytest.mark.parametrize("seed", range(6))
def test_phrases_over_columns_equal_the_chain(seed):
    rng, rows = random.Random(seed), []
    for key in [None, 3, 4, 5, 6, 7]:
        t = rng.randrange(0, 500)
        for i in range(rng.choice([1, 2, 3, 5, 90, 700])):
            n = rng.choice([30, 100, 300])
            rows.append((key, t, t + n, i, rng.choice(["a", "wörd", "end.", "no!", "considerably", "x" * 30, "", "."])))
            t += rng.choice([0, 20, 90, 400])
    kinds = pa.schema([("k", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("w_idx", pa.int32()), ("word", pa.string())])
    slots = pa.schema([("k", pa.int64()), ("phrase", pa.int64()), ("text", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("active", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_())])
    words = pa.schema([*kinds, ("phrase", pa.int64()), ("place", pa.int32()), ("phrase_end_ms", pa.int64())])
    for new, plain, names in ((_Counted, chunks.SlotChain, slots), (chunks.PhrasePass, chunks.PhraseChain, words)):
        want = []
        for key, mine in itertools.groupby(rows, lambda r: r[0]):
            chain = plain()
            want += [(key, *x) for r in mine for x in chain.add(*r[1:])] + [(key, *x) for x in chain.close()]
        for size in (1, 2, 7, 64, 10_000):  # batches cut phrases and keys anywhere
            pass_, got = new(), []
            for i in range(0, len(rows), size):
                columns = zip(*rows[i : i + size])
                got.append(pass_.step(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), names))
            got.append(pass_.step(None, names))
            assert [tuple(r.values()) for b in got if b is not None for r in b.to_pylist()] == want
        assert new().step(None, names) is None
