"""What is picked: suppression in rounds against the fold, the final clips, clip times against a plain form."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals, retrieval

SPANS = "media_id string, id long, start_ms long, end_ms long, score double"


def _spans(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for m in ["a", "b", "c"]:
        for i in range(n if m == "a" else 12):
            s = rng.randrange(0, 60_000 if seed % 2 else 900_000)
            rows.append((m, i, s, s + rng.choice([0, 500, 4000, 90_000]), float(rng.choice([1, 2, 3]) if seed < 2 else rng.random())))
    return rows


def plain_suppress(rows, most):
    out = {}
    for m, i, s, e, score in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        kept = out.setdefault(m, [])
        clash = lambda k: min(e - s, k[2] - k[1]) > 0 and max(0, min(e, k[2]) - max(s, k[1])) / min(e - s, k[2] - k[1]) > most
        if not any(map(clash, kept)):
            kept.append((i, s, e))
    return {(m, n, k[0]) for m, kept in out.items() for n, k in enumerate(kept, 1)}


@pytest.mark.parametrize("seed,most", [(0, 0.5), (1, 0.0), (3, 0.5)])
def test_rounds_equal_the_fold(spark, seed, most):
    rows = _spans(seed)
    df = spark.createDataFrame(rows, SPANS).repartition(3)
    want = plain_suppress(rows, most)
    for fold in (1, 50, 1000) if seed == 0 else (50,):  # all in rounds, the large one in rounds, none
        got = [(r["media_id"], r["rank"], r["id"]) for r in retrieval.suppress(df, "score", most, fold=fold).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rounds_settle_a_chain_and_keep_what_has_no_rival(spark):
    chain = [("a", i, i * 1000, i * 1000 + 1900, float(-i)) for i in range(9)] + [("z", 1, 0, 10, 0.0)]
    got = {(r["media_id"], r["id"]) for r in retrieval.suppress(spark.createDataFrame(chain, SPANS), "score", 0.2, fold=0).collect()}
    assert got == {("a", i) for i in range(0, 9, 2)} | {("z", 1)}
    assert retrieval.suppress(spark.createDataFrame([], SPANS), "score", 0.5, fold=0).count() == 0


def test_selection_drops_fragments_unless_none_is_left(spark):
    rows = [("a", 1, 0, 10_000, 9.0), ("a", 2, 20_000, 40_000, 5.0), ("a", 3, 21_000, 41_000, 4.0), ("a", 4, 100_000, 250_000, 1.0), ("b", 1, 0, 9_000, 2.0), ("b", 2, 500, 9_500, 3.0)]
    clips = spark.createDataFrame(rows, SPANS).withColumn("duration", (F.col("end_ms") - F.col("start_ms")) / 1000)
    pick = lambda **k: {(r["media_id"], r["rank"], r["id"]) for r in retrieval.select_clips(clips, **k).collect()}
    assert pick() == {("a", 1, 2), ("a", 2, 4), ("b", 1, 2)}  # 3 nearly repeats 2; b has fragments alone
    assert pick(count=1, spread=False) == {("a", 1, 2), ("b", 1, 2)}
    assert retrieval.select_clips(clips.limit(0)).count() == 0


def test_merging_probes_keeps_the_distance_of_the_best_hit(spark):
    hits = spark.createDataFrame([(1, 7, 0.5, 0.51), (2, 7, 0.8, 0.2), (3, 7, 0.8, 0.19), (1, 8, 0.0, 1.4)], "probe int, id int, relevance double, distance double")
    got = {r["id"]: r["distance"] for r in retrieval.merge_probes(hits, 3).collect()}
    assert got == {7: 0.2, 8: 1.4}


@pytest.mark.parametrize("seed", range(3))
def test_clip_times_equal_plain(spark, seed):
    rng, spans, times = random.Random(seed), [], []
    for m in range(8):
        t = 0
        for _ in range(m % 4):
            t += rng.choice([0, 0, 700, 5000])
            n = rng.choice([1, 400, 3000])
            spans.append((m, t, t + n))
            t += n
        spans.append((m, 50, 50)) if m % 2 else None  # empty ones are left out
        times += [(m, i, rng.randrange(-500, 16_000)) for i in range(30)] + [(m, 100 + i, x) for i, x in enumerate(v for s in spans if s[0] == m for v in s[1:])]
    got = {(r["media_id"], r["t_id"]): (r["clip_ms"], r["clamped_ms"]) for r in intervals.clip_times(spark.createDataFrame(times, "media_id long, t_id long, t_ms long"), spark.createDataFrame(spans, "media_id long, start_ms long, end_ms long")).collect()}
    assert len(got) == len(times)
    for m, i, t in times:
        mine = sorted(s[1:] for s in spans if s[0] == m and s[2] > s[1])
        before, edges, inside = 0, [], None
        for s, e in mine:
            if inside is None and s <= t <= e:
                inside = before + t - s
            edges += [(abs(t - s), len(edges), before), (abs(t - e), len(edges) + 1, before + e - s)]
            before += e - s
        assert got[m, i] == (inside, inside if inside is not None else min(edges)[2] if edges else 0)


def test_suppression_writes_no_rounds_and_remembers_a_moment(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    df, before = spark.createDataFrame(_spans(0), SPANS), jobs()
    retrieval.suppress(df, "score", 0.5, fold=1)
    assert jobs() == before  # a plan alone: candidates aren't run again for sizes and rounds
    rng, chain, held = random.Random(1), retrieval.Suppression(0.3, 5), 0
    rows = [("a", i, i * 1000, i * 1000 + rng.choice([0, 1500, 2500]), float(rng.randrange(50))) for i in range(5000)]
    got = []
    for m, i, s, e, score in rows:
        got += chain.add(-score, i, s, e)
        held = max(held, len(chain.open))
    got += chain.close()
    assert {i for i, _ in got} == {i for _, _, i in plain_suppress(rows, 0.3)} and len(got) == len(set(got)) and held < 8
