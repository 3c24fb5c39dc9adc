"""Words stay where their texts were dealt: only texts and small rows are shuffled. Lookups by buckets give what a plain search gives."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import composing, exclusions, transcript
from spanloom.plans import queries as plans
from spanloom.sources import views

BY_WORDS = ["q_subtract", "q_clamp_outside", "q_overlap_fraction", "q_mostly_outside", "q_excluded_seconds", "q_housekeeping", "q_brands", "q_prompt_lines", "q_captions", "q_asof_words", "q_snap", "q_setup"]
BY_CLIPS = ["q_compose", "q_grade", "q_finish_thought", "q_windows_split"]


def _shuffled(spark) -> int:
    """Records written to shuffles so far."""
    empty = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", BY_WORDS + BY_CLIPS)
def test_words_are_not_shuffled(spark, sf, name):
    words = views.words(spark, sf).count()
    before = _shuffled(spark)
    plans.Q[name](spark, sf).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < words / 2


def test_edges_at_against_a_plain_search(spark):
    rows = [(1, 0, "a", 500, 800), (1, 1, "b", 900, 45_000), (1, 2, "c", 46_000, 46_100), (1, 3, "d", 46_000, 46_300), (1, 4, "e", 300_000, 300_001), (2, 0, "f", 19_999, 20_000), (3, 0, "g", 30_000, 30_400)]
    words = spark.createDataFrame(rows, "media_id long, w_idx int, word string, start_ms long, end_ms long")
    times = [-70_000, 0, 500, 501, 800, 899, 900, 20_000, 30_000, 45_000, 46_000, 46_050, 46_300, 99_999, 100_000, 250_000, 300_000, 300_001, 9_000_000]
    asked = [(m, i, t) for m in (1, 2, 4) for i, t in enumerate(times)] + [(1, 7, 501)]
    got = transcript.edges_at(words, spark.createDataFrame(asked, "media_id long, t_id long, t_ms long")).collect()

    def plain(m, t):
        mine = [(s, e) for k, _, _, s, e in rows if k == m]
        last = max((w for w in mine if w[0] < t), default=None)
        inside = last if last and last[1] > t else (None, None)
        return (min((s for s, _ in mine if s >= t), default=None), max((e for _, e in mine if e <= t), default=None), *inside)

    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((m, i, t, *plain(m, t)) for m, i, t in asked), key=key)


def test_last_before_against_a_plain_search(spark):
    rows = [(1, 100, "a"), (1, 9_999, "b"), (1, 10_000, "c"), (1, 10_000, "b"), (1, 95_000, None), (2, 40_000, "x")]
    times = [-5.0, 99.0, 100.0, 9_999.5, 10_000.0, 50_000.0, 95_000.0, 1e9]
    asked = [(m, i, t) for m in (1, 2, 3) for i, t in enumerate(times)]
    got = composing.last_before(spark.createDataFrame(asked, "media_id long, id long, t_ms double"), spark.createDataFrame(rows, "media_id long, end_ms long, v string"), "v").collect()

    def plain(m, t):
        return max(((e, v or "") for k, e, v in rows if k == m and e <= t), default=(0, ""))[1] or None

    assert {(r[0], r[1]): r[2] for r in got} == {(m, i): plain(m, t) for m, i, t in asked}


def test_asks_need_no_other_words(spark):
    """A marker of three words, at the start, after a breath and far from any clause."""
    from spanloom.operators import exclusions

    text = "hit the bell now and then we go on . so please hit the bell and hit the bell".split()
    words = spark.createDataFrame([(1, i, w, i * 1000, i * 1000 + 900) for i, w in enumerate(text)], "media_id long, w_idx int, word string, start_ms long, end_ms long")
    got = [tuple(r) for r in exclusions.housekeeping_spans(words, ["hit the bell"], longest_ms=5000).orderBy("start_ms").collect()]
    assert got == [(1, 0, 5000), (1, 10_000, 15_000)]  # both later asks look back to the same word


def test_subject_filter_stays_small(spark):
    """The filter that posexplode brings along doesn't hold the scaling of whole arrays once a place."""
    from spanloom.operators import framing

    pixels = spark.range(64).select(F.floor(F.col("id") / 16).alias("clip"), (F.floor(F.col("id") / 4) % 4).alias("sample"), (F.col("id") % 4).alias("y"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.abs(F.sin(i * F.col("id")))).alias("row"))
    rows = framing.subject_x(pixels, 0.3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("lambdafunction") for line in plan.splitlines() if "Filter (size" in line) < 30
    assert rows.count() == 4


def test_exclusions_deal_texts_once(spark, sf):
    docs = views.table(spark, sf, "documents").count()
    before = _shuffled(spark)
    plans.Q["q_excluded"](spark, sf).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before <= docs  # sponsors and asks read the words of one shuffle


def test_a_name_is_kept_by_its_mentions_and_tells_a_passage(spark):
    texts = ["this is sponsored by acme today", "nothing", "acme again", "more on use code bolt", "at the end bolt"]
    rows = [(1, i, t, i * 4000, i * 4000 + 3000, 3) for i, t in enumerate(texts)] + [(1, 99, "acme", 900_000, 901_000, 1), (2, 0, "acme and bolt", 0, 9000, 3)]
    s = spark.createDataFrame(rows, "media_id long, sent_id long, text string, start_ms long, end_ms long, n_words int")
    how = dict(templates=[r"by (\w+)", r"code (\w+)"], domain=r"(\w+)\.com")
    assert {tuple(r) for r in exclusions.find_brands(s, ["sponsored"], **how).collect()} == {(1, "bolt")}  # mentions of acme lie too far apart
    got = exclusions.sponsor_spans(s, ["sponsored"], ["again"], **how).collect()
    assert [tuple(r) for r in got] == [(1, 0, 19_000, 5, "bolt")]


def test_splitting_deals_texts_once(spark, sf):
    docs = views.table(spark, sf, "documents").count()
    before = _shuffled(spark)
    rows = plans.Q["q_chunk_split"](spark, sf)
    rows.write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before <= docs  # neither words nor pieces are dealt again
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_pieces_against_a_plain_search(spark):
    """Texts at the limit and beyond it, empty words, words without text, texts that go over batches, and a key of two columns."""
    from spanloom.operators import chunks

    said = lambda n: [("ab. ", "c,", "", "defg;", "h", "ijklmnop")[(i * i + n) % 6].strip() for i in range(n)]
    texts = {(1, 0): said(3), (1, 1): said(200), (2, 0): ["x" * 20, "y" * 19], (2, 1): ["x" * 20, "y" * 20], (3, 7): said(25_000), (4, 0): ["z" * 300]}
    rows = [(a, b, i, w, 7 * i - i % 3, 7 * i + 5 + 11 * (i % 4)) for (a, b), ws in texts.items() for i, w in enumerate(ws)] + [(1, 1, 70, None, -9, 9_999_999)]
    words = spark.createDataFrame(rows, "media_id long, w_index int, w_idx int, word string, start_ms long, end_ms long").repartition(3)
    got = {tuple(r) for r in chunks.split_long(words, 40, 9, ("media_id", "w_index")).collect()}

    want = set()
    for (a, b), ws in texts.items():
        mine, at = [], 0
        for i, w in enumerate(ws):
            mine.append((at, at + len(w), i, 7 * i - i % 3, 7 * i + 5 + 11 * (i % 4)))
            at += len(w) + 1
        text, lo = " ".join(ws), 0
        for k, (s, e) in enumerate(chunks.split_text(text, 40, 9) if len(text) > 40 else []):
            while lo < len(mine) and mine[lo][1] <= s - 40:
                lo += 1
            held = [w for w in mine[lo : lo + 200] if w[0] < e and w[1] > s]
            if held:
                want.add((a, b, k, held[0][2], held[-1][2], min(w[3] for w in held), max(w[4] for w in held)))
    assert got == want and len(want) > 1000 and {r[:2] for r in want} == {(1, 1), (2, 1), (3, 7), (4, 0)}
