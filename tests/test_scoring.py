"""One candidate from its lines to a scored clip, and reviews of clips, on a talk with a known hook and a stub for the model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import scoring, transcript
from spanloom.plans.queries import LISTS
from test_operators import WORDS, word_rows

HOOK = "nobody believed this trick would ever work."
SCHEMA = "media_id long, id long, start_ms long, end_ms long, text string, retrieval_score double"


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(3)
    said = []
    for k in range(60):
        said += [HOOK] if k == 20 else [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(7)) + f" {k}."]
    words = spark.createDataFrame(word_rows(1, " ".join(said), 300, {i: 400 for i in range(7, 480, 8)}), WORDS).cache()
    sentences = transcript.sentences(words).cache()
    return words, sentences, sentences.orderBy("sent_id").collect()


def stub(answers):
    def factory():
        return lambda prompt: answers(prompt)

    return factory


def run(spark, talk, rows, answers, excluded=()):
    words, sentences, _ = talk
    ex = spark.createDataFrame(list(excluded), "media_id long, start_ms long, end_ms long")
    ends = sentences.groupBy("media_id").agg(F.max("end_ms").alias("end_ms"))
    out = scoring.score_candidates(spark.createDataFrame(rows, SCHEMA), words, sentences, ex, ends, stub(answers), C.contains_any(F.col("text"), ["no such reveal"]), LISTS, 15_000, 60_000)
    return {(r["media_id"], r["id"]): r for r in out.collect()}


def test_candidates_become_scored_clips(spark, talk):
    lines = talk[2]
    s, e = lines[18]["start_ms"], lines[26]["end_ms"]

    def answers(prompt):
        assert ">[" in prompt
        if "Untold" in prompt:
            return "I can't do that."
        return 'Sure: {"start_line": 0, "end_line": "9", "hook": "> Nobody believed this trick would ever work", "hook_line": 3, "title": " \\"A   title\\" ", "virality_score": "120", "hook_strength": 7.5, "tags": "#One, two", "reason": null} done'

    got = run(spark, talk, [(1, 0, s, e, "raw text", 0.8), (7, 1, 0, 20_000, "a medium without lines and a long text of more than sixty characters in all", 0.5)], answers)
    clip = got[1, 0]
    assert clip["scored_by"] == "model" and clip["title"] == "A title" and clip["virality"] == 100 and clip["final_score"] == 95.0
    assert clip["breakdown"]["hook_strength"] == 7.5 and clip["breakdown"]["shareability"] == 5 and clip["tags"] == ["one", "two"] and clip["reason"] == ""
    assert clip["hook_ms"] == lines[20]["start_ms"] and len(clip["spans"]) == 1
    a, b = clip["spans"][0]
    assert 0 <= lines[20]["start_ms"] - a <= 4000 and 15_000 <= b - a <= 69_000 and HOOK in clip["text"]
    alone = got[7, 1]
    assert alone["scored_by"] == "retrieval" and alone["final_score"] == 50.0 and alone["reason"] == "Retrieval-only score (no transcript lines in range)."
    assert [tuple(p) for p in alone["spans"]] == [(0, 20_000)] and len(alone["title"]) <= 60 and alone["breakdown"] is None


def test_a_model_without_json_is_asked_again_then_left_out(spark, talk):
    lines = talk[2]
    rows = [(1, 0, lines[5]["start_ms"], lines[9]["end_ms"], "text", 0.4)]
    again = run(spark, talk, rows, lambda p: '{"virality_score": 40}' if p.endswith("nothing else.") else "no json")
    assert again[1, 0]["scored_by"] == "model" and again[1, 0]["final_score"] == 40.0
    never = run(spark, talk, rows, lambda p: 1 / 0)
    assert never[1, 0]["scored_by"] == "retrieval" and "parseable" in never[1, 0]["reason"] and never[1, 0]["title"] == "text"


def test_thoughts_are_finished_clear_of_exclusions(spark):
    spans = spark.createDataFrame([(1, 0, 0, 20_000), (1, 1, 50_000, 60_000), (1, 2, 100_000, 105_000)], "media_id long, id long, start_ms long, end_ms long")
    ends = spark.createDataFrame([(1, 30_000), (1, 200_000)], "media_id long, end_ms long")
    ads = spark.createDataFrame([(1, 25_000, 28_000), (1, 99_000, 106_000)], "media_id long, start_ms long, end_ms long")
    got = {r["id"]: (r["start_ms"], r["end_ms"]) for r in scoring.finish_thought(spans, ends, ads).collect()}
    assert got == {0: (0, 25_000), 1: (50_000, 60_000), 2: (100_000, 105_000)}


def test_reviews_recut_only_what_measures_better(spark, talk):
    words, sentences, lines = talk
    spans = lambda a, b: [(float(lines[a]["start_ms"]), float(lines[b]["end_ms"]))]
    rows = [(1, i, s, HOOK) for i, s in enumerate([spans(12, 24), spans(20, 30), spans(12, 24), spans(12, 24)])]
    clips = spark.createDataFrame(rows, "media_id long, id long, spans array<struct<s:double,e:double>>, hook string")
    first = {i: sum(x["end_ms"] > rows[i][2][0][0] - 60_000 for x in []) for i in range(4)}  # lines are numbered from the first one around a clip
    around = {i: [x["sent_id"] for x in lines if x["end_ms"] > rows[i][2][0][0] - 60_000 and x["start_ms"] < rows[i][2][0][1] + 90_000] for i in first}
    bad = lambda i, a, b: json.dumps({"opens_on_hook": False, "contains_payoff": True, "has_housekeeping": True, "suggested_start_line": around[i].index(a), "suggested_end_line": around[i].index(b)})
    reviews = spark.createDataFrame([(1, 0, bad(0, 20, 30)), (1, 1, bad(1, 10, 30)), (1, 2, bad(2, 3, 12)), (1, 3, "no json")], "media_id long, id long, reply string")
    none = spark.createDataFrame([], "media_id long, start_ms long, end_ms long")
    never = C.contains_any(F.col("text"), ["no such phrase"])
    got = {r["id"]: r for r in scoring.apply_critique(clips, reviews, words, sentences, none, never, never).collect()}
    assert got[0]["upheld"] == ["opens_on_hook"] and got[0]["applied"] and abs(got[0]["spans"][0]["s"] - lines[20]["start_ms"]) <= 1500 + 250
    assert got[1]["upheld"] == [] and not got[1]["applied"]  # it opens on its hook and holds no filler: nothing of the review stands
    assert got[2]["upheld"] == ["opens_on_hook"] and not got[2]["applied"]  # the hook would be lost
    assert got[3]["upheld"] == [] and [tuple(p) for p in got[3]["spans"]] == rows[3][2]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scoring.message_text(F.lit('[{"type":"text","text":"a"}, "b", {"n": 1}]'))) == "ab"
    assert one(scoring.message_text(F.lit('"quoted"'))) == "quoted" and one(scoring.message_text(F.lit("plain"))) == "plain" and one(scoring.message_text(F.lit(None).cast("string"))) == ""
    assert one(scoring.as_text(F.lit("  a "))) == "a" and one(scoring.as_text(F.lit(None))) == "" and one(scoring.as_text(F.lit(3))) == "3"
    lines = F.array(*[F.struct(F.lit(1000 * k).cast("long").alias("s"), F.lit(1000 * k + 900).cast("long").alias("e"), F.lit(k).alias("n"), F.lit(f"t{k}").alias("text")) for k in range(3)])
    assert one(scoring.prompt_lines(lines, F.lit(1), F.lit(1))) == " [0] (0.0s–0.9s) t0\n>[1] (1.0s–1.9s) t1\n [2] (2.0s–2.9s) t2"
    assert one(scoring.covered_text(lines, F.array(F.struct(F.lit(1500.0).alias("s"), F.lit(2100.0).alias("e"))))) == "t1 t2"


def test_clips_without_spans_and_repeated_identifiers_stay(spark, talk):
    from spanloom.operators import composing

    words, sentences, lines = talk
    schema = "media_id long, id long, start_ms long, end_ms long, setup_s long, setup_e long"
    s, e, a, b = lines[4]["start_ms"], lines[12]["end_ms"], lines[30]["start_ms"], lines[40]["end_ms"]
    none = spark.createDataFrame([], "media_id long, start_ms long, end_ms long")
    twice = composing.compose(words, spark.createDataFrame([(1, 5, s, e, None, None), (1, 5, a, b, None, None), (1, 5, a, b, None, None)], schema), none, 15_000, 60_000).collect()
    apart = {i: composing.compose(words, spark.createDataFrame([(1, 5, *x, None, None)], schema), none, 15_000, 60_000).collect()[0]["spans"] for i, x in enumerate([(s, e), (a, b)])}
    assert sorted(r["spans"] for r in twice) == sorted([apart[0], apart[1], apart[1]])
    clips = spark.createDataFrame([(1, 0, [], "of"), (1, 1, [(float(s), float(e))], "of")], "media_id long, id long, spans array<struct<s:double,e:double>>, hook string")
    reply = '{"opens_on_hook": false, "contains_payoff": false, "has_housekeeping": true}'
    reviews = spark.createDataFrame([(1, 0, reply), (1, 1, reply)], "media_id long, id long, reply string")
    flag = C.contains_any(F.col("text"), ["no such phrase"])
    got = {r["id"]: r for r in scoring.apply_critique(clips, reviews, words, sentences, none, flag, flag).collect()}
    assert set(got) == {0, 1} and got[0]["spans"] == [] and got[0]["upheld"] == [] and not got[0]["applied"]


def test_a_model_reviews_clips(spark, talk):
    words, sentences, lines = talk
    clips = spark.createDataFrame([(1, 0, [(float(lines[4]["start_ms"]), float(lines[9]["end_ms"]))], HOOK), (1, 1, [], "x"), (9, 2, [(0.0, 5.0)], None)], "media_id long, id long, spans array<struct<s:double,e:double>>, hook string")
    seen = lambda prompt: json.dumps({"n": prompt.count(">["), "hook": HOOK in prompt, "limits": "15 to 180" in prompt})
    got = {r["id"]: r["reply"] for r in scoring.review(clips, sentences, stub(seen)).collect()}
    assert json.loads(got[0]) == {"n": 6, "hook": True, "limits": True} and got[1] is None and got[2] is None

    def fails(prompt):
        raise RuntimeError("busy")

    assert {r["reply"] for r in scoring.review(clips, sentences, stub(fails)).collect()} == {None}


def test_candidates_are_cut_to_their_own_length_class(spark, talk):
    from spanloom.operators import retrieval

    words, sentences, lines = talk
    s, e = lines[10]["start_ms"], lines[14]["end_ms"]
    rows = spark.createDataFrame([(1, i, s, e, "text", 1.0 - i / 10) for i in range(6)], SCHEMA)
    classed = retrieval.length_classes(rows)
    dealt = {r["id"]: (r["low_ms"], r["high_ms"]) for r in classed.collect()}
    assert dealt[0] == dealt[5] == (15_000, 24_660) and dealt[4][1] == 180_000 and all(dealt[i][1] == dealt[i + 1][0] for i in range(4))
    answers = lambda prompt: '{"start_line": 0, "end_line": 99, "hook": ""}'  # noqa: E731  as long as it may be
    none = spark.createDataFrame([], "media_id long, start_ms long, end_ms long")
    ends = sentences.groupBy("media_id").agg(F.max("end_ms").alias("end_ms"))
    no = C.contains_any(F.col("text"), ["no such reveal"])
    got = {r["id"]: sum(b - a for a, b in r["spans"]) for r in scoring.score_candidates(classed, words, sentences, none, ends, stub(answers), no, LISTS).collect()}
    for i, n in got.items():
        assert dealt[i][0] <= n <= min(dealt[i][1] * 1.15, 180_000) + 1, (i, n)
    assert got[0] == got[5] < got[1] < got[2] < got[3]


def test_semantic_gaps_join_the_boundaries(spark, talk):
    gaps = transcript.topic_gaps(talk[1], [], [], 10**9)
    one = spark.createDataFrame([(1, 7, 0.1), (1, 999, 0.1)], "media_id long, sent_id long, score double")
    assert {r["end_ms"] for r in transcript.topic_ends(gaps, one).collect()} == {talk[2][7]["end_ms"], talk[2][-1]["end_ms"]}
    spoken = spark.createDataFrame([(1, 0, "One thing.", 0, 900, 2), (1, 1, "Moving on, next.", 1000, 1900, 3), (1, 2, "It ends.", 2000, 2900, 2)], "media_id long, sent_id long, text string, start_ms long, end_ms long, n_words long")
    assert [r["by_marker"] for r in transcript.topic_gaps(spoken).orderBy("sent_id").collect()] == [True, False, False]  # the reference lists are the defaults


def test_marked_lines_are_found_once_a_prompt(spark):
    """Up to which line a prompt is marked is told by chance: told once, the marked lines come first."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct(i.cast("long").alias("s"), i.cast("long").alias("e"), i.cast("int").alias("n"), F.lit("t").alias("text")))
    got = spark.range(20).select(scoring.prompt_lines(lines, F.lit(0), F.floor(F.rand(7) * 60)).alias("p")).collect()
    marks = ["".join(line[0] for line in r["p"].split("\n")) for r in got]
    assert all(m == ">" * m.count(">") + " " * m.count(" ") and len(m) == 60 for m in marks) and len(set(marks)) > 5
