"""Personal data: the fixed patterns against the plain regular expressions, the field's sums and choices against all segmentations."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import personal_data as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1])]
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), list(PLAIN).index(kind), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "-", " ", "+", "(", ")", "a", "b7", "é", "٣", "_", "%", "\n", "1", "25", "255", "256", "0009", "4111 1111", "41111111", "1111 1111", "mail", "x.y", " "]), max_size=24).map("".join))
def test_patterns_equal_plain_expressions(text):
    assert P.base_spans(text) == plain_spans(text)
    borders = {b for lo, hi in P.regions(text, P.base_spans(text)) for b in P.Island(text, lo, hi, []).borders}
    assert all(s in borders and e in borders for s, _, e in P.base_spans(text))


CARD, ALSO = "4111 1111 1111 1111", "4845168114407329"
LINES = [
    "write to {a}.{n}@mail{k}.example.com today",
    "from {k}7.{n}.31.{k} port",
    "paid by 4{n}1111111111{c} again",
    "ring +1 ({n}) 555-{n}{k} at noon",
    "build 1.{n}.3 of {n}{n}{n}{n} and 98{n}57{n}",
    "on 2024-10-{k}1 12:30:5{k} came {n}",
]


def _made(seed=1, n=240):
    rng, out = random.Random(seed), []
    for i in range(n):
        t = LINES[i % len(LINES)].format(a=rng.choice(["bo", "an.na", "x"]), n=rng.randint(100, 254), k=rng.randint(1, 9), c="{c}")
        if "{c}" in t:
            stem = re.search(r"4\d+", t)[0] + "".join(rng.choice("0123456789") for _ in range(1))
            check = next(d for d in "0123456789" if P.luhn(stem + d))
            t = t.replace(re.search(r"4\d+\{c\}", t)[0], stem + check)
        out.append(t)
    return out


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.createDataFrame([(t,) for t in _made()], "text string"))


def test_field_adds_what_patterns_miss(model):
    added = lambda t: [(P.KINDS[k], t[s:e]) for s, k, e, b in model.spans(t) if not b]
    first, second = (next(t[s:e] for s, k, e in P.base_spans(t)) for t in [x for x in _made() if "paid" in x][:2])
    assert added(f"paid by {first} {second} again") == [("card", first), ("card", second)]  # the pattern takes both as one number
    assert added("write to bo.150 (at) mail3.example.com today") == [("email", "bo.150 (at) mail3.example.com")]
    for t in ["build 1.2.3 of 150150150", "on 2024-10-11 12:30:55 came 120", "no digits here", "paid by 4111111111111112 again", "from 300.1.2.3 port", "1 2 3 4 5 6 7 8 9"]:
        assert added(t) == [], t


def test_base_spans_stay(model):
    for t in _made(7) + [f"{CARD} {ALSO}", "+1 4111111111111111 x@y.z 1.2.3.4", "+41 11 11 11 11 11 11 1.2.3.4"]:
        base = {(s, k, e) for s, k, e, b in model.spans(t) if b}
        assert base == set(plain_spans(t))
        for s, k, e, b in model.spans(t):
            assert b or not any(s < y and x < e for x, _, y in base)


def _segmentations(n, arcs):
    """Every path from border 0 to n - 1 by arcs and single tokens, as lists of arc numbers."""
    def go(i):
        if i == n - 1:
            yield []
            return
        yield from go(i + 1)
        for a, (s, e, *_ ) in enumerate(arcs):
            if s == i:
                for rest in go(e):
                    yield [a, *rest]
    return list(go(0))


def _score(path, arcs, scores, turn):
    """A kind's weight after another holds where the segments touch."""
    total, end, last = 0.0, None, -1
    for a in path:
        s, e, k, row = arcs[a]
        total += scores[row][k] + turn[last + 1 if end == s else 0][k]
        end, last = e, k
    return total


@pytest.mark.parametrize("seed", range(8))
def test_sums_and_choice_equal_all_segmentations(seed):
    rng = np.random.default_rng(seed)
    n = 6
    arcs = sorted((int(i), int(j), int(k), r) for r, (i, j, k) in enumerate({(i, j, k) for i in range(n - 1) for j in range(i + 1, n) for k in range(4) if rng.random() < 0.3}))
    scores, turn = rng.normal(0, 2, (len(arcs), 4)), rng.normal(0, 1, (5, 4))
    paths = _segmentations(n, arcs)
    weight = [math.exp(_score(p, arcs, scores, turn)) for p in paths]
    share, turns = P._expected(n, arcs, scores.tolist(), turn.tolist())
    for a in range(len(arcs)):
        assert share[a] == pytest.approx(sum(w for p, w in zip(paths, weight) if a in p) / sum(weight), abs=1e-9)
    assert sum(map(sum, turns)) == pytest.approx(sum(len(p) * w for p, w in zip(paths, weight)) / sum(weight))

    class Fixed(P.Field):
        def scores(self, rows):
            return np.array([scores[r[0]] for r in rows]).reshape(-1, 4)

    class Given:
        borders, clamped = list(range(n)), set()

        def fill(self, a, b):
            self.arcs = [x for x in arcs if a <= x[0] < b]
            self.rows = [[r] for r in range(len(arcs))]

    field = Fixed()
    field.turn = turn
    for block in (2, 100):
        got = field.decode(Given(), 0.0, block)
        best = max(paths, key=lambda p: _score(p, arcs, scores, turn))
        assert got == [(arcs[a][0], arcs[a][2], arcs[a][1]) for a in best]


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 200_000, "@" * 100_000, "a.b@" * 60_000, "1 " * 60_000, "x@y.zz " * 20_000, "@a.b " * 50_000, "4111 1111 1111 1111\n" * 5_000])
def test_long_texts_take_linear_time(model, text):
    start = time.time()
    spans = model.spans(text)
    assert time.time() - start < 60 and [x[:3] for x in spans if x[3]] == P.base_spans(text)


def test_operator(spark, model):
    texts = [None, "", "é x@y.zz", f"{CARD} and {CARD}", "\U0001f600 1.2.3.4 +1 (017) 555-7713", "x@y.zz", "  "] + ["x@y.zz"] * 3 + ["a " * 40_000 + "b@c.dd"]
    rows = [(str(i) if i != 5 else None, t, "found", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, spans string, n_email int").repartition(3)
    got = {r["doc_id"]: r for r in P.digest(P.find(docs, model)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t or "")]
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",") if r["spans"] else [])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b.startswith(k) for b in base) for k in P.KINDS]
    assert P.find(docs.limit(0)).collect() == [] and P.find(docs.where("text is null")).count() == 1
    clean = {r["doc_id"]: r for r in P.redacted(docs, model).collect()}
    assert clean["2"]["text"] == "é [EMAIL]" and clean["0"]["text"] is None and clean["3"]["text"] == "[CARD] and [CARD]" and clean["4"]["spans"] == "found"


def test_fit_is_the_same_however_rows_are_dealt(spark):
    docs = spark.createDataFrame([(t,) for t in _made()] * 2, "text string")
    a, b = P.fit(docs.repartition(1)), P.fit(docs.repartition(7))
    assert (a.w == b.w).all() and (a.turn == b.turn).all()
    assert not P.fit(docs.where("text like 'build%'")).spans("write to bo.150 (at) mail3.example.com today")


def test_overlapping_spans_are_redacted_once():
    text = "+1 4111111111111111 x"
    assert P.redact("a b c d", [("ip", 0, 3), ("card", 2, 5)]) == "[IP] d" and P.redact(None, []) is None and P.redact(text, []) == text
