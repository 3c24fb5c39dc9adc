"""Hooks: few lines are compared with a hook in full."""

import difflib
import random

import pandas as pd

from spanloom.operators import narrative


def _common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if c == d else max(row[j + 1], row[j])
    return row[-1]


def test_common_length_equals_the_table():
    rng = random.Random(1)
    text = lambda signs: "".join(rng.choice(signs) for _ in range(rng.randrange(81)))
    pairs = [(text("abcdé "), text("abcxé ")) for _ in range(200)] + [("", "a"), ("a", ""), ("", ""), ("a\0", "a\0"), ("a" * 80, "a" * 80), ("a" * 33, "ba" * 40), ("😀b", "b😀")]
    assert narrative.common_length(*map(list, zip(*pairs))).tolist() == [_common(a, b) for a, b in pairs]
    assert narrative.common_length([], []).tolist() == [] and narrative.common_length([""], ["x"]).tolist() == [0]


def test_unlike_lines_are_not_compared(monkeypatch):
    rng = random.Random(2)
    words = ["river", "stone", "quick", "above", "many", "the", "light", "of", "a", "window"]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)]
    hook, calls, ratio = lines[7], [], difflib.SequenceMatcher.ratio
    plain = [difflib.SequenceMatcher(None, hook[:80], x[:80]).ratio() for x in lines]
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))


    out = narrative.ratios(pd.Series([hook] * 400), pd.Series(lines), 0.8)
    assert [x if x >= 0.8 else 0 for x in out] == [x if x >= 0.8 else 0 for x in plain] and len(calls) < 20
    assert narrative.ratios(pd.Series([None, "", "ab"]), pd.Series(["x", None, "AB"]), 0.6).tolist() == [0.0, 1.0, 1.0]
