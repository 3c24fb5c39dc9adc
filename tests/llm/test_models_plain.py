"""Classifiers and packing from end to end against plain Python written from the stated rules, on rows of the fixtures."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import packing, quality, toxicity
from test_llm import whole_ids


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    long_ = spark.createDataFrame([(9001, "said again and again " * 20_000), (9002, None), (9003, ""), (None, "no name"), (9001, "twice")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(long_)
    return docs, labels, [tuple(r) for r in docs.collect()], {r["doc_id"]: r for r in labels.collect()}


def training(rows, labels, target):
    return [(i, t, labels[i][target]) for i, t in rows if i in labels and labels[i][target] is not None and zlib.crc32(str(i).encode()) % 5]


def plain_best_segments(s):
    """Maximal segments by their definition: the best one, the shortest and first of equals, then what is left and right of it."""
    if not s:
        return []
    at = np.concatenate([[0.0], np.cumsum(s)])
    low, best = 0, (0.0, 0, 0)
    for j in range(1, len(at)):
        if at[j] - at[low] > best[0] + 1e-12:
            best = (at[j] - at[low], low, j)
        if at[j] <= at[low]:
            low = j
    total, a, b = best
    if total <= 1e-12:
        return []
    return [*plain_best_segments(s[:a]), total, *plain_best_segments(s[b:])]


def test_toxicity_equals_a_plain_form(tables):
    docs, labels, rows, known = tables
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    train = training(rows, known, "toxic")
    toxic, clean = Counter(), Counter()
    for _, t, y in train:
        (toxic if y else clean).update(set(words(t)))
    nt, nc = sum(toxic.values()), sum(clean.values())
    score, share = {}, {}
    for w in toxic.keys() | clean.keys():
        y, n = toxic[w], clean[w]
        a = (y + n) / (nt + nc) * 500 + 0.5
        odds = math.log((y + a) / (nt + 500 - y - a)) - math.log((n + a) / (nc + 500 - n - a))
        s = odds - 3 * math.sqrt(1 / (y + a) + 1 / (n + a))
        if s > 0:
            score[w], share[w] = s, (n + 0.5) / nc
    rest = 1 - sum(share.values())
    total = lambda lam: sum(p * math.exp(lam * score[w]) for w, p in share.items()) + rest * math.exp(-lam * 0.35)
    assert len(score) > 3
    hi = next(h for h in np.arange(0.01, 50, 0.01) if total(h) > 1)
    lo = hi - 0.01
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if total((lo + hi) / 2) > 1 else ((lo + hi) / 2, hi)

    def bits(t):
        ws = words(t)
        s = [score[w] if w in score and not (k and ws[k - 1] == w) else -0.35 for k, w in enumerate(ws)]
        found = [lo * x - math.log(max(1, len(ws))) for x in plain_best_segments(s)]
        return sum(b for b in found if b > 0)

    x = np.array([math.log1p(bits(t)) for _, t, _ in train])
    y = np.array([v for *_, v in train], dtype=float)
    w = np.array([0.0, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    loss = lambda w: np.sum(np.logaddexp(0, x * w[0] + w[1]) - y * (x * w[0] + w[1])) + 0.025 * w[0] ** 2 + 0.0005 * w[1] ** 2
    step, turns = 1.0, 0  # coordinate search: no derivatives, so nothing in common with the fit under test
    while step > 1e-6:
        turns += 1
        assert turns < 5000
        tries = [w + step * np.array(d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1), (1, -2), (-1, 2), (2, -1), (-2, 1))]
        best = min(tries, key=loss)
        w, step = (best, step) if loss(best) < loss(w) - 1e-14 else (w, step / 2)
    want = sorted((i or -1, t or "", 1 / (1 + math.exp(-(math.log1p(bits(t)) * w[0] + w[1])))) for i, t in rows)
    scored = toxicity.classify(docs, labels).collect()
    got = Counter()
    for r in scored:
        got[r["doc_id"] or -1] += 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
    assert got == Counter(i for i, *_ in want)
    assert sorted(r["score"] for r in scored) == pytest.approx(sorted(s for *_, s in want), abs=2e-3)
    assert sum(r["predicted"] for r in scored) == sum(s >= 0.5 for *_, s in want)


def test_quality_equals_a_plain_form(tables):
    docs, labels, rows, known = tables
    mask = (1 << 64) - 1

    def plain(text):
        words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+", (text or "").encode())
        h = [zlib.crc32(w) for w in words]
        keys = [x * 0x94D049BB133111EB & mask for x in h]
        keys += [0xD6E8FEB86659FD93 if a == b else a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 & mask for a, b in zip(h, h[1:])]
        x = {k: math.log1p(n) for k, n in Counter(k >> 46 for k in keys).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / norm for k, v in x.items()}

    train = sorted(training(rows, known, "quality"), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1] or ""))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        l1 = 0.0 if k == "intercept" else 0.1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((1 + math.sqrt(n[k])) / 1.0 + 0.1)

    def at(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items()) - weight("intercept")))

    ones = sum(y for *_, y in train)
    rare = math.sqrt((len(train) - ones) / ones)
    for _ in range(4):
        for _, t, y in train:
            x = plain(t)
            p = at(x)
            for k, v in [*x.items(), ("intercept", 1.0)]:
                g, w = (rare if y else 1 / rare) * (p - y) * v, weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) * w
                n[k] += g * g
    got = sorted((r["doc_id"] or -1, r["score"]) for r in quality.classify(docs, labels).collect())
    want = sorted((i or -1, at(plain(t))) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_packing_of_documents_is_whole_and_near_the_bound(tables):
    docs, _, rows, _ = tables
    got = packing.pack_documents(docs).collect()
    lengths = sorted(len(whole_ids(t)) + 1 for _, t in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    assert sum(r["length"] for r in got) == sum(lengths) and len(got) == sum(-(-n // 2048) for n in lengths)
    for parts in by_seq.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    for i in {i for i, _ in rows if i is not None and i < 9000}:
        ids = whole_ids(next(t for j, t in rows if j == i)) + [0]
        for r in by_doc[i]:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    # no packing can do with fewer: tokens over capacity, or the pieces over half of it
    pieces = [r["length"] for r in got]
    assert len(by_seq) <= 1.01 * max(-(-sum(pieces) // 2048), sum(2 * n > 2048 for n in pieces)) + 1


def test_text_identifiers(spark, tables):
    docs, labels, rows, _ = tables
    named, known = (d.withColumn("doc_id", d["doc_id"].cast("string")) for d in (docs, labels))
    assert quality.classify(named, known).count() == toxicity.classify(named, known).count() == len(rows)
