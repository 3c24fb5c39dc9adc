"""Each operator against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import byte_bpe, chat, common, exact_dedup, html_extract, labelled, packing, quality, simhash, token_store, topk, toxicity, word_ids
from spanloom.llm.components import components

LONG = "word's Ünïcode 12,5 \x85 ß  naïve café " * 3000
TEXTS = ["a b c d", None, "", "  ", "a  b\tc\nd", "a b c d", "A b c d", LONG, LONG, "don't it's 'tis I'LL", "Σίσυφος ΟΔΟΣ é é", "<|endoftext|> x", "日本語 テキスト 123", "x" * 5000, "a b", "  z", "tab\x0bvt\x1cfs"]
SCHEMA = "doc_id long, text string, lang string, score double, norm string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, 0.5, "n", 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(text, library=[]):
    if not library:  # a tokenizer of the test's own, as the file gives it
        import public_tokenizers
        from tokenizers import Tokenizer

        library.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return library[0].encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_library():
    enc = word_ids.encoder("word_bpe_49k.json")
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abCé'. ,1\ńẞßİΣ＊") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole_ids(t)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = whole_ids(t) + [0]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["length"] for r in got] == [len(ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
        for r in got:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_tight(seed):
    rng = random.Random(seed)
    hist = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(5000))
    plan, used = packing.plan_packing(hist, 2048)
    fill, taken = defaultdict(list), Counter()
    for n, c in hist.items():
        mine = plan[plan[:, 0] == n]
        for rank in range(c):
            row = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            r = rank - row[1]
            fill[row[2] + r // row[3]].append((row[4] + r % row[3] * n, n))
            taken[n] += 1
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and sum(3 * n > 2048 for _, n in parts) <= 2
    assert len(fill) == used and taken == hist
    total = sum(n * c for n, c in hist.items())
    large = sum(c for n, c in hist.items() if 2 * n > 2048)
    assert used <= max(-(-total // 2048), large) * 1.02 + 1


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    import xxhash

    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, empty):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    base = [rng.choice(words) for _ in range(200)]
    extra = []
    for k in range(25):
        t = list(base)
        for _ in range(k % 5):
            t[rng.randrange(200)] = rng.choice(words)
        extra.append((100 + k, " ".join(t), None, 0.0, None, 0))
    more = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(more).collect()}
    texts = {**dict(enumerate(TEXTS)), **{r[0]: r[1] for r in extra}}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    want = plain_components(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert simhash.near_duplicates(empty).count() == 0
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("a", "else"), (None, "else"), (None, "alone here")], "doc_id string, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(named).collect()]
    assert Counter(got) == Counter([("b", "a"), ("a", "a"), ("a", "a"), (None, "a"), (None, None)])


@pytest.mark.parametrize("hot", [20_000, 5, 0])
def test_gray_index_finds_every_link(spark, hot):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    centres[20:] = centres[20] ^ rng.integers(0, 1 << 9, 10, dtype=np.uint64)  # crowded blocks
    codes = {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(6):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << b
            codes.add(x)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    prints = spark.createDataFrame(list(zip(signed, range(len(codes)))), "fp long, rep long")
    got = {r["node"]: r["component"] for r in components(simhash.near_links(prints, hot=hot)).collect()}
    want = plain_components(range(len(codes)), lambda a, b: bin(codes[a] ^ codes[b]).count("1") <= 3)
    assert {n: got.get(n, n) for n in range(len(codes))} == want


def test_hot_keys_join_like_any_other(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(60)] + [(7, 60), (None, 61)], "key int, x int")
    right = spark.createDataFrame([(0, "a", 20), (1, "b", 20), (2, "c", 20), (9, "d", 0)], "key int, y string, n long")
    for limit in (0, 19, 100):
        got = common.join_hot(left, right, "key", limit, "left")
        assert Counter(map(tuple, got.select("key", "x", "y").collect())) == Counter([(k % 3, k, "abc"[k % 3]) for k in range(60)] + [(7, 60, None), (None, 61, None)])
        assert common.join_hot(left, right, "key", limit).count() == 60
    assert common.hot_limit(10) == 20_000 and common.hot_limit(10**9) == 200_000


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60) if i != 30] + [(100, 101), (5, 5), (101, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_store(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = sorted(token_store.store_documents(docs, folder).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(rows, TEXTS, strict=True):
        ids = whole_ids(t) + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    chunks = spark.read.parquet(f"{folder}/parts").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("name").distinct().count()
    recipes = spark.read.parquet(f"{folder}/recipes").orderBy("part", "pos").collect()
    assert [r["doc_id"] for r in recipes] == sorted(r["doc_id"] for r in recipes)
    bodies = {bytes(r["name"]): np.frombuffer(bytes(r["body"]), "<u2").tolist() for r in chunks.collect()}
    for r in recipes:
        names = bytes(r["chunks"])
        ids = [x for i in range(0, len(names), 16) for x in bodies[names[i : i + 16]]]
        assert ids == whole_ids(TEXTS[r["doc_id"]]) + [2]
    assert token_store.store_documents(empty).count() == 0


@pytest.fixture
def stored(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None if i % 7 == 0 else i % 9, rng.choice(["", None, "a b c", " ".join(f"w{rng.randrange(90)}" for _ in range(400))])) for i in range(120)]
    folder = f"{tmp_path}/store"
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{folder}")
    return rows, folder


def test_token_store_orders_null_and_repeated_identifiers(spark, stored):
    rows, folder = stored
    got = sorted(map(tuple, token_store.read_store(spark, f"file://{folder}").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    ids = {t: np.array(whole_ids(t) + [2], "<u4") for _, t in rows}
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    again = f"{folder}-again"  # the same rows in another order give the same places
    token_store.write_store(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5), f"file://{again}")
    assert sorted(map(tuple, token_store.read_store(spark, f"file://{again}").collect()), key=lambda r: r[1]) == got


def largest(folder):
    import pathlib

    return max(pathlib.Path(folder).rglob("*.parquet"), key=lambda p: p.stat().st_size)


@pytest.mark.parametrize("part", ["recipes", "manifest", "parts/kind=chunk"])
def test_token_store_with_a_lost_file_is_an_error(spark, stored, part):
    largest(f"{stored[1]}/{part}").unlink()
    with pytest.raises(Exception, match="recipe files|manifest|is missing or altered|UNABLE_TO_INFER_SCHEMA|PATH_NOT_FOUND"):
        token_store.read_store(spark, f"file://{stored[1]}").collect()


def test_token_store_with_an_altered_chunk_is_an_error(spark, stored):
    folder = f"file://{stored[1]}"
    chunks = spark.read.parquet(f"{folder}/parts/kind=chunk").collect()
    worst = max(chunks, key=lambda r: r["n"])
    rows = [(r["doc_id"], r["n"], r["name"], bytes(r["body"][::-1] if r["name"] == worst["name"] else r["body"]), r["sizes"]) for r in chunks]
    spark.createDataFrame(rows, spark.read.parquet(f"{folder}/parts/kind=chunk").schema).write.mode("overwrite").parquet(f"{folder}/parts/kind=chunk")
    with pytest.raises(Exception, match="is missing or altered"):
        token_store.read_store(spark, folder).collect()


def test_salted_join_equals_a_plain_one(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(60)] + [(7, 60), (None, 61)], "key int, x int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (9, "d")], "key int, y string")
    for hot in ([], [(0, 7)], [(0, 2), (1, 3), (9, 4), (5, 5)]):
        got = common.join_salted(left, right, "key", spark.createDataFrame(hot, "key int, parts int"), common.F.xxhash64("x"), "left")
        assert Counter(map(tuple, got.select("key", "x", "y").collect())) == Counter([(k % 3, k, "abc"[k % 3]) for k in range(60)] + [(7, 60, None), (None, 61, None)])


def test_crc_join_and_cuts():
    rng, joiner = random.Random(5), token_store.CrcJoin()
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(0, 3000)), rng.randbytes(rng.randrange(0, 70000))
        assert joiner.join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    ids = np.random.default_rng(1).integers(0, 49000, 30000).astype("<u4")
    ends = token_store.cut_points(ids)
    moved = token_store.cut_points(np.concatenate([ids[:50], ids]))
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.LONGEST
    assert len({e + 50 for e in ends} & set(moved)) > 0.8 * len(ends)


def test_byte_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs).collect():
        t = TEXTS[r["doc_id"]] or ""
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    rng, coder = random.Random(2), byte_bpe.coder("byte_bpe_multi_50k.tiktoken")
    for _ in range(300):
        t = "".join(rng.choice("abCé'sdl. ,12\ń ß\x1cn't日") for _ in range(80))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    encoded = byte_bpe.encode_documents(docs)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode_documents(encoded).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert byte_bpe.round_trip(empty).count() == 0
    assert all(coder.whole.get(k) == v for k, v in ranks.items()) and coder.whole.get(b"no such token") is None
    assert sorted(coder.whole.keys) == sorted(ranks) and byte_bpe.PerfectHash({}).get(b"a") is None


def accuracy(rows, truth):
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in held) / len(held)


def labelled_docs(spark, bad):
    rng = random.Random(11)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        y = i % 4 == 0
        t = [rng.choice(plain) for _ in range(60)]
        if y:
            at = rng.randrange(50)
            t[at : at + 4] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(t)))
        labels.append((i, int(y), int(not y)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1])]
    labels += [(5, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    docs, labels = labelled_docs(spark, [f"slur{k}" for k in range(6)])
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and r["doc_id"] is not None}
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 904 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, truth) >= 0.98
    scorer = toxicity.fit(docs, labels)
    assert toxicity.toxic_passages(docs, scorer).select("doc_id").distinct().count() >= 200
    none = toxicity.classify(docs, labels.where("false")).collect()
    assert len(none) == 904 and max(r["score"] for r in none) < 0.5
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_maximal_segments_against_brute_force():
    rng = random.Random(4)

    def brute(s, lo, hi, out):  # Ruzzo and Tompa's definition: the best segment, then what is left and right of it
        best = max(((sum(s[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            return
        i = -best[2]
        j = i - best[1]
        brute(s, lo, i, out)
        out.append((i, j))
        brute(s, j, hi, out)

    for _ in range(200):
        table = {f"t{k}": rng.random() * 2 + 0.01 * k for k in range(4)}
        words = [rng.choice([*table, "x", "y", "z", "u", "v"]) for _ in range(rng.randrange(0, 30))]
        words = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
        scorer = toxicity.Scorer(table, {}, drift=0.6)
        want: list = []
        brute([table.get(w, -0.6) for w in words], 0, len(words), want)
        assert [(a, b) for a, b, _ in scorer.segments(words)] == want


def test_quality(spark):
    docs, labels = labelled_docs(spark, ["###", "$$$", "click", "here"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] is not None}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 904 and accuracy(rows, truth) >= 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert labelled.training_rows(docs, labels, "quality", 50).select("doc_id").distinct().count() == 50


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>side</aside><div class="odd">Site frame text</div><article><h1>Title {k} &amp; more</h1><p>First <b>bold</b>text&nbsp;here &am<br>next<p>Open paragraph {k}
<form><input>Name</form><ul><li>one<li>two</ul></article><section class="comments"><article class="comment">Nice!</article></section><footer>&copy; x</footer>"""


def test_html(spark):
    rows = [(i, f"https://Host.example/{i}", PAGE.format(k=i), 1) for i in range(8)]
    rows += [(100, None, None, 1), (101, "https://a.example/", "", 1), (102, "https://a.example/1", "<p>only <b>this", 1), (103, "https://a.example/1", "x < y &lt; z <a hre", 1), (103, "https://a.example/1", "x < y &lt; z <a hre", 1)]
    plain = [(200 + i, "http://blog.example/x", f"<body><div>Same block</div><div>Own words {i}</div></body>", 1) for i in range(6)]
    got = defaultdict(list)
    for r in html_extract.extract_pages(spark.createDataFrame(rows + plain, "page_id long, url string, html string, templates int")).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for i in range(8):
        assert got[i] == [f"Title {i} & more First boldtext here &am next Open paragraph {i} one two"]
    assert got[100] == [""] and got[101] == [""] and got[102] == ["only this"] and got[103] == ["x < y < z"] * 2
    assert [got[200 + i] for i in range(6)] == [[f"Own words {i}"] for i in range(6)]
    joined = html_extract.extract_pages(spark.createDataFrame(plain, "page_id long, url string, html string, templates int"), broadcast_rows=0)
    assert {r["text"] for r in joined.collect()} == {f"Own words {i}" for i in range(6)}
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).round(2)
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in e], 0) for i, e in enumerate(v)]
    rows += [(400, None, 0), (420, [None] * 8, 0), (440, [float("nan")] * 8, 0), (460, [1.0, 2.0], 0), (461, [0.5, 2.0], 0), (480, [float("inf")] * 8, 0)]
    rows += [(20, rows[20][1], 0), (40, rows[41][1], 0), (500, [], 0), (501, [], 0), (None, rows[3][1], 0)]  # repeated queries, one with another vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, floor int")
    usable = [(i, np.floor(64 * np.array(e)).astype(int)) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = []
    for q, a in (x for x in usable if x[0] % 20 == 0):
        best = sorted((-int(a @ b), i) for i, b in usable if i != q and len(b) == len(a))[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard, leaf, block in ((topk.SHARD, topk.LEAF, topk.BLOCK), (64, 16, 4)):
        for name, value in (("SHARD", shard), ("LEAF", leaf), ("BLOCK", block)):
            monkeypatch.setattr(topk, name, value)
        assert sorted(map(tuple, topk.top_k(df, k=7).collect())) == sorted(want)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>, floor int")
    assert topk.top_k(few).count() == 3
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.rounds(1) == [(0, 1)] and topk.rounds(6) == [(0, 1), (1, 2), (2, 4), (4, 6)]


def test_top_k_beyond_float_range(spark):
    big = [(i, [2.0**24 + (3 + i) / 64, 1.0]) for i in range(5)]  # scores near 2^60
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=2).collect()
    v = {i: [int(np.floor(64 * x)) for x in e] for i, e in big}
    best = sorted((-(v[0][0] * v[i][0] + v[0][1] * v[i][1]), i) for i in range(1, 5))[:2]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in best]


def test_exact_dedup(spark, docs, empty):
    many = docs.unionByName(spark.createDataFrame([(1000 + i, "hot  text", None, 0.0, None, 0) for i in range(400)] + [(None, "hot text", None, 0.0, None, 0), (3, "  ", None, 0.0, None, 0)], SCHEMA))
    rows = exact_dedup.exact_dedup(many).collect()
    groups = defaultdict(list)
    for r in many.collect():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")].append(r["doc_id"])
    assert len(rows) == len(TEXTS) + 402
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min(i for i in ids if i is not None) and (not r["kept"] or r["doc_id"] == r["keep_id"])
    assert sum(r["kept"] for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\b ### <x> </turn>\n"), (1, 2, "user", None), (1, 2, "assistant", "tie"), (1, 3, "a:b \\c", "odd role"), (2, 0, "user", "alone"), (3, 0, None, ""), (3, 0, None, ""), (None, 1, "assistant", "x" * 100_000), (4, None, "assistant", "é日")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, piece string")
    turns = chat.format_turns(df)
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    folder = chat.write_examples(df)
    got = {r["conv_id"]: r for r in chat.digest(spark, folder).collect()}
    assert set(got) == set(want)
    stored = spark.read.parquet(f"{folder}/examples").collect()
    assert Counter(r["conv_id"] for r in stored) == Counter(c for c, _, role, _ in rows if role == "assistant")
    whole = {c: "".join(r["piece"] for r in sorted(ps, key=lambda r: r["pos"])) for c, ps in ((c, [r for r in spark.read.parquet(f"{folder}/pieces").collect() if r["conv_id"] == c]) for c in want)}
    for r in stored:  # the mask covers the reply and nothing else, right behind its context
        assert whole[r["conv_id"]][r["loss_start"] : r["loss_end"]] == r["reply"] and r["context_start"] == 0 and r["context_end"] == r["loss_start"]
        assert whole[r["conv_id"]][: r["context_end"]].endswith("### assistant: ") and whole[r["conv_id"]][r["loss_end"] : r["chars"]] == "</turn>\n"
    for c, ts in want.items():
        loss = "".join(x for role, x in ts if role == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    full = {(r["conv_id"], r["example"]): r for r in chat.render_examples(turns).collect()}
    assert len(full) == 4
    pieces = [r["piece"] for r in turns.where("conv_id = 1").orderBy("pos").collect()]
    first, second = full[1, 1], full[1, 2]
    at = [i for i, (role, _) in enumerate(want[1]) if role == "assistant"]
    assert first["context"] == "".join(pieces[: at[0]]) + "### assistant: " and second["context"] == "".join(pieces[: at[1]]) + "### assistant: "
    assert chat.digest(spark, chat.write_examples(df.where("false"))).count() == 0


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        names.append(name)
        if k < 4:
            assert out.columns == columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(before.items()):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
            assert kept == set(first.values())
        if name == "simhash_near_dedup":
            fp = {i: plain_fingerprint(t) for i, t in before.items()}
            assert kept == set(plain_components(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3).values())
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length").collect()} == {tuple(r) for r in docs.select("doc_id", "piece", "length").collect()}


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, None, None, 1), (None, "", "x", 2), (1, "", None, 3), (1, None, None, 4), (2, "word " * 60_000, "y", 5), (2, "tie one two three", None, 6), (2, "tie one two three", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, norm int")  # clashing names, nulls, a very long text, ties
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    kept = Counter(map(tuple, corpus_pipeline.drop_exact_copies(spark, docs, "").collect()))
    assert sum(kept.values()) == 3 and {t[1] or "" for t in kept} == {"", rows[4][1], "tie one two three"}
    packed = corpus_pipeline.pack(spark, docs, "")
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.pack(spark, docs.where("false"), "").count() == 0


def test_pipeline_keeps_rows_by_identifier_and_text(spark):
    import corpus_pipeline

    rng = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(300)) for _ in range(5))
    near = next(t for w in a.split() if bin(plain_fingerprint(a) ^ plain_fingerprint(t := a.replace(w, "other"))).count("1") in (1, 2, 3))
    rows = [(3, a, 0), (5, a, 1), (5, b, 1), (5, b, 2), (None, c, 1), (None, d, 1), (None, a, 1), (7, e, 1), (None, e.replace(" ", "  ", 1), 0), (3, near, 0), (None, near, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name int").repartition(3)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    assert Counter(map(tuple, exact.collect())) == Counter([(3, a, 0), (5, b, 1), (None, c, 1), (None, d, 1), (7, e, 1), (3, near, 0)])
    kept = Counter(tuple(r)[:2] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    first = min((3, a), (3, near), key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())
    assert kept == Counter([first, (5, b), (None, c), (None, d), (7, e)])


def test_html_copies_keep_their_text(spark):
    page = "<html><body><div>Same block</div><div><p>Copied words</p></div></body></html>"
    rows = [(i, None if i % 2 else "odd", page) for i in range(9)] + [(20 + i, None, f"<head><title>{i}</title></head>" + page) for i in range(6)]
    rows += [(50 + i, None, f"<body><div>Same block</div><div>Own words {i}</div></body>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: "Copied words" if i < 50 else f"Own words {i - 50}" for i, _, _ in rows}


def test_html_boxes_inside_the_article(spark):
    page = "<body><{0}><div class='box'>Get <b>the letter</b></div><p>Same paragraph</p><div>Own words {1}</div></{0}></body>"
    rows = [(i, "https://h.example/", page.format("main" if i % 2 else "article", i)) for i in range(8)]
    rows += [(20, "https://h.example/", "<main><div class='box'>Get <b>the letter</b></div></main>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {**{i: f"Same paragraph Own words {i}" for i in range(8)}, 20: ""}


def plain_pages(rows, outside=0.01, share=0.3, least=5):
    """Texts of pages (page_id, url, html) of div, p and article elements alone, by trees, strings and sets."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self, source):
            super().__init__()
            self.root = ["body", []]
            self.open = [self.root]
            self.feed(source)

        def handle_starttag(self, tag, attrs):
            node = [tag, []]
            self.open[-1][1].append(node)
            self.open.append(node)

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            self.open[-1][1].append(data)

    def spell(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(spell, node[1]))}</{node[0]}>"

    def holds(node):
        return not isinstance(node, str) and (node[0] == "article" or any(map(holds, node[1])))

    def walk(node, inside, see):
        for child in node[1]:
            if not isinstance(child, str):
                within = inside or child[0] == "article"
                if not holds(child) and (not inside or child[0] == "div"):
                    see(spell(child), within)
                walk(child, within, see)

    def text(node, inside, gone, article):
        out = []
        for child in node[1]:
            if isinstance(child, str):
                if inside or not article:
                    out.append(child)
            elif holds(child) or not gone(spell(child), inside, child[0]):
                out += [" ", *text(child, inside or child[0] == "article", gone, article), " "]
        return out

    def whole(tree, gone):
        return " ".join("".join(text(tree, False, gone, holds(tree))).split())

    trees = {i: Tree(h).root for i, _, h in rows}
    sites = defaultdict(dict)
    for i, u, _ in rows:
        sites[u.split("/")[2]].setdefault(whole(trees[i], lambda *_: False), []).append(i)
    out = {}
    for pages in sites.values():
        n, framed = Counter(), Counter()
        for ids in pages.values():
            seen, frame = set(), set()
            tree = trees[ids[0]]
            walk(tree, False, lambda x, within: (seen.add(x), frame.add(x) if not within and holds(tree) else None))
            n.update(seen)
            framed.update(frame)
        for ids in pages.values():
            for i in ids:
                everywhere = lambda x: n[x] >= least and n[x] >= share * len(pages)
                frame = lambda x: framed[x] >= least and framed[x] >= outside * len(pages)
                out[i] = whole(trees[i], lambda x, inside, tag: everywhere(x) and (not inside or tag == "div") or not inside and frame(x))
    return out


def test_html_templates_against_trees(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        site = rng.choice("aaab")
        layout = [f"<div>frame {site}{rng.randrange(2)}<p>menu {rng.randrange(2)}</p></div>" for _ in range(2)]
        words = lambda: f"<p>{rng.choice(['said often', f'said once {i} {rng.random()}'])}</p>"
        notice = "<div>read the letter</div>" if rng.random() < 0.6 else f"<div>own box {i}</div>"
        main = f"{words()}{notice}{words()}<div>{words()}</div>"
        body = f"<article>{main}</article>" if rng.random() < 0.8 else f"<div>{main}</div>"
        rows.append((i, f"https://{site}.example/{i}", f"{layout[0]}<div>{body}</div>{layout[1]}"))
    want = plain_pages(rows)
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    split = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=0).collect()
    assert {r["page_id"]: r["text"] for r in split} == want
    assert not any("frame" in t or "letter" in t for t in want.values()) and sum("said often" in t for t in want.values()) > 100
    assert all(r["n_templates"] > 0 for r in got)


def test_html_finds_templates_in_the_fixtures(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = html_extract.extract_pages(pages).agg({"n_templates": "sum"}).first()[0]
    assert found > 0
