"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are 64 majority bits over the XXH64 values of word shingles. Two that differ in at most three bits agree in one
of four 16-bit blocks, so each distinct fingerprint is dealt out once for each block, by the block's value; a value that
too many share is split again, twice at most, by the blocks of the bits left, in which the same holds. In a partition the
fingerprints are sorted by Gray rank behind their block: fingerprints with equal leading bits lie together, and each level of
the index holds the next eight bits once for all of them. Node pairs are walked from the top, adding up differing bits; a
pair of groups over the limit is dropped whole, as is one whose members are already joined. A partition reports a spanning
star of what it linked, not all pairs; components over these links give the result.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle are
one shingle; equal rows share a fingerprint; identifiers may be numbers or text, and rows that repeat one are rows of their own; rows
without an identifier link like any other, and a component where none has one has no name; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import hot_limit, join_hot, shuffle_partitions, written
from spanloom.llm.components import components

SHINGLE, SEED, RADIUS, HOT = 3, 42, 3, 20_000
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_CHUNK = 1 << 20  # node pairs opened at a time


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    if len(words) < shingle:
        pieces, n = iter([b" ".join(words)]), 1
    else:
        pieces, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence; codes with equal leading bits stay together."""
    r = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


class GrayIndex:
    """Self-join of fingerprints within groups: links of at most `radius` differing bits among each group's members."""

    def __init__(self, group: np.ndarray, code: np.ndarray, radius: int = RADIUS):
        order = np.lexsort((gray_rank(code), group))
        self.order, self.code, self.radius, g = order, code[order], radius, group[order]
        self.starts, self.patterns = [], []
        for bits in range(0, 65, 8):  # a level for the groups, then one for each eight bits
            top = self.code >> np.uint64(64 - bits) if bits else np.zeros_like(self.code)
            new = np.ones(len(g), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (top[1:] != top[:-1])
            at = np.flatnonzero(new)
            self.starts.append(at)
            self.patterns.append((top[at] & np.uint64(255)).astype(np.uint8))
        self.ends = [np.append(s[1:], len(g)) for s in self.starts]
        self.kids = [np.searchsorted(self.starts[k + 1], np.append(s, len(g))) for k, s in enumerate(self.starts[:-1])]

    def labels(self) -> np.ndarray:
        """For each input row the row number that stands for its component."""
        n = len(self.code)
        lab = np.arange(n)
        at = np.arange(len(self.starts[0]))
        stack = [(0, at, at, np.zeros(len(at), dtype=np.uint8))]
        while stack:
            level, a, b, d = stack.pop()
            if level == len(self.starts) - 1:
                lab = _join(lab, self.starts[level][a], self.starts[level][b])
                continue
            s, e = self.starts[level], self.ends[level]
            open_ = (a != b) | (e[a] - s[a] > 1)
            if len(a) > 1:  # a pair whose rows are joined already adds nothing
                lo, hi = np.minimum.reduceat(lab, s), np.maximum.reduceat(lab, s)
                open_ &= (lo[a] != hi[a]) | (lo[b] != hi[b]) | (lo[a] != lo[b])
            a, b, d = a[open_], b[open_], d[open_]
            if not len(a):
                continue
            k = self.kids[level]
            na, nb = k[a + 1] - k[a], k[b + 1] - k[b]
            total = np.cumsum(na * nb)
            if total[-1] > _CHUNK and len(a) > 1:
                cut = max(1, min(len(a) - 1, int(np.searchsorted(total, total[-1] // 2))))
                stack += [(level, a[cut:], b[cut:], d[cut:]), (level, a[:cut], b[:cut], d[:cut])]
                continue
            pair = np.repeat(np.arange(len(a)), na * nb)
            i = np.arange(total[-1]) - np.repeat(total - na * nb, na * nb)
            x, y = k[a][pair] + i // nb[pair], k[b][pair] + i % nb[pair]
            p = self.patterns[level + 1]
            nd = d[pair] + _POP[p[x] ^ p[y]]
            near = (nd <= self.radius) & ((a != b)[pair] | (x <= y))
            if near.any():
                stack.append((level + 1, x[near], y[near], nd[near]))
        out = np.empty(n, dtype=np.int64)
        out[self.order] = self.order[lab]
        return out


def _join(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking rows i with rows j; each label is the smallest row of its component."""
    while True:
        a, b = lab[i], lab[j]
        apart = a != b
        if not apart.any():
            return lab
        i, j = i[apart], j[apart]
        np.minimum.at(lab, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _links(radius: int):
    def run(batches):
        cols = [[], [], []]
        for batch in batches:
            for c, name in zip(cols, ("grp", "code", "rep")):
                c.append(batch.column(name).to_numpy())
        if not cols[0]:
            return
        group, code, rep = (np.concatenate(c) for c in cols)
        lab = GrayIndex(group, code.view(np.uint64), radius).labels()
        apart = np.flatnonzero(lab != np.arange(len(lab)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[apart]), pa.array(rep[lab[apart]])], names=["a", "b"])

    return run


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def _rotated(block: int):
    """The fingerprint with 16-bit block number `block` moved to the top."""
    return F.shiftleft("fp", 48 - 16 * block).bitwiseOR(F.shiftrightunsigned("fp", 16 + 16 * block)) if block < 3 else F.col("fp")


def near_links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between representatives (fp, rep) whose fingerprints differ in at most `radius` <= 3 bits, spanning each component.

    Rows that agree in a block are a group; a crowded group is dealt again by the four blocks of the bits left, in which the
    same holds, twice at most: fingerprints that then still meet agree in 37 bits."""
    n = shuffle_partitions(prints.sparkSession)
    dealt = prints.select("rep", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _rotated(b).alias("code")) for b in range(4)])).alias("x"))
    dealt = dealt.select("rep", "x.code", (F.col("x.block") * 65536 + F.shiftrightunsigned("x.code", 48)).cast("long").alias("grp"))
    limit = hot_limit(4 * prints.count(), hot)
    for bits, room in ((12, 15), (9, 12)):  # a block's bits, and those of its number (from 1) and value together; 18 + 15 + 12 in all
        crowded = dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > limit)
        again = F.array(*[(F.lit((k + 1) << bits) + F.shiftrightunsigned("code", bits * k).bitwiseAND(F.lit((1 << bits) - 1))).cast("long") for k in range(4)])
        split = dealt.join(F.broadcast(crowded), "grp", "left")  # few, by hot_limit
        subs = F.when(F.col("members").isNull(), F.array(F.lit(0).cast("long"))).otherwise(again)
        # of 36 bits left the blocks are cut alike wherever a group was split before; where it was not, it is not crowded now
        dealt = split.select("rep", "code", F.col("grp").alias("was"), F.explode(subs).alias("sub")).select("rep", _below("code", "sub", bits).alias("code"), F.shiftleft("was", room).bitwiseOR(F.col("sub")).alias("grp"))
    return dealt.repartition(n, "grp").mapInArrow(_links(radius), "a long, b long")


def _below(code: str, sub: str, bits: int):
    """The code with the block that `sub` names moved behind the bits used before, so the bits left are the lowest ones again; as it is for 0."""
    left = 4 * bits  # the lowest bits, not used so far
    out = F.col(code)
    for k in range(4):
        low, high = (1 << (bits * k)) - 1, (1 << (left - bits * (k + 1))) - 1
        block = F.shiftrightunsigned(code, bits * k).bitwiseAND(F.lit((1 << bits) - 1))
        above = F.shiftrightunsigned(code, bits * (k + 1)).bitwiseAND(F.lit(high))
        moved = F.shiftleft(F.shiftrightunsigned(code, left), left)
        moved = moved.bitwiseOR(F.shiftleft(block, left - bits)).bitwiseOR(F.shiftleft(above, bits * k)).bitwiseOR(F.col(code).bitwiseAND(F.lit(low)))
        out = F.when(F.shiftright(sub, bits) == k + 1, moved).otherwise(out)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id (smallest identifier reachable)."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(docs.mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = components(near_links(distinct.select("fp", F.col("fp").alias("rep")), radius))  # fingerprints are the nodes
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("c"), "rep", F.col("n").alias("rows"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_print = written(join_hot(named.select("fp", "c", "rows"), least, "c", hot_limit(distinct.count())).select("fp", "component_id", F.col("rows").alias("n")), "named-fingerprints")
    rows = join_hot(prints, of_print, "fp", hot_limit(prints.count()))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def near_kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """The row of each component of near copies that stays (doc_id, text_sha256): smallest identifier, null last, then the text's digest.
    Fingerprints are the nodes here, so texts under one identifier, or under none, are rows of their own."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("sha"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(fp.view(np.int64))], names=["doc_id", "sha", "fp"])

    prints = docs.mapInArrow(run, f"doc_id {kind}, sha string, fp long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first")
    distinct = written(prints.groupBy("fp").agg(first), "distinct-fingerprints")
    found = components(near_links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("c"), "first")
    return named.groupBy("c").agg(F.min("first").alias("first")).select("first.doc_id", F.col("first.sha").alias("text_sha256"))
