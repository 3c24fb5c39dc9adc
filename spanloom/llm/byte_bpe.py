"""Byte-level BPE encoding and decoding with two tiers of lookup.

Pre-tokens that are vocabulary entries are resolved by a minimal perfect hash (hash and displace: one seed for each bucket
of keys, and the slot itself for buckets of one key). The others are merged from bytes: a heap holds the adjacent pairs of
a linked list by rank and place, and stale pairs are dropped when they come up. Results of distinct pre-tokens are kept
in a table bounded in bytes in each worker.

Edge cases: null and empty texts give no ids and the digests of nothing; text is encoded whole, control strings as ordinary text;
equal rows give equal rows; null and repeated identifiers are rows like any other; lone surrogates become the replacement character; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Memo, vocabulary_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The same alternatives as the general pattern, for texts of ASCII and Latin-1 letters, where letters and digits are these ranges.
_PLAIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?(?:[{LETTERS}]+|[0-9]+|[^\\s{LETTERS}0-9]+)|\\s+(?!\\S)|\\s+")
_UNUSUAL = re.compile("[^\\t-\\r -~À-ÖØ-öø-ÿ]")


def load_ranks(name: str) -> dict[bytes, int]:
    with open(vocabulary_file(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash from n keys to n slots; `get` compares the key in the slot, so other keys give None."""

    def __init__(self, entries: dict[bytes, int]):
        n = len(entries)
        self.n, self.buckets = n, max(1, n // 2)
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in entries:
            groups[xxhash.xxh64_intdigest(key) % self.buckets].append(key)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if len(groups[b]) < 2:
                break
            seed, slots = 0, []
            while len(set(slots)) < len(groups[b]) or any(self.keys[s] is not None for s in slots):
                seed += 1
                slots = [xxhash.xxh64_intdigest(key, seed) % n for key in groups[b]]
            self.seeds[b] = seed
            for key, s in zip(groups[b], slots):
                self.keys[s] = key
        free = iter([s for s, key in enumerate(self.keys) if key is None])
        for b, group in enumerate(groups):
            if len(group) == 1:
                s = next(free)
                self.seeds[b], self.keys[s] = -s - 1, group[0]
        self.values = [entries[key] for key in self.keys]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        s = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return self.values[s] if self.keys[s] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is joined until none is in the vocabulary."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an index; -1 in after: gone
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, mid, end = heappop(heap)
        if after[i] != mid or after[mid] != end:
            continue
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (rank, i, end, after[end]))
        if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heappush(heap, (rank, left, i, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class ByteBPE(Memo):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        super().__init__()
        import public_tokenizers
        import regex

        self.ranks = load_ranks(name)
        self.whole = PerfectHash(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # the Unicode White_Space property
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{white}").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")
        self.general = regex.compile(pattern)

    def made(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        whole = self.whole.get(raw)
        ids = [whole] if whole is not None else merge_bytes(raw, self.ranks)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        find = self.general if _UNUSUAL.search(text) else _PLAIN
        return b"".join(map(self.__getitem__, find.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_CODERS: dict[str, ByteBPE] = {}


def coder(name: str) -> ByteBPE:
    """One coder per worker process."""
    if name not in _CODERS:
        _CODERS[name] = ByteBPE(name)
    return _CODERS[name]


def _map_text(fn, out, kinds):
    def run(batches):
        for batch in batches:
            rows = [fn(x) for x in batch.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *out])

    return run


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, ids): ids as one binary of little-endian unsigned 32-bit integers."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = _map_text(lambda t: (coder(vocabulary).encode(t),), ["ids"], [pa.binary()])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, bytes) of what encode_documents gave."""
    rows = encoded.select("doc_id", F.col("ids").alias("text"))
    run = _map_text(lambda ids: (coder(vocabulary).decode(ids or b""),), ["bytes"], [pa.binary()])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def both(text):
        bpe = coder(vocabulary)
        ids = bpe.encode(text)
        return len(ids) // 4, sha256(ids).hexdigest(), sha256(bpe.decode(ids)).hexdigest()

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = _map_text(both, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
