"""Token ids of whole texts by a tokenizers file, as the untouched library gives them.

Words repeat, so each distinct piece goes through the library once per worker and its ids are kept in a table bounded in
bytes. That holds for files whose normalizer and pre-tokenizer are the ones stated below: white space never takes part in a match
of their split pattern, nor in NFC composition, so a text's ids are those of its white-space separated chunks in order. Where a
text holds only printable ASCII without apostrophes and Latin-1 letters, a run of letters, one digit, or a run of other signs in a
chunk is exactly one pre-token, and the library's own BPE model encodes it directly. Texts that hold an added token's string, and all texts
under files with other rules, go through the library whole.

Edge cases: null and empty texts have no ids; very long texts and pieces are encoded whole; equal texts have equal ids.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from spanloom.llm.common import Memo, vocabulary_file

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(f"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9 \\t\\n\\r]+")
_UNUSUAL = re.compile("[^\\t\\n\\r -&(-~À-ÖØ-öø-ÿ]")
_CHUNK = re.compile("[^ \\t\\n\\r]+")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}


#: The rules under which a text may be cut into pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder(Memo):
    """Maps a piece to its ids as little-endian unsigned 32-bit integers; ``encode`` joins them for a text."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        path = vocabulary_file(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        plain = rules["model"].get("type") == "BPE" and not rules["model"].get("dropout") and not rules.get("post_processor") and not rules.get("truncation") and not rules.get("padding")
        added = rules.get("added_tokens") or []
        self.cut = plain and rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER and not any(t["normalized"] for t in added)
        self.added = [t["content"] for t in added]
        self.model = self.library.model
        self.alphabet = byte_alphabet()

    def made(self, piece: str) -> bytes:
        if piece[0] == "\0":  # a chunk for the whole library pipeline
            return self.whole(piece[1:])
        parts = _PIECE.findall(piece)
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return struct.pack(f"<{len(ids := self.model.tokenize(spelled))}I", *[token.id for token in ids])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut or any(t in text for t in self.added):
            return self.whole(text)
        if _UNUSUAL.search(text):
            return b"".join(map(self.__getitem__, ["\0" + x for x in _CHUNK.findall(text)]))
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """One encoder per worker process; its table stays warm from task to task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name)
    return _ENCODERS[name]
