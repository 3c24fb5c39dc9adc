"""Personal data by fixed patterns and a semi-Markov conditional random field.

The fixed patterns (e-mail addresses, internet addresses, card and phone numbers, each with its own check) give the base spans. Around
what could be personal data (a sign for "at", or digits close together) the text becomes an island of tokens: runs of letters, runs of
digits, single signs. Every run of up to MOST_TOKENS tokens that could be of a kind is a candidate segment, and features of
the whole segment score it: its shape, digit groups, separators, checks and surroundings. A dynamic program
over token borders, with weights for which kind follows which, chooses borders and kinds jointly: entities are bounded, so the work is linear in
the text. Base spans are clamped, so they are always found; segments that the field finds beside them are added.

Weights maximise the conditional likelihood on a bounded sample of islands, SAMPLE for each kind and as many without any, drawn by a hash of
the island over all documents. Base spans are the labels. Spoiled copies (a wrong check digit, a part over 255, digits run together) are
labelled as nothing and rewritten ones (no country code, dots between groups, "(at)", "[.]") as their kind, so the field learns
what makes a kind, not how the pattern is written.

Edge cases: null and empty texts have no span; equal texts have equal spans; null and repeated identifiers are rows like any other and may be
text; other columns are ignored; without base spans in the sample, or on an empty table, nothing is added; base spans of two kinds
may overlap and all stay, an added one overlaps none; a span may be as long as its pattern runs. Places are code points.
"""

from __future__ import annotations

import math
import re
import string
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Islands of each kind, and without any, that the weights are fitted on at most; a fixed bound, whatever the input's size.
SAMPLE = 60
MOST_TOKENS, REACH = 16, 48  # tokens of a segment that the field adds; characters of an island on either side of what called for it
BUCKETS, EPOCHS, BATCH, RATE, RIDGE = 4096, 8, 25, 0.4, 1e-3
MARGIN = 2.0  # what a segment's log-odds have to exceed to be added
CLAMPED = 1e6
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

#: Fixed patterns, written so that no text takes more than linear time; e-mail addresses are found from their domain backwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_NO_DIGITS = {c: None for c in map(ord, " ().-+[]")}
_HINT = re.compile(r"@|[(\[]at[)\]]|[0-9](?:[^0-9\n]{0,3}[0-9]){6,}+|[0-9]++(?:[^0-9\n]{1,3}[0-9]++){3}", re.I)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\dA-Za-z_]+|\s+|.", re.S)
_GROUP = re.compile("[0-9]+")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _part(group: str) -> bool:
    group = group.lstrip("0")
    return len(group) < 3 or len(group) == 3 and int(group) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; leftmost and apart for each kind, and those that fail their check dropped."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = last + len(text[last:at].rstrip(_LOCAL))
        if start < at:
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = at + 1
    for m in _IP.finditer(text):
        if all(map(_part, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if m.end() - m.start() >= 11 and 10 <= len(m[0].translate(_NO_DIGITS)) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str, base: list) -> list[tuple[int, int]]:
    """Parts of the text that islands are made of: what may be personal data with REACH characters on either side, inside its line."""
    hits = [m.span() for m in _HINT.finditer(text)] + [(s, e) for s, _, e in base]
    out: list[tuple[int, int]] = []
    for s, e in sorted(hits):
        lo = max(s - REACH, 0)
        lo = max(lo, text.rfind("\n", lo, s) + 1)
        hi = text.find("\n", e, e + REACH)
        hi = hi if hi >= 0 else min(e + REACH, len(text))
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _sort(c: str) -> str:
    return "^" if not c else "9" if c in string.digits else "a" if c.isalpha() else "_" if c.isspace() else c


def _feature(name: str) -> int:
    return crc32(name.encode("utf-8", "replace")) % BUCKETS


_BIAS = _feature("bias")


def features(span: str, left: str, right: str) -> list[int]:
    """What the field sees of a whole segment and of the characters beside it."""
    groups = _GROUP.findall(span)
    n = sum(map(len, groups))
    signs = "".join(sorted({c for c in span if not (c.isalnum() and c.isascii())}))
    shape = re.sub(r"[A-Za-z]+", "a", _GROUP.sub("9", span))
    names = [f"n{n}", f"g{len(groups)}", f"s{signs}", f"p{shape[:32]}", f"l{_sort(left)}", f"r{_sort(right)}", f"b{_sort(left)}{_sort(span[0])}", f"e{_sort(span[-1])}{_sort(right)}", f"w{'-'.join(str(len(g)) for g in groups[:8])}", f"k{min(len(span) // 4, 16)}"]
    if n >= 12:
        check = luhn("".join(groups))
        names += [f"luhn{check}", f"luhn{check}{len(groups)}"]
    if "@" in span or "at" in span:
        names += [f"mail{bool(_MAIL.fullmatch(span))}"]
    if len(groups) == 4:
        names += [f"parts{all(map(_part, groups))}"]
    return [_BIAS, *map(_feature, names)]


def possible(digits: int, groups: int, ats: int, words: int, dots: int) -> list[int]:
    """Kinds that a segment can be of at all."""
    if ats:
        return [0] if ats == 1 and words >= 2 else []  # a word or two, and a top-level domain
    if words:
        return []
    return [k for k, fits in ((1, groups == 4 and dots == 3 and digits <= 12), (2, 12 <= digits <= 19), (3, 7 <= digits <= 15)) if fits]


class Island:
    """Tokens of a region and its candidate segments, as arcs (from border, to border, kind, row of features)."""

    def __init__(self, text: str, lo: int, hi: int, base: list):
        self.text = text
        self.borders = [lo] + [lo + m.end() for m in _TOKEN.finditer(text[lo:hi])]
        at = {p: i for i, p in enumerate(self.borders)}
        self.base = sorted((at[s], at[e], k) for s, k, e in base if s in at and e in at)
        self.clamped = set(self.base)
        self.taken = np.zeros(len(self.borders), dtype=bool)  # tokens of base spans
        for i, j, _ in self.base:
            self.taken[i:j] = True
        self.rows: list[list[int]] = []
        self.arcs: list[tuple[int, int, int, int]] = []

    def fill(self, a: int, b: int, across: bool = False) -> None:
        """Arcs that start at borders a to b, in order: the base spans and all possible segments; those over tokens of a base span only if `across`."""
        self.rows, self.arcs = [], []
        text, borders = self.text, self.borders
        for i in range(a, min(b, len(borders) - 1)):
            first = text[borders[i]]
            if not (first.isascii() and first.isalnum() or first in "+("):
                continue
            digits = groups = ats = words = dots = 0
            for j in range(i + 1, min(i + 1 + MOST_TOKENS, len(borders))):
                piece = text[borders[j - 1] : borders[j]]
                if "\n" in piece or not piece.isascii() or self.taken[j - 1] and not across:
                    break
                if piece[0] in string.digits:
                    digits, groups = digits + len(piece), groups + 1
                elif piece[0] == "@" or piece.lower() == "at" and text[borders[j - 1] - 1 : borders[j - 1]] in ("(", "["):
                    ats += 1
                elif piece[0].isalpha():
                    words += 1
                dots += piece == "."
                if digits > 19 or ats > 1 or words and not ats and digits > 15:
                    break
                if not text[borders[j] - 1].isalnum():
                    continue
                kinds = [k for k in possible(digits, groups, ats, words, dots) if (i, j, k) not in self.clamped]
                if kinds:
                    self._add(i, j, kinds)
        for i, j, k in self.base:
            if a <= i < b:
                self._add(i, j, [k])
        self.arcs.sort()

    def _add(self, i: int, j: int, kinds: list[int]) -> None:
        s, e = self.borders[i], self.borders[j]
        self.rows.append(features(self.text[s:e], self.text[s - 1 : s], self.text[e : e + 1]))
        self.arcs += [(i, j, k, len(self.rows) - 1) for k in kinds]


class Field:
    """Weights of segments, by feature and kind, and of a kind after another (0: no kind)."""

    def __init__(self):
        self.w, self.turn = np.zeros((BUCKETS, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS)))

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(KINDS)))
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return np.add.reduceat(self.w[np.concatenate(rows)], np.cumsum(sizes) - sizes)

    def decode(self, island: Island, margin: float = MARGIN, block: int = 2048) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation; base spans are worth more than anything beside them."""
        n, turn = len(island.borders), self.turn.tolist()
        low = float("-inf")
        best = [[low] * (len(KINDS) + 1) for _ in range(n)]
        back: list = [[None] * (len(KINDS) + 1) for _ in range(n)]
        best[0][0] = 0.0
        for lo in range(0, n, block):
            island.fill(lo, lo + block)
            scores, at = self.scores(island.rows).tolist(), 0
            arcs = island.arcs
            for i in range(lo, min(lo + block, n)):
                here = best[i]
                top = max(range(len(here)), key=here.__getitem__)
                if i + 1 < n and here[top] > best[i + 1][0]:
                    best[i + 1][0], back[i + 1][0] = here[top], (i, top)
                while at < len(arcs) and arcs[at][0] == i:
                    _, j, k, row = arcs[at]
                    at += 1
                    gain = CLAMPED if (i, j, k) in island.clamped else scores[row][k] - margin
                    for p, v in enumerate(here):
                        if v + turn[p][k] + gain > best[j][k + 1]:
                            best[j][k + 1], back[j][k + 1] = v + turn[p][k] + gain, (i, p)
        out, j = [], n - 1
        state = max(range(len(KINDS) + 1), key=best[j].__getitem__)
        while j:
            i, p = back[j][state]
            if state:
                out.append((island.borders[i], state - 1, island.borders[j]))
            j, state = i, p
        return out[::-1]

    def spans(self, text: "str | None", margin: float = MARGIN) -> list[tuple[int, int, int, bool]]:
        """(start, kind, end, base) of a text: the base spans and those that the field adds."""
        if not text:
            return []
        base = base_spans(text)
        found = {(s, k, e): True for s, k, e in base}
        at = 0
        for lo, hi in regions(text, base):
            mine = []
            while at < len(base) and base[at][0] < hi:
                mine.append(base[at])
                at += 1
            for span in self.decode(Island(text, lo, hi, mine), margin):
                found.setdefault(span, False)
        return [(*span, found[span]) for span in sorted(found)]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == float("-inf") else top + math.log(sum(math.exp(v - top) for v in values))


def _expected(n: int, arcs: list, scores: list, turn: list) -> tuple[dict, list]:
    """How likely each arc is, and each kind after each, over all segmentations (forward and backward sums)."""
    low, kinds = float("-inf"), len(KINDS)
    ahead = [[[] for _ in range(kinds + 1)] for _ in range(n)]
    ahead[0][0].append(0.0)
    alpha, into = [], []
    starts: dict = {}
    for a, arc in enumerate(arcs):
        starts.setdefault(arc[0], []).append(a)
    for i in range(n):
        here = [_log_sum(x) if x else low for x in ahead[i]]
        alpha.append(here)
        if i + 1 < n:
            ahead[i + 1][0].append(_log_sum(here))
        into.append([_log_sum([v + turn[p][k] for p, v in enumerate(here)]) for k in range(kinds)] if i in starts else None)
        for a in starts.get(i, ()):
            _, j, k, row = arcs[a]
            ahead[j][k + 1].append(into[i][k] + scores[row][k])
    beta: list = [None] * n
    beta[n - 1] = [0.0] * (kinds + 1)
    for i in range(n - 2, -1, -1):
        plain = beta[i + 1][0]
        ways: list = [[plain] for _ in range(kinds + 1)]
        for a in starts.get(i, ()):
            _, j, k, row = arcs[a]
            for p in range(kinds + 1):
                ways[p].append(turn[p][k] + scores[row][k] + beta[j][k + 1])
        beta[i] = [_log_sum(x) for x in ways]
    total = _log_sum([v + beta[n - 1][p] for p, v in enumerate(alpha[n - 1])])
    share, turns = {}, [[0.0] * kinds for _ in range(kinds + 1)]
    for a, (i, j, k, row) in enumerate(arcs):
        rest = scores[row][k] + beta[j][k + 1] - total
        share[a] = math.exp(min(0.0, into[i][k] + rest))
        for p in range(kinds + 1):
            turns[p][k] += math.exp(min(0.0, alpha[i][p] + turn[p][k] + rest))
    return share, turns


def rewritten(text: str, s: int, e: int, kind: int) -> list[tuple[str, list]]:
    """Copies of a labelled island: the same datum written another way, and spoiled ones that are no datum."""
    span, put = text[s:e], lambda new: text[:s] + new + text[e:]
    kept, spoiled = [], []
    digits = "".join(_GROUP.findall(span))
    if kind == 0:
        local, _, domain = span.partition("@")
        kept += [f"{local} (at) {domain}", f"{local}[at]{domain}"]
    elif kind == 1:
        a, b, c, d = span.split(".")
        kept += [f"{a}[.]{b}[.]{c}[.]{d}", f"{a}.{b}.{c}[.]{d}"]
        spoiled += [f"{a}.{b}.{c}.{256 + int(d[-4:])}", f"{a}[.]{300 + int(b[-4:])}[.]{c}[.]{d}"]
    elif kind == 2:
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        kept += [".".join(four), "/".join(four)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        spoiled += [wrong, ".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4))]
    else:
        at = span.find("(")
        if at > 0 and span[at:].count(")") == 1:
            kept += [span[at:], span[at:].replace("-", ".")]
        spoiled += [digits, span[-8:].lstrip("+(). -")]
    out = [(put(new), [(s, kind, s + len(new))]) for new in kept]
    return out + [(put(new), []) for new in spoiled if new and not base_spans(put(new))]


def train(examples: list[tuple[str, list]]) -> Field:
    """Weights from islands (text, labelled spans) by steps along the likelihood, smaller where a weight has moved much."""
    model, made = Field(), []
    for text, spans in examples:
        island = Island(text, 0, len(text), spans)
        if set(x for s in spans for x in (s[0], s[2])) <= set(island.borders):
            island.fill(0, len(island.borders), True)
            made.append((len(island.borders), island.arcs, island.rows, [arc[:3] in island.clamped for arc in island.arcs]))
    seen_w, seen_t = np.full_like(model.w, 1e-6), np.full_like(model.turn, 1e-6)
    for _ in range(EPOCHS):
        for at in range(0, len(made), BATCH):
            step_w, step_t = RIDGE * model.w, RIDGE * model.turn
            for n, arcs, rows, gold in made[at : at + BATCH]:
                if not arcs:
                    continue
                share, turns = _expected(n, arcs, model.scores(rows).tolist(), model.turn.tolist())
                index, kind, value = [], [], []
                for a, (i, _, k, row) in enumerate(arcs):
                    g = share[a] - gold[a]
                    if abs(g) > 1e-9:
                        index += rows[row]
                        kind += [k] * len(rows[row])
                        value += [g] * len(rows[row])
                        if gold[a]:
                            before = [x[2] for x, y in zip(arcs, gold) if y and x[1] == i]
                            step_t[before[0] + 1 if before else 0, k] -= 1
                np.add.at(step_w, (index, kind), value)
                step_t += turns
            seen_w += step_w * step_w
            seen_t += step_t * step_t
            model.w -= RATE * step_w / np.sqrt(seen_w)
            model.turn -= RATE * step_t / np.sqrt(seen_t)
    return model


def _islands(batches):
    """Islands of whole texts with what the fixed patterns say of them: text, spans as s:k:e, and the kind of the first or -1."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            if text:
                base = base_spans(text)
                for lo, hi in regions(text, base):
                    if hi - lo > 400:
                        continue  # nothing to learn a single datum from
                    mine = [(s - lo, k, e - lo) for s, k, e in base if s >= lo and e <= hi]
                    apart = all(a[2] <= b[0] for a, b in zip(mine, mine[1:]))
                    if apart:
                        out.append((text[lo:hi], " ".join(f"{s}:{k}:{e}" for s, k, e in mine), mine[0][1] if mine else -1))
        cols = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], names=["island", "spans", "kind"])


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Weights from at most `sample` different islands of each kind and without any, out of all documents."""
    texts = docs.select(F.col(text_col).alias("text"))
    islands = written(texts.mapInArrow(_islands, "island string, spans string, kind int").distinct(), "islands")
    rows = []
    for kind in (-1, *range(len(KINDS))):
        chosen = islands.where(F.col("kind") == kind).orderBy(F.xxhash64("island"), "island").limit(sample)
        rows += [(r["island"], [tuple(map(int, x.split(":"))) for x in r["spans"].split()]) for r in chosen.collect()]  # at most `sample`
    examples = list(rows)
    for text, spans in rows:
        if len(spans) == 1:
            examples += rewritten(text, *(spans[0][p] for p in (0, 2, 1)))
    examples.sort(key=lambda x: crc32(x[0].encode()))
    return train(examples)


def find(docs: DataFrame, model: Field | None = None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs' doc_id and `found`: all spans by start, then kind; base says which ones the fixed patterns give."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in shared.value.spans(t, margin)] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found {SPANS}")


def written_out(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256, spans (all of them), n_added."""
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    added = (F.size("found") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"), added)


def redact(text: "str | None", spans: list) -> "str | None":
    """A text with each span (kind, start, end, ...) replaced by its kind in brackets; where spans overlap, the first that begins covers both."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs with the personal data in their texts replaced; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, [(KINDS[k], s, e) for s, k, e, _ in shared.value.spans(t)]))

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
