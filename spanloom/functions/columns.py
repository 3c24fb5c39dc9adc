"""Column functions over text, times, spans and vectors; all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def ends_sentence(word: Column) -> Column:
    return F.trim(word).rlike(r"[.!?…]$")


def ends_clause(word: Column) -> Column:
    return F.trim(word).rlike(r"[,;:—-]$")


def lowered(text: Column) -> Column:
    """Lower case sign by sign, as the SQL has it; whole texts would turn a dotted capital I into two signs."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    """Substring test of the lower-cased text against each marker."""
    lower = lowered(text)
    return any_of(F.contains(lower, F.lit(m)) for m in markers)


def any_of(tests: Iterable[Column]) -> Column:
    """Tests that share a text, one after the other: compiled code makes it once, where a lambda over the markers would make it for each of them."""
    return reduce(or_, tests, F.lit(False))


def opens_with(text: Column, markers: Sequence[str]) -> Column:
    """Prefix test after leading signs are stripped."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^[^a-z0-9]+", "")
    return any_of(F.startswith(bare, F.lit(m)) for m in markers)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def first_tokens(text: Column, n: int) -> Column:
    """The first tokens alone; the rest of a long text isn't looked at."""
    return F.regexp_extract_all(F.regexp_extract(F.lower(text), "^(?:[^a-z0-9']*+[a-z0-9']++){0,%d}" % n, 0), F.lit("[a-z0-9']+"), F.lit(0))


def mentions(text: Column, term: Column) -> Column:
    """A token equals the term, give or take a plural s."""
    return F.arrays_overlap(tokens(text), F.array(term, F.concat(term, F.lit("s")), F.regexp_replace(term, "s+$", "")))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter span."""
    shorter = F.least(e1 - s1, e2 - s2)
    return F.when(shorter > 0, overlap(s1, e1, s2, e2) / shorter).otherwise(F.lit(0.0))


def envelope_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the envelope of both spans."""
    whole = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(whole > 0, overlap(s1, e1, s2, e2) / whole).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def _clock(total: Column, *parts: int) -> list[Column]:
    out = []
    for p in parts:
        out.append(F.floor(total / p))
        total = total % p
    return [*out, total]


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.format_string("%02d:%02d:%02d,%03d", *(c.cast("long") for c in _clock(F.greatest(ms, F.lit(0)), 3_600_000, 60_000, 1000)))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, centiseconds rounded half to even."""
    cs = F.bround(F.greatest(ms, F.lit(0)) / 10, 0).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", *(c.cast("long") for c in _clock(cs, 360_000, 6000, 100)))


def short_time(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    h, m, s = (c.cast("long") for c in _clock(seconds.cast("long"), 3600, 60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def ass_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("\n"), F.lit(" "))


def clean_title(text: Column, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.btrim(F.trim(F.coalesce(text, F.lit(""))), F.lit("\"' ")), r"\s+", " "), 1, longest)


def slug(text: Column, longest: int = 60) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), 1, longest)


def tags(text: Column, most: int = 5) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda t: F.lower(F.regexp_replace(F.trim(t), "^#+", "")))
    return F.slice(F.filter(parts, lambda t: t != ""), 1, most)


def json_object(text: Column) -> Column:
    """The text as a JSON object, whole or between its outermost braces; null for anything else."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.when(F.trim(text).rlike(r"(?s)^\{.*\}$"), F.try_parse_json(F.trim(text)))
    return F.coalesce(whole, F.when(inner != "", F.try_parse_json(inner)))


def clamp(value: Column, lo: float, hi: float, default: float) -> Column:
    number = F.coalesce(value.try_cast("double"), F.lit(float(default)))
    return F.least(F.greatest(number, F.lit(float(lo))), F.lit(float(hi)))


def is_url(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("(?i)^https?://"), F.lit(False))
