"""Main text of web pages, with site templates removed.

Every element's subtree is hashed twice: by its tag, class names and content, with numbers, links and the page's own title masked,
and by its slot, which is tag, class names and nesting without the texts, where equal neighbours count once. Spark counts both for
each host over distinct pages, where pages that give the same text before any deletion are one page however often they are
copied. Four kinds of subtrees are template and are deleted:

- frame: what stands outside the article on many pages of the host. Sites use several layouts, so a small share of the pages is
  enough. A frame is deleted wherever it stands outside an article, on pages that have none too.
- slot: a container outside the article whose slot is on a large share of the host's pages and whose texts come back: a menu, a footer or
  a box that is filled in many ways. What fills it on one page alone goes with the rest.
- strong slot: one of whose different texts most come back. Only these are deleted on pages without an article, and never one that
  holds more than half of the page's text.
- anything that stands on a large share of the host's pages: boxes (div, section) inside the article, and all of a page that has
  no article. Paragraphs, headings, lists and quotes that recur in an article are content and stay, as do html, body and
  whatever is or holds the article.

The text is what is left of the body. Rules on tags and class names then take what recurrence can't see on a host of few pages: menus,
headers, footers, sidebars, notices, adverts, forms and comments; scripts, styles and what isn't shown never were text. On hosts of fewer than TRUSTED_PAGES
distinct pages, where frames may be unseen, only the article is taken if there is one; elsewhere it only protects.

Edge cases: null html and null url are empty; pages that repeat an identifier are pages of their own; a page without an article
or main element gives what is left of its body; unclosed elements end with their parent, a cut tag at the end is dropped;
an empty table gives an empty result; a page may be as long as a row.
"""

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import hot_limit, join_salted, written

#: A subtree is template from this many distinct pages of its host on, and from a share of them: a small one for what stands outside
#: articles, a large one for anything else. A page has few subtrees, so few can reach a share: a host's list stays short.
MIN_PAGES, FRAME_SHARE, MIN_SHARE = 5, 0.01, 0.3
#: Share of a slot's different texts that stand on two pages or more, from which it is a slot, and a strong one.
COMES_BACK, STRONG = 0.05, 0.5
TRUSTED_PAGES = 20
#: Template hashes up to which they are broadcast; more are joined by host.
BROADCAST_ROWS = 200_000

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^<>]*\Z|[^<]+|<", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
_HIDDEN = frozenset("head noscript template iframe object svg canvas audio video".split())
_DROP = _HIDDEN | frozenset("nav footer aside form button select textarea dialog menu".split())
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|signup|social|share|sharing|related|recommend\w*|comments?|respond|replies|disqus|widget|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: What can be template inside an article, and what is no slot of its own.
_BOXES = frozenset(("div", "section"))
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody figure figcaption article main html body title".split()) | _HIDDEN
_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
_P_ENDS = frozenset("p div ul ol li table section article main aside nav footer header form h1 h2 h3 h4 h5 h6 blockquote pre hr dl figure address fieldset".split())


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROP or tag == "header" and not inside:
        return True
    return "=" in attrs and any(_BOILERPLATE.search(a or b or c) for a, b, c in _NAMES.findall(attrs))


def _masked(text: str) -> str:
    return _DIGITS.sub("0", text) if _DIGITS.search(text) else text


def _hash(parts: list) -> int:
    h = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


class _Element:
    __slots__ = ("tag", "attrs", "parts", "masked", "slot", "before", "chars", "dropped", "inside", "protected")

    def __init__(self, tag: str, attrs: str, before: int, dropped: bool, inside: bool, protected: bool):
        name = tag + _masked(" ".join(a or b or c for a, b, c in _NAMES.findall(attrs))) if "=" in attrs else tag
        self.tag, self.attrs, self.parts, self.masked, self.slot = tag, attrs, [tag, attrs], [name], [name]
        self.before, self.chars, self.dropped, self.inside, self.protected = before, 0, dropped, inside, protected


class Templates:
    """Hashes of a host's templates by kind, and whether it has enough pages for its frames to be seen."""

    def __init__(self, frames=(), anywhere=(), slots=(), strong=(), trusted: bool = False):
        self.frames, self.anywhere, self.slots, self.strong, self.trusted = frozenset(frames or ()), frozenset(anywhere or ()), frozenset(slots or ()), frozenset(strong or ()), bool(trusted)


_NONE = Templates()


class _Page:
    """One pass over a page: its blocks, and the hashes of its subtrees that can be template. Without `rules` nothing but what isn't shown is
    dropped by its tag or class names."""

    def __init__(self, source: str, templates: Templates = _NONE, rules: bool = True):
        self.templates, self.rules, self.removed = templates, rules, 0
        self.outside, self.frames, self.boxes, self.slots = set(), set(), set(), set()
        self.blocks: list[tuple[str, bool]] = []  # text, in the article
        self.marked: list[tuple[int, int, int]] = []  # slots to delete once the page is known: blocks from and to, slot
        self.run: list[str] = []
        self.stack: list[_Element] = []
        self.has_main, self.title = False, ""
        for m in _PART.finditer(source):
            raw = m[0]
            if m[3]:
                (self.close if m[2] else self.open)(m[3].lower(), m[4])
            elif raw[0] != "<" or raw == "<":
                self.text(raw)
        self.end_block()
        while self.stack:
            self.pop()
        self._clear_slots()

    def dropped(self) -> bool:
        return bool(self.stack) and self.stack[-1].dropped

    def inside(self) -> bool:
        return bool(self.stack) and self.stack[-1].inside

    def text(self, raw: str) -> None:
        if self.stack:
            top = self.stack[-1]
            top.parts.append(raw)
            shown = _SPACE.sub(" ", raw).strip()
            if shown:
                if top.tag == "title" and not self.title:
                    self.title = shown
                elif self.title and len(self.title) > 8 and self.title in shown:
                    shown = shown.replace(self.title, "\1")
                top.masked.append(_masked(shown))
                top.chars += len(shown)
                if top.slot[-1] != "t":
                    top.slot.append("t")
        if not self.dropped():
            self.run.append(html.unescape(raw))

    def end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.run)).strip()
        self.run = []
        if text:
            self.blocks.append((text, self.inside()))

    def open(self, tag: str, attrs: str) -> None:
        if tag not in _INLINE:
            self.end_block()
        if tag in _VOID:
            return
        main = tag in ("article", "main") or 'role="main"' in attrs
        if main and self.dropped():  # an unclosed part of the frame doesn't hide the article
            if not _boilerplate(tag, attrs, True) and all(e.tag in _DROP for e in self.stack if e.dropped) and "comment" not in " ".join(e.attrs for e in self.stack):
                while self.dropped():
                    self.pop()
        if tag in _P_ENDS and self.stack and self.stack[-1].tag == "p":
            self.pop()
        if tag == "li" and self.stack and self.stack[-1].tag == "li":
            self.pop()
        inside = self.inside()
        dropped = self.dropped() or (_boilerplate(tag, attrs, inside) if self.rules else tag in _HIDDEN)
        if main and not dropped:
            inside = self.has_main = True
            for e in self.stack:
                e.protected = True
        self.stack.append(_Element(tag, attrs, len(self.blocks), dropped, inside, main and not dropped))

    def close(self, tag: str, _attrs: str) -> None:
        if tag not in _INLINE:
            self.end_block()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                break
            if self.stack[k].tag in ("article", "main") and tag in _INLINE:
                return
        else:
            return
        while len(self.stack) > k:
            self.pop()

    def pop(self) -> None:
        if self.stack[-1].tag not in _INLINE:
            self.end_block()
        e = self.stack.pop()
        h, m, s = map(_hash, (e.parts, e.masked, e.slot))
        slot = "t" if e.tag in _INLINE else f"{s:x}"
        if self.stack:
            above = self.stack[-1]
            above.parts.append(f"{h:x}")
            above.masked.append(f"{m:x}")
            above.chars += e.chars
            if above.slot[-1] != slot:
                above.slot.append(slot)
        if e.protected or e.tag in _INLINE or e.tag in ("html", "body") or e.inside and e.tag not in _BOXES:
            return
        if e.inside:
            self.boxes.add(h)
        else:
            self.outside.add(h)
            self.frames.add(m)
        if h in self.templates.anywhere or not e.inside and m in self.templates.frames:
            self.removed += 1
            del self.blocks[e.before :]
            self.marked = [x for x in self.marked if x[0] < e.before]  # what was inside is gone
        elif not e.inside and e.tag not in _CONTENT and e.chars:
            self.slots.add((s, m))
            if s in self.templates.slots:
                self.marked.append((e.before, len(self.blocks), s))

    def _clear_slots(self) -> None:
        """Delete the slots, now that it is known whether the page has an article to protect what is content."""
        size = sum(len(t) for t, _ in self.blocks)
        gone: set = set()
        for a, b, s in self.marked:
            if self.has_main or s in self.templates.strong and 2 * sum(len(t) for t, _ in self.blocks[a:b]) <= size:
                self.removed += 1
                gone.update(range(a, b))
        if gone:
            self.blocks = [x for i, x in enumerate(self.blocks) if i not in gone]

    def candidates(self) -> tuple[list, list, list]:
        """Masked hashes of what stands outside an article, hashes of all that can be template, and slots with what fills them."""
        return sorted(self.frames) if self.has_main else [], sorted(self.outside | self.boxes), sorted(self.slots)

    def main_text(self) -> str:
        whole = self.templates.trusted or not self.has_main
        return " ".join(text for text, inside in self.blocks if whole or inside)


def main_text(source: "str | None", templates: Templates = _NONE, rules: bool = True) -> str:
    return _Page(source or "", templates, rules).main_text()


def host(c):
    return F.coalesce(F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_PAIR = pa.struct([("slot", pa.int64()), ("hash", pa.int64())])


def _subtrees(batches):
    for batch in batches:
        pages = [_Page(source or "") for source in batch.column("html").to_pylist()]
        texts = [xxhash.xxh3_128_hexdigest(p.main_text().encode("utf-8", "replace")) for p in pages]
        frames, others, slots = zip(*(p.candidates() for p in pages)) if pages else ((), (), ())
        slots = [[{"slot": s, "hash": h} for s, h in x] for x in slots]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(texts, pa.string()), pa.array(frames, kind), pa.array(others, kind), pa.array(slots, pa.list_(_PAIR))], names=["host", "content", "frames", "others", "slots"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, frame_share: float = FRAME_SHARE, min_share: float = MIN_SHARE, comes_back: float = COMES_BACK) -> DataFrame:
    """(host, frames, anywhere, slots, strong, trusted): hashes of the subtrees that recur on distinct pages of the host, by kind."""
    kind = "host string, content string, frames array<long>, others array<long>, slots array<struct<slot:long,hash:long>>"
    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_subtrees, kind)
    distinct = rows.groupBy("host", "content").agg(F.min(F.struct("frames", "others", "slots")).alias("x"))
    none = F.lit(None)
    item = lambda h, s, f: F.struct(h.cast("long").alias("hash"), s.cast("long").alias("slot"), F.lit(f).alias("frame"))
    slots = F.array_distinct(F.transform("x.slots", lambda x: x["slot"]))
    each = [F.array(item(none, none, False)), F.transform("x.frames", lambda h: item(h, none, True)), F.transform("x.others", lambda h: item(h, none, False)), F.transform(slots, lambda s: item(none, s, False)), F.transform("x.slots", lambda x: item(x["hash"], x["slot"], False))]
    counts = distinct.select("host", F.explode(F.concat(*each)).alias("i")).select("host", "i.*")  # without hash and slot: the page itself
    counts = counts.groupBy("host", "hash", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("frame").alias("n_frame"))
    fills = F.col("hash").isNotNull() & F.col("slot").isNotNull()
    counts = counts.groupBy("host", F.when(~fills, F.col("hash")).alias("hash"), "slot").agg(
        F.max(F.when(~fills, F.col("n"))).alias("n"), F.max("n_frame").alias("n_frame"), F.count_if(fills).alias("texts"), F.count_if(fills & (F.col("n") > 1)).alias("again")
    )
    counts = written(counts.where((F.col("n") >= min_pages) | (F.col("hash").isNull() & F.col("slot").isNull())), "subtree-counts")
    totals = counts.where("hash is null and slot is null").select("host", F.col("n").alias("pages"))
    rated = counts.join(totals, "host")
    many, page = F.col("n") >= F.col("pages") * min_share, F.col("hash").isNull() & F.col("slot").isNull()
    back = F.when(F.col("slot").isNotNull() & many, F.col("again") / F.col("texts"))
    framing = (F.col("n_frame") >= min_pages) & (F.col("n_frame") >= F.col("pages") * frame_share)
    plain = F.col("hash").isNotNull() & (F.col("n_frame") == 0)
    rated = rated.select("host", "pages", "hash", "slot", page.alias("page"), (plain & many).alias("anywhere"), (F.col("hash").isNotNull() & framing).alias("frame"), back.alias("back"))
    rated = rated.where((F.col("page") & (F.col("pages") >= TRUSTED_PAGES)) | F.col("anywhere") | F.col("frame") | (F.col("back") >= comes_back))
    listed = lambda c, when: F.collect_list(F.when(when, F.col(c)))
    return rated.groupBy("host").agg(
        listed("hash", F.col("frame")).alias("frames"), listed("hash", F.col("anywhere")).alias("anywhere"), listed("slot", F.col("back") >= comes_back).alias("slots"),
        listed("slot", F.col("back") >= STRONG).alias("strong"), (F.first("pages") >= TRUSTED_PAGES).alias("trusted"),
    )


_LISTS = ("frames", "anywhere", "slots", "strong", "trusted")


def _extracted(batches, of_host):
    """Rows of pages without their templates; of_host gives those of a row."""
    for batch in batches:
        names = batch.column("host").to_pylist()
        pages = [_Page(source or "", of_host(name, batch, i)) for i, (name, source) in enumerate(zip(names, batch.column("html").to_pylist()))]
        texts = [p.main_text() for p in pages]
        counts = pa.array([len(t) for t in texts], pa.int64()), pa.array([p.removed for p in pages], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_templates"])


def _from_broadcast(shared, use=_extracted):
    return lambda batches: use(batches, lambda name, batch, i: shared.value.get(name, _NONE))


def _from_columns(batches, use=_extracted):
    last: dict = {}  # templates of the hosts seen last

    def of_host(name, batch, i):
        if name not in last:
            if len(last) >= 64:
                last.pop(next(iter(last)))
            last[name] = Templates(*(batch.column(c)[i].as_py() for c in _LISTS))
        return last[name]

    return use(batches, of_host)


def _by_host(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows joined by host with templates; a host with a large share of the rows is dealt over several tasks, its templates to each."""
    sizes = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-sizes")
    limit = hot_limit(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    large = sizes.where(F.col("n") > limit).select("host", F.ceil(F.col("n") / limit).alias("parts"))  # few, by hot_limit
    return join_salted(rows, found, "host", large, F.xxhash64("page_id", "url", F.length("html")), "left")


def _with_templates(pages: DataFrame, found: DataFrame, use, out: str, broadcast_rows: int) -> DataFrame:
    """Each page seen beside its host's templates, which are broadcast up to a number and joined beyond."""
    size = found.agg(F.coalesce(F.sum(1 + F.size("frames") + F.size("anywhere") + F.size("slots") + F.size("strong")), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if size > broadcast_rows:
        return _by_host(rows, found).mapInArrow(lambda batches: _from_columns(batches, use), out)
    sets = {r["host"]: Templates(*(r[c] for c in _LISTS)) for r in found.collect()}  # at most `broadcast_rows` hashes
    return rows.mapInArrow(_from_broadcast(pages.sparkSession.sparkContext.broadcast(sets), use), out)


def extract_pages(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_templates (deleted subtrees)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return _with_templates(pages, written(site_templates(pages), "templates"), _extracted, f"page_id {kind}, url string, text string, n_chars long, n_templates int", broadcast_rows)


def _weighed(batches, of_host):
    for batch in batches:
        out = []
        for i, (name, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
            row = []
            for page in (_Page(source or "", rules=False), _Page(source or "", of_host(name, batch, i), rules=False)):
                row += [sum(len(t) for t, inside in page.blocks if inside is where) for where in (False, True)]
            out.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["outside", "inside", "outside_left", "inside_left"])


def template_effect(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What templates alone do, with all rules on tags and class names off: one row with the characters outside and inside articles, before and after."""
    found = written(site_templates(pages), "templates") if found is None else found
    each = _with_templates(pages, found, _weighed, "outside long, inside long, outside_left long, inside_left long", BROADCAST_ROWS)
    return each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("outside", "inside", "outside_left", "inside_left")))
