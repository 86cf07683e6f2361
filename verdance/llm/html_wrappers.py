"""Main text of web pages by wrapper inference (union-free regular expressions) over same-host pages.

A page's token stream (start tags, text slots, end tags) is read as nested groups. A sequence of groups that comes again at once becomes a
repeated group. The wrapper of a host starts as one page's expression and is aligned with the next, again and again: a
mismatch of texts becomes a text slot, a mismatch of tags a repeated group where one side repeats what the other holds once, and else an optional one.
No alternatives are ever needed, so the wrapper is a union-free expression over the tags. In it the region of the article is
the marked article or main element, or else the smallest group that holds most of the long slots.

A page is read by its host's wrapper: the texts of the slots in the region are its main text. A slot that is on all pages of a host keeps the
texts that are the same on all of them: these belong to the template, not to any article, and are left out (``TEMPLATE_PAGES``). A page that
its host's wrapper doesn't fit is read by the wrapper of itself alone. Lists of words in classes and ids are hints of what is no article; within an article
they say nothing about headings, and ids, which are often made from headings, say it only by ``SURE_WORDS``.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship_by_value

#: Parts in which a host's expressions are merged before the parts are, a long slot's code points,
#: and bytes of wrappers that are broadcast at most; beyond that they are joined.
HOST_PARTS, LONG_SLOT, BROADCAST_BYTES = 64, 80, 32 << 20
#: Different pages of a host that must have a text in one place, all of them, before it counts as the template's; it never does where
#: the template would make up more of a page's region than the rest.
TEMPLATE_PAGES = 4
#: Kinds of groups in a sequence that is looked for as repeated, at most, and hosts whose expressions are merged in one task at once.
PERIOD, OPEN_HOSTS = 4, 256
#: Pairs of groups that are compared at most to align two contents.
LARGEST_TABLE = 1 << 22

#: Elements nested deeper are part of what holds them, as far as the wrapper goes; their texts are whole all the same.
MAX_DEPTH = 100

#: Elements by what they are (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset("head script style textarea title xmp iframe noembed noframes template noscript select button svg math object canvas audio video".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments commentlist respond replies disqus discussion footer masthead toolbar widget pagination pager banner contentinfo complementary search".split()
)
SURE_WORDS = frozenset("navbar breadcrumb breadcrumbs sidebar advert adverts advertisement sponsored cookies newsletter comment comments commentlist respond disqus masthead pagination".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset("header topbar".split())
MAIN_WORDS = frozenset("articlebody main article".split())
#: A start tag of the first kind ends an open element of the others.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "option": frozenset(["option"]),
}
#: An element that an end or an implied end doesn't reach beyond.
BARRIERS = frozenset("html body table td th article main section div ul ol dl nav aside footer header form".split())

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Open:
    """An open element."""

    tag: str
    key: str
    boiler: bool


@lru_cache(maxsize=1 << 14)
def _key(tag: str, attributes: str, within_main: bool) -> tuple[str, bool]:
    """An element's kind for alignment, and whether it holds no part of an article."""
    names: set[str] = set()
    hints: set[str] = set()
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            said = {w for w in re.split(r"[^a-z]+", value) if w}
            # Ids differ from page to page; only what they hint at makes a kind.
            names |= said & (BOILER_WORDS | HEADER_WORDS | MAIN_WORDS) if m[1].lower() == "id" else said
            names.update(w for w in WORD.findall(value.replace("-", "").replace("_", "")) if w in MAIN_WORDS)
            hints |= said & SURE_WORDS if within_main and m[1].lower() == "id" else said & BOILER_WORDS
    boiler = tag in BOILER_TAGS or tag in NO_TEXT or bool(hints and "articlebody" not in names)
    if within_main:
        boiler = boiler and tag not in HEADINGS
    else:
        boiler = boiler or tag == "header" or bool(names & HEADER_WORDS)
    if tag in ("html", "body", "article", "main") and not names & {"comment", "comments"}:
        boiler = False
    return f"{tag}.{'.'.join(sorted(names))}" if names else tag, boiler


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """The page as balanced events: ``("open", kind, boiler)``, ``("text", raw text, boiler)``, ``("break", "", ...)``, ``("close", kind, ...)``.

    Inline elements open and close nothing unless they hold no text of an article; implied ends are made explicit. Open elements are
    counted by tag, in all and since the last barrier, so no step looks through the open elements but to close them.
    """
    stack: list[Open] = []
    in_all: Counter[str] = Counter()
    since: list[Counter[str]] = [Counter()]
    hidden = mains = at = 0

    def push(element: Open) -> None:
        nonlocal hidden, mains
        stack.append(element)
        in_all[element.tag] += 1
        if element.tag in BARRIERS:
            since.append(Counter())
        since[-1][element.tag] += 1
        hidden += element.boiler
        mains += element.tag in ("article", "main")

    def close() -> tuple[str, str, bool]:
        nonlocal hidden, mains
        top = stack.pop()
        in_all[top.tag] -= 1
        since[-1][top.tag] -= 1
        if top.tag in BARRIERS:
            since.pop()
        hidden -= top.boiler
        mains -= top.tag in ("article", "main")
        return "close", top.key, hidden > 0

    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            yield "text", page[at:], hidden > 0
            break
        if m.start() > at:
            yield "text", page[at : m.start()], hidden > 0
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not m[0].endswith(">"):
            continue  # cut off within a tag
        if ends:
            known = since[-1] if tag in INLINE or tag == "p" else in_all
            if tag not in VOID and known[tag]:
                while stack[-1].tag != tag:
                    yield close()
                yield close()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            stop = page.find(">", at)
            at = stop + 1 if end and stop >= 0 else len(page)
            continue
        if tag in VOID:
            if tag not in INLINE:
                yield "break", "", hidden > 0
            elif tag == "br":
                yield "text", " ", hidden > 0
            continue
        ended = CLOSES.get(tag, ())
        while any(since[-1][t] for t in ended):
            yield close()
        if attributes.endswith("/") and tag in ("svg", "math", "object"):
            continue
        key, boiler = _key(tag, attributes, mains > 0)
        if tag in INLINE and not boiler:
            continue
        yield "open", key, boiler
        push(Open(tag, key, boiler))
    while stack:
        yield close()


def blocks(page: str) -> Iterator[tuple[str, str, bool]]:
    """The events with whole blocks in place of texts: ``("block", text, ...)``, decoded, without white space at the ends or in runs."""
    parts: list[str] = []

    def block() -> Iterator[tuple[str, str, bool]]:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                yield "block", text, False

    for what, value, hidden in events(page):
        if what == "text":
            if not hidden:
                parts.append(value)
            continue
        if what == "break" or not _is_inline(value):
            yield from block()
        if what != "break":
            yield what, value, hidden
    yield from block()


@dataclass
class Group:
    """A part of a union-free expression: a kind of element, whether it may be missing or may come again, and its content.

    The kind ``#`` is a text slot; ``+`` and some kinds is a sequence of groups of these that comes again.
    """

    kind: str
    boiler: bool = False
    optional: bool = False
    repeated: bool = False
    long: bool = False
    #: Digests of a slot's texts: all of a page's, and of several pages those that each of them has.
    texts: frozenset[int] = frozenset()
    inner: list[Group] = field(default_factory=list)

    def pack(self) -> list:
        return [self.kind, self.boiler + 2 * self.optional + 4 * self.repeated + 8 * self.long, sorted(self.texts), [x.pack() for x in self.inner]]


def unpack(x: list) -> Group:
    kind, bits, texts, inner = x
    return Group(kind, bool(bits & 1), bool(bits & 2), bool(bits & 4), bool(bits & 8), frozenset(texts), [unpack(y) for y in inner])


def merge(a: Group, b: Group, pages: bool = True) -> Group:
    """One group that fits what either fits; of different ``pages``, or of one."""
    texts = a.texts & b.texts if pages else a.texts | b.texts
    return Group(a.kind, a.boiler and b.boiler, a.optional or b.optional, a.repeated or b.repeated, a.long or b.long, texts, align(a.inner, b.inner, pages))


def again(a: Group, b: Group) -> Group:
    """``a`` and its next repetition ``b`` on the same page, or in the same wrapper."""
    out = merge(a, b, False)
    out.optional, out.repeated = a.optional and b.optional, True
    return out


def fold(groups: list[Group]) -> list[Group]:
    """Neighbours of one kind become one repeated group, and so do sequences of up to ``PERIOD`` kinds that come again at once."""
    out: list[Group] = []
    for g in groups:
        if out and out[-1].kind == g.kind:
            out[-1] = again(out[-1], g)
        else:
            out.append(g)
        for n in range(2, PERIOD + 1):
            if len(out) > n and out[-n - 1].kind == sequence(out[-n:]):
                out[-n - 1 :] = [again(out[-n - 1], Group(out[-n - 1].kind, inner=out[-n:]))]
                break
            if len(out) >= 2 * n and sequence(out[-n:]) == sequence(out[-2 * n : -n]) and not any(x.kind[:1] == "+" for x in out[-n:]):
                kind = sequence(out[-n:])
                out[-2 * n :] = [again(Group(kind, inner=out[-2 * n : -n]), Group(kind, inner=out[-n:]))]
                break
    return out


def sequence(groups: list[Group]) -> str:
    return "+" + "+".join(x.kind for x in groups)


def gather(groups: list[Group], sequences: set[str]) -> list[Group]:
    """``groups`` with each run that another expression has as a repeated sequence as one group."""
    out: list[Group] = []
    for g in groups:
        out.append(g)
        for n in range(2, PERIOD + 1):
            if len(out) >= n and (kind := sequence(out[-n:])) in sequences:
                out[-n:] = [Group(kind, inner=out[-n:])]
                if len(out) > 1 and out[-2].kind == kind:
                    out[-2:] = [again(out[-2], out[-1])]
                break
    return out


def align(a: list[Group], b: list[Group], pages: bool = True) -> list[Group]:
    """Content that fits both: the longest sequence of groups in common, the others optional."""
    if [x.kind for x in a] != [y.kind for y in b]:
        repeated = {x.kind for x in (*a, *b) if x.kind[:1] == "+"}
        if repeated:
            a, b = gather(a, repeated), gather(b, repeated)
    left, right = [x.kind for x in a], [y.kind for y in b]
    if left == right:
        return [merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    first = 0
    while first < min(len(left), len(right)) and left[first] == right[first]:
        first += 1
    last = 0
    while last < min(len(left), len(right)) - first and left[-1 - last] == right[-1 - last]:
        last += 1
    out = [merge(x, y, pages) for x, y in zip(a[:first], b[:first], strict=True)]
    i, j = first, first
    for k, n in _common(left[first : len(left) - last], right[first : len(right) - last]):
        out += _optional(a[i : first + k]) + _optional(b[j : first + n])
        out.append(merge(a[first + k], b[first + n], pages))
        i, j = first + k + 1, first + n + 1
    out += _optional(a[i : len(a) - last]) + _optional(b[j : len(b) - last])
    out += [merge(x, y, pages) for x, y in zip(a[len(a) - last :], b[len(b) - last :], strict=True)]
    return fold(out)


def _optional(groups: list[Group]) -> list[Group]:
    for g in groups:
        g.optional = True
    return groups


def _common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; where its table would be too large, of one that takes the next occurrence each time."""
    n, m = len(left), len(right)
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(k, len(number)) for k in kinds], np.int64) for kinds in (left, right))
    out: list[tuple[int, int]] = []
    if n * m > LARGEST_TABLE:
        where: dict[int, list[int]] = {}
        for j, k in enumerate(y.tolist()):
            where.setdefault(k, []).append(j)
        j = 0
        for i, k in enumerate(x.tolist()):
            at = bisect_left(where.get(k, []), j)
            if at < len(where.get(k, [])):
                out.append((i, where[k][at]))
                j = where[k][at] + 1
        return out
    longest = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        best = np.maximum(longest[i + 1, :-1], np.where(y == x[i], longest[i + 1, 1:] + 1, 0))
        longest[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif longest[i + 1, j] >= longest[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def expression(page: str) -> Group:
    """The page's own expression; its texts are slots, long or not."""
    root = Group("")
    path = [root]
    for what, value, hidden in blocks(page):
        if what == "open" and len(path) > MAX_DEPTH:
            path.append(path[-1])
        elif what == "open":
            path[-1].inner.append(g := Group(value, hidden))
            path.append(g)
        elif what == "close":
            g = path.pop()
            if g is not path[-1]:
                g.inner = fold(g.inner)
        else:
            path[-1].inner.append(Group("#", long=len(value) >= LONG_SLOT, texts=frozenset([digest(value)])))
    root.inner = fold(root.inner)
    return root


def infer(shapes: list[Group]) -> Group:
    """The wrapper: each expression in turn is aligned with what fits all before it."""
    wrapper = shapes[0]
    for s in shapes[1:]:
        wrapper = merge(wrapper, s)
    return wrapper


def _weight(g: Group) -> int:
    if g.boiler:
        return 0
    if g.kind == "#":
        return 3 if g.long else 1
    return sum(map(_weight, g.inner)) * (4 if g.repeated else 1)


def region(wrapper: Group) -> list[str]:
    """Kinds on the way from the page's root to the article."""
    marked: list[tuple[int, int, list[str]]] = []

    def find(g: Group, path: list[str]) -> None:
        if g.boiler:
            return
        names = set(g.kind.split("."))
        if names & MAIN_WORDS:
            marked.append((_weight(g), len(path), path))
        for x in g.inner:
            if x.kind != "#":
                find(x, path if x.kind[:1] == "+" else [*path, x.kind])

    find(wrapper, [])
    if marked:
        top = max(w for w, _, _ in marked)
        # An article within main is closer to the text than main; of like ones the one that holds most.
        return max((p for w, n, p in marked if 2 * w >= top), key=len)
    path, g = [], wrapper
    while True:
        total = _weight(g)
        inner = [x for x in g.inner if x.kind != "#" and not x.boiler and _tag(x) not in ("p", "h1", "h2", "h3", "li", "td", "blockquote", "pre")]
        best = max(inner, key=_weight, default=None)
        if best is None or 5 * _weight(best) < 4 * total:
            return path
        if best.kind[:1] != "+":
            path.append(best.kind)
        g = best


def _tag(g: Group) -> str:
    return g.kind.split(".")[0]


def template(wrapper: Group, path: list[str]) -> set[int]:
    """Digests of the texts in the region ``path`` that every page has in the same place, each with the place in it."""
    out: set[int] = set()

    def collect(g: Group, at: str) -> None:
        for x in g.inner:
            if x.optional or x.boiler or _tag(x) in HEADINGS:
                continue
            if x.kind == "#":
                out.update(placed(t, at) for t in x.texts)
            else:
                collect(x, at if x.kind[:1] == "+" else f"{at}/{x.kind}")

    def descend(g: Group, left: list[str]) -> None:
        if not left:
            collect(g, "")
            return
        for x in g.inner:
            if x.kind[:1] == "+":
                descend(x, left)
            elif x.kind == left[0]:
                descend(x, left[1:])

    descend(wrapper, path)
    return out


@lru_cache(maxsize=1 << 12)
def _place(at: str) -> int:
    return digest(at)


def placed(text: int, at: str) -> int:
    """A text's digest and its place below the region as one number."""
    return text ^ _place(at)


def extract(page: str, path: list[str] | None, constant: frozenset[int] = frozenset()) -> str | None:
    """The slots' texts in the region ``path`` without the template's, or None if the page has no such region."""
    found: list[str] = []
    fixed: list[bool] = []
    here: list[str] = []
    inside = -1 if path else 0
    known = not path
    for what, value, hidden in blocks(page):
        if what == "block":
            if inside >= 0:
                found.append(value)
                fixed.append(bool(constant) and placed(digest(value), "".join(f"/{k}" for k in here[inside:])) in constant)
        elif what == "open":
            here.append(value)
            if inside < 0 and not hidden and here == path:
                inside, known = len(here), True
        else:
            if inside == len(here) and path:
                inside = -1
            here.pop()
    if sum(len(t) for t, f in zip(found, fixed, strict=True) if f) * 2 <= sum(map(len, found)):
        found = [t for t, f in zip(found, fixed, strict=True) if not f]
    return "\n".join(found) if known else None


def _is_inline(kind: str) -> bool:
    return kind.partition(".")[0] in INLINE


def main_text(page: str | None, path: list[str] | None, constant: frozenset[int] = frozenset()) -> str:
    """The article's text, by the host's wrapper or else by that of the page alone."""
    if not page:
        return ""
    text = extract(page, path, constant) if path else None
    if text or (text is not None and set(path[-1].split(".")) & MAIN_WORDS):
        return text
    return extract(page, region(expression(page))) or ""


def all_texts(shape: Group) -> int:
    """A digest of a page's texts, whatever scripts and counters it has besides."""
    out: list[int] = []
    todo = [shape]
    while todo:
        g = todo.pop()
        out += g.texts
        todo += g.inner
    return digest(str(sorted(out)))


@dataclass
class Merged:
    """Some pages of a host as one expression, and digests of up to ``TEMPLATE_PAGES`` different pages among them."""

    shape: Group
    pages: set[int]

    def add(self, shape: Group, pages: set[int]) -> None:
        self.shape = merge(self.shape, shape)
        self.pages = set(sorted(self.pages | pages)[:TEMPLATE_PAGES])

    def row(self, host: str, part: int) -> tuple[str, int, str, str]:
        return host, part, json.dumps(self.shape.pack(), separators=(",", ":")), json.dumps(sorted(self.pages))


def _merged_rows(rows: list[tuple[str, int, str, str]]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, ["host", "part", "shape", "pages"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pages, merged by host and part; at most ``OPEN_HOSTS`` of these are held at a time."""
    held: dict[tuple[str, int], Merged] = {}
    for batch in batches:
        for host, part, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shape = expression(page or "")
            pages = {all_texts(shape)}
            if (host, part) in held:
                held[host, part].add(shape, pages)
            else:
                held[host, part] = Merged(shape, pages)
        if len(held) >= OPEN_HOSTS:
            yield _merged_rows([m.row(*k) for k, m in held.items()])
            held.clear()
    yield _merged_rows([m.row(*k) for k, m in held.items()])


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of host and part: each part as one expression, only one of which is held at a time."""
    key, merged = None, None
    for batch in batches:
        for host, part, shape, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            g, seen = unpack(json.loads(shape)), set(json.loads(pages))
            if (host, part) == key:
                merged.add(g, seen)
            else:
                if key is not None:
                    yield _merged_rows([merged.row(*key)])
                key, merged = (host, part), Merged(g, seen)
    if key is not None:
        yield _merged_rows([merged.row(*key)])


def _infer_host(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "shape"])
    wrapper = infer([unpack(json.loads(s)) for s in rows["shape"]])
    path = region(wrapper)
    pages = set().union(*(json.loads(p) for p in rows["pages"]))
    constant = sorted(template(wrapper, path)) if len(pages) >= TEMPLATE_PAGES else []
    packed = json.dumps(wrapper.pack(), separators=(",", ":"))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [packed], "region": ["\t".join(path)], "template": [json.dumps(constant)]})


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, wrapper, region, template``: each host's wrapper, the path to the article in it, and the digests of the template's texts there.

    A host's pages are dealt to ``HOST_PARTS`` parts by hash. Each task merges what it has of a part, then the parts are merged and then the host, so
    no task holds all pages of a host.
    """
    part = F.pmod(F.xxhash64(page), F.lit(HOST_PARTS)).cast("int")
    rows = pages.select(host_of(url).alias("host"), part.alias("part"), F.col(page).alias("html"))
    shapes = map_arrow(rows, _shapes, "host string, part int, shape string, pages string")
    ordered = shapes.repartition("host", "part").sortWithinPartitions("host", "part", "shape")
    merged = map_arrow(ordered, _merge_parts, "host string, part int, shape string, pages string")
    return merged.groupBy("host").applyInPandas(_infer_host, "host string, wrapper string, region string, template string")


def host_of(url: str):
    """A URL's host in small letters; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Blocks are separated by one line feed; white space within a block, ``br`` included, is one space; character references
    are decoded. A null or empty page has an empty text; a null URL belongs to the host ""; repeated rows and null ids stay; an empty table gives
    no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    wrappers = cut(infer_wrappers(pages, url, page).select("host", "region", "template"))
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("region") + F.octet_length("template") + 64)).first()[0] or 0
    rows = pages.select(F.col(row_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("host"))
    if size <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r["host"]: (r["region"], r["template"]) for r in wrappers.collect()})
        rows = rows.withColumns({"region": F.lit(None).cast("string"), "template": F.lit(None).cast("string")})
    else:
        known = None
        rows = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "region", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constant = lru_cache(maxsize=64)(lambda said: frozenset(json.loads(said or "[]")))
        for batch in batches:
            hosts, regions, templates = (batch.column(c).to_pylist() for c in ("host", "region", "template"))
            if known is not None:
                regions, templates = zip(*(known.value.get(h, (None, None)) for h in hosts), strict=True)
            out = [main_text(p, r.split("\t") if r else None, constant(t)) for p, r, t in zip(batch.column("html").to_pylist(), regions, templates, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    id_type = dict(rows.dtypes)["page_id"]
    return map_arrow(rows, texts, f"page_id {id_type}, url string, text string, n_chars long")


ship_by_value(__name__)
