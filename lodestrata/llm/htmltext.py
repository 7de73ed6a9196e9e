"""Main text of web pages by consensus paths of their host.

Every page is read into containers; each container is scored by the text of its own blocks, less links.  From the best
one the winner is raised to the article around it, else to its main element, else to the container around it as long
as that adds prose or the page's heading.  Its generalised path (tags with classes, digits folded) is a vote for it at the page's host; Spark
counts the votes (combined map-side: a host with a third of all pages sends one row a task and path).  Pages are then
read again: elements on the host's winning path give the text, boilerplate inside them left out; a page that lacks the
path takes its own winner.  A path is a 64-bit hash, so deep pages cost no more than others.

Text: character references are decoded once, in each run of text by itself; white space within a block becomes one
space, blocks are joined in page order by a space.  Left out: scripts, styles, menus, page headers and footers,
sidebars, forms, graphics, and elements whose class, id or role names an advert, a notice, comments and the like.  A
name counts if all its words are such words or neutral ones (``related-posts``, not ``related-work``); where other
words stand beside them the score decides: the element goes if most of its text is in links.

Defined cases: a null or empty page, or one without text outside boilerplate, has an empty text; a url without a host
(or null) votes with the other such pages; paths with equal votes are ordered by their characters, then by their hash;
an element that is not closed ends where its parent ends, raw text (scripts, styles, titles, text areas, frames) ends
with the page, and graphics, objects, selects, templates and the like that are closed nowhere have no content; repeated
rows vote and are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import Scratch, ship

#: Bytes of hosts and winning paths that are broadcast to the second reading at most; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: A container is raised to the one around it if that has so many times its text, less links, at least.
RAISE = 1.1

#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("svg math foreignobject object select template noscript canvas audio video datalist".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button".split())
CONTAINER = frozenset("body article main section div td center blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words of names (class, id) that mark boilerplate, and words that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist disqus respond reply replies reviews sidebar aside rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer copyright share sharing social related recommended recommendations pagination pager skip search".split())
NEUTRAL = frozenset("area article articles bar block body bottom box button buttons container content entry feed footer form global group header headline holder html icon icons inner item items js label left legal link links list main media module outer page pages panel post posts primary reader readers right row secondary section site slot small stories sticky text thread title top unit user users wide wrap wrapper x".split())
CONTENT = frozenset("post entry article hentry content story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CLOSING = re.compile("</(" + "|".join(sorted(HIDDEN)) + r")(?=[\s/>])", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}


class Node:
    """An open element: its path, whether it is boilerplate, whether it is on the wanted path, and its container.

    ``chars`` and ``linked`` count the text of a container's own blocks, and of everything in an element whose name
    leaves doubt (``doubt`` is the nearest such element).
    """

    __slots__ = ("tag", "path", "out", "on", "inside", "container", "around", "doubt", "chars", "linked")

    def __init__(self, tag: str, path: int, out: bool, on: bool, inside: bool, parent: Node | None, container: bool, doubt: bool) -> None:
        self.tag, self.path, self.out, self.on, self.inside = tag, path, out, on, inside
        self.around = parent.container if parent else None
        self.container = self if container or parent is None else parent.container
        self.doubt = Doubt(parent.doubt if parent else None) if doubt else parent.doubt if parent else None
        self.chars = self.linked = 0


class Doubt:
    """Text, and text in links, of an element whose name alone does not tell whether it is boilerplate."""

    __slots__ = ("above", "chars", "linked")

    def __init__(self, above: Doubt | None) -> None:
        self.above, self.chars, self.linked = above, 0, 0

    def links(self) -> bool:
        return 2 * self.linked > self.chars


_names: dict[str, int] = {}


def judge(name: str) -> int:
    """2: a class or id that marks boilerplate; 1: one that may; 0: any other."""
    if name not in _names:
        words = [w.lower() for w in _WORDS.findall(name)]
        marks = sum(w in MARKS for w in words)
        if len(_names) > 100_000:
            _names.clear()
        layout = "content" in words and not {"sidebar", "aside", "rail"}.isdisjoint(words)  # what holds both columns
        _names[name] = 0 if not marks else 1 if layout or not all(w in MARKS or w in NEUTRAL for w in words) else 2
    return _names[name]


def _marked(tag: str, names: list[str], roles: list[str]) -> int:
    if tag in ("html", "body"):
        return 0
    if any(r.lower() in ROLES for r in roles):
        return 2
    if tag in ("article", "main"):  # these hold content unless a whole name says otherwise
        low = {n.lower() for n in names}
        return 2 if low & MARKS and not low & CONTENT else 0
    return max(map(judge, names), default=0)


@lru_cache(maxsize=1 << 16)
def _described(tag: str, attributes: str) -> tuple[bytes, int]:
    """The step of a path that an element makes (its tag, and its classes with digits folded), and how it is marked."""
    found: dict[str, list[str]] = {"class": [], "id": [], "role": []}
    for a in _ATTRIBUTE.finditer(attributes):
        found[a[1].lower()].extend((a[2] or a[3] or a[4] or "").split())
    step = ".".join([tag, *sorted({_DIGITS.sub("#", n) for n in found["class"]})]).encode()
    return step, _marked(tag, found["class"] + found["id"], found["role"])


@lru_cache(maxsize=1 << 16)
def _path(above: int, step: bytes) -> int:
    """Hash of a path one step further."""
    low = zlib.crc32(step, above & 0xFFFFFFFF)
    return zlib.crc32(step[::-1], (above >> 32) ^ low) << 32 | low


def read(page: str, wanted: int | None = None) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(blocks, containers) outside boilerplate: (innermost element, decoded text, characters in links), in page order."""
    root = Node("#page", 1, False, wanted == 1, False, None, True, False)
    stack, containers = [root], [root]
    open_tags: Counter[str] = Counter()
    blocks: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links = linked = 0
    at, end = 0, len(page)
    closed: dict[str, int] | None = None  # where each hidden element is closed last

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                home = next(x for x in reversed(stack) if x.tag not in HIDDEN)
                blocks.append((home, text, min(linked, len(text))))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].out:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_tags[x.tag] -= 1
        del stack[k:]

    def close(tag: str) -> None:
        if open_tags[tag]:
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            cut(k)

    def push(tag: str, path: int, out: bool, container: bool, doubt: bool) -> None:
        top = stack[-1]
        node = Node(tag, path, out, top.on or path == wanted, top.inside or tag in ("article", "main"), top, container, doubt)
        if container and not out:
            containers.append(node)
        open_tags[tag] += 1
        stack.append(node)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, top = m[2].lower(), stack[-1]
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in HIDDEN:
                close(tag)
            elif tag in BLOCK:
                flush()
                close(tag)
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = ends.end() if ends else end
            continue
        if tag == "a":
            links += 1
            continue
        if tag in HIDDEN:
            if closed is None:
                closed = {x[1].lower(): x.start() for x in _CLOSING.finditer(page)}
            if not m[3].endswith("/>") and closed.get(tag, -1) >= at:
                push(tag, top.path, True, False, False)
            continue
        if tag not in BLOCK:
            continue
        while stack[-1].tag in ("svg", "math"):  # text elements end a graphic
            cut(len(stack) - 1)
        flush()
        if tag in VOID:
            continue
        if stack[-1].tag == "p":
            cut(len(stack) - 1)
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            if any(open_tags[x] for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ends:
                        cut(k)
                        break
        top = stack[-1]
        step, mark = _described(tag, m[3])
        out = top.out or tag in BOILERPLATE or (tag == "header" and not top.inside) or mark == 2
        push(tag, _path(top.path, step), out, tag in CONTAINER, mark == 1 and not out)
    flush()
    for node, text, of in blocks:
        d = node.doubt
        while d is not None:
            d.chars, d.linked, d = d.chars + len(text), d.linked + of, d.above

    def dropped(d: Doubt | None) -> bool:
        while d is not None and not d.links():
            d = d.above
        return d is not None

    return [b for b in blocks if not dropped(b[0].doubt)], containers


def best(blocks: list[tuple[Node, str, int]], containers: list[Node]) -> tuple[Node, int] | None:
    """The container whose own blocks hold most text, links counted against it, raised; and all its text's length.

    The first of equals.
    """
    for node, text, linked in blocks:
        node.container.chars += len(text)
        node.container.linked += linked
    place = {id(c): i for i, c in enumerate(containers)}
    found = max(containers, key=lambda c: (c.chars - 2 * c.linked, -place[id(c)]), default=None)
    if found is None or not found.chars:
        return None
    total = [c.chars for c in containers]  # with everything inside: containers come before those they hold
    worth = [c.chars - 2 * c.linked for c in containers]
    titled = {id(node.container) for node, _, _ in blocks if node.tag == "h1"}
    for i in range(len(containers) - 1, 0, -1):
        j = place[id(containers[i].around)]
        total[j] += total[i]
        worth[j] += max(0, worth[i])
    for kind in ("article", "main"):
        c = found
        while c is not None and c.tag != kind:
            c = c.around
        if c is not None:
            return c, total[place[id(c)]]
    while (c := found.around) is not None and c.tag not in ("body", "#page"):
        if worth[place[id(c)]] < (1.0 if id(c) in titled else RAISE) * worth[place[id(found)]]:
            break
        found = c
    return found, total[place[id(found)]]


def vote(page: str | None) -> tuple[int, int] | None:
    """(path, characters) of a page's winner."""
    found = best(*read(page or ""))
    return (found[0].path, found[1]) if found else None


def extract(page: str | None, path: int | None) -> str:
    """Text of the elements on ``path``, or of the page's own winner where there is none."""
    blocks, containers = read(page or "", path)
    texts = [text for node, text, _ in blocks if node.on]
    if not texts and (found := best(blocks, containers)):
        held = {id(found[0])}
        for c in containers:
            if c.around is not None and id(c.around) in held:
                held.add(id(c))
        texts = [text for node, text, _ in blocks if id(node.container) in held]
    return " ".join(texts)


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _unsigned(path: int | None) -> int | None:
    return None if path is None else path & 0xFFFFFFFFFFFFFFFF


def winners(pages: DataFrame) -> DataFrame:
    """host, path: each host's path with most votes (then most text, then the largest hash) of pages(host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = vote(page.as_py())
                if v:
                    cell = total.setdefault((host, v[0]), [0, 0])
                    cell[0] += 1
                    cell[1] += v[1]
            if len(total) > 100_000:
                yield give(total)
        yield give(total)

    def give(total: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], type=pa.string()), pa.array([_signed(k[1]) for k in total], type=pa.int64()), pa.array([v[0] for v in total.values()], type=pa.int64()), pa.array([v[1] for v in total.values()], type=pa.int64())], names=["host", "path", "votes", "chars"])
        total.clear()
        return out

    votes = pages.select("host", "html").mapInArrow(run, "host string, path long, votes long, chars long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "chars", "path")).alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    ship(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    won = scratch.keep(winners(rows), "winners")
    size = won.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    won = F.broadcast(won) if size <= BROADCAST_BYTES else won

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), _unsigned(path.as_py())) for page, path in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(won, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
