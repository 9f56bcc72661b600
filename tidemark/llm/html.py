"""Main text of web pages by site template removal.

1. A page is parsed to a tree (lenient: missing and stray end tags, truncated
   pages). Every element's subtree gets a hash of its tags and text.
2. Spark counts, for each host and for its site (the host's last two labels), on how
   many pages with different text a subtree and a text block occur. One on at least
   ``MIN_PAGES`` and ``MIN_SHARE`` of the group's different pages recurs. A recurring
   subtree is template, unless over half of its pages are copies of one another: then
   it is content that was published twice. Pages are copies if they share their least
   block that does not recur. Only a page with little text in such blocks (under half;
   under a seventh for a subtree on over half of the group's pages) goes by its least
   recurring block elsewhere. A page counts here for the subtrees that lie in no larger
   recurring one, which goes or stays with all it holds.
3. Template subtrees are deleted. What doesn't recur often enough to be counted goes by
   its role (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
   comments): by tag, by the ``role`` attribute, or by a token of class or id that is such
   a word or ends in one after a hyphen. An element that holds the page's article, or a
   form that holds most of its text, is not of a role.
4. Where a page marks its article, the rest of the page goes as well, and single
   paragraphs within it are never template, however often they are quoted.

Blocks are the text between block elements: references decoded, white space as
one space, trimmed; empty ones drop out; the others are joined by a line feed.

Defined cases: null or empty html gives an empty text; a null url is of host '';
repeated rows count as one page and get equal texts; a very long page is parsed
whole; an empty table gives an empty one; other columns pass through (the
operator's own names raise).
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urls import url_parts

MIN_PAGES = 5
MIN_SHARE = 0.005
COPY_PARTS = 7  # near copies that share three quarters of their text in all have under a seventh of their own
BROADCAST_ROWS = 1_000_000

#: Fixed values of HTML: elements without content, with raw content, that break text, that end an open element of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What an end tag can't reach beyond.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
FENCES = frozenset("div section article main td li body table aside nav header footer form".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr figcaption".split())
#: Boilerplate roles: by tag, by the role attribute, by a word of class or id.
BOILERPLATE_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select textarea dialog head title menu object".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments "
    "disqus replies discussion respond widget toolbar pagination".split()
)

#: Words before a hyphen that make a class speak of the page's layout, not of the element.
LAYOUT_WORDS = frozenset("no non has have with without is not hide show".split())

#: A comment, a declaration, or a tag with its attributes; a value without quotes may hold quotes.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|=|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[-_:]+")


def _speaks(token: str) -> bool:
    """Whether a class or id names a boilerplate role."""
    parts = [p for p in _PART.split(token) if p]
    return bool(parts) and parts[-1] in BOILERPLATE_WORDS and LAYOUT_WORDS.isdisjoint(parts[:-1])


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE_TAGS:
        return True
    if tag in ("html", "body", "main", "article") and "comment" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "role" and value in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id") and any(map(_speaks, value.split())):
            return True
    return False


class _Open:
    """The open elements, with the places of each tag in them: closing looks at no element that stays open."""

    def __init__(self) -> None:
        self.elements, self.tags, self.blocks = [0], ["#page"], [0]
        self.places: dict[str, list[int]] = defaultdict(list)

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def push(self, element: int, tag: str) -> None:
        self.places[tag].append(len(self.elements))
        if tag in BLOCK:
            self.blocks.append(len(self.elements))
        self.elements.append(element)
        self.tags.append(tag)

    def cut(self, at: int) -> None:
        while len(self.elements) > at:
            self.elements.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        at = self.last(tag)
        if at > 0 and (tag in BLOCK or at > self.blocks[-1]):  # an inline end tag stays within its block
            self.cut(at)

    def imply(self, tag: str) -> None:
        """End what the start of a block element ends."""
        for name in ({"p"} if tag != "option" else set()) | ENDS.get(tag, set()):
            at = self.last(name)
            if at > 0 and at > max(map(self.last, FENCE.get(name, FENCES))):
                self.cut(at)


class Page:
    """A parsed page: elements in order of their start tags, and text blocks. roles: whether roles decide."""

    def __init__(self, html: str, roles: bool = True) -> None:
        self.tags, self.parents, self.own = ["#page"], [0], [False]
        self.silent = [False]  # in an inline element of a role: its text stays out of the block around it
        self.blocks: list[tuple[int, str]] = []  # element, text
        self.parts: list[list[str]] = [[]]
        opened, text, owner, at = _Open(), [], 0, 0
        stack = opened.elements
        low = None

        def flush() -> None:
            if text:
                block = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((owner, block))
                    self.parts[owner].append(block)

        for m in iter(lambda: _TAG.search(html, at), None):
            if m.start() > at and not self.silent[stack[-1]]:
                if not text:
                    owner = stack[-1]
                text.append(html[at : m.start()])
            at = m.end() if m.end() > m.start() else m.end() + 1
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    flush()
                depth = len(stack)
                opened.close(tag)
                if text and len(stack) < depth and owner > stack[-1]:  # a run goes on in the element around an inline one
                    owner = stack[-1]
                continue
            if tag in BLOCK:
                flush()
                opened.imply(tag)
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
                continue
            self._open(opened, tag, (roles or tag in RAW) and _boilerplate(tag, m[3]))
            if tag in RAW:
                low = html.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == len(html) else -1
                if end < 0:
                    found = re.compile(f"</{tag}", re.I).search(html, at)
                    end = found.start() if found else len(html)
                at = end
        if at < len(html) and not self.silent[stack[-1]]:
            if not text:
                owner = stack[-1]
            text.append(html[at:])
        flush()
        self._settle(roles)

    def _open(self, opened: _Open, tag: str, drop: bool) -> None:
        parent = opened.elements[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.parts.append([])
        self.own.append(drop)
        self.silent.append(self.silent[parent] or drop and tag not in BLOCK)
        opened.push(len(self.tags) - 1, tag)

    def _settle(self, roles: bool) -> None:
        """What goes by its role, and what lies in the article: known once the whole page is."""
        n = len(self.tags)
        marks = [roles and t in ("article", "main") and not drop for t, drop in zip(self.tags, self.own, strict=True)]
        holds, size = list(marks), [0] * n
        for owner, block in self.blocks:
            size[owner] += len(block)
        for k in range(n - 1, 0, -1):
            holds[self.parents[k]] |= holds[k]
            size[self.parents[k]] += size[k]
        self.dropped, self.article = [False] * n, [False] * n
        for k in range(1, n):
            spared = holds[k] or self.tags[k] == "form" and 2 * size[k] > size[0]
            self.dropped[k] = self.dropped[self.parents[k]] or self.own[k] and not spared
            self.article[k] = self.article[self.parents[k]] or marks[k] and not self.dropped[k]

    @cached_property
    def subtrees(self) -> dict[int, int]:
        """Hash of each element that could be template and has text."""
        n = len(self.tags)
        pieces: list[list[str]] = [[] for _ in range(n)]
        hashes: dict[int, int] = {}
        for k in range(n - 1, 0, -1):
            pieces[k].reverse()
            if not (self.parts[k] or pieces[k]):
                continue
            digest = _digest("\x01".join([self.tags[k], *self.parts[k], *pieces[k]]))
            pieces[self.parents[k]].append(digest.hex())
            if self.tags[k] in BLOCK and self.tags[k] not in ("html", "body", "article", "main") and not (self.article[k] and self.tags[k] in PARAGRAPHS):
                hashes[k] = int.from_bytes(digest, "big", signed=True)
        return hashes

    @cached_property
    def block_hashes(self) -> list[int]:
        return [_hash(b) for _, b in self.blocks]

    @cached_property
    def items(self) -> set[int]:
        """What is counted of the page."""
        return {*self.subtrees.values(), *self.block_hashes}

    @cached_property
    def print(self) -> int:
        """Pages of equal text count once."""
        return _hash("\n".join(b for _, b in self.blocks))

    def text(self, template: Callable[[int], bool] | None = None) -> str:
        """The main text, with the subtrees whose hash is template deleted."""
        gone = list(self.dropped)
        hashes = self.subtrees if template else {}
        for k in range(1, len(gone)):
            gone[k] = gone[k] or gone[self.parents[k]] or (k in hashes and template(hashes[k]))
        marked = any(self.article[o] and not self.dropped[o] for o, _ in self.blocks)
        return "\n".join(b for o, b in self.blocks if not gone[o] and (self.article[o] or not marked))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _hash(text: str) -> int:
    return int.from_bytes(_digest(text), "big", signed=True)


@lru_cache(1 << 16)
def groups_of(host: str) -> list[str]:
    """The groups whose pages are counted together: the host, and its site (in capitals, so that it is no host)."""
    labels = host.split(".")
    return [host, ".".join(labels[-2:]).upper()] if len(labels) > 2 else [host]


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, item, page) of each subtree and block, and one row without an item for the page itself."""
    for batch in batches:
        groups, items, prints = [], [], []
        for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            page = Page(html or "")
            found = [None, *page.items]
            for group in groups_of(host):
                groups += [group] * len(found)
                items += found
                prints += [page.print] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(items, pa.int64()), pa.array(prints, pa.int64())], names=["group", "item", "page"])


def _family_rows(page: Page, recurs: Callable[[int], bool]) -> Iterator[tuple[int, int, int, int, int]]:
    """(subtree, least own block, least recurring block elsewhere, parts, page) of each recurring subtree in no other one.

    parts is 2 if under half of the page's text is in own blocks, 7 if under a seventh is, else 0.
    """
    found = {k for k, h in page.subtrees.items() if recurs(h)}
    if not found:
        return
    covered, hashes = [False] * len(page.tags), {}
    for k in range(1, len(page.tags)):
        covered[k] = covered[page.parents[k]] or page.parents[k] in found
        if k in found and not covered[k]:
            hashes[page.subtrees[k]] = k
    ends = list(range(len(page.tags)))
    for k in range(len(ends) - 1, 0, -1):
        ends[page.parents[k]] = max(ends[page.parents[k]], ends[k])
    least, mine, whole, shared = 0, 0, 0, []
    for h, (owner, block) in zip(page.block_hashes, page.blocks, strict=True):
        whole += len(block)
        if recurs(h):
            shared.append((h, owner))
        else:
            mine += len(block)
            least = min(least, h) if mine > len(block) else h
    shared.sort()
    parts = COPY_PARTS if COPY_PARTS * mine < whole else 2 if 2 * mine < whole else 0
    for subtree, k in hashes.items():
        yield subtree, least, next((b for b, o in shared if not k <= o <= ends[k]), 0), parts, page.print


@lru_cache(1 << 16)
def _group_hash(group: str) -> int:
    return _hash(group)


def _key(group: str, item: int) -> int:
    return _group_hash(group) ^ item


def _page_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, group, item, key) of each page, which its two hashes tell apart."""
    for batch in batches:
        rows = []
        for host, html, p1, p2 in zip(*(batch[c].to_pylist() for c in ("host", "html", "_p1", "_p2")), strict=True):
            found = Page(html or "").items
            rows += [(p1, p2, g, i, _key(g, i)) for g in groups_of(host) for i in found]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_p1", "_p2", "group", "item", "key"])


def _given(hosted: DataFrame, table: DataFrame, broadcast_rows: int) -> tuple[DataFrame, Callable[[list[int] | None], Callable[[str], Callable[[int], bool]]]]:
    """hosted with _known, and the test of a page's hashes, by group, against the (group, item) rows of table.

    A table of up to broadcast_rows is sent to every task; of a larger one each page
    gets those of its own items that are in it, by a join.
    """
    context = hosted.sparkSession.sparkContext
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = table.toArrow()
        keys = np.unique(np.array([_key(g, i) for g, i in zip(found["group"].to_pylist(), found["item"].to_pylist(), strict=True)], np.int64))
        sent = context.broadcast(frozenset(keys.tolist()))
        given = hosted.withColumn("_known", F.lit(None).cast("array<long>"))
    else:
        sent = context.broadcast(frozenset())
        keyed = hosted.withColumn("_p1", F.xxhash64("host", "html")).withColumn("_p2", F.xxhash64(F.lit(1), "html", "host"))
        items = keyed.select("host", "html", "_p1", "_p2").mapInArrow(_page_items, "_p1 long, _p2 long, group string, item long, key long")
        own = items.join(table, ["group", "item"]).groupBy("_p1", "_p2").agg(F.collect_set("key").alias("_known"))  # at most the page's own items
        given = keyed.join(own, ["_p1", "_p2"], "left").drop("_p1", "_p2")

    def test(own: list[int] | None) -> Callable[[str], Callable[[int], bool]]:
        known = frozenset(own) if own else sent.value

        def of(group: str) -> Callable[[int], bool]:
            of_group = _group_hash(group)
            return lambda item: item ^ of_group in known

        return of

    return given, test


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(group, item) of the template elements; pages: host, html."""
    rows = pages.mapInArrow(_counted_rows, "group string, item long, page long")
    counted = rows.distinct().groupBy("group", "item").agg(F.count("*").alias("n"))
    counted = written(counted.filter(F.col("item").isNull() | (F.col("n") >= min_pages)), "counted-items")
    sizes = counted.filter("item is null").select("group", F.col("n").alias("pages"))
    recurring = written(counted.filter("item is not null").join(sizes, "group").filter(F.col("n") >= min_share * F.col("pages")), "recurring-items")
    given, test = _given(pages, recurring.select("group", "item"), broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, html, own in zip(*(batch[c].to_pylist() for c in ("host", "html", "_known")), strict=True):
                page = Page(html or "")
                for group in groups_of(host):
                    out += [(group, *x) for x in _family_rows(page, test(own)(group))]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(x, pa.int64()) for x in columns[1:]]], names=["group", "item", "own", "shared", "parts", "page"])

    families = given.select("host", "html", "_known").mapInArrow(run, "group string, item long, own long, shared long, parts long, page long").distinct().join(recurring, ["group", "item"])
    copy = F.col("parts") >= F.when(2 * F.col("n") > F.col("pages"), COPY_PARTS).otherwise(2)
    counted = (
        families.groupBy("group", "item", F.when(copy, F.col("shared")).otherwise(F.col("own")).alias("family")).agg(F.count("*").alias("n"))
        .groupBy("group", "item").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    )
    return counted.filter(2 * F.col("largest") <= F.col("n")).select("group", "item")


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS, roles: bool = True) -> DataFrame:
    """pages' columns but html, with text and n_chars (code points). roles: whether roles and marked articles decide beside the templates."""
    taken = {"text", "n_chars", "host", "path", "_known", "_p1", "_p2"} & {c.lower() for c in pages.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    hosted = url_parts(pages).drop("path")
    template = written(template_subtrees(hosted.select("host", "html"), min_pages, min_share, broadcast_rows), "template-subtrees")
    schema = pages.drop("html").schema.add("text", "string").add("n_chars", "long")
    names = [c for c in pages.columns if c != "html"]
    given, test = _given(hosted, template, broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, html, own in zip(*(batch[c].to_pylist() for c in ("host", "html", "_known")), strict=True):
                of = [test(own)(g) for g in groups_of(host)]
                texts.append(Page(html or "", roles).text(lambda h, of=of: any(t(h) for t in of)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return given.select(*names, "host", "html", "_known").mapInArrow(run, schema)
