"""Main text of web pages by wrapper induction over the pages of a host.

Pages of a host come together in chunks. Each page becomes a tree of block elements whose leaves are
slots of text; sibling subtrees of equal shape that follow each other become one repeated node. Two trees
are aligned by simple tree matching: the largest number of matched nodes that keeps parents and the order
of siblings. All pages of a chunk are aligned with one page of the most usual shape. A text that stands in
the same slot on most of the chunk's distinct pages is template, and goes; what varies is content, unless
its place tells otherwise: menus, page headers, footers, sidebars, notices, adverts, forms and comments by
element, role, class or id, and runs of sibling blocks that are mostly links, unless they stand in a marked article
or main part. If a page marks its article (or its main
part), the text comes from there.

Chunks have at most ``CHUNK`` pages, so a host of any size is cut, and memory is bounded; hosts with many
pages are dealt over several tasks. NULL and empty pages, and pages without such text, have an empty text.
A page whose URL has no host is compared with others of that kind. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 100
#: Hosts with more than this part of all pages are dealt over several tasks; so there are at most this many.
HEAVY = 2000
#: A text is template if it stands in its slot on this share of the distinct pages, and on so many of them.
CONSTANT_SHARE, CONSTANT_PAGES = 0.6, 4
#: A block is a list of links if more of its characters than this are in links.
LINKED = 0.6

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html iframe legend li main menu nav noscript object ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes svg annotation annotation-xml".split())
CLOSES_P = BLOCK_TAGS - frozenset("button object option iframe noscript".split())
#: An opening tag ends an open element of these kinds, up to the element that holds them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
OUTSIDE_TAGS = frozenset("nav footer aside form button select option iframe noscript template dialog menu object search fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|topbar|breadcrumbs?|sidebar|side|aside|footer|foot|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|respond|replies|disqus|widget|pagination|pager|login|signup|search|skip|copyright|toolbar|masthead)(?:$|[\s_-])"
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|head)(?:$|[\s_-])")
MAIN = re.compile(r"(?:^|[\s_-])(?:main|content|main-content|article-body|articlebody|post-body|entry-content|post-content|story)(?:$|[\s_-])")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")


class _Node:
    __slots__ = ("tag", "label", "outside", "main", "kids")

    def __init__(self, tag: str, label: str, outside: bool, main: int):
        self.tag, self.label, self.outside, self.main, self.kids = tag, label, outside, main, []


class Page:
    """The tree of a page: ``shape`` is nested tuples, ``blocks`` its texts in order with the slot of each."""

    def __init__(self, html: str):
        self.texts: list[tuple[str, bool, int]] = []  # text, outside, how well its place is marked as main
        root = _read(html, self.texts)
        self.slots: list[int] = [0] * len(self.texts)
        self.shape, _ = self._shape(root, 0)

    def _shape(self, node: _Node, first: int) -> tuple[tuple, int]:
        """The shape of a subtree whose slots are numbered from ``first``, and how many it has."""
        kids: list[tuple] = []
        count = before = 0
        for kid in node.kids:
            if isinstance(kid, int):
                shape, many = SLOT, 1
                place = before if kids and kids[-1] == SLOT else count
                self.slots[kid] = first + place
            else:
                shape, many = self._shape(kid, first + count)
                place = count
                if kids and kids[-1] == shape and many:
                    self._shape(kid, first + before)
                    place = before
            if kids and kids[-1] == shape:
                continue
            kids.append(shape)
            before = place
            count += many
        return (node.label, tuple(kids)), count


SLOT = ("#", ())


def _read(html: str, texts: list) -> _Node:
    root = _Node("", "", False, 0)
    stack, inline = [root], 0
    buffer: list[str] = []
    linked: list[str] = []
    menus: list[tuple | None] = []  # of each text its parent and kind of element, if it is mostly links

    def close() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                top = stack[-1]
                top.kids.append(len(texts))
                texts.append((text, top.outside, top.main))
                links = len(" ".join(entities.unescape("".join(linked)).split()))
                holder = stack[-2] if len(stack) > 1 else None
                menus.append((id(holder), top.label) if links > LINKED * len(text) and top.main < 2 else None)
            buffer.clear()
            linked.clear()

    at = 0
    while True:
        found = TOKEN.search(html, at)
        text = html[at : found.start()] if found else html[at:]
        if text:
            buffer.append(text)
            if inline:
                linked.append(text)
        if not found:
            break
        at = found.end()
        slash, name, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if name == "a":
            inline = 0 if slash else 1
        elif name == "br":
            buffer.append(" ")
        elif name in RAW:
            if not slash and not rest.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif name == "head" and not slash:
            pass
        elif name in BLOCK_TAGS:
            close()
            if slash:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        inline = 0
                        break
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        inline = 0
                        break
                    if stack[i].tag in BLOCK_TAGS - {"p"}:
                        break
            if name in ENDS:
                kinds, holders = ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in kinds:
                        del stack[i:]
                        break
                    if stack[i].tag in holders:
                        break
            parent = stack[-1]
            node = _element(name, rest, parent)
            parent.kids.append(node)
            if name not in VOID and not (rest.endswith("/") and name in ("iframe", "object")):
                stack.append(node)
    close()
    for i, menu in enumerate(menus):
        if menu and (menu in menus[max(i - 1, 0) : i] or menu in menus[i + 1 : i + 2]):
            texts[i] = (texts[i][0], True, texts[i][2])
    return root


def _element(name: str, rest: str, parent: _Node) -> _Node:
    mark = role = ""
    hidden = False
    if rest and not rest.isspace():
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                mark += " " + value
            elif key == "role":
                role = value
            elif key == "itemprop" and value == "articlebody":
                mark += " articlebody"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
    inside = parent.main
    main = max(inside, 3 if name == "article" else 2 if name == "main" or role in ("main", "article") else 1 if mark and MAIN.search(mark) else 0)
    outside = parent.outside or hidden or name in OUTSIDE_TAGS or role in OUTSIDE_ROLES or bool(mark and name not in ("body", "html", "article", "main") and OUTSIDE.search(mark))
    if not outside and not inside and (name == "header" or mark and name not in ("body", "html") and HEADER.search(mark)):
        outside = True
    return _Node(name, f"{name}{mark}" if mark else name, outside, main)


@lru_cache(maxsize=50_000)
def slots_of(shape: tuple) -> int:
    return 1 if shape == SLOT else sum(map(slots_of, shape[1]))


@lru_cache(maxsize=50_000)
def nodes_of(shape: tuple) -> int:
    return 1 + sum(map(nodes_of, shape[1]))


@lru_cache(maxsize=50_000)
def align(a: tuple, b: tuple) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Simple tree matching: how many nodes match, and which slots of ``a`` match which of ``b``."""
    if a == b:
        return nodes_of(a), tuple((i, i) for i in range(slots_of(a)))
    if a[0] != b[0]:
        return 0, ()
    left, right = a[1], b[1]
    same = 0
    while same < min(len(left), len(right)) and left[same] == right[same]:
        same += 1
    tail = 0
    while tail < min(len(left), len(right)) - same and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(same)] + [(len(left) - 1 - i, len(right) - 1 - i) for i in range(tail)]
    rows, columns = left[same : len(left) - tail], right[same : len(right) - tail]
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for i, x in enumerate(rows):
        for j, y in enumerate(columns):
            both = best[i][j] + align(x, y)[0] if x[0] == y[0] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], both)
    i, j = len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((same + i, same + j))
    starts_a, starts_b = _starts(left), _starts(right)
    total, slots = 1, []
    for i, j in pairs:
        score, inner = align(left[i], right[j])
        total += score
        slots += [(starts_a[i] + x, starts_b[j] + y) for x, y in inner]
    return total, tuple(slots)


def _starts(kids: tuple) -> list[int]:
    out, at = [], 0
    for kid in kids:
        out.append(at)
        at += slots_of(kid)
    return out


def extract(htmls: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    pages = [Page(h or "") for h in htmls]
    usual = Counter(p.shape for p in pages).most_common(1)[0][0]
    places = [dict(align(p.shape, usual)[1]) for p in pages]
    seen: dict[tuple, set] = {}
    distinct = set()
    for number, (page, place) in enumerate(zip(pages, places)):
        whole = tuple(t[0] for t in page.texts if t[2] and not t[1]) or tuple(t[0] for t in page.texts)
        if whole in distinct:
            continue  # copies of an article don't make it a template
        distinct.add(whole)
        for slot, (text, _, _) in zip(page.slots, page.texts):
            if slot in place:
                seen.setdefault((place[slot], text), set()).add(number)
    least = max(CONSTANT_PAGES, CONSTANT_SHARE * len(distinct))
    template = {key for key, found in seen.items() if len(found) >= least}
    out = []
    for page, place in zip(pages, places):
        rest = [(t, m) for slot, (t, outside, m) in zip(page.slots, page.texts) if not outside and (place.get(slot), t) not in template]
        top = max((m for _, m in rest), default=0)
        out.append("\n\n".join(t for t, m in rest if m == top or top < 3 and m >= top))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host."""
    held: list[dict] = []

    def done() -> pa.RecordBatch:
        texts = extract([r["html"] for r in held])
        out = pa.RecordBatch.from_arrays([pa.array([r["id"] for r in held], kind), pa.array([r["url"] for r in held], pa.string()), pa.array(texts, pa.string())], ["id", "url", "text"])
        held.clear()
        return out

    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        for i in range(0, batch.num_rows, 200):
            for row in batch.slice(i, 200).to_pylist():
                if held and (len(held) >= CHUNK or row["host"] != held[-1]["host"]):
                    yield done()
                held.append(row)
    if held:
        yield done()


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``key``, ``url`` and ``text``, a row per page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    counts = rows.groupBy("host").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    size = max(CHUNK, total / HEAVY)
    # At most HEAVY hosts have more pages than this.
    heavy = counts.filter(F.col("count") > size).select("host", F.ceil(F.col("count") / size).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(heavy), "host", "left").withColumn("part", F.pmod(F.xxhash64("id", "url"), F.coalesce("parts", F.lit(1))))
    sorted_rows = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "id").select("id", "url", "html", "host")
    kind = rows.schema["id"].dataType.simpleString()
    return sorted_rows.mapInArrow(_chunks, f"id {kind}, url string, text string").select(F.col("id").alias(key), F.col("url").alias(url), "text")
