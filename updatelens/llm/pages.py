"""Main text of web pages by wrapper induction.

The pages of a host that have the same frame of elements share a layout. Every page is aligned where it lies,
by simple tree matching, with a page of each of the most frequent layouts of its host. Texts are then counted
over all pages by host, layout, node and digest: what stands at one node of a large share of a layout's
pages is template, what varies fills a slot. A page gives its slots without the parts that its tags, or names
outside its article, mark as navigation, advertisement, comment and the like.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from updatelens.llm.common import BROADCAST_BYTES, attach, map_batches, session
from updatelens.session import materialize

LAYOUTS = 3  # layouts of a host that have a page to align with; pages of others are aligned with the nearest of these
SHARE = 0.5  # share of a layout's different pages in which a template text stands, at least
PAGES = 4  # number of different pages in which it stands, at least
HOT_ROWS = 1 << 16

# Elements by their role in HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "noscript", "template", "iframe", "svg")  # they do not part the text around them
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
DROPPED = frozenset(
    "head nav footer aside form script style textarea title noscript template iframe svg button select dialog menu "
    "object canvas audio video".split()
)
# What an open element of the first kind is closed by.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
        "section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol".split())
# Words in class, id and role that name parts other than the text, outside an article.
NAMED = frozenset(
    "ad ads adv advert advertisement advertising adverts alert alerts banner banners breadcrumb breadcrumbs comment "
    "commentlist comments complementary consent contentinfo cookie cookies disqus discussion feedback footer gdpr "
    "header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted promotion promotions recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar".split()
)
SPOKEN_OF = frozenset("has is no not with without".split())  # words before a name that only speak of it
# Whole names that mark such a part inside an article, or an article that is none.
MARKED = frozenset(
    "ad ads advert advertisement advertising breadcrumb breadcrumbs comment comment-list commentlist comments "
    "comments-area comments-section complementary cookie-banner cookie-notice disqus_thread navigation newsletter "
    "pagination promo promotion recommended related related-articles related-posts reply replies respond share "
    "share-buttons sharing sidebar social social-share sponsor sponsored subscribe subscription toolbar".split()
)
_PAIRS = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']*))?")
_FRAME = re.compile(r"<([a-zA-Z][^\s/<>]*)([^<>]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_VALUE = re.compile(r"[^>=]*")
_BLANK = re.compile(r"\s*")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}

ARTICLE, MAIN, DENSE = 1, 2, 4


# --- reading ------------------------------------------------------------------------------------------


class Node:
    """A block element, or a text (tag ``#``). ``dropped`` and ``zone`` count for all that lies inside."""

    __slots__ = ("tag", "key", "text", "children", "parent", "dropped", "zone", "size", "digest", "at")

    def __init__(self, tag: str, key: str, parent: Node | None, text: str = "", dropped: bool = False, zone: int = 0):
        self.tag, self.key, self.text, self.parent, self.children = tag, key, text, parent, []
        self.dropped, self.zone, self.size, self.digest, self.at = dropped, zone, 1, 0, 0


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: ``text``, ``open`` with attributes, or ``close``. A tag ends at the first ``>``
    outside a quoted value, or with the page, so every character is looked at once."""
    at, n = 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            yield "text", "", source[at:]
            return
        if start > at:
            yield "text", "", source[at:start]
        after = source[start + 1 : start + 2]
        if after == "!" or after == "?":
            if source.startswith("<!--", start):
                end, over = source.find("-->", start + 4), 3
            elif source.startswith("<![CDATA[", start):
                end, over = source.find("]]>", start + 9), 3
                yield "text", "", html.escape(source[start + 9 : end if end >= 0 else n])
            else:
                end, over = source.find(">", start), 1
            at = end + over if end >= 0 else n
            continue
        close = after == "/"
        name = _NAME.match(source, start + 1 + close)
        if not name:
            if close:  # not an end tag
                end = source.find(">", start)
                at = end + 1 if end >= 0 else n
            else:
                yield "text", "", "<"
                at = start + 1
            continue
        end = name.end()
        while True:
            end = _TO_VALUE.match(source, end).end()
            if end >= n or source[end] == ">":
                break
            end = _BLANK.match(source, end + 1).end()
            if source[end : end + 1] in ('"', "'") and end < n:
                end = source.find(source[end], end + 1) + 1
                if not end:
                    end = n
                    break
        at = end + 1
        if end < n:
            yield "close" if close else "open", name.group().lower(), source[name.end() : end]
            tag = name.group().lower()
            if not close and tag in _ENDS:
                ended = _ENDS[tag].search(source, at)
                at = source.find(">", ended.end()) + 1 if ended else 0
                at = at or n


def _looks(attributes: str, inside: bool) -> tuple[str, bool]:
    """Class names for the key of a node, and whether its attributes tell that it is no text."""
    if not attributes.strip(" /\t\r\n"):
        return "", False
    shown, dropped = [], False
    for found in _PAIRS.finditer(attributes):
        name, value = found.group(1).lower(), (found.group(2) or "").strip("\"'")
        if name == "hidden" or name == "style" and _NONE.search(value):
            dropped = True
        if name == "class":
            shown = sorted(value.split())
        if name in ("class", "id", "role"):
            for word in value.split():
                if inside:
                    dropped |= word.lower() in MARKED
                    continue
                parts = [w.lower() for w in _CAMEL.split(word) if w]
                if parts and parts[0] not in SPOKEN_OF and not NAMED.isdisjoint(parts):
                    dropped = True
    return ".".join(shown), dropped


def parse(source: str | None) -> list[Node]:
    """All nodes in page order, the root first. Inline tags join their text; a line break is a space."""
    root = Node("#root", "", None)
    nodes, stack, words = [root], [root], []
    # How often an element is open, in all and since the last one that end tags of small elements do not leave.
    open_all: Counter = Counter()
    frames: list[Counter] = [Counter()]
    inline: list[tuple[str, bool]] = []
    inline_open: Counter = Counter()
    unseen = 0  # open inline parts that are no text

    def flush() -> None:
        nonlocal unseen
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                top = stack[-1]
                node = Node("#", "#", top, text, top.dropped, top.zone)
                top.children.append(node)
                nodes.append(node)
        if inline:
            inline.clear()
            inline_open.clear()
            unseen = 0

    def pop() -> str:
        tag = stack.pop().tag
        open_all[tag] -= 1
        if tag in SCOPES:
            frames.pop()
        else:
            frames[-1][tag] -= 1
        return tag

    for kind, tag, rest in tokens(source or ""):
        if kind == "text":
            if not unseen:
                words.append(rest)
            continue
        close = kind == "close"
        if tag == "br":
            words.append(" ")
            continue
        if tag in INLINE:
            if close:
                if inline_open[tag]:
                    while True:
                        name, hidden = inline.pop()
                        inline_open[name] -= 1
                        unseen -= hidden
                        if name == tag:
                            break
            elif tag not in VOID and not rest.endswith("/"):
                hidden = _looks(rest, bool(stack[-1].zone))[1] if rest else False
                inline.append((tag, hidden))
                inline_open[tag] += 1
                unseen += hidden
            continue
        if tag in SILENT:
            continue
        flush()
        if close:
            if tag in SCOPES and open_all[tag] or frames[-1][tag] > 0:
                while pop() != tag:
                    pass
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            pop()
        top = stack[-1]
        own = {"article": ARTICLE, "main": MAIN}.get(tag, 0)
        names, dropped = _looks(rest, bool(top.zone or own))
        # A head of the article itself belongs to the text.
        dropped = (dropped or tag in DROPPED or tag == "header" and not top.zone) and tag not in ("html", "body")
        node = Node(tag, f"{tag}.{names}" if names else tag, top, "", top.dropped or dropped, top.zone | own)
        top.children.append(node)
        nodes.append(node)
        if tag not in VOID and tag not in _ENDS and not rest.rstrip().endswith("/"):
            stack.append(node)
            open_all[tag] += 1
            if tag in SCOPES:
                frames.append(Counter())
            else:
                frames[-1][tag] += 1
    flush()
    return nodes


def measure(nodes: list[Node]) -> None:
    """Sizes, places and digests of the shapes (keys, without texts) of all subtrees, from the last node to the first."""
    held: dict[int, list[int]] = {}
    for node in reversed(nodes):
        below = held.pop(id(node), [])
        below.reverse()
        node.digest = xxhash.xxh3_64_intdigest(f"{node.key}\x00{below}")
        if node.parent is not None:
            held.setdefault(id(node.parent), []).append(node.digest)
            node.parent.size += node.size
    for place, node in enumerate(nodes):
        node.at = place


def frame(source: str | None) -> int:
    """A digest of the kinds of elements of a page (tag and class names), without those of running text: its layout."""
    seen = set()
    for tag, rest in set(_FRAME.findall(source or "")):
        tag = tag.lower()
        if tag not in INLINE and tag not in CLOSED_BY and tag not in HEADS:
            seen.add((tag, _looks(rest, True)[0] if rest else ""))
    return xxhash.xxh3_64_intdigest(repr(sorted(seen)))


def dense(nodes: list[Node]) -> Node:
    """The smallest element that still holds four fifths of the text outside dropped parts."""
    mass: Counter = Counter()
    for node in reversed(nodes):
        if node.tag == "#" and not node.dropped:
            mass[id(node)] += len(node.text)
        if node.parent is not None:
            mass[id(node.parent)] += mass[id(node)]
    top = nodes[0]
    while True:
        inner = [c for c in top.children if c.tag != "#"]
        best = max(inner, key=lambda c: mass[id(c)], default=None)
        if best is None or best.tag in ("p", "li", "td") or not mass[id(top)] or mass[id(best)] < 0.8 * mass[id(top)]:
            return top
        top = best


# --- tree matching --------------------------------------------------------------------------------------


class Group:
    """Nodes of two pages below the same path of keys, one of each shape, and the groups of their children by key.
    ``scores`` tells how well every shape of the left matches every one of the right."""

    __slots__ = ("left", "right", "base", "lists", "below", "scores")

    def __init__(self, left: list[Node], right: list[Node]):
        self.left, self.right = {n.digest: n for n in left}, {n.digest: n for n in right}
        self.below: dict[str, Group] = {}
        self.scores: dict[int, np.ndarray] = {}
        # Nodes matched in any case, and the children to match of each node of the left and of the right.
        self.base, self.lists = 1, ([n.children for n in self.left.values()], [n.children for n in self.right.values()])
        if len(self.left) == 1 == len(self.right):
            (a,), (b,) = self.left.values(), self.right.values()
            same, own, others = _rest(a, b)
            self.base, self.lists = 1 + sum(x.size for x, _ in same), ([own], [others])

    def split(self) -> None:
        own, others = map(_by_key, self.lists)
        self.below = {key: Group(own[key], others[key]) for key in own if key in others}

    def lone(self) -> bool:
        """Whether there is one child on each side, so that the recurrence pairs these."""
        return [[len(n) for n in side] for side in self.lists] == [[1], [1]]

    def score(self) -> None:
        """Simple tree matching of all pairs, when the groups below have their scores."""
        left, right = self.lists
        if not self.below:
            self.scores = dict.fromkeys(self.left, np.full(len(right), self.base, np.int32))
            return
        if self.lone():
            (group,) = self.below.values()
            self.scores = {d: self.base + s for d, s in zip(self.left, group.scores.values())}
            return
        rows = Rows(right, self.below, 1 + max(n.size for n in self.left.values()))
        for digest, children in zip(self.left, left):
            row = rows.first
            for x in children:
                row = rows.next(row, x)
            self.scores[digest] = (row[rows.ends] - rows.first[rows.ends] + self.base).astype(np.int32)


class Rows:
    """The table of the recurrence, row by row, for the children of several right nodes side by side: each has a column
    for no child and one for each child that can be matched. Values of a node are ``apart`` from those of the next, so a
    running maximum does not pass from one to the other."""

    def __init__(self, right: list[list[Node]], below: dict[str, Group], apart: int):
        first, ends, found = [], [], {key: ([], []) for key in below}
        shapes = {key: {d: k for k, d in enumerate(g.right)} for key, g in below.items()}
        for own, children in enumerate(right):
            first.append(own * apart)
            for y in children:
                if y.key in found:
                    found[y.key][0].append(len(first))
                    found[y.key][1].append(shapes[y.key][y.digest])
                    first.append(own * apart)
            ends.append(len(first) - 1)
        self.below, self.ends = below, np.array(ends)
        self.found = {key: (np.array(places), np.array(of)) for key, (places, of) in found.items()}
        self.first = np.array(first, np.int32 if apart * len(right) < 1 << 31 else np.int64)

    def next(self, row: np.ndarray, x: Node) -> np.ndarray:
        if x.key not in self.found:
            return row
        places, of = self.found[x.key]
        out = row.copy()
        out[places] = np.maximum(row[places], row[places - 1] + self.below[x.key].scores[x.digest][of])
        return np.maximum.accumulate(out, out=out)


def _by_key(lists: list[list[Node]]) -> dict[str, list[Node]]:
    out: dict[str, list[Node]] = {}
    for n in chain.from_iterable(lists):
        out.setdefault(n.key, []).append(n)
    return out


def _common(left: list[Node], right: list[Node]) -> tuple[list[Node], list[Node]]:
    keys = {n.key for n in left} & {n.key for n in right}
    return [n for n in left if n.key in keys], [n for n in right if n.key in keys]


def _rest(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """First children of equal shape, which the recurrence pairs in any case (none matches better, and of equals it takes
    the first), and the children that are left. Those whose key the other side does not have are never paired."""
    left, right = _common(a.children, b.children)
    n = next((k for k, (x, y) in enumerate(zip(left, right)) if x.digest != y.digest), min(len(left), len(right)))
    return list(zip(left[:n], right[:n])), *_common(left[n:], right[n:])


def _matched(a: Node, b: Node, memo: dict) -> Group:
    """The group of two roots with the scores of all groups below. Every pair of shapes at one path of keys is matched
    once, whatever the pages' size: time grows with the product of such children, memory with that of such shapes."""
    if (id(a), id(b)) not in memo:
        groups = [Group([a], [b])]
        for group in groups:  # grows by the groups below
            group.split()
            groups += group.below.values()
        for group in reversed(groups):
            group.score()
        memo[id(a), id(b)] = groups[0]
    return memo[id(a), id(b)]


def _match(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: nodes of the largest common top-down tree with the order of children kept."""
    return int(_matched(a, b, memo).scores[a.digest][0]) if a.key == b.key else 0


def _paired(left: list[Node], right: list[Node], below: dict[str, Group]) -> list[tuple[Node, Node]]:
    """The children that the recurrence pairs. Of its table one row in ``step`` is kept, those between are made again."""
    if max(len(left), len(right)) <= 1:  # none, or one of the same key on each side
        return list(zip(left, right))
    rows = Rows([right], below, 0)
    step = isqrt(len(left)) + 1
    kept, row = [], rows.first
    for i, x in enumerate(left):
        if i % step == 0:
            kept.append(row)
        row = rows.next(row, x)
    i, j, pairs = len(left), len(right), []
    while kept and j:
        table, start = [kept.pop()], len(kept) * step
        for x in left[start:i]:
            table.append(rows.next(table[-1], x))
        while i > start and j:
            here, above = table[i - start], table[i - start - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
    return pairs[::-1]


def align(a: Node, b: Node, memo: dict) -> Iterator[tuple[Node, Node]]:
    """The pairs of nodes of a simple tree matching."""
    todo = [(a, b, _matched(a, b, memo))]
    while todo:
        x, y, group = todo.pop()
        yield x, y
        if x.digest == y.digest:
            todo += [(p, q, group) for p, q in zip(x.children, y.children)]
            continue
        same, left, right = _rest(x, y)
        todo += [(p, q, group) for p, q in same]
        todo += [(p, q, group.below[p.key]) for p, q in _paired(left, right, group.below)]


# --- pages ------------------------------------------------------------------------------------------------

BLOCKS = "blocks array<struct<t:string,s:int,d:long>>, layout int, page long"


class Reader:
    """Reads pages; trees of the layout pages of recent hosts are kept."""

    def __init__(self):
        self.known: dict[str, tuple[list[Node], int]] = {}

    def tree(self, source: str) -> tuple[list[Node], int]:
        """Nodes and layout of a layout page."""
        if source not in self.known:
            if len(self.known) > 300:
                self.known.clear()
            nodes = parse(source)
            measure(nodes)
            self.known[source] = nodes, frame(source)
        return self.known[source]

    def read(self, source: str | None, layouts: list[str] | None) -> tuple[list[dict], int, int]:
        """The blocks of a page that may be text, with the node ``s`` of the layout page each is aligned with (-1: none)
        and a digest of the text; the layout, and a digest that tells pages of different content apart."""
        nodes = parse(source)
        measure(nodes)
        kept = _region(nodes)
        slots: dict[int, int] = {}
        best = -1
        if layouts and kept:
            trees = [self.tree(other) for other in layouts]
            memo: dict = {}
            own = frame(source)
            best = next((k for k, (_, layout) in enumerate(trees) if layout == own), -1)
            if best < 0:  # the nearest of the others
                scores = [_match(nodes[0], tree[0], memo) for tree, _ in trees]
                best = scores.index(max(scores))
            pairs = align(nodes[0], trees[best][0][0], memo)
            slots = {x.at: y.at for x, y in pairs if x.tag == "#"}
        blocks = [{"t": n.text, "s": slots.get(n.at, -1), "d": _digest(n.text)} for n in kept]
        longest = max((n.text for n in kept), key=len, default="")
        return blocks, best, _digest(longest)


def _digest(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _region(nodes: list[Node]) -> list[Node]:
    """Texts outside dropped parts: those of article elements, or of main elements, if these hold a quarter of all,
    else those of the element where nearly all text stands."""
    found = [n for n in nodes if n.tag == "#" and not n.dropped]
    total = sum(len(n.text) for n in found)
    for zone in (ARTICLE, MAIN):
        own = [n for n in found if n.zone & zone]
        if own and 4 * sum(len(n.text) for n in own) >= total:
            return own
    if not found:
        return found
    top = dense(nodes)
    inside = {id(top)}
    for node in nodes[top.at + 1 : top.at + top.size]:
        inside.add(id(node))
    return [n for n in found if id(n) in inside]


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def layout_pages(pages: DataFrame) -> DataFrame:
    """(host, layouts): a page of each of the ``LAYOUTS`` most frequent layouts of a host, hosts of few pages left out.

    pages: host, html, h (a hash of the row).
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch["f"] = [frame(s) & ((1 << 62) - 1) for s in batch["html"]]
        return batch[["host", "h", "f"]]

    frames = materialize(map_batches(pages.select("host", "h", "html"), run, "host string, h long, f long"))
    counted = frames.groupBy("host", "f").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    all_of = counted.groupBy("host").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("host").orderBy(F.col("n").desc(), "f")
    chosen = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LAYOUTS)
    chosen = materialize(chosen.join(all_of.where(F.col("total") >= PAGES), "host").select("host", "h", "k"))
    found = pages.select("host", "h", "html").join(chosen, ["host", "h"]).dropDuplicates(["host", "h"])
    listed = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "html"))).alias("_l"))
    return materialize(listed.select("host", F.transform("_l", lambda x: x["html"]).alias("layouts")))


def _with_layouts(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """Left join by host. If the layout pages, as counted, are many bytes, hosts with over a 65,536th of all pages (so many
    at most) have their pages dealt to several tasks."""
    size = F.aggregate("layouts", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s))
    if (layouts.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(layouts), "host", "left")
    counts = materialize(pages.groupBy("host").agg(F.count("*").alias("n")))
    part = F.greatest(F.lit(1000), F.lit(counts.agg(F.sum("n")).first()[0]) / HOT_ROWS)
    hot = F.broadcast(counts.where(F.col("n") > part).select("host", F.ceil(F.col("n") / part).cast("int").alias("_parts")))
    left = pages.join(hot, "host", "left").withColumn("_at", F.pmod("h", F.coalesce("_parts", F.lit(1))).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = layouts.join(hot, "host", "left").withColumn("_at", every).drop("_parts")
    return left.drop("_parts").join(right, ["host", "_at"], "left").drop("_at")


def templates(blocks: DataFrame) -> DataFrame:
    """(host, template): what is constant, as texts of layout, node and digest.

    Pages with the same longest text count as one, so copies of a page do not make its text a template.
    """
    each = blocks.where("layout >= 0").select("host", "layout", "page", F.explode("blocks").alias("b"))
    facts = each.where("b.s >= 0").select("host", "layout", "page", F.col("b.s").alias("s"), F.col("b.d").alias("d")).distinct()
    texts = facts.groupBy("host", "layout", "s", "d").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    pages = blocks.where("layout >= 0").select("host", "layout", "page").distinct()
    pages = pages.groupBy("host", "layout").agg(F.count("*").alias("all"))
    fixed = texts.join(pages, ["host", "layout"]).where(F.col("n") >= SHARE * F.col("all"))
    name = F.concat_ws(" ", "layout", "s", "d")
    return materialize(fixed.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(name)), "\n").alias("template")))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars and n_template, the number of blocks left out as template.

    A null or empty page has an empty text. Pages without a host are those of one host. Repeated pages give equal rows;
    an empty table gives an empty result; other columns are not read. Pages of any length and depth are read
    whole, each character once, and aligned whole.
    """
    session(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", _host("url").alias("host"), F.xxhash64("page_id", "url", "html").alias("h"))
    kind = pages.schema["page_id"].dataType.simpleString()
    reader = Reader()

    def read(batch: pd.DataFrame) -> pd.DataFrame:
        found = [reader.read(s, None if w is None else list(w)) for s, w in zip(batch["html"], batch["layouts"])]
        batch["blocks"], batch["layout"], batch["page"] = ([f[k] for f in found] for k in range(3))
        return batch[["page_id", "url", "host", "h", "blocks", "layout", "page"]]

    known = _with_layouts(rows, layout_pages(rows))
    blocks = map_batches(known, read, f"page_id {kind}, url string, host string, h long, {BLOCKS}")
    blocks = materialize(blocks)
    ready: dict[str, frozenset] = {}

    def join(batch: pd.DataFrame) -> pd.DataFrame:
        texts, left = [], []
        for own, layout, told in zip(batch["blocks"], batch["layout"], batch["template"]):
            if told not in ready:
                if len(ready) > 1000:
                    ready.clear()
                ready[told] = frozenset((told or "").split("\n"))
            fixed = ready[told]
            kept = [b["t"] for b in own if f"{layout} {b['s']} {b['d']}" not in fixed]
            texts.append("\n\n".join(kept))
            left.append(len(own) - len(kept))
        batch["text"], batch["n_chars"], batch["n_template"] = texts, [len(t) for t in texts], left
        return batch[["page_id", "url", "text", "n_chars", "n_template"]]

    told = attach(blocks, templates(blocks), "host", F.col("h"))
    return map_batches(told, join, f"page_id {kind}, url string, text string, n_chars long, n_template long")
