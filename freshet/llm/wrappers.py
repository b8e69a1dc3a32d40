"""Operator 5: main text of HTML pages by wrapper induction.

Each page is parsed to a tree of its block elements in which runs of like siblings are one node.  The trees of a host are
aligned by simple tree matching and merged into one wrapper, which counts for each
node the distinct pages that have it and whether its text is the same on all.  Nodes
whose text is constant become template, varying slots become content, but for
those that stand in elements which never hold main text (navigation, forms, adverts,
comments and the like).  If the page itself has an article or main element, content is
what varies within that.

Wrappers are merged in steps (a task's pages, then a host's tasks in 64 parts, then these), so no
task holds a host's pages, and a host with a third of all pages is no heavier than others.

Contract
--------
Null html counts as empty; its text is empty.  Null or malformed urls share the
host ''.  Repeated rows are all returned; pages that differ in nothing but elements that never hold main text
count as one.  An empty table
gives an empty result; extra columns are left out.  Long pages are parsed in
one pass.  ``<br>`` is white space within its block.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, only, pages, staged
from .urls import split_url

#: Comments and declarations, then tags.  As in HTML, quotes mean something only after ``=``, and what isn't closed goes on to the end.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BETWEEN = re.compile(r"[^a-z]+")
#: Elements of HTML (fixed values).
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in "script style textarea title iframe".split()}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements that never hold main text, and words that say so where a class, id or role is made of them and neutral words only (fixed values).
NEVER = frozenset("nav header footer aside form script style noscript template iframe svg textarea title head button select menu dialog object".split())
NEVER_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog footer form header login menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search".split())
NEUTRAL_WORDS = frozenset("area bar block bottom box center column container content fixed global group inner item items left links list main outer page panel primary right row secondary section site slot sticky thread top unit user wrap wrapper".split())
MAIN = frozenset({"article", "main"})
NEVER_NAMED = frozenset({"#", "html", "body", "article", "main"})
LEAST_PAGES = 3
MOST_STEPS = 2_000_000


@dataclass(slots=True)
class Node:
    """A node of a page's tree or of a wrapper."""

    label: str
    kids: list["Node"] = field(default_factory=list)
    pages: list[str] = field(default_factory=list)  # digests of LEAST_PAGES distinct pages at most
    text: str | None = ""  # digest of the direct text; None if it varies

    def walk(self) -> Iterator["Node"]:
        """This node and all below, parents first and in page order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.kids)

    def packed(self) -> list:
        """One flat list, so depth is no matter."""
        return [[n.label, len(n.kids), n.pages, n.text] for n in self.walk()]

    @classmethod
    def unpacked(cls, rows: list) -> "Node":
        root = cls("#")
        todo = [[root, 1]]
        for label, kids, pages, text in rows:
            while not todo[-1][1]:
                todo.pop()
            todo[-1][1] -= 1
            node = cls(label, [], pages, text)
            todo[-1][0].kids.append(node)
            todo.append([node, kids])
        return root.kids[0]


def label_of(tag: str, attributes: str) -> str:
    """The tag, and the words of its class, id and role without digits: ``div.cookie-notice``."""
    if "=" not in attributes:
        return tag
    names = " ".join(m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes))
    words = sorted({w for x in names.split() if (w := _BETWEEN.sub("-", _CAMEL.sub("-", x).lower()).strip("-"))})
    return f"{tag}.{'.'.join(words)}" if words else tag


class Page:
    """A parsed page: its tree, and its texts as (node, block, text) in page order."""

    def __init__(self, source: str):
        self.root = Node("#")
        self.texts: list[tuple[Node, int, str]] = []
        self.stack: list[tuple[str, Node]] = [("#", self.root)]
        self.open: dict[str, int] = {}
        self.parse(source)

    def close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        """Close the innermost ``tag`` and all in it, unless an element of ``within`` is nearer."""
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                for closed, _ in self.stack[i:]:
                    self.open[closed] -= 1
                del self.stack[i:]
                return
            if name in within:
                return

    def parse(self, source: str) -> None:
        stack, texts = self.stack, self.texts
        at, block = 0, 0
        while True:
            m = _TOKEN.search(source, at)
            if raw := source[at : m.start() if m else len(source)]:
                texts.append((stack[-1][1], block, raw))
            if m is None:
                return
            at = m.end()
            if m[2] is None or m[0][-1] != ">":
                continue
            tag = m[2].lower()
            if tag in INLINE:
                if tag == "br":
                    texts.append((stack[-1][1], block, " "))
                continue
            block += 1
            if m[1]:
                self.close(tag)
                continue
            if tag in CLOSES_P:
                self.close("p")
            if tag in SAME_CLOSES:
                self.close(tag, SAME_CLOSES[tag])
            parent = stack[-1][1]
            label = label_of(tag, m[3])
            if parent.kids and parent.kids[-1].label == label:  # a run of like siblings is one node
                node = parent.kids[-1]
            else:
                node = Node(label)
                parent.kids.append(node)
            if tag in RAW:
                end = RAW[tag].search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, node))
                self.open[tag] = self.open.get(tag, 0) + 1

    def signature(self) -> str:
        return " ".join(f"{n.label}({len(n.kids)}" for n in self.root.walk())

    def digests(self) -> dict[int, str]:
        """Digest of the direct text of each node that has any."""
        found: dict[int, list[str]] = {}
        for node, _, text in self.texts:
            if squeezed := " ".join(text.split()):
                found.setdefault(id(node), []).append(squeezed)
        return {k: blake2b(" ".join(v).encode("utf-8", "surrogatepass"), digest_size=6).hexdigest() for k, v in found.items()}


def shapes(root: Node) -> dict[int, tuple[int, int]]:
    """Of each node a hash of the tree below and its size, by id."""
    found: dict[int, tuple[int, int]] = {}
    for node in reversed(list(root.walk())):
        below = [found[id(k)] for k in node.kids]
        found[id(node)] = hash((node.label, *(h for h, _ in below))), 1 + sum(n for _, n in below)
    return found


def heaviest(xs: list[tuple[str, int]], ys: list[tuple[str, int]], weight: dict[tuple[int, int], int], most_steps: int) -> list[tuple[int, int]]:
    """The order-keeping pairs of places of the greatest weight; nodes are given as (label, hash of the tree).

    All pairs are weighed, row by row.  Of a table above ``most_steps`` entries a few rows are kept, from which
    the strips between them are made again on the way back, so memory grows with the length of a row.
    """
    places: dict[str, dict[int, list[int]]] = {}
    for j, (label, shape) in enumerate(ys):
        places.setdefault(label, {}).setdefault(shape, []).append(j)
    gains: dict[int, np.ndarray | None] = {}

    def below(above: np.ndarray, i: int) -> np.ndarray:
        label, shape = xs[i]
        if label not in places:
            return above
        if shape not in gains:
            if len(gains) * len(ys) > MOST_STEPS:
                gains.clear()
            gains[shape] = np.zeros(len(ys), dtype=np.int64)
            for other, at in places[label].items():
                gains[shape][at] = weight[shape, other]
        row = np.zeros(len(above), dtype=np.int64)
        np.maximum.accumulate(np.maximum(above[:-1] + gains[shape][: len(above) - 1], above[1:]), out=row[1:])
        return row

    chosen = []

    def back(top: np.ndarray, low: int, high: int, j: int) -> int:
        """From row ``high`` and column ``j`` back to row ``low``, whose entries are ``top``; the column there."""
        if not j:
            return 0
        rows = [top[: j + 1]]
        if high - low > max(1, most_steps // (j + 1)):
            strip = -(-(high - low) // 16)
            cuts = list(range(low, high, strip))
            kept = rows[:]
            for i in range(low, cuts[-1]):
                rows[0] = below(rows[0], i)
                if (i + 1 - low) % strip == 0:
                    kept.append(rows[0])
            for start, row in zip(reversed(cuts), reversed(kept)):
                j = back(row, start, min(start + strip, high), j)
            return j
        for i in range(low, high):
            rows.append(below(rows[-1], i))
        i = high - low
        while i and j:
            w = weight.get((xs[low + i - 1][1], ys[j - 1][1]), 0)
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                chosen.append((low + i - 1, j - 1))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return j

    back(np.zeros(len(ys) + 1, dtype=np.int64), 0, len(xs), len(ys))
    return chosen


def aligned(wrapper: Node, tree: Node, most_steps: int = MOST_STEPS) -> dict[int, Node]:
    """Simple tree matching, the greatest top-down matching that keeps order: id of a tree's node -> wrapper's node.

    Equal trees at either end of two lists of children are paired outright, which
    loses nothing, and pairs of the same two shapes are weighed once.  All other pairs of children are weighed,
    however long their lists; ``most_steps`` bounds the entries held at a time and has no say in the result.
    """
    if wrapper.label != tree.label:
        return {}
    of_a, of_b = shapes(wrapper), shapes(tree)
    weight: dict[tuple[int, int], int] = {}
    found: dict[tuple[int, int], tuple[int, int, list[tuple[int, int]]]] = {}
    waiting = []
    todo = [(wrapper, tree)]
    while todo:
        x, y = todo.pop()
        (shape, _), (other, size) = of_a[id(x)], of_b[id(y)]
        if (shape, other) in weight:
            continue
        weight[shape, other] = size
        if shape == other:
            continue
        xs, ys, first = x.kids, y.kids, 0
        while first < min(len(xs), len(ys)) and of_a[id(xs[first])] == of_b[id(ys[first])]:
            first += 1
        last = 0
        while last < min(len(xs), len(ys)) - first and of_a[id(xs[-1 - last])] == of_b[id(ys[-1 - last])]:
            last += 1
        waiting.append((size, shape, other, x, y, first, last))
        kinds: dict[str, dict[int, Node]] = {}
        for v in ys[first : len(ys) - last]:
            kinds.setdefault(v.label, {})[of_b[id(v)][0]] = v
        for u in {of_a[id(u)][0]: u for u in xs[first : len(xs) - last]}.values():
            todo += [(u, v) for v in kinds.get(u.label, {}).values()]
    waiting.sort(key=lambda row: row[0])  # children before what holds them
    for _, shape, other, x, y, first, last in waiting:
        xs = [(u.label, of_a[id(u)][0]) for u in x.kids[first : len(x.kids) - last]]
        ys = [(v.label, of_b[id(v)][0]) for v in y.kids[first : len(y.kids) - last]]
        chosen = heaviest(xs, ys, weight, most_steps) if xs and ys else []
        ends = [*y.kids[:first], *y.kids[len(y.kids) - last :]]
        weight[shape, other] = 1 + sum(of_b[id(v)][1] for v in ends) + sum(weight[xs[i][1], ys[j][1]] for i, j in chosen)
        found[shape, other] = first, last, chosen
    where: dict[int, Node] = {}
    pairs = [(wrapper, tree)]
    while pairs:
        x, y = pairs.pop()
        where[id(y)] = x
        shape, other = of_a[id(x)][0], of_b[id(y)][0]
        if shape == other:
            pairs += zip(x.kids, y.kids)
            continue
        first, last, chosen = found[shape, other]
        pairs += zip(x.kids[:first], y.kids[:first])
        pairs += zip(x.kids[len(x.kids) - last :], y.kids[len(y.kids) - last :])
        pairs += [(x.kids[first + i], y.kids[first + j]) for i, j in chosen]
    return where


def merge(wrapper: Node, tree: Node) -> dict[int, Node]:
    """Align a tree with the wrapper and add its unmatched nodes there; node id -> wrapper's node.

    The wrapper's counts are left as they are.
    """
    where = aligned(wrapper, tree)
    if not where:
        raise ValueError("roots differ")
    todo = [(wrapper, tree)]
    while todo:
        own, node = todo.pop()
        kids, rest = [], iter(own.kids)
        for kid in node.kids:
            known = where.get(id(kid))
            if known is None:
                known = where[id(kid)] = Node(kid.label)
                kids.append(known)
            else:
                for k in rest:
                    kids.append(k)
                    if k is known:
                        break
            todo.append((known, kid))
        own.kids = [*kids, *rest]
    return where


def count_in(node: Node, pages: list[str], text: str | None) -> None:
    """Count pages, by digest, with a node whose direct text has a digest (None: it varies)."""
    node.text = text if not node.pages else node.text if node.text == text else None
    if len(node.pages) < LEAST_PAGES:
        node.pages = sorted({*node.pages, *pages})[:LEAST_PAGES]


class Induction:
    """Wrappers of the hosts a task has met."""

    def __init__(self) -> None:
        self.wrappers: dict[str, Node] = {}
        self.known: dict[tuple[str, str], list[tuple[Node, bool]]] = {}

    def add(self, host: str, source: str) -> None:
        page = Page(source)
        wrapper = self.wrappers.setdefault(host, Node("#"))
        nodes = list(page.root.walk())
        key = (host, page.signature())
        if key not in self.known:
            where = merge(wrapper, page.root)
            shown = outside(page.root)
            self.known[key] = [(where[id(n)], id(n) in shown) for n in nodes]
        digests = page.digests()
        texts = [digests.get(id(n), "") for n in nodes]
        whole = key[1] + "\n" + " ".join(t for t, (_, shown) in zip(texts, self.known[key]) if shown)
        digest = blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()
        for text, (own, _) in zip(texts, self.known[key]):
            count_in(own, [digest], text)


def merged(packed: list[str]) -> str:
    """One wrapper of a host's partial wrappers."""
    out = Node("#")
    for x in sorted(packed):
        tree = Node.unpacked(json.loads(x))
        where = merge(out, tree)
        for node in tree.walk():
            count_in(where[id(node)], node.pages, node.text)
    return json.dumps(out.packed(), separators=(",", ":"))


@lru_cache(100_000)
def never(label: str) -> bool:
    tag, *names = label.split(".")
    if tag in NEVER or tag in NEVER_NAMED:
        return tag in NEVER
    parts = [name.split("-") for name in names]
    return any(not NEVER_WORDS.isdisjoint(x) and NEVER_WORDS.union(NEUTRAL_WORDS).issuperset(x) for x in parts)


def outside(root: Node) -> set[int]:
    """Ids of the nodes outside elements that never hold main text."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        if not never(node.label):
            found.add(id(node))
            todo += node.kids
    return found


def constant_nodes(wrapper: Node, least_pages: int = LEAST_PAGES) -> set[int]:
    """Ids of the wrapper's nodes whose direct text is template."""
    return {id(n) for n in wrapper.walk() if n.text is not None and len(n.pages) >= least_pages}


def content_nodes(page: Node, where: dict[int, Node], constant: set[int]) -> set[int]:
    """Ids of a page's nodes whose direct text is content; ``where`` has the wrapper's nodes."""
    shown = outside(page)

    def is_main(n: Node) -> bool:
        tag, *names = n.label.split(".")
        return tag in MAIN or "main" in names and tag in ("div", "section")

    found = any(is_main(n) for n in page.walk() if id(n) in shown)
    content, todo = set(), [(page, False)]
    while todo:
        node, inside = todo.pop()
        if id(node) not in shown:
            continue
        inside = inside or is_main(node)
        if (inside or not found) and id(node) in where and id(where[id(node)]) not in constant:
            content.add(id(node))
        todo += [(k, inside) for k in node.kids]
    return content


class Extractor:
    """Applies wrappers; keeps the alignment of each (wrapper, page shape)."""

    def __init__(self, limit: int = 20_000) -> None:
        self.limit = limit
        self.wrappers: dict[str, tuple[Node, set[int]]] = {}
        self.known: dict[tuple[str, str], list[bool]] = {}

    def text(self, wrapper: str, source: str) -> str:
        page = Page(source)
        nodes = list(page.root.walk())
        if len(self.known) > self.limit or len(self.wrappers) > self.limit:
            self.known.clear()
            self.wrappers.clear()
        key = (wrapper, page.signature())
        if key not in self.known:
            if wrapper not in self.wrappers:
                tree = Node.unpacked(json.loads(wrapper))
                self.wrappers[wrapper] = tree, constant_nodes(tree)
            tree, constant = self.wrappers[wrapper]
            content = content_nodes(page.root, aligned(tree, page.root), constant)
            self.known[key] = [id(n) in content for n in nodes]
        own = {id(n) for n, yes in zip(nodes, self.known[key]) if yes}
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.texts:
            if id(node) in own:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def induce(rows: DataFrame, hosts_at_once: int = 5000) -> DataFrame:
    """``(host, wrapper)`` of ``(host, html)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Induction()

        def out() -> pa.RecordBatch:
            packed = [json.dumps(w.packed(), separators=(",", ":")) for w in task.wrappers.values()]
            return pa.RecordBatch.from_pydict({"host": pa.array(list(task.wrappers), pa.string()), "wrapper": pa.array(packed, pa.string())})

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                task.add(host, source)
                if len(task.wrappers) > hosts_at_once:
                    yield out()
                    task = Induction()
        if task.wrappers:
            yield out()

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [merged(part["wrapper"].tolist())]})

    parts = rows.select("host", "html").mapInArrow(lean(partial), "host string, wrapper string")
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    some = dealt.groupBy("host", "part").applyInPandas(whole, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(whole, "host string, wrapper string")


def extract_text(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(<id>, url, text)`` of every page."""
    host, _ = split_url(F.coalesce(F.col("url"), F.lit("")))
    rows = only(df, key=id_column, url=url_column, html=html_column).select("key", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    wrappers = staged(induce(rows), "wrappers")
    joined = rows.join(wrappers, "host", "left").select("key", "url", "html", F.coalesce("wrapper", F.lit('[["#",0,[],""]]')).alias("wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor()
        for batch in batches:
            texts = [extractor.text(w, h) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    return joined.mapInArrow(lean(run), f"key {rows.schema['key'].dataType.simpleString()}, url string, text string").withColumnRenamed("key", id_column)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(pages(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
