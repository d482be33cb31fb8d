"""Main text of pages by wrapper induction.

Pages of a host are aligned, tree by tree, with simple tree matching: a template tree
per host collects for every node how often it occurs and which texts stand there.
Texts that stay the same over most pages are template, slots whose texts vary are
content; menus, notices and the like go by their tags and names. Trees have block
elements as nodes, and equal siblings in a row as one node, so that a list or an
article of any length is one slot. Trees may be of any depth: what walks them keeps
its own stack. A host with few pages has a wrapper of its own all the same; its tags,
names and varying text tell the region, but no text is known to be constant there.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from html import unescape
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicewatch.llm.arrow_rows import slices
from sluicewatch.llm.scratch import stored

#: A text is template if it stands in its slot on this share of the host's pages, of so many.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 5
#: Wrappers of so many hosts a task holds before it reads them anew.
HELD_HOSTS = 500
#: Wrappers of all hosts are broadcast up to this size, and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_BLOCKS = frozenset(
    "html head body article main section div p ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption nav header footer aside form fieldset address details "
    "summary menu dialog hgroup center".split()
)
_BREAKS = frozenset("br hr img".split())
_RAW = frozenset("script style title noscript textarea iframe svg template select button object canvas math".split())
_CHROME_TAGS = frozenset("head nav header footer aside form menu dialog".split())
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer header cookie cookies consent notice notices alert popup modal "
    "newsletter subscribe share sharing social related recommended comment comments disqus reply replies respond "
    "toolbar pagination pager copyright login signup search complementary contentinfo".split()
)
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "p": "p"}
_LISTS = frozenset("ul ol dl table".split())


#: A walk of a tree that yields the walks it needs, and gets their results.
Walk = Generator["Walk", Any, Any]


def walked(walk: Walk) -> Any:
    """The result of a walk, with a stack on the heap: trees may be deeper than Python's."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def spelled(root) -> tuple[str, list]:
    """A tree's labels in brackets, and its nodes in the order of their numbers."""
    nodes, parts, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
            continue
        nodes.append(node)
        parts.append(node.label)
        if node.kids:
            parts.append("(")
            stack.append(")")
            for k, kid in enumerate(reversed(node.kids)):
                stack += ([","] if k else []) + [kid]
    return "".join(parts), nodes


class Node:
    """A block, or a row of equal sibling blocks."""

    __slots__ = ("label", "kids", "index")

    def __init__(self, label: str):
        self.label = label
        self.kids: list[Node] = []
        self.index = 0

    def child(self, label: str) -> Node:
        """The last child if it is of this label, else a new one."""
        if self.kids and self.kids[-1].label == label:
            return self.kids[-1]
        self.kids.append(Node(label))
        return self.kids[-1]


def _label(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    names = {w.lower() for m in _NAME.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")}
    marks = sorted(names & _CHROME_NAMES) or (["main"] if "main" in names else [])
    return f"{tag}.{marks[0]}" if marks else tag


class Page:
    """The folded tree of a page, and its runs of text: (node, text, characters in links)."""

    def __init__(self, html: str):
        self.root = Node("")
        self.runs: list[tuple[Node, str, int]] = []
        self._stack = [(self.root, "")]
        self._open_tags: Counter[str] = Counter()
        self._text: list[str] = []
        self._linked, self._links = 0, 0
        self._read(html)
        self.shape, self.nodes = spelled(self.root)
        for i, node in enumerate(self.nodes):
            node.index = i

    def _read(self, html: str) -> None:
        at, skip = 0, ""
        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = m[1] or m[4]
            if tag in _RAW:
                if not closing and not (m[3] or m[6] or "").endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else len(html)
            elif tag == "a":
                self._links = 0 if closing else 1
            elif tag in _BREAKS:
                self._text.append(" ")
            elif tag in _BLOCKS:
                self._flush()
                if closing:
                    self._close(tag)
                else:
                    self._open(tag, m[3] or m[6] or "")
        if at < len(html):
            self._add(html[at:])
        self._flush()

    def _add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._links:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.runs.append((self._stack[-1][0], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if stack[-1][1] == "p":
            self._cut(len(stack) - 1)
        ends = _CLOSES.get(tag, "").split()
        if tag != "p" and any(self._open_tags[t] for t in ends):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] in _LISTS:
                    break
                if stack[depth][1] in ends:
                    self._cut(depth)
                    break
        stack.append((stack[-1][0].child(_label(tag, attributes)), tag))
        self._open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        if self._open_tags[tag]:
            self._cut(next(d for d in range(len(self._stack) - 1, 0, -1) if self._stack[d][1] == tag))

    def _cut(self, depth: int) -> None:
        self._open_tags.subtract(tag for _, tag in self._stack[depth:])
        del self._stack[depth:]


def match(a, b, pairs: list) -> int:
    """Simple tree matching: size of the best match of two trees, in ``pairs`` its nodes.

    Both have ``label`` and ``kids``. Matched nodes have equal labels and matched
    parents, and keep the order of siblings.
    """
    return walked(_match(a, b, pairs))


def _match(a, b, pairs: list) -> Walk:
    if a.label != b.label:
        return 0
    rows, columns = len(a.kids), len(b.kids)
    if rows == columns and all(x.label == y.label for x, y in zip(a.kids, b.kids)):
        pairs.append((a, b))
        total = 1
        for x, y in zip(a.kids, b.kids):
            total += yield _match(x, y, pairs)
        return total
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, rows + 1):
        for j in range(1, columns + 1):
            size = 0
            if a.kids[i - 1].label == b.kids[j - 1].label:
                own: list = []
                size = yield _match(a.kids[i - 1], b.kids[j - 1], own)
                found[i, j] = size, own
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size)
    pairs.append((a, b))
    i, j = rows, columns
    while i and j:
        size, own = found.get((i, j), (0, []))
        if size and best[i][j] == best[i - 1][j - 1] + size:
            pairs.extend(own)
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[rows][columns]


class Slot:
    """A node of a template: on how many pages, with how many texts and characters, which texts constant."""

    __slots__ = ("label", "kids", "pages", "texts", "constant", "chars", "linked")

    def __init__(self, label: str):
        self.label = label
        self.kids: list[Slot] = []
        self.pages = self.texts = self.chars = self.linked = 0
        self.constant: list[int] = []


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


_PARTS = re.compile(r"[(),]|[^(),]+")


def grown(shape: str) -> tuple[Slot, list[Slot]]:
    """The tree of a shape, and its nodes in the order of their numbers."""
    root = last = Slot("")
    slots, stack = [root], []
    for part in _PARTS.findall(shape):
        if part == "(":
            stack.append(last)
        elif part == ")":
            stack.pop()
        elif part != ",":
            last = Slot(part)
            stack[-1].kids.append(last)
            slots.append(last)
    return root, slots


def merge(template: Slot | None, other: Slot) -> Slot:
    """The template that covers both; nodes of either that don't match stand side by side."""
    if template is None:
        return other
    pairs: list = []
    match(other, template, pairs)
    of = {id(b): a for b, a in pairs}
    for b, a in pairs:
        if len(a.kids) == len(b.kids) and all(id(k) in of for k in b.kids):
            continue
        places = {id(k): i + 1 for i, k in enumerate(a.kids)}
        place, added = 0, []
        for kid in b.kids:
            if id(kid) in of:
                place = places[id(of[id(kid)])]
            else:
                added.append((place, kid))
        for n, (place, kid) in enumerate(added):
            a.kids.insert(place + n, kid)
    return template


class Rule:
    """A node of a wrapper: whether its text is content, and texts to leave out there."""

    __slots__ = ("label", "keep", "constant", "kids")

    def __init__(self, label: str, keep: bool, constant: list):
        self.label, self.keep, self.constant = label, keep, frozenset(constant)
        self.kids: list[Rule] = []

    @staticmethod
    def unpacked(packed: list) -> Rule:
        """From (label, keep, constant texts, number of children) of all nodes in order."""
        top = Rule("", False, [])
        stack = [[top, 1]]
        for label, keep, constant, kids in packed:
            rule = Rule(label, bool(keep), constant)
            stack[-1][0].kids.append(rule)
            stack[-1][1] -= 1
            stack.append([rule, kids])
            while stack and not stack[-1][1]:
                stack.pop()
        return top.kids[0]


def _is_chrome(label: str, inside: bool) -> bool:
    tag, _, name = label.partition(".")
    if inside and (tag == "header" or name == "header"):
        return False
    return tag in _CHROME_TAGS or (bool(name) and name in _CHROME_NAMES)


def _is_region(label: str) -> bool:
    tag, _, name = label.partition(".")
    return tag in ("article", "main") or name == "main"


def _varying(template: Slot) -> dict[int, float]:
    """Characters of varying text outside links below each node, by its identity."""
    below: dict[int, float] = {}
    for slot in reversed(spelled(template)[1]):  # children first
        own = 0 if slot.texts and len(slot.constant) == slot.texts else slot.chars - slot.linked
        chrome = _is_chrome(slot.label, False)
        below[id(slot)] = 0.0 if chrome else own + sum(below[id(k)] for k in slot.kids)
    return below


def _has_region(template: Slot) -> bool:
    """Whether a region element outside chrome is on half of the pages."""
    stack = [template]
    while stack:
        slot = stack.pop()
        if _is_chrome(slot.label, False):
            continue
        if _is_region(slot.label) and 2 * slot.pages >= template.pages:
            return True
        stack += slot.kids
    return False


def _main_region(template: Slot) -> Slot:
    """The lowest node that holds most of the varying text."""
    varying, slot = _varying(template), template
    total = varying[id(slot)]
    while total:
        best = max(slot.kids, key=lambda k: varying[id(k)], default=None)
        if best is None or varying[id(best)] < 0.8 * total:
            break
        slot = best
    return slot


def wrapper(template: Slot) -> list:
    """Rules for every node of a template in order: label, whether its text is content,
    constant texts to leave out, number of children.

    The region is an article or main element where most pages have one, and otherwise
    the lowest node with most of the varying text. Inside it all text is content but
    that of chrome and constant texts; if more texts of the region are constant than
    vary (copies of one page), nothing in it counts as constant.
    """
    tagged = _has_region(template)
    region = None if tagged else _main_region(template)
    inside = {}  # by identity: None below chrome, else whether in the region
    stack = [(template, False)]
    while stack:
        slot, within = stack.pop()
        if within is not None:
            within = within or slot is region or (tagged and _is_region(slot.label))
            within = None if _is_chrome(slot.label, within) else within
        inside[id(slot)] = within
        stack += [(k, within) for k in slot.kids]

    slots = spelled(template)[1]
    content = [slot for slot in slots if inside[id(slot)]]
    constant = sum(len(slot.constant) for slot in content)
    trust = constant <= sum(slot.texts for slot in content) - constant
    return [
        [slot.label, int(bool(inside[id(slot)])), slot.constant if inside[id(slot)] and trust else [], len(slot.kids)]
        for slot in slots
    ]


class Reader:
    """Main texts of pages under one wrapper; alignments are remembered by page shape."""

    def __init__(self, packed: list):
        self.rule = Rule.unpacked(packed)
        self.by_shape: dict[str, list] = {}

    def _decisions(self, page: Page) -> list:
        """(keep, texts to leave out) per node; unmatched nodes follow their parent or tag."""
        pairs: list = []
        match(page.root, self.rule, pairs)
        of = {a.index: r for a, r in pairs}
        out: list = [None] * len(page.nodes)

        stack = [(page.root, False, False)]
        while stack:
            node, inside, dead = stack.pop()
            rule = of.get(node.index)
            inside = inside or _is_region(node.label)
            dead = dead or _is_chrome(node.label, inside)
            keep = rule.keep if rule else inside
            out[node.index] = (bool(keep or inside) and not dead, rule.constant if rule else frozenset())
            below = inside or bool(rule and rule.keep)
            stack += [(kid, below, dead) for kid in node.kids]
        return out

    def text(self, html: str) -> str:
        page = Page(html)
        if page.shape not in self.by_shape:
            if len(self.by_shape) > 5000:
                self.by_shape.clear()
            self.by_shape[page.shape] = self._decisions(page)
        decisions = self.by_shape[page.shape]
        kept = []
        for node, text, _ in page.runs:
            keep, constant = decisions[node.index]
            if keep and not (constant and text_key(text) in constant):
                kept.append(text)
        return " ".join(kept)


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _merged(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Shapes (``host``, ``shape``, ``pages``) merged per key, streaming: a task holds one template at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, template, total = None, None, 0

        def done() -> pa.RecordBatch:
            columns = [pa.array([host], pa.string()), pa.array([spelled(template)[0]]), pa.array([total], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["host", "shape", "pages"])

        for batch in batches:
            for name, shape, pages in zip(*(c.to_pylist() for c in batch.columns)):
                if template is not None and name != host:
                    yield done()
                    template, total = None, 0
                host, template, total = name, merge(template, grown(shape)[0]), total + pages
        if template is not None:
            yield done()

    dealt = shapes.repartition(*by).sortWithinPartitions("host", F.desc("pages"), "shape")
    return dealt.select("host", "shape", "pages").mapInArrow(run, "host string, shape string, pages bigint")


_RUN = pa.struct([("node", pa.int32()), ("key", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])


def different_pages(pages: DataFrame) -> DataFrame:
    """(``host``, ``digest``, ``shape``, ``runs``) of every different page of a host, once.

    From (``host``, ``html``). ``runs`` are the texts of a page by node and key, without
    repeats. Equal pages are one row wherever their copies are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # spares reading the copies a task meets; the rest go below
        for batch in batches:
            for part in slices(batch, 1):
                rows, cells, ends = [], [], [0]
                for host, html in zip(*(c.to_pylist() for c in part.columns)):
                    digest = xxhash.xxh64_intdigest(html.encode("utf-8", "replace")) - (1 << 63)
                    if (host, digest) in seen:
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add((host, digest))
                    page = Page(html)
                    found: dict[tuple[int, int], list[int]] = {}
                    for node, text, linked in page.runs:
                        cell = found.setdefault((node.index, text_key(text)), [0, 0])
                        cell[0] += len(text)
                        cell[1] += linked
                    rows.append((host, digest, page.shape))
                    cells.extend((*place, *size) for place, size in found.items())
                    ends.append(len(cells))
                columns = list(zip(*cells)) or [()] * 4
                items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUN)], fields=list(_RUN))
                hosts, digests, shapes = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(shapes, pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
                    ],
                    names=["host", "digest", "shape", "runs"],
                )

    schema = "host string, digest bigint, shape string, runs array<struct<node:int,key:bigint,chars:bigint,linked:bigint>>"
    return stored(pages.mapInArrow(run, schema).dropDuplicates(["host", "digest"]), "pages")


def _small(side: DataFrame, *texts: str) -> DataFrame:
    """A stored side of a join, to be broadcast if it is small enough, and else shuffled."""
    size = side.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(40)))).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def induce(pages: DataFrame) -> DataFrame:
    """(``host``, ``rules``) of every host, from :func:`different_pages`.

    The shapes of a host merge to its template, a hot host's in portions first. Every
    shape is then aligned with the whole template, and pages and texts of its nodes are
    counted by Spark: no node and no text of a host is left out.
    """
    shapes = stored(pages.groupBy("host", "shape").agg(F.count("*").alias("pages")), "shapes")
    portion = F.pmod(F.xxhash64("shape"), F.lit(32))
    templates = stored(_merged(_merged(shapes.withColumn("p", portion), ["host", "p"]), ["host"]), "templates")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, template, number = None, None, {}
        for batch in batches:
            found = []
            for name, shape, whole in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "template"))):
                if template is None or name != host:
                    host, (template, slots) = name, grown(whole)
                    number = {id(slot): i for i, slot in enumerate(slots)}
                page, nodes = grown(shape)
                pairs: list = []
                match(page, template, pairs)
                of = {id(node): number[id(slot)] for node, slot in pairs}
                found.append([of.get(id(node), -1) for node in nodes])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("shape"), batch.column("pages"), pa.array(found, pa.list_(pa.int32()))],
                names=["host", "shape", "pages", "slots"],
            )

    whole = templates.select("host", F.col("shape").alias("template"))
    sorted_shapes = shapes.join(_small(whole, "host", "template"), "host").sortWithinPartitions("host")
    aligned = stored(
        sorted_shapes.select("host", "shape", "pages", "template")
        .mapInArrow(align, "host string, shape string, pages bigint, slots array<int>"),
        "aligned",
    )
    slots = aligned.select("host", "pages", F.explode("slots").alias("slot")).where("slot >= 0")
    slots = stored(slots.groupBy("host", "slot").agg(F.sum("pages").alias("pages")), "slots")

    of_shape = aligned.select("host", "shape", "slots")
    size = aligned.agg(F.sum(F.octet_length("host") + F.octet_length("shape") + 4 * F.size("slots"))).first()[0] or 0
    runs = pages.join(F.broadcast(of_shape) if size <= BROADCAST_BYTES else of_shape, ["host", "shape"])
    runs = runs.select("host", "slots", F.inline("runs")).withColumn("slot", F.get("slots", F.col("node"))).where("slot >= 0")
    # A page has a text once in a node, and a node once in a slot.
    texts = runs.groupBy("host", "slot", "key").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    often = (F.col("pages") >= CONSTANT_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    texts = texts.join(_small(slots, "host"), ["host", "slot"]).groupBy("host", "slot").agg(
        F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sort_array(F.collect_list(F.when(often, F.col("key")))).alias("constant"),
    )
    measures = F.struct("slot", "pages", "texts", "chars", "linked", "constant")
    counted = slots.join(texts, ["host", "slot"], "left").groupBy("host").agg(F.collect_list(measures).alias("counts"))

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for shape, counts in zip(*(batch.column(c).to_pylist() for c in ("shape", "counts"))):
                template, nodes = grown(shape)
                for x in counts:
                    slot = nodes[x["slot"]]
                    slot.pages, slot.texts, slot.constant = x["pages"], x["texts"] or 0, x["constant"] or []
                    slot.chars, slot.linked = x["chars"] or 0, x["linked"] or 0
                packed.append(json.dumps(wrapper(template), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(packed, pa.string())], names=["host", "rules"]
            )

    return templates.select("host", "shape").join(counted, "host").mapInArrow(rules, "host string, rules string")


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``text``) of every page.

    Blocks in page order, white space within and between them one blank; character
    references decoded. Null and empty pages have empty text; null urls and urls
    without a host are one host. Repeated pages are read each on its own, and counted
    once; pages may be of any length and depth. An empty table gives an empty result,
    and other columns are ignored, whatever their names.
    """
    rows = pages.select(
        F.col(id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.lower(F.regexp_extract(F.col(url), _HOST, 1)), F.lit("")).alias("host"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    induced = stored(induce(different_pages(rows.select("host", "html"))), "wrappers")
    joined = rows.join(_small(induced, "host", "rules"), "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            for part in slices(batch, 2):
                texts = []
                for page, packed in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if packed not in readers:
                        if len(readers) > HELD_HOSTS:
                            readers.clear()
                        readers[packed] = Reader(json.loads(packed))
                    texts.append(readers[packed].text(page))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    kinds = dict(rows.dtypes)
    return joined.select("page_id", "url", "html", "rules").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )
