"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree of labelled elements (tag and class names), in which equal neighbours are one
repeated node. The trees of a host are aligned with one of its pages' by simple tree
matching: the largest match of two trees that keeps order and ancestry, by dynamic programming over children.
A block of text then has a slot, the matched node of that page. Texts that the same slot holds in most of
a host's different pages are template. The slots whose text varies show where the content is: the host's region
is the innermost node of the model that is not itself a block of text and under which REGION of the varying text of all pages
stands, text of links not counted. Blocks in the region are content, unless their elements name them as something else
(menus, adverts, notices, forms, comments, ...), and if a page marks articles there, those in an article. A page that
has nothing in its host's region is judged by its marks and links alone.

Counting is distributed: pages of equal content count once; a host's constants number at most the blocks of a
page over SHARE, its slots at most the nodes of a page. Hosts with fewer than LEAST different pages have no template texts.
Wrappers meet the pages by broadcast where their measured size allows it, else by host, large hosts salted.

Defined results: a null or blank html gives an empty text; markup that is cut off ends there; a null url is
a host of its own name ``""``; repeated rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.components import cut
from dialoom.llm.op06_url_filters import host_of

SHARE, LEAST, REGION = 0.6, 4, 0.75
#: Bytes of wrappers that may be broadcast, and the part of all rows from which on a host is salted (so at most as many hosts are).
BROADCAST_BYTES, SALTED = 16 << 20, 1024
#: Alignments of trees up to this size are kept for the next page of the shape.
KEPT_NODES = 400
#: Cells of a table of two lists of children; longer lists are halved by the best cut first.
CELLS = 1 << 21

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

# Elements by what HTML says of them, and names that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form button head dialog menu".split())
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar tracking widget widgets alert alerts topbar reader".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th"), "thead": ("tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_PARAGRAPH_STOP = frozenset("td th table button article section main body".split())


class Node:
    __slots__ = ("article", "children", "label", "link", "main", "number", "shape", "size", "tag", "unwanted")

    def __init__(self, tag: str, label: str, parent: "Node | None", unwanted: bool):
        self.tag, self.label, self.children = tag, label, []
        self.unwanted = unwanted or (parent is not None and parent.unwanted)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.article = self if tag == "article" and not (parent and parent.article) else parent.article if parent else None
        self.main = tag == "main" or (parent is not None and parent.main)
        self.shape, self.size, self.number = "", 1, 0

    def close(self) -> None:
        """Shape and size, with equal neighbours as one."""
        shapes, last = [], None
        self.size = 1
        for child in self.children:
            if child.shape != last:
                shapes.append(child.shape)
                self.size += child.size
                last = child.shape
        self.shape = f"{self.label}({''.join(shapes)})"


def _element(tag: str, attributes: str, parent: Node) -> Node:
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if attributes else ""
    words = _WORD.findall(names)
    unwanted = tag in DROPPED or (tag == "header" and parent.article is None) or bool(words and not UNWANTED.isdisjoint(words) and tag not in ("body", "html", "main", "article") or tag == "article" and not UNWANTED.isdisjoint(words))
    return Node(tag, tag + "." + "-".join(words) if words else tag, parent, unwanted)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """(Root, blocks): each block has its element, its text and how many of its characters are links."""
    root = Node("", "", None, False)
    stack, blocks, run, linked = [root], [], [], [0]
    page = _CUT.sub("", page)
    at, end, search = 0, len(page), _TAG.search

    def flush(node: Node) -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((node, text, linked[0]))
            run.clear()
            linked[0] = 0

    def block_node() -> Node:
        for node in reversed(stack):
            if node.tag in BLOCK or not node.tag:
                return node
        return root

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.close()
            stack[-1].children.append(node)

    while at < end:
        m = search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = page[at:stop]
            run.append(entities.unescape(text) if "&" in text else text)
            if stack[-1].link:
                linked[0] += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush(block_node())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if stack[depth].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush(block_node())
            elif tag == "br":
                run.append(" ")
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if tag in ("title", "select", "textarea", "iframe", "noscript", "template", "object", "canvas", "svg", "math", "script", "style") and not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in BLOCK:
            flush(block_node())
            if tag in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in CLOSES[tag]:
                        pop_to(depth)
                        break
                    if stack[depth].tag in STOPS.get(tag, ()):
                        break
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in _PARAGRAPH_STOP:
                    break
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        stack.append(_element(tag, attributes, stack[-1]))
    flush(block_node())
    pop_to(1)
    root.close()
    todo = [root]
    while todo:
        node = todo.pop()
        number, last, held = node.number + 1, None, 0
        for child in node.children:
            if child.shape != last:
                number += held
                held, last = child.size, child.shape
            child.number = number
        todo += node.children
    return root, blocks


@lru_cache(maxsize=64)
def _tree(shape: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of the nodes of a shape, in preorder."""
    labels, children, stack, at = [], [], [], 0
    for m in re.finditer(r"[()]", shape):
        if m[0] == "(":
            labels.append(shape[at : m.start()])
            children.append([])
            if stack:
                children[stack[-1]].append(len(labels) - 1)
            stack.append(len(labels) - 1)
        else:
            stack.pop()
        at = m.end()
    return labels, children


def align(shape: str, model: str) -> dict[int, int]:
    """Matched node of ``model`` for nodes of ``shape``, by simple tree matching of trees of any size."""
    return (_kept if max(shape.count("("), model.count("(")) <= KEPT_NODES else _match)(shape, model)


class _Weights:
    """Sizes of the largest matches of equally labelled subtrees; equal subtrees have one number and match whole."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.pairs: dict[tuple[int, int], int] = {}

    def number(self, labels: list[str], children: list[list[int]]) -> list[int]:
        """Number of each node's subtree, a child's below its parent's."""
        out = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            key = (labels[i], tuple(out[c] for c in children[i]))
            out[i] = self.numbers.setdefault(key, len(self.labels))
            if out[i] == len(self.labels):
                self.labels.append(key[0])
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
        return out

    def fill(self, a: int, b: int) -> None:
        """The weights of all pairs that a match of ``a`` and ``b`` can hold."""
        seen, todo = {(a, b)}, [(a, b)]
        while todo:
            x, y = todo.pop()
            of: dict[str, list[int]] = {}
            for q in set(self.kids[y]):
                of.setdefault(self.labels[q], []).append(q)
            for p in set(self.kids[x]):
                for q in of.get(self.labels[p], ()):
                    if p != q and (p, q) not in seen:
                        seen.add((p, q))
                        todo.append((p, q))
        for x, y in sorted(seen):
            xs, ys = self.kids[x], self.kids[y]
            k = _common(xs, ys)
            self.pairs[x, y] = 1 + sum(self.sizes[p] for p in xs[:k]) + int(self.last(xs[k:], ys[k:])[-1])

    def rows(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> Iterator[np.ndarray]:
        """The rows of the table of two lists of children, one after the other."""
        best = np.zeros(len(ys) + 1, dtype=np.int64)
        yield best
        distinct, of = np.unique(np.array(ys, dtype=np.int64), return_inverse=True)
        for p in xs:
            weight = np.array([self.sizes[p] if p == q else self.pairs.get((p, q), 0) for q in distinct.tolist()], dtype=np.int64)[of]
            best = np.concatenate([[0], np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weight))])
            yield best

    def last(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        if not xs or not ys:
            return np.zeros(len(ys) + 1, dtype=np.int64)
        for best in self.rows(xs, ys):
            pass
        return best

    def matched(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the children that a largest match pairs."""
        k = _common(xs, ys)
        out, todo = [(i, i) for i in range(k)], [(k, len(xs), k, len(ys))]
        while todo:
            i0, i, j0, j = todo.pop()
            if i0 == i or j0 == j:
                continue
            if i - i0 > 1 and (i - i0) * (j - j0) > CELLS:
                mid = (i0 + i) // 2
                both = self.last(xs[i0:mid], ys[j0:j]) + self.last(xs[mid:i][::-1], ys[j0:j][::-1])[::-1]
                at = j0 + int(both.argmax())
                todo += [(i0, mid, j0, at), (mid, i, at, j)]
                continue
            best = list(self.rows(xs[i0:i], ys[j0:j]))
            while i > i0 and j > j0:
                here = best[i - i0][j - j0]
                if here == best[i - i0 - 1][j - j0]:
                    i -= 1
                elif here == best[i - i0][j - j0 - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out


def _common(xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
    """How many children are equal from the first on; some largest match pairs them."""
    return next((i for i, (p, q) in enumerate(zip(xs, ys, strict=False)) if p != q), min(len(xs), len(ys)))


def _match(shape: str, model: str) -> dict[int, int]:
    if shape == model:
        return {i: i for i in range(shape.count("("))}
    (la, ca), (lb, cb) = _tree(shape), _tree(model)
    if la[0] != lb[0]:
        return {}
    weights = _Weights()
    na, nb = weights.number(la, ca), weights.number(lb, cb)
    weights.fill(na[0], nb[0])
    out, todo = {}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        if na[a] == nb[b]:
            out.update(zip(range(a, a + weights.sizes[na[a]]), range(b, b + weights.sizes[na[a]]), strict=True))
            continue
        out[a] = b
        todo += [(ca[a][i], cb[b][j]) for i, j in weights.matched(weights.kids[na[a]], weights.kids[nb[b]])]
    return out


_kept = lru_cache(maxsize=4096)(_match)


def _hash(text: str, seed: int = 0) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data, seed) << 31 ^ zlib.adler32(data, seed + 1)) & 0x7FFFFFFFFFFFFFFF


@lru_cache(maxsize=64)
def _parents(shape: str) -> list[int]:
    """The parent of each node of a shape, -1 for the root."""
    _, children = _tree(shape)
    out = [-1] * len(children)
    for node, held in enumerate(children):
        for child in held:
            out[child] = node
    return out


def placed(shape: str, model: str, numbers: list[int]) -> list[int]:
    """The model's node that matches each given node or its nearest matched ancestor; 0 without any."""
    of, parents = align(shape, model), _parents(shape)
    out = []
    for n in numbers:
        while n >= 0 and n not in of:
            n = parents[n]
        out.append(of[n] if n >= 0 else 0)
    return out


@lru_cache(maxsize=1024)
def region(model: str, masses: tuple[tuple[int, int, int], ...]) -> frozenset[int]:
    """The nodes of a host's region; ``masses`` are (node, length of varying text placed there, length of that in blocks of the node itself)."""
    _, children = _tree(model)
    total, own = [0] * len(children), [0] * len(children)
    for node, mass, direct in masses:
        total[node] += mass
        own[node] += direct
    for node in range(len(children) - 1, -1, -1):
        total[node] += sum(total[c] for c in children[node])
    if not total[0]:
        return frozenset()
    at = 0
    while children[at]:
        best = max(children[at], key=lambda c: total[c])
        if total[best] < REGION * total[at] or 2 * own[best] > total[best]:
            break
        at = best
    inside, todo = [], [at]
    while todo:
        inside.append(todo.pop())
        todo += children[inside[-1]]
    return frozenset(inside)


def main_text(blocks: list[tuple[Node, str, int]], keys: list[int], constant: frozenset[int], nodes: list[int] | None = None, inside: frozenset[int] = frozenset()) -> str:
    """The content blocks in page order; ``nodes`` are the blocks' places in the model and ``inside`` its region, if there is one."""
    held = [(n, t, link, not inside or nodes[i] in inside) for i, (n, t, link) in enumerate(blocks) if not n.unwanted and keys[i] not in constant]
    within = [b[:3] for b in held if b[3]]
    articles: dict[int, list[int]] = {}
    for node, text, link, _ in held:
        if node.article is not None:
            size = articles.setdefault(id(node.article), [0, 0])
            size[0] += len(text)
            size[1] += link
    chosen = {k for k, (size, link) in articles.items() if 2 * link <= size}
    for good in (within, [b[:3] for b in held]):
        marked = [t for n, t, _ in good if n.article is not None and id(n.article) in chosen]
        if marked:
            return "\n".join(marked)
    good = within or [b[:3] for b in held]
    if any(n.main for n, _, _ in good):
        return "\n".join(t for n, t, _ in good if n.main)
    return "\n".join(t for _, t, link in good if 2 * link <= len(t))


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for host, page in zip(frame["host"], frame["html"], strict=True):
            root, blocks = parse(page or "")
            texts = [t for _, t, _ in blocks]
            rows.append((host, _hash("\n".join(texts)), root.shape, [n.number for n, _, _ in blocks], [zlib.crc32(n.label.encode()) % 100_000 for n, _, _ in blocks], [_hash(t) for t in texts], [max(len(t) - 2 * link, 0) for _, t, link in blocks]))
        yield pd.DataFrame(rows, columns=["host", "digest", "shape", "numbers", "labels", "texts", "sizes"])


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for host, shape, model, numbers, labels, texts, sizes in zip(*(frame[c] for c in ("host", "shape", "model", "numbers", "labels", "texts", "sizes")), strict=True):
            of, seen = align(shape, model), {}
            for n, l, t, size, node in zip(numbers, labels, texts, sizes, placed(shape, model, [int(n) for n in numbers]), strict=True):
                x = seen.setdefault((_slot(int(of.get(int(n), 100_000 + int(l))), int(t)), node), [0, 0])
                x[0] += int(size)
                x[1] += int(size) if int(n) in of else 0
            rows += [(host, slot, node, mass, direct) for (slot, node), (mass, direct) in seen.items()]
        yield pd.DataFrame(rows, columns=["host", "slot", "node", "mass", "direct"])


def _slot(slot: int, text: int) -> int:
    return (text * 0x9E3779B97F4A7C15 + slot * 0xBF58476D1CE4E5B9) >> 3 & 0x7FFFFFFFFFFFFFFF


def induce(pages: DataFrame) -> DataFrame:
    """(host, model, rows, constants, masses): the tree to align with, the host's rows, the hashes of template texts by slot, and how much varying text each node has."""
    given = pages.select(host_of(F.col("url")).alias("host"), "html")
    seen = given.mapInPandas(_survey, "host string, digest long, shape string, numbers array<int>, labels array<int>, texts array<long>, sizes array<int>")
    page = F.struct("shape", "numbers", "labels", "texts", "sizes")
    seen = cut(seen.groupBy("host", "digest").agg(F.min(page).alias("p"), F.count("*").alias("rows")).select("host", "digest", "rows", "p.*"))
    # The model is a page with about as many blocks as three in four pages have at most: no empty one, no outlier.
    usual = seen.groupBy("host").agg(F.percentile_approx(F.size("texts"), F.lit(0.75)).alias("usual"), F.count("*").alias("pages"), F.sum("rows").alias("rows"))
    nearest = F.struct(F.abs(F.size("texts") - F.col("usual")), "digest")
    models = seen.select("host", "digest", "shape", "texts").join(usual, "host").groupBy("host").agg(F.min_by("shape", nearest).alias("model"), F.first("pages").alias("pages"), F.first("rows").alias("rows"))
    slots = seen.join(models.select("host", "model"), "host").select("host", "shape", "model", "numbers", "labels", "texts", "sizes")
    slots = slots.mapInPandas(_aligned, "host string, slot long, node int, mass long, direct long")
    slots = slots.groupBy("host", "slot", "node").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.sum("direct").alias("direct"))
    slots = slots.join(models.select("host", "pages"), "host")
    is_constant = (F.col("pages") >= LEAST) & (F.col("n") >= SHARE * F.col("pages"))
    by_node = slots.groupBy("host", F.when(~is_constant, F.col("node")).alias("node")).agg(F.sum("mass").alias("mass"), F.sum("direct").alias("direct"), F.collect_set(F.when(is_constant, F.col("slot"))).alias("constants"))
    varying = F.when(F.col("node").isNotNull() & (F.col("mass") > 0), F.struct("node", "mass", "direct"))
    found = by_node.groupBy("host").agg(F.sort_array(F.collect_list(varying)).alias("masses"), F.flatten(F.collect_list("constants")).alias("constants"))
    return models.join(found, "host", "left").select("host", "model", "rows", "constants", "masses")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        texts = []
        for page, model, constants, masses in zip(frame["html"], frame["model"], frame["constants"], frame["masses"], strict=True):
            root, blocks = parse(page or "")
            model = model or root.shape
            of = align(root.shape, model)
            held = frozenset(int(c) for c in constants) if constants is not None else frozenset()
            keys = [_slot(of.get(n.number, 100_000 + zlib.crc32(n.label.encode()) % 100_000), _hash(t)) for n, t, _ in blocks] if held else [0] * len(blocks)
            inside = region(model, tuple((int(m["node"]), int(m["mass"]), int(m["direct"])) for m in masses)) if masses is not None else frozenset()
            texts.append(main_text(blocks, keys, held, placed(root.shape, model, [n.number for n, _, _ in blocks]), inside))
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    wrappers = cut(induce(pages))
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    size = wrappers.agg(F.sum(F.length("model") + 8 * F.size("constants") + 24 * F.size("masses")), F.sum("rows")).first()
    if (size[0] or 0) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(wrappers.drop("rows")), "host", "left")
    else:
        salts = F.greatest(F.lit(1), F.expr(f"cast(rows * {SALTED} div {size[1]} as int)"))
        wrappers = wrappers.withColumn("salts", salts)
        rows = rows.join(F.broadcast(wrappers.where("salts > 1").select("host", "salts")), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int"))
        met = rows.drop("salts").join(wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), ["host", "salt"], "left")
    out = met.select("page_id", "url", "html", "model", "constants", "masses").mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
