"""Main text of web pages by tag-path ratios.

Text length and punctuation are summed per root-to-leaf tag path, divided by the path's
nodes, smoothed over neighbouring blocks and multiplied; paths above a threshold select the
content nodes. The smallest element that holds nearly all of their text is the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A quote opens a value right after "=" and only if it is closed somewhere; else it is a character like others.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)(?:>|\Z)", re.S)
#: Name and value of each attribute in turn, so that no name is looked for within a value.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg head title nav footer aside form button select textarea iframe menu dialog object xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
#: What a class, id or role is made of that marks what is not the article.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer "
    "hidden masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies reply "
    "search share sharing sidebar social sponsor sponsored subscribe toolbar".split())
#: Words that may stand beside those and only say which box it is.
BOX_WORDS = frozenset(
    "area article articles bar block bottom box button buttons container entry form global inner item items left links list main outer "
    "page post posts primary right secondary section site top widget wrap wrapper".split())
SIDE_TOKENS = frozenset(("is-hidden", "visually-hidden"))
#: Elements that pages put around everything, so that what they hold decides.
AROUND = frozenset(("form", "head"))
PUNCTUATION = re.compile(r"[,.;:!?…，。、；：！？]")
#: A path is content from this share of the best smoothed score.
THRESHOLD = 0.1
#: The article holds at least this share of the selected text.
HOLDS = 0.9


class Node:
    """``mark`` says why the element itself may be a side part; ``side`` is settled once the whole page is read.
    ``path`` is the number of its tag path on the page."""

    __slots__ = ("tag", "parent", "path", "depth", "mark", "side", "article", "size", "clean", "held", "inside")

    def __init__(self, tag: str, parent: "Node | None", mark: str, path: int) -> None:
        self.tag, self.parent, self.mark, self.path = tag, parent, mark, path
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag in ARTICLES or bool(parent and parent.article)
        self.side, self.size, self.clean, self.held, self.inside = False, 0, 0, 0, False


class OpenElements:
    """The open elements, and where the last one of each tag, the last block and the last container stand."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], {}
        self.blocks, self.containers = [0], [0]
        self.paths: dict[tuple[int, str], int] = {}

    def open(self, tag: str, mark: str) -> Node:
        above, place = self.nodes[-1], len(self.nodes)
        node = Node(tag, above, mark, self.paths.setdefault((above.path, tag), len(self.paths) + 1))
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in _CONTAINERS:
            self.containers.append(place)
        return node

    def last(self, tag: str) -> int:
        """Place of the last open element of a tag, 0 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def close_from(self, place: int) -> None:
        while len(self.nodes) > place:
            gone = len(self.nodes) - 1
            self.at[self.nodes.pop().tag].pop()
            for places in (self.blocks, self.containers):
                if places[-1] == gone:
                    places.pop()


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values).lower())  # of a repeated attribute the first counts
    return out


def _is_side_token(token: str) -> bool:
    """A side word, alone or with words of its kind: ``cookie-notice`` and ``site-footer``, but not ``overflow-hidden`` or ``no-sidebar``."""
    words = {w for w in re.split(r"[\W\d_]+", token) if w}
    return token in SIDE_TOKENS or bool(words & SIDE_WORDS) and words <= SIDE_WORDS | BOX_WORDS


def _mark(tag: str, attributes: str, parent: Node) -> str:
    """``tag`` or ``attribute`` where that says side part, else nothing."""
    if tag in SKIPPED - AROUND or tag == "header" and not parent.article:
        return "tag"
    if tag in AROUND:
        return "attribute"
    own = _attributes(attributes) if attributes.strip() else {}
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"(?<![\w-])display\s*:\s*none", own.get("style", "")):
        return "attribute"
    if tag not in ("html", "body", *ARTICLES):
        if any(_is_side_token(t) for name in ("class", "id", "role") for t in own.get(name, "").split()):
            return "attribute"
    return ""


def _settle_sides(nodes: list[Node], pieces: list[tuple[str, Node]]) -> None:
    """Sets ``side`` of all nodes, parents first: marked elements and what they hold, but for wrappers.

    A wrapper holds an article or main with more text than any has that stands around it or
    outside of marked elements; or it holds most of the page's text, and none of those has
    text. Elements that are side by their tag, and those in an article or main that hold
    another one, must hold both that article and most of the text.
    """
    for text, node in pieces:
        node.size += len(text)
        node.clean += len(text)
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
        if not node.mark and node.tag not in ARTICLES:  # the text of an article is its own, without side parts
            node.parent.clean += node.clean
    # the largest article below each node, and the largest outside of all marked ones
    best: dict[Node, int] = {}
    for node in reversed(nodes):
        own = max(best.get(node, 0), node.clean if node.tag in ARTICLES and not node.mark else 0)
        if own and node.parent:
            best[node.parent] = max(best.get(node.parent, 0), own)
    under: set[Node] = set()
    outside = 0
    for node in nodes:
        if node.mark or node.parent in under:
            under.add(node)
        elif node.tag in ARTICLES:
            outside = max(outside, node.clean)
    for node in nodes:
        if not node.parent:
            continue
        node.side = node.parent.side
        if node.mark and not node.side:
            kept, up = outside, node.parent
            while up and up.article:
                kept, up = max(kept, up.clean if up.tag in ARTICLES else 0), up.parent
            holds, most = best.get(node, 0) > kept, 2 * node.size > nodes[0].size
            enough = holds and not node.parent.article or most and not kept
            node.side = not (holds and most or node.mark == "attribute" and enough)


def blocks_of(page: str) -> tuple[list[Node], list[tuple[str, Node]]]:
    """All elements, parents first, and the text blocks in page order with their innermost block element; side parts are left out."""
    root = Node("", None, "", 0)
    stack, nodes, read = OpenElements(root), [root], []
    pieces: list[tuple[str, Node]] = []
    home: list[Node] = [root]

    def flush() -> None:
        if pieces:
            read.append((pieces[:], home[0]))
            pieces.clear()

    def add(text: str) -> None:
        if text:
            pieces.append((html.unescape(text), stack.nodes[-1]))

    def settle() -> None:
        """The block element that text belongs to from here on."""
        flush()
        home[0] = stack.nodes[stack.blocks[-1]]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag or m.group(0)[-1] != ">":
            continue
        if closing:
            place = stack.last(tag)
            if place:
                # an end tag closes what it holds, but an inline one closes no block around it
                if tag in BLOCKS or stack.blocks[-1] < place:
                    if tag in BLOCKS:
                        flush()
                    stack.close_from(place)
                    if tag in BLOCKS:
                        settle()
            elif tag in ("br", "p"):
                add(" ")
            continue
        if tag in VOID:
            add(" " if tag == "br" else "")
            if tag == "hr":
                settle()
            continue
        if tag in BLOCKS:
            flush()
            if stack.last("p") > stack.containers[-1]:
                stack.close_from(stack.last("p"))
            ends, until = _IMPLIED.get(tag, ((), ()))
            place = max(map(stack.last, ends), default=0)
            if place > max(map(stack.last, until), default=0):
                stack.close_from(place)
        if attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        nodes.append(stack.open(tag, _mark(tag, attributes, stack.nodes[-1])))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = end.end()
            stack.close_from(len(stack.nodes) - 1)
        elif tag in BLOCKS:
            settle()
    flush()
    _settle_sides(nodes, [(" ".join(text.split()), node) for own, _ in read for text, node in own])
    blocks = ((" ".join("".join(text for text, node in own if not node.side).split()), node) for own, node in read)
    return nodes, [(text, node) for text, node in blocks if text and not node.side]


_CONTAINERS = BLOCKS - {"p"} - HEADINGS
#: Elements that a start tag ends, unless one of the second kind stands between; every block ends a paragraph.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    return np.convolve(np.pad(x, 2, mode="edge"), kernel / kernel.sum(), mode="valid")


def path_scores(blocks: list[tuple[str, Node]]) -> dict[int, float]:
    """Of every tag path the best score of its blocks: mean length times mean punctuation of a path, both smoothed over neighbours."""
    paths: dict[int, list[float]] = {}
    for text, node in blocks:
        sums = paths.setdefault(node.path, [0.0, 0.0, 0.0])
        sums[0] += len(text)
        sums[1] += len(PUNCTUATION.findall(text))
        sums[2] += 1
    lengths = np.array([paths[n.path][0] / paths[n.path][2] for _, n in blocks])
    marks = np.array([(paths[n.path][1] + 1) / paths[n.path][2] for _, n in blocks])
    best: dict[int, float] = {}
    for (_, node), s in zip(blocks, _smooth(lengths) * _smooth(marks)):
        best[node.path] = max(best.get(node.path, 0.0), float(s))
    return best


def main_text(page: str | None) -> str:
    nodes, blocks = blocks_of(page or "")
    if not blocks:
        return ""
    best = path_scores(blocks)
    least = THRESHOLD * max(best.values())
    chosen = [best[n.path] >= least for _, n in blocks]

    for (text, node), c in zip(blocks, chosen):
        node.held += c * len(text)
    for node in reversed(nodes[1:]):
        node.parent.held += node.held
    total = nodes[0].held
    root = max((n for n in nodes if n.held >= HOLDS * total and (n.tag in _CONTAINERS or not n.parent)), key=lambda n: n.depth)
    if not root.article:
        root = min((n for n in nodes if n.tag in ARTICLES and n.held > 0.5 * total), key=lambda n: n.depth, default=root)
    while root.article and root.tag not in ARTICLES:
        root = root.parent
    for node in nodes:
        node.inside = node is root or bool(node.parent and node.parent.inside)

    # a short quote or list between chosen blocks belongs to them
    places = [k for k, (_, n) in enumerate(blocks) if chosen[k] and n.inside]
    first, last = places[0], places[-1]
    return "\n\n".join(t for k, (t, n) in enumerate(blocks) if n.inside and (
        chosen[k] or root.article or n.tag in HEADINGS or first < k < last))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page: blocks joined by an empty line, white space within a block as one space.

    Null and empty html give an empty text. Pages cut short, open tags and stray characters are
    read as far as they go; a tag cut off at the end of the page is no text. The ratios of tag
    paths choose the content blocks and with them the element that holds the article; blocks
    between chosen ones and headings stay. Where that element lies in an ``article`` or ``main``,
    all of it stays that is no side part. Work and memory grow with the page, not with how
    deep its tags nest. One row per input row, nothing is shuffled; other
    columns are ignored and an empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
