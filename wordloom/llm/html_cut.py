"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. A linear classifier turns each block's tags, class names, links and length into the cost of
calling it boilerplate or content: the capacity of its edge from the source or to the sink. Neighbouring blocks, and
neighbours under one parent element, are joined by smoothness edges, stronger the closer they are in the document tree. The
minimum cut, by maximum flow, separates content from boilerplate.

Defined results: null and empty pages give empty texts. Repeated rows are read alike. Pages of any length are read whole; broken
markup (unclosed or stray tags, cut references) is read as far as it goes.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column

# Elements that start a block of their own, that hold no text of the page, and that have no end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
SILENT = frozenset("title script style template textarea iframe annotation annotation-xml".split())
#: Elements whose text is no text of the page if their end tag comes; without it, what follows from the next block on is.
LABELS = frozenset("noscript select option optgroup svg object canvas audio video button".split())
#: What may stand in a head; any other start tag, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements first.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements beyond which such an implied end does not reach.
FENCES = frozenset("ul ol dl table tbody thead tfoot select button object article section div main aside nav body".split())

# What an element and the words in its class, id and role say for content (above 0) or boilerplate.
TAGS = {"article": 4.0, "main": 3.0, "nav": -5.0, "footer": -5.0, "aside": -5.0, "form": -5.0, "dialog": -5.0, "menu": -5.0, "header": -4.0}
NAMES = {
    -6.0: "comment comments respond reply replies disqus",
    -5.0: "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside ad ads advert advertisement "
    "adverts banner sponsor sponsored promo cookie cookies consent notice popup modal newsletter subscribe signup form login "
    "share sharing social related recommended widget pagination pager toolbar alert gdpr",
    2.0: "article articlebody post entry story content body text main",
}
NAME_SCORES = {w: score for score, words in NAMES.items() for w in words.split()}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Smoothness of neighbouring blocks at tree distance 0; of neighbours under one parent.
NEAR, SIBLING = 1.2, 0.4


class Element:
    __slots__ = ("tag", "parent", "depth", "score", "silent", "hidden", "first")

    def __init__(self, tag: str, parent: Element | None, attributes=(), first: int = 0):
        self.tag, self.parent, self.first = tag, parent, first
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = tag in SILENT or bool(parent and parent.hidden)
        self.silent = self.hidden or tag in LABELS or bool(parent and parent.silent)
        own = TAGS.get(tag, 0.0)
        # A header inside the article holds its title.
        if tag == "header" and parent and parent.score > 2:
            own = 0.0
        words = {w.lower() for name, value in attributes if name in ("class", "id", "role", "itemprop") and value for w in WORD.findall(value)}
        found = [NAME_SCORES[w] for w in words if w in NAME_SCORES]
        if found:
            own += min(found) if min(found) < 0 else max(found)
        if any(name == "hidden" for name, _ in attributes):
            own -= 5.0
        # What stands nearer weighs more; what its ancestors say fades.
        self.score = own + (parent.score * (0.5 if own else 1.0) if parent else 0.0)


class Block:
    __slots__ = ("parent", "parts", "linked")

    def __init__(self, parent: Element):
        self.parent, self.parts, self.linked = parent, [], 0


class PageReader(HTMLParser):
    """Collects the blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.here = Element("#page", None)
        self.blocks: list[Block] = []
        self.open: Block | None = None
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if self.here.tag == "head" and tag not in IN_HEAD:
            self.leave(self.here)
        if tag == "br":
            if self.open:
                self.open.parts.append(" ")
            return
        if tag in BLOCKS:
            self.open = None
            self.close_for(tag)
            if tag not in LABELS and tag != "hr":
                self.break_labels()
        if tag in VOID:
            return
        self.links += tag == "a"
        self.here = Element(tag, self.here, attrs, len(self.blocks))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag != "a":
            self.handle_endtag(tag)

    def break_labels(self) -> None:
        """Text counts from here on, until an end tag shows that it belongs to a label."""
        at = self.here
        while at and at.silent and not at.hidden:
            at.silent = False
            at = at.parent

    def drop(self, element: Element) -> None:
        """Forgets the blocks that began in an element."""
        if len(self.blocks) > element.first:
            del self.blocks[element.first :]
            self.open = None

    def close_for(self, tag: str) -> None:
        wanted = ENDS.get(tag, frozenset()) | {"p"}
        found, at = None, self.here
        while at.parent and at.tag not in FENCES:
            if at.tag in wanted:
                found = at
            at = at.parent
        if found:
            self.leave(found)
            if found.tag == "head":
                self.drop(found)

    def handle_endtag(self, tag):
        at = self.here
        while at.parent and at.tag != tag:
            # An inline end tag does not close blocks.
            if at.tag in BLOCKS and tag not in BLOCKS and tag not in SILENT and tag not in LABELS and tag != "head":
                return
            at = at.parent
        if at.parent:
            self.leave(at)
            if tag in LABELS or tag == "head":
                self.drop(at)

    def leave(self, element: Element) -> None:
        while True:
            here = self.here
            self.here = here.parent
            self.links -= here.tag == "a"
            if here.tag in BLOCKS:
                self.open = None
            if here is element:
                return

    def handle_data(self, data):
        if self.here.tag == "head" and data.strip():
            self.leave(self.here)
        if self.here.silent:
            return
        if self.open is None:
            if not data.strip():
                return
            at = self.here
            while at.parent and at.tag not in BLOCKS:
                at = at.parent
            self.open = Block(at)
            self.blocks.append(self.open)
        self.open.parts.append(data)
        if self.links:
            self.open.linked += len(data)


def score(block: Block, text: str) -> float:
    """How much speaks for content rather than boilerplate."""
    density = min(1.0, block.linked / max(1, len(text)))
    own = {"p": 0.6, "pre": 0.6, "blockquote": 0.6, "li": -0.3, "td": -0.2}.get(block.parent.tag, 0.0)
    marked = -1.5 if text[:1] in "©®" or text[:9].lower() == "copyright" else 0.0
    return block.parent.score + own + marked - 2.5 * density + min(len(text), 300) / 200 - 0.6


def distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each block, whether it is on the source's side (content) of a minimum cut.

    A block's edge runs from the source where its score is above 0, else to the sink. Maximum flow by shortest augmenting
    levels (Dinic).
    """
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def connect(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            connect(source, i, s, 0.0)
        elif s < 0:
            connect(i, sink, -s, 0.0)
    for a, b, weight in edges:
        connect(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(e)
                a = to[e]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1


def main_text(html: str) -> str:
    """The content blocks of a page, joined by blank lines."""
    reader = PageReader()
    reader.feed(html)
    reader.close()
    texts = [" ".join("".join(b.parts).split()) for b in reader.blocks]
    blocks = [(b, t) for b, t in zip(reader.blocks, texts) if t]
    if not blocks:
        return ""
    edges: list[tuple[int, int, float]] = []
    last_under: dict[int, int] = {}
    for i, (b, _) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR / (1 + distance(blocks[i - 1][0].parent, b.parent))))
        box = b.parent.parent or b.parent
        if last_under.get(id(box), i - 1) != i - 1:
            edges.append((last_under[id(box)], i, SIBLING))
        last_under[id(box)] = i
    content = minimum_cut([score(b, t) for b, t in blocks], edges)
    return "\n\n".join(t for (_, t), c in zip(blocks, content) if c)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The table with ``text``, the main text of every page, in place of its html (and of a text column, if it has one)."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in column(batch, "_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = dict(pages.dtypes)
    given = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html"))
    return given.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))
