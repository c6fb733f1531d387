"""HTML extraction (2) by minimum-cut labelling.

A page is cut into text blocks (text between block-level tags). A logistic
regression on a block's text and DOM ancestors, fitted by
:mod:`~spanloom.llm.html_training` on a bounded set of labelled pages, gives the
costs of either label, the capacities to the two terminals. Blocks next to each
other on the page and blocks under the same parent are joined by smoothness edges
whose capacity falls with their distance in the tree; their scale is fitted on
the same pages. A maximum flow separates content from boilerplate at the least
total cost; the content blocks are the text.

Names of classes are a weak hint: a part that holds most of a page's prose is no furniture,
whatever it is called, and readers' comments without a name are told by their making:
siblings of one shape, each with a line like a name and a date.

Pages are independent: one task holds one page at a time. Time is near linear in
a page's length, however deep its tags nest. A null or empty page
and a page without content give an empty text. Unclosed, stray and cut-off tags
are tolerated; scripts, styles, comments and the head never give text. Character
references are decoded once, white space inside a block becomes one space
(``<br>`` counts as white space), blocks are joined by one newline. Repeated
rows each get a result; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea noscript iframe template svg object canvas audio video xmp noembed noframes annotation annotation-xml".split())
#: What runs to the end of the page if it is not closed; of others an unclosed tag alone is skipped.
TO_THE_END = frozenset(("script", "style", "template", "xmp"))
NEVER = frozenset("head title button select option optgroup datalist dialog".split()) | RAW
ASIDE = frozenset("nav footer aside form menu header fieldset search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words in class, id and role that mark page furniture, whole or as beginnings.
FURNITURE = frozenset(
    "ad ads adv nav menu footer header masthead topbar toolbar share sharing social related login signin signup search skip legal copyright pager popup modal overlay "
    "widget rail tags tagcloud byline meta toc alert notice notices gdpr consent rss feed complementary contentinfo navigation teaser teasers poll".split()
)
FURNITURE_START = ("advert", "adsense", "sponsor", "promo", "banner", "sidebar", "breadcrumb", "comment", "disqus", "reply", "replies", "respond", "cookie", "newsletter", "subscri", "recommend", "paginat", "navbar", "navigat", "footer", "outbrain", "taboola", "disclaimer", "feedback", "dropdown", "offcanvas", "lightbox", "paywall")
#: Beginnings of words that mark readers' comments.
DISCUSSION = ("comment", "disqus", "respond", "replies", "discussion", "talkback", "thread")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([A-Za-z][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|copyright|cookie|privacy policy|terms of (?:use|service)|sign up|subscribe|log ?in\b", re.I)
_END = re.compile(r"[.!?…。！？:;\"'»”)]\s*$")


#: What a line of an author, a date or a reply has.
_SIGNED = re.compile(r"\b(?:ago|says|said|wrote|replied|reply|posted|commented)\b|\b\d{1,2}:\d\d\b|\b(?:19|20)\d\d\b|\b\d{1,2}[./-]\d{1,2}[./-]", re.I)
#: Elements that hold a comment.
THREADED = frozenset(("div", "li", "article", "section"))
#: The shares of a page's prose from which a part is its text in spite of its name, or of a name of comments.
MOST, NEARLY_ALL = 0.5, 0.8
#: Edges over longer ways in the tree have no capacity worth counting.
FAR = 40


class Element:
    __slots__ = ("tag", "parent", "depth", "marked", "never", "aside", "article", "holds", "owner", "context", "shape", "prose", "parts", "signed", "thread")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.never = tag in NEVER or parent is not None and parent.never
        self.aside = tag in ASIDE
        self.article = tag in ("article", "main")
        self.marked = 0
        self.holds = False  # an article, main or h1 below
        self.owner = self if tag in BLOCK or parent is None else parent.owner
        self.context: tuple[bool, bool, bool, bool] | None = None
        self.shape = tag  # tells siblings that are made alike
        self.prose = 0.0  # the share of the page's prose below
        self.parts = 0  # blocks below
        self.signed = False  # a line like an author's or a date below
        self.thread = False  # one of several signed siblings of one shape
        if attrs and tag not in ("html", "body"):
            self._read(attrs)

    def _read(self, attrs: str) -> None:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                self.shape = f"{self.tag}.{value}"
            if name in ("class", "id", "role"):
                words = [w.lower() for part in re.split(r"[^A-Za-z0-9]+", value) for w in (_WORD.findall(part) or [part])]
                whole = [w.lower() for w in re.split(r"[\s_-]+", value) if w]
                if any(w.startswith(DISCUSSION) for w in whole + words):
                    self.marked = 2
                elif any(w in FURNITURE or w.startswith(FURNITURE_START) for w in whole + words):
                    self.marked = max(self.marked, 1)
                if name == "role" and value in ("main", "article"):
                    self.article = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                self.never = True

    def hold(self) -> None:
        """Tells the elements above, up to the article or main they are in, that they hold an article, main or h1."""
        e = self.parent
        while e is not None and not e.holds:
            e.holds = True
            if e.tag == "main" or e.article and not e.marked:
                break
            e = e.parent

    def surroundings(self) -> tuple[bool, bool, bool, bool]:
        """Whether it stands in page furniture, beside the text, in an article, and among readers' comments; known once the page is read.

        A part that holds most of the page's prose is no furniture, whatever its name.
        """
        chain, e = [], self
        while e is not None and e.context is None:
            chain.append(e)
            e = e.parent
        furniture, aside, inside, thread = e.context if e is not None else (False, False, False, False)
        for x in reversed(chain):
            inside = inside or x.article and (not x.marked or x.prose >= MOST)
            named = x.marked == 2 and not (x.holds and (x.tag in ("body", "html") or x.prose >= MOST)) and x.prose < NEARLY_ALL or x.marked == 1 and not x.holds and not x.article and x.prose < MOST
            furniture = furniture or named
            aside = aside or x.aside and not x.holds and not (x.tag == "header" and inside) and x.prose < MOST
            thread = thread or x.thread and x.prose < MOST
            x.context = furniture, aside, inside, thread
        return self.context


class Block:
    __slots__ = ("text", "element", "links", "chars")

    def __init__(self, text: str, element: Element, links: int):
        self.text, self.element, self.links, self.chars = text, element, links, len(text)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, without those that never show."""
    top = Element("#page", None, "")
    stack, out, held = [top], [], []
    opened: dict[str, list[int]] = {}  # where the open elements of a tag stand on the stack
    open_blocks: list[int] = []
    linked = 0  # characters inside links in the block so far
    unclosed: set[str] = set()  # raw tags without an end in the rest of the page

    def end() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not stack[-1].never:
                out.append(Block(text, stack[-1].owner, min(linked, len(text))))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        held.append(text)
        if opened.get("a"):
            linked += len(text.strip())

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            opened[e.tag].pop()
            if e.tag in BLOCK:
                open_blocks.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        lo = m.start() if m else n
        if lo > at:
            add(html.unescape(page[at:lo]))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            if name in BLOCK:
                end()
            k = last((name,))
            if k and (name in BLOCK or name == "a" or not open_blocks or open_blocks[-1] < k):
                close(k)
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name != "svg":
                if name not in unclosed:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    if stop:
                        at = stop.end()
                    elif name in TO_THE_END:
                        at = n
                    else:
                        unclosed.add(name)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                end()
            continue
        if name in BLOCK:
            end()
            if open_blocks and stack[open_blocks[-1]].tag == "p":  # an open p ends where a block begins
                close(open_blocks[-1])
            if name in CLOSES and (k := last(CLOSES[name])) > last(KEEPS_OPEN[name]):
                close(k)
        e = Element(name, stack[-1], attrs)
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            open_blocks.append(len(stack))
        stack.append(e)
        if e.article and not e.marked or name == "h1":
            e.hold()
    end()
    return out


def weigh(blocks: list[Block]) -> None:
    """Tells each element above a block its share of the page's prose, and which are signed siblings of one shape with more to say.

    Prose are blocks of some words that are no links. Elements are visited once, the deepest first.
    """
    seen: dict[int, Element] = {}
    for b in blocks:
        words = b.text.count(" ") + 1
        if words >= 8 and b.links * 2 < b.chars:
            b.element.prose += b.chars
        b.element.parts += 1
        b.element.signed = b.element.signed or words <= 8 and b.text[-1] not in ".!?…" and _SIGNED.search(b.text) is not None
        e = b.element
        while e is not None and id(e) not in seen:
            seen[id(e)] = e
            e = e.parent
    order = sorted(seen.values(), key=lambda e: -e.depth)
    alike: dict[tuple[int, str], list[Element]] = {}
    for e in order:
        if e.parent is not None:
            e.parent.prose += e.prose
            e.parent.parts += e.parts
            e.parent.signed = e.parent.signed or e.signed
            if e.signed and e.parts > 1 and e.tag in THREADED:
                alike.setdefault((id(e.parent), e.shape), []).append(e)
    total = order[-1].prose if order else 0.0
    for group in alike.values():
        for e in group:
            e.thread = len(group) > 1 and not e.holds
    for e in order:
        e.prose /= total or 1.0


#: What the classifier sees of a block, besides a constant.
FEATURES = ("furniture", "aside", "comment", "inside", "beside an article", "link share", "mostly links", "words", "few words", "ends a sentence", "h1", "paragraph", "item outside", "rights or sign-up", "after h1")


def features(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` and a 1 for each block."""
    weigh(blocks)
    around = [b.element.surroundings() for b in blocks]
    has_article = any(inside for _, _, inside, _ in around)
    out = np.ones((len(blocks), len(FEATURES) + 1))
    title = False
    for row, b, (furniture, aside, inside, thread) in zip(out, blocks, around, strict=True):
        words, tag, links = b.text.count(" ") + 1, b.element.tag, b.links / max(1, b.chars)
        title = title or tag == "h1"
        row[:-1] = (
            furniture, aside, thread, inside, has_article and not inside, links, links > 0.5, min(30, words) / 10, words < 6 and not inside, _END.search(b.text) is not None,
            tag == "h1", tag in ("p", "blockquote", "pre", "h2", "h3"), tag == "li" and not inside, not inside and _RIGHTS.search(b.text) is not None, title,
        )
    return out


def costs(blocks: list[Block], weights: np.ndarray, most: float = 12.0) -> tuple[list[float], list[float]]:
    """Per block the cost of calling it boilerplate and of calling it content: the negative log of the classifier's probabilities, ``most`` at most."""
    odds = np.clip(features(blocks) @ weights, -most, most)
    return np.logaddexp(0, odds).tolist(), np.logaddexp(0, -odds).tolist()


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, up to ``FAR``."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block], scale: float) -> list[tuple[int, int, float]]:
    """Edges between page neighbours and between following blocks under one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        parent = id(b.element.parent)
        if i:
            edges.append((i - 1, i, scale * 0.6 ** distance(blocks[i - 1].element, b.element)))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, 0.35 * scale))
        last[parent] = i
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut (Dinic's algorithm, without recursion)."""
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i in range(n):
        common = min(source[i], sink[i])  # flows straight through
        if source[i] > common:
            arc(s, i, source[i] - common, 0.0)
        if sink[i] > common:
            arc(i, t, sink[i] - common, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in head[a]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = s
        while True:
            if at == t:
                least = min(room[k] for k in path)
                for k in path:
                    room[k] -= least
                    room[k ^ 1] += least
                cut = next(i for i, k in enumerate(path) if room[k] <= tiny)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[at] < len(head[at]):
                k = head[at][turn[at]]
                if room[k] > tiny and level[to[k]] == level[at] + 1:
                    break
                turn[at] += 1
            else:
                if at == s:
                    break
                level[at] = -1
                at = to[path.pop() ^ 1]
                continue
            path.append(k)
            at = to[k]


def content_of(blocks: list[Block], weights: np.ndarray, scale: float) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    keep, drop = costs(blocks, weights)
    return minimum_cut(keep, drop, smoothness(blocks, scale))


def main_text(page: str | None, model: tuple[np.ndarray, float] | None = None) -> str:
    """The content blocks of a page, joined by newlines; ``model`` has the classifier's weights and the scale of the edges."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    content = content_of(blocks, *(model or fitted()))
    return "\n".join(b.text for b, c in zip(blocks, content, strict=True) if c)


def fitted() -> tuple[np.ndarray, float]:
    """The model of :func:`spanloom.llm.html_training.fit`, fitted once a process."""
    from .html_training import fit

    return fit()


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of each page with ``text`` and ``n_chars`` (code points)."""
    schema = T.StructType([pages.schema[c] for c in keep]).add("text", "string").add("n_chars", "long")
    model = fitted()

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h.as_py(), model) for h in part.column(last)]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, pages[html_col].alias("_html")).mapInArrow(run, schema)
