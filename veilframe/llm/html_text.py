"""Main text of web pages by minimum cut between content and boilerplate.

A page is read as a sequence of text blocks in an element tree. Two classifiers give each block's
costs for the two labels (terminal capacities): a logistic one of the block's shape, fitted once on a
bounded sample of the pages, and stated costs of what its ancestors' tags, roles and names tell.
Neighbours in reading order, and successive like elements under one parent, are tied by smoothness
capacities that grow with their closeness in the tree. The minimum cut of that graph is the labelling
of least total cost, so blocks that shape and names leave open follow their surroundings, and a weak
name is outvoted by them. Each page is cut whole, where it lies.

What a name costs shrinks where its element holds most of the page's prose: a form or a class word
around the whole article says nothing about it.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import mapped

#: Pages (expected, chosen by hash) to learn block shapes from, and the longest taken; all pages are cut whole.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 200_000
NEIGHBOUR = 1.2  # smoothness of neighbours in reading order
SIBLING = 0.8  # and of successive like elements under one parent
STRONG, WEAK = 6.0, 4.5  # costs that names of boilerplate put on the content label
CONTENT = 2.0  # and that names of content put on the other
PULL = 1.0  # how strongly the shape classifier is held to its prior, per learned block
SHAPE = 2.0  # most that a block's shape can weigh
MOST_PROSE = (0.6, 0.9)  # shares of the prose between which a name's cost falls to nothing

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe noframes select".split())
DROPPED_TAGS = frozenset("head button option optgroup datalist object canvas audio video".split())
STRONG_TAGS = frozenset("nav footer aside menu dialog search".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE_TAGS = frozenset("ul ol dl table div article main section nav aside footer header form body html blockquote".split())
STRONG_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr "
    "notice newsletter subscribe signup login pagination pager tagcloud copyright".split()
)
WEAK_WORDS = frozenset("header banner widget widgets promo alert popup modal overlay search form share sharing social related recommended recommendations legal toolbar skip tags".split())
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies discussion".split())
CONTENT_WORDS = frozenset("article post entry story articlebody postbody postcontent entrycontent storybody contentbody maincontent bodytext".split())
BODY_WORDS = frozenset("body content text title".split())
#: Names that tell a state or a topic, not a role: has-sidebar, tag-politics, share-enabled.
_STATE = re.compile(r"(?:has|is|no|not|with|without|tag|category|cat|type|status|format|js|hide|show|using)[-_]|.*[-_](?:enabled|disabled|on|off|active|inactive|visible|open|closed|layout|wrap|wrapper)$", re.I)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ROLES = {r: STRONG for r in "navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split()} | {"form": WEAK, "alert": WEAK}
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""", re.I)
_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_TAG_STOP = re.compile(r"""=\s*+(["'])|>""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")  # beyond any character


@dataclass
class Element:
    """What a block-level element tells: its kind, its names' costs, and its place."""

    parent: int
    depth: int
    kind: str  # tag and class; successive ones under a parent are alike
    tag: str = ""
    strong: float = 0.0
    weak: float = 0.0
    comments: float = 0.0
    content: float = 0.0
    main: bool = False  # main, article or first-level heading, here or inside
    prose: int = 0  # characters outside links, here and inside


@dataclass
class Block:
    text: str
    element: int
    linked: int  # characters inside links
    heading: bool
    apart: int  # steps in the tree from the block before
    cue: float = 0.0  # what the ancestors tell, above zero for content


@dataclass
class _Tree:
    elements: list[Element] = field(default_factory=lambda: [Element(-1, 0, "")])
    blocks: list[Block] = field(default_factory=list)


def markup(page: str):
    """(text, tag, attributes, closes) events of a page; text events have no tag. One pass, in linear time.

    Quotes count only as attribute values. A tag that nothing closes is text. Elements of RAW_TAGS
    give nothing; without an end tag script and style run to the page's end, others are empty.
    """
    at, size = 0, len(page)
    missing: set[str] = set()  # quotes and end tags that don't occur any more
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= size:
            yield page[at:], "", "", False
            return
        if lt > at:
            yield page[at:lt], "", "", False
        follow = page[lt + 1]
        if page.startswith("!--", lt + 1):
            # "<!-->" and "<!--->" are whole comments.
            short = 5 if page.startswith("!-->", lt + 1) else 6 if page.startswith("!--->", lt + 1) else 0
            end = None if short else _COMMENT_END.search(page, lt + 4)
            at = lt + short if short else end.end() if end else size
            continue
        if follow in "!?" or (follow == "/" and not page[lt + 2 : lt + 3].isalpha()):
            gt = page.find(">", lt + 2)
            at = gt + 1 if gt >= 0 else size
            continue
        name = _TAG_NAME.match(page, lt + 1 + (follow == "/"))
        if not name:
            yield "<", "", "", False
            at = lt + 1
            continue
        stop, end = name.end(), -1
        while m := _TAG_STOP.search(page, stop):
            if m[0] == ">":
                end = m.start()
                break
            stop = m.end()
            if m[1] not in missing:
                close = page.find(m[1], stop)
                if close < 0:
                    missing.add(m[1])
                else:
                    stop = close + 1
        if end < 0:
            # No tag ends any more, but for those a quote hid.
            end = page.find(">", name.end())
            if end < 0:
                yield page[lt:], "", "", False
                return
        tag, attributes = name[0].lower(), page[name.end() : end]
        at = end + 1
        if tag in RAW_TAGS and follow != "/":
            if not attributes.rstrip().endswith("/"):
                close = None if tag in missing else _RAW_END[tag].search(page, at)
                if close:
                    gt = page.find(">", close.end())
                    at = gt + 1 if gt >= 0 else size
                elif tag in ("script", "style"):
                    at = size
                else:
                    missing.add(tag)
            if tag in BLOCK_TAGS:
                yield "", "hr", "", False
            continue
        yield "", tag, attributes, follow == "/"


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond any character give U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_NUMBER.sub("�", text)
    return html.unescape(text)


def tree_of(page: str | None) -> _Tree:
    """The text blocks of a page in order, and its block-level elements. Form controls and the head give no text."""
    out = _Tree()
    if not page:
        return out
    pieces: list[str] = []
    linked = 0
    stack: list[tuple[str, int]] = []  # open elements: tag, and the number of the innermost block-level element
    places: dict[str, list[int]] = {}  # of the open elements of a tag, in the stack
    blocks_at, scopes_at = [-1], [-1]
    dropped = links = headings = 0
    lowest = 0  # depth of the highest element passed since the last block

    def cut(size: int) -> None:
        nonlocal dropped, links, headings, lowest
        while len(stack) > size:
            tag, _ = stack.pop()
            places[tag].pop()
            dropped -= tag in DROPPED_TAGS
            links -= tag == "a"
            headings -= tag in _HEADINGS
            if blocks_at[-1] == len(stack):
                blocks_at.pop()
                lowest = min(lowest, out.elements[stack[-1][1] if stack else 0].depth)
            if scopes_at[-1] == len(stack):
                scopes_at.pop()

    def flush() -> None:
        nonlocal linked, lowest
        text = " ".join("".join(pieces).split()) if pieces else ""
        pieces.clear()
        if text:
            own = stack[-1][1] if stack else 0
            depth = out.elements[own].depth
            apart = out.elements[out.blocks[-1].element].depth + depth - 2 * min(lowest, depth) if out.blocks else 0
            out.blocks.append(Block(text, own, min(linked, len(text)), headings > 0, apart))
            lowest = depth
        linked = 0

    for text, tag, attributes, closes in markup(page):
        if not tag:
            if not dropped:
                text = decoded(text)
                pieces.append(text)
                if links:
                    linked += len(text.strip())
            continue
        block = tag in BLOCK_TAGS or "-" in tag
        if block:
            flush()
        if closes:
            at = places[tag][-1] if places.get(tag) else -1
            if at >= 0 and (block or at > blocks_at[-1]):
                cut(at)
            continue
        if tag in VOID_TAGS:
            if tag == "br":
                pieces.append(" ")
            continue
        shut = CLOSES.get(tag, ()) + (("p",) if block and tag != "p" else ())
        at = max((places[t][-1] for t in shut if places.get(t)), default=-1)
        if at > scopes_at[-1]:
            cut(at)
        if tag == "body" and places.get("head"):
            cut(places["head"][-1])
        holder = stack[-1][1] if stack else 0
        if block:
            blocks_at.append(len(stack))
            out.elements.append(_element(tag, attributes, holder, out.elements[holder].depth + 1))
            holder = len(out.elements) - 1
        if tag in SCOPE_TAGS:
            scopes_at.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, holder))
        dropped += tag in DROPPED_TAGS
        links += tag == "a"
        headings += tag in _HEADINGS
    flush()
    _tell(out)
    return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _element(tag: str, attributes: str, parent: int, depth: int) -> Element:
    """A block-level element and what its tag, role and names tell by themselves."""
    own = Element(parent, depth, tag, tag)
    own.main = tag in ("main", "article", "h1")
    if tag in ("main", "article"):
        own.content = CONTENT
    elif tag in STRONG_TAGS:
        own.strong = STRONG
    elif tag == "form":
        own.weak = WEAK
    names = [tag] if "-" in tag else []
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what == "role":
                role = value.strip().lower()
                if role in ("main", "article"):
                    own.content, own.main = CONTENT, True
                elif _ROLES.get(role, 0) == STRONG:
                    own.strong = STRONG
                elif role in _ROLES:
                    own.weak = WEAK
            elif what == "itemprop":
                if value.strip().lower() == "articlebody":
                    own.content, own.main = CONTENT, True
            else:
                names += value.split()
                own.kind = f"{own.kind} {value}" if what == "class" else own.kind
    if tag not in ("html", "body", "main"):
        for name in names:
            kind = _name(name)
            if kind == "content":
                own.content = CONTENT
            elif kind == "comments":
                own.comments = STRONG
            elif kind == "strong" and tag != "article":
                own.strong = STRONG
            elif kind == "weak" and tag != "article":
                own.weak = WEAK
    return own


def _name(name: str) -> str:
    """What one class or id tells: content, comments, strong or weak boilerplate, or nothing."""
    if _STATE.match(name):
        return ""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    if not COMMENT_WORDS.isdisjoint(words):
        return "comments"
    if not STRONG_WORDS.isdisjoint(words):
        return "strong"
    told = not CONTENT_WORDS.isdisjoint(words) or (len(words) > 1 and words[0] == "main" and words[1] in BODY_WORDS) or words == ["content"]
    if told:
        rest = WEAK_WORDS.intersection(words) - {"header"}  # an article's header is the article's
        return "weak" if rest else "content"
    return "weak" if not WEAK_WORDS.isdisjoint(words) else ""


def _tell(tree: _Tree) -> None:
    """Give each block the sum of what its ancestors tell, weighed by how much of the text outside links they hold."""
    elements = tree.elements
    total = 0
    for b in tree.blocks:
        elements[b.element].prose += len(b.text) - b.linked
        total += len(b.text) - b.linked
    for e in reversed(elements[1:]):
        elements[e.parent].prose += e.prose
        elements[e.parent].main |= e.main
    against, towards = [0.0] * len(elements), [0.0] * len(elements)
    low, high = MOST_PROSE
    for i, e in enumerate(elements):
        if i:
            share = e.prose / total if total else 0.0
            fade = 1.0 if share <= low else max(0.0, (high - share) / (high - low))
            inside = towards[e.parent] > 0
            weak = 0.0 if e.main and share > 0.3 else e.weak * fade
            own = max(weak, e.strong if e.tag in STRONG_TAGS else e.strong * fade, e.comments if share < 0.97 else 0.0)
            if e.tag == "header" and not inside and not e.content:
                own = max(own, STRONG * fade)
            against[i] = max(against[e.parent], own)
            towards[i] = max(towards[e.parent], e.content)
    for b in tree.blocks:
        b.cue = towards[b.element] - against[b.element]


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order, with what their ancestors tell."""
    return tree_of(page).blocks


def features(blocks: list[Block]) -> np.ndarray:
    """Shape of each block: one, log length, link share (less for sentences and headings), sentence marks, heading, neighbours' lengths and links, place."""
    n = len(blocks)
    out = np.zeros((n, 9))
    for i, b in enumerate(blocks):
        length = len(b.text)
        marks = min(1.0, sum(map(b.text.count, ".,;!?")) / 5)
        out[i, :5] = 1, math.log1p(length) / 5, min(1.0, b.linked / length) * (1 - max(marks, b.heading) / 2), marks, b.heading
    out[1:, 5], out[:-1, 6] = out[:-1, 1], out[1:, 1]
    out[1:, 7] += out[:-1, 2] / 2
    out[:-1, 7] += out[1:, 2] / 2
    if n:
        place = (np.arange(n) + 0.5) / n
        out[:, 8] = 4 * place * (1 - place)
    return out


#: The stated prior of the shape weights.
PRIOR = np.array([-0.1, 1.0, -3.0, 1.0, 0.5, 0.1, 0.1, -0.5, 0.0])


def fit(pages: list[str]) -> np.ndarray:
    """Logistic shape weights from the blocks of pages whose ancestors tell their label; the prior where none do."""
    x, y = [np.zeros((0, 9))], []
    for page in pages:
        blocks = blocks_of(page)
        told = [i for i, b in enumerate(blocks) if b.cue]
        if told:
            x.append(features(blocks)[told])
            y += [blocks[i].cue > 0 for i in told]
    x, y = np.concatenate(x), np.array(y, float)
    w = PRIOR.copy()
    if len(y):
        pull = PULL * len(y)
        for _ in range(30):  # Newton steps, drawn to the prior: the sample's sites are not all sites
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + pull * np.eye(9), x.T @ (y - q) - pull * (w - PRIOR))
    return w


def smoothness(tree: _Tree) -> list[tuple[int, int, float]]:
    """Edges of the graph: neighbours in order, nearer in the tree tied stronger, headings most to what follows, and successive like siblings."""
    edges, last = [], {}
    for i, b in enumerate(tree.blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR * (1 + tree.blocks[i - 1].heading) / (1 + b.apart)))
        e = tree.elements[b.element]
        key = (e.parent, e.kind)
        if key in last:
            edges.append((last[key], i, SIBLING))
        last[key] = i
    return edges


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut.

    lean is the source capacity less the sink capacity of each node (what both have in common flows
    straight through). Augmenting flow by blocking flows (Dinic): levels by breadth-first search,
    then depth-first augmentation with current arcs.
    """
    n = len(lean)
    if not n:
        return []
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for a, b, capacity in edges:
        arcs[a].append(len(to)), to.append(b), room.append(capacity)
        arcs[b].append(len(to)), to.append(a), room.append(capacity)
    give, want = [max(x, 0.0) for x in lean], [max(-x, 0.0) for x in lean]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if give[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or want[i] > tiny
            for e in arcs[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        current = [0] * n
        for root in range(n):
            while give[root] > tiny:
                path, i = [], root
                while want[i] <= tiny:
                    while current[i] < len(arcs[i]):
                        e = arcs[i][current[i]]
                        if room[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        current[i] += 1
                    else:
                        if not path:
                            break
                        i = to[path.pop() ^ 1]
                        current[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if want[i] <= tiny:
                    break
                flow = min(give[root], want[i], *(room[e] for e in path)) if path else min(give[root], want[i])
                give[root] -= flow
                want[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The blocks labelled content, joined by single spaces."""
    tree = tree_of(page)
    kept = minimum_cut(leans(tree, weights), smoothness(tree))
    return " ".join(b.text for b, k in zip(tree.blocks, kept, strict=True) if k)


def leans(tree: _Tree, weights: np.ndarray) -> list[float]:
    """Source less sink capacity of every block: its shape's log-odds, held to SHAPE, and its ancestors' costs."""
    shape = np.clip(features(tree.blocks) @ weights, -SHAPE, SHAPE)
    return [float(s) + b.cue for s, b in zip(shape, tree.blocks, strict=True)]


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Fit on about `sample` pages of up to SAMPLE_CHARS characters, chosen by hash of page_id."""
    total = pages.count()
    wide = 1 << 30
    rows = pages.select(F.xxhash64("page_id", "html").alias("h"), F.xxhash64("page_id").alias("id"), F.col("html").cast("string"))
    chosen = rows.where((F.pmod("id", F.lit(wide)) < min(wide, sample * wide // max(1, total))) & (F.length("html") <= SAMPLE_CHARS))
    return fit(sorted(r.html for r in chosen.orderBy("h", "html").limit(2 * sample).collect()))


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null, empty and textless pages have an empty text. Pages of any length and any malformed markup
    are read whole, in linear time (see `markup`). Repeated rows stay, and ties don't arise; other
    columns are ignored. An empty table gives an empty result.
    """
    weights = train(pages) if weights is None else weights

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return mapped(rows, run, "page_id long, url string, text string, n_chars long")
