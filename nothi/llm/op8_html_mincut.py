"""Main text of web pages by a minimum cut between content and boilerplate.

The page is cut into blocks of text. A classifier gives each block log-odds of being content; they are the capacities to the two terminals. Edges
between adjacent blocks and between neighbours under one parent make it costly to part what stands together. The minimum cut labels the blocks: a
maximum flow decides them all but for those whose log-odds outweigh their edges, which no minimum cut can label otherwise and which are fixed before.

The log-odds have two parts, both with fixed weights: what the page says of a block's place (elements around it, words in their class, id and role), and what the block looks like (length,
links, sentence ends, wording, its own element). They are priors and not fitted, because on pages of one template a fit learns the template, and a page's text would depend on
the pages beside it. So a page's text depends on the page alone. Looks count for ``MOST_LOOKS`` at most, so a place that is
clear wins; blocks whose place is not are decided by looks and neighbours. ``cut_report`` counts the blocks that the cut labels
against the sign of their log-odds.

Null or empty html gives an empty text. Markup that ends early is read as far as it goes, unclosed elements close with their
parents, and an unclosed script or style ends at the next block element. Very long and very deep pages take time in proportion to their
size. Repeated rows and null ids are kept as they are. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: HTML element names by what they do.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body p div section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset legend address hr details summary menu dialog center hgroup search select button template xmp".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end does not cross.
SCOPE = frozenset("ul ol dl table div section article main body td th blockquote aside nav header footer form".split())
AGAINST = {"nav": 9.0, "footer": 9.0, "aside": 8.0, "header": 8.0, "form": 9.0, "menu": 9.0, "dialog": 9.0, "button": 9.0, "select": 9.0, "template": 9.0, "address": 3.0, "search": 9.0, "head": 20.0}
FOR = {"article": 3.0, "main": 3.0}
#: Words in class, id or role that name boilerplate, and those that may also stand for a part of the article.
_AGAINST = re.compile(
    r"(?:^|[\s_-])(ads?|adverts?|advertis\w*|adsense|adslot|sponsor\w*|cookies?|consent|gdpr|newsletter|subscri\w*|signup|sidebar|sidenav|rail|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|login|skip|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
_WEAK = re.compile(r"(?:^|[\s_-])(promo\w*|banner|notices?|alerts?|popup|modal|overlay|social|share\w*|sharing|related|recommend\w*|widgets?|header|repl(?:y|ies)|discussion|search|copyright|disclaimer|dialog|form)(?=$|[\s_-])", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion)(?=$|[\s_-])", re.I)
_FOR = re.compile(r"(?:^|[\s_-])(article|main|content|post|entry|story|body|text|page)(?=$|[\s_-])", re.I)
_WORDING = re.compile(r"cookie|privacy policy|terms of (?:use|service)|all rights reserved|©|copyright|subscribe|newsletter|advertis|sponsored|sign (?:up|in)|log ?in|share (?:this|on)|follow us|skip to|read more|leave a (?:comment|reply)", re.I)
BY_CLASS, BY_WEAK_CLASS, MOST_LOOKS = 8.0, 4.0, 4.0
ADJACENT, NEAR, APART, SIBLING = 2.5, 1.5, 0.3, 1.0
_UNCLOSED = re.compile(r"</?(?:p|div|article|section|main|body|html|h[1-6]|ul|ol|table|footer|nav|aside|header)\b", re.I)


class Element:
    __slots__ = ("name", "parent", "against", "for_", "by_class", "comment", "hidden", "heading", "inside", "best", "worst", "own")

    def __init__(self, name: str, parent: "Element | None", attributes: str = ""):
        self.name, self.parent, self.heading = name, parent, False
        self.against, self.for_, self.by_class, self.comment, self.hidden = AGAINST.get(name, 0.0), FOR.get(name, 0.0), 0.0, False, False
        self.best = self.worst = self.own = None
        self.inside = parent is not None and (parent.inside or parent.name in FOR)
        if attributes and name not in ("html", "body"):
            found = _ATTRIBUTE.findall(attributes)
            said = " ".join(a or b or c for _, a, b, c in found)
            self.hidden = any(k.lower() == "hidden" and not (a or b or c) for k, a, b, c in found)
            if said:
                self.by_class, self.comment = BY_CLASS if _AGAINST.search(said) else BY_WEAK_CLASS if _WEAK.search(said) else 0.0, bool(_COMMENT.search(said))
                if _FOR.search(said) and not self.by_class:
                    self.for_ = max(self.for_, 2.0)


class Block:
    __slots__ = ("parts", "parent", "linked", "in_link", "text")

    def __init__(self, parent: Element):
        self.parts, self.parent, self.linked, self.in_link, self.text = [], parent, 0, 0, ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    root = Element("html", None)
    stack, out, links, at, opened = [root], [Block(root)], 0, 0, Counter()

    def cut() -> None:
        if out[-1].parts:
            out.append(Block(stack[-1]))
        else:
            out[-1].parent = stack[-1]

    def add(text: str) -> None:
        if text:
            out[-1].parts.append(text)
            if links:
                out[-1].linked += len(text.split())

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(e.name == "a" for e in stack[i:])
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]
        cut()

    n, endless = len(page), set()
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if opened[name] <= 0:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if name in BLOCK:
                        pop_to(i)
                    else:
                        links -= name == "a"
                        opened[name] -= 1
                        del stack[i]
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
            continue
        if name in RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at) if name not in endless else None
                if end is None:
                    endless.add(name)
                    end = _UNCLOSED.search(page, at)
                    at = end.start() if end else n
                else:
                    at = end.end()
            add(" ")
            continue
        if name in VOID:
            if name in ("br", "hr", "img"):
                add(" ")
            if name == "hr":
                cut()
            continue
        if name in BLOCK:
            if name != "html" or len(stack) > 1:
                ends = {"p", "select"} | CLOSES.get(name, set())
                for i in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
                    if stack[i].name in ends:
                        pop_to(i)
                        break
                    if stack[i].name in SCOPE:
                        break
            e = Element(name, stack[-1], m.group(3))
            stack.append(e)
            opened[name] += 1
            if name == "body":
                stack[:] = [root, e]
                opened.clear()
                opened[name] = 1
            if name in ("h1", "article", "main"):
                up = e.parent
                while up is not None and not up.heading:
                    up.heading = True
                    up = up.parent
            cut()
        else:
            links += name == "a"
            opened[name] += 1
            stack.append(Element(name, stack[-1], m.group(3)))
    found = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            found.append(b)
    return found


def placed(e: Element) -> Element:
    """Fills in best and worst of what the elements down to this one say, and the nearest block element's name."""
    path = []
    while e is not None and e.best is None:
        path.append(e)
        e = e.parent
    best, worst = (e.best, e.worst) if e is not None else (0.0, 0.0)
    for e in reversed(path):
        against = e.against
        # A heading or the article itself inside shows that the class of a wrapper, or an article's own header, isn't meant.
        if e.by_class and (e.comment or not e.heading):
            against = max(against, e.by_class)
        if e.heading and (e.name == "form" or e.name == "header" and e.inside):
            against = 0.0
        best, worst = max(best, e.for_), max(worst, against, 20.0 if e.hidden else 0.0)
        e.best, e.worst = best, worst
        e.own = e.name if e.name in BLOCK or e.parent is None else e.parent.own
    return path[0] if path else e


def place(b: Block) -> float:
    """Log-odds by the elements around a block."""
    e = b.parent if b.parent.best is not None else placed(b.parent)
    return e.best - e.worst


def looks(b: Block) -> list[float]:
    """What the block looks like; the first is the constant."""
    words = b.text.split()
    n, own = len(words), b.parent.own
    return [
        1.0,
        min(5.0, math.log2(1 + n / 4)),
        min(1.0, b.linked / n),
        float(b.text[-1] in ".!?…\"'”"),
        float(n < 60 and _WORDING.search(b.text) is not None),
        float(own == "p"),
        float(own in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(own == "li"),
    ]


#: Weights of the looks.
LOOKS = (-1.0, 0.9, -4.0, 0.7, -2.5, 1.0, 1.2, -0.5)


def log_odds(b: Block, weights=LOOKS) -> float:
    """How much likelier content is than boilerplate; positive: content."""
    at = place(b)
    return at + max(-MOST_LOOKS, min(MOST_LOOKS, sum(w * x for w, x in zip(weights, looks(b)))))


def together(a: Element, b: Element) -> bool:
    """Whether two elements have the same parent, or one within three steps that is less than the page."""
    if a.parent is b.parent:
        return True
    up = []
    for _ in range(3):
        if a is None or a.name in ("body", "html"):
            break
        up.append(a)
        a = a.parent
    for _ in range(3):
        if b is None or b.name in ("body", "html"):
            break
        if any(b is x for x in up):
            return True
        b = b.parent
    return False


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            edges.append((i - 1, i, ADJACENT if a.parent is b.parent else NEAR if together(a.parent, b.parent) else APART))
        key = id(b.parent.parent)
        if key in last and last[key] != i - 1:
            edges.append((last[key], i, SIBLING))
        last[key] = i
    return edges



def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a block is content in a minimum cut."""
    n, near = len(odds), [[] for _ in odds]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    odds, label, look = list(odds), [None] * n, deque(range(n))
    while look:
        i = look.popleft()
        if label[i] is None and abs(odds[i]) >= sum(w for j, w in near[i] if label[j] is None):
            label[i] = odds[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    odds[j] += w if label[i] else -w
                    look.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        source, sink = len(rest), len(rest) + 1
        room = [{} for _ in range(len(rest) + 2)]
        for i in rest:
            k = number[i]
            if odds[i] > 0:
                room[source][k], room[k][source] = odds[i], 0.0
            else:
                room[k][sink], room[sink][k] = -odds[i], 0.0
            for j, w in near[i]:
                if label[j] is None:
                    room[k][number[j]] = room[k].get(number[j], 0.0) + w
        reached = max_flow(room, source, sink)
        for i in rest:
            label[i] = number[i] in reached
    return label


def max_flow(room: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """Dinic's algorithm on residual capacities; returns what the source still reaches."""
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        ahead = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                # Back to the first edge that is full now; its end may be tried again from elsewhere.
                full = next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12)
                path = path[: full + 1]
                continue
            step = next((j for j in ahead[i] if room[i].get(j, 0.0) > 1e-12 and level.get(j) == level[i] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def labelled(page: str | None, weights=LOOKS) -> tuple[list[Block], list[float], list[bool]]:
    """Blocks, their log-odds, and whether the minimum cut has them as content."""
    blocks = blocks_of(page or "")
    odds = [log_odds(b, weights) for b in blocks]
    return blocks, odds, minimum_cut(odds, edges_of(blocks))


def main_text(page: str | None, weights=LOOKS) -> str:
    blocks, _, label = labelled(page, weights)
    return " ".join(b.text for b, content in zip(blocks, label) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    common.small_batches(pages.sparkSession)
    return common.pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def cut_report(pages: DataFrame) -> DataFrame:
    """One row: blocks, doubtful (those that some edge could outweigh), flipped (those that the cut labels against the sign of their log-odds)."""
    schema = pa.schema([(n, pa.int64()) for n in ("blocks", "doubtful", "flipped")])

    def run(batches):
        total = np.zeros(3, np.int64)
        for b in batches:
            for page in b.column(0).to_pylist():
                blocks, odds, label = labelled(page)
                room = np.zeros(len(blocks))
                for i, j, w in edges_of(blocks):
                    room[i] += w
                    room[j] += w
                total += [len(blocks), int((np.abs(odds) < room).sum()), sum((o > 0) != x for o, x in zip(odds, label))]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], schema=schema)

    return common.pick(pages, html="string").mapInArrow(run, "blocks long, doubtful long, flipped long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blocks", "doubtful", "flipped")])


def op8_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
