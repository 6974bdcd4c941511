"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block a log-odds of being content: the
shape of its text, with weights fitted on blocks whose containers say what they are, plus the container
itself. Log-odds become terminal capacities of a flow network, neighbours in the page and under one
parent are tied by edges that weaken with their distance in the tree, and the minimum cut parts content
from boilerplate.
"""
from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import in_batches, sampled

#: Pages the classifier is fitted on, about; log-odds of a block for its container, most log-odds for the
#: shape of its text; weights of the edges to the next block and to the next one under the same parent.
SAMPLE, CONTAINER, SHAPE, NEXT, SIBLING = 2000, 5.0, 3.0, 1.0, 1.0
#: Log-odds against a block whose container is boilerplate by class or id only, on pages with content by
#: container, and on pages without, where such a word may well name the layout of the whole page.
NAMED, NAMED_ALONE = 3.5, 2.0

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
                  "tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page, and those of them whose content is not markup.
SKIP = frozenset("script style template noscript iframe noembed noframes object svg math canvas audio video select textarea button head title".split())
RAW = frozenset("script style iframe noembed noframes textarea title noscript".split())
#: A start tag on the left ends an open element on the right.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          **dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot"))}
#: Elements whose end tag may be left out, and those that leave the head open.
OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot caption colgroup option optgroup head body html".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Containers by tag, role, and words of class and id.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
BOILER_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
                         "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo "
                         "recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
#: Of these, what holds articles that are not the page's own; and words after which others only say what is there or not.
LIST_WORDS = frozenset("comment comments disqus promo recommended related respond sponsor sponsored".split())
QUALIFIERS = frozenset("has have no not with without".split())
CONTENT_WORDS = frozenset("article articlebody content entry main maincontent post posting story".split())

#: A start tag closes an open element within the nearest of these only.
SCOPE = frozenset("ul ol dl table tbody thead tfoot".split()) | SKIP

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+|[^>]*+)>|<[/a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\bhidden\b""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: What a container makes of its blocks: content, boilerplate by tag or role, boilerplate by class or id, and
#: by one that names articles other than the page's own.
CONTENT, BOILER, BY_CLASS, BY_LIST = 1, -1, -2, -3
#: In the place of a container: the element is left out with all it holds.
OUT = -9


def _words(named: dict[str, str]) -> set[str]:
    """Words of class and id without those that a has-, no- or with- goes before."""
    found = set()
    for name in f"{named.get('class', '')} {named.get('id', '')}".split():
        for word in _WORD.findall(name):
            if word.lower() in QUALIFIERS:
                break
            found.add(word.lower())
    return found


def _container(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    """What an element makes of the blocks in it, else as around it; and whether it is hidden."""
    named = {}
    hidden = False
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1]:
                named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            else:
                hidden = True
    hidden |= named.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")))
    if inside == BOILER:
        return inside, hidden  # nothing in boilerplate is content again
    words = set() if tag in ("html", "body") else _words(named)
    role = named.get("role", "").lower()
    by_class = BY_LIST if words & LIST_WORDS else BY_CLASS if words & BOILER_WORDS else 0
    if tag == "header" and inside > 0:
        return (BY_CLASS if words & (BOILER_WORDS - {"header"}) else inside), hidden
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return BOILER, hidden
    if tag in CONTENT_TAGS or role in ("main", "article"):
        own = tag == "main" or role == "main" or inside >= 0 or inside == BY_CLASS and not by_class
        return (CONTENT if own else inside), hidden
    if by_class and not words & CONTENT_WORDS:
        return min(inside, by_class), hidden
    return (CONTENT if words & CONTENT_WORDS and inside >= 0 else inside), hidden


class Block:
    __slots__ = ("text", "tag", "container", "parent", "step", "linked")

    def __init__(self, text, tag, container, parent, step, linked):
        self.text, self.tag, self.container, self.parent, self.step, self.linked = text, tag, container, parent, step, linked


class Open:
    """The stack of open elements (tag, container, number), with the places of each tag, of blocks, of elements
    without text and of scopes, so that the innermost open one is known without a walk."""

    def __init__(self):
        self.stack = [("", 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.skips, self.scopes = [0], [0], [0]

    def _lists(self, tag):
        yield self.places.setdefault(tag, [])
        for tags, places in ((BLOCK, self.blocks), (SKIP, self.skips), (SCOPE, self.scopes)):
            if tag in tags:
                yield places

    def push(self, tag, container, number):
        for places in self._lists(tag):
            places.append(len(self.stack))
        self.stack.append((tag, container, number))

    def pop(self):
        tag = self.stack.pop()[0]
        for places in self._lists(tag):
            places.pop()
        return tag

    def last(self, *tags):
        """Place of the innermost open element with one of the tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. step: edges of the tree between a block and the one before it;
    linked: characters inside links. Unclosed and stray tags are mended as browsers do. The time is linear in the page."""
    found: list[Block] = []
    tree = Open()
    stack = tree.stack
    count, depth_seen, depth_low, links = 1, 0, 0, 0
    words: list[str] = []
    linked = 0
    at, end = 0, len(page)
    out, loose = 0, False  # place in the stack of an element that is left out; whether it has no end tag
    ended: set[int] | None = None

    def flush():
        nonlocal words, linked, depth_seen, depth_low
        text = " ".join("".join(words).split())
        if text:
            place = tree.blocks[-1]
            tag, container, number = stack[place]
            found.append(Block(text, tag, stack[-1][1] if stack[-1][1] < 0 else container, stack[place - 1][2] if place else 0,
                               place + depth_seen - 2 * min(depth_low, place), linked))
            depth_seen = depth_low = place
        words, linked = [], 0

    def pop_to(k):
        nonlocal depth_low, links, out
        out = out if k > out else 0
        while len(stack) > k:
            links -= tree.pop() == "a"
        depth_low = min(depth_low, len(stack) - 1)

    def close(k, block):
        """End the k-th open element, if k is not 0; visible words so far are a block if `block`."""
        if 0 < k <= out:
            pop_to(out)
        if block and not out:
            flush()
        if 0 < k < len(stack):
            pop_to(k)

    while at < end:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else end]
        if out and stack[-1][0] == "head" and text.strip():
            pop_to(out)  # text ends the head
        if text and not out:
            words.append(html.unescape(text))
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = tree.last(tag)
            if k < out and stack[out][0] in SKIP and tag not in BLOCK and tag not in ("td", "th"):
                continue  # a stray end tag of text
            close(k, tag in BLOCK)
            if tag in ("td", "th") and not out:
                words.append(" ")
            continue
        if out:
            top = stack[out][0]
            if (top == "head" and tag not in HEAD or top == tag and tag in ("button", "select") or top == "select" and tag == "input"
                    or loose and tag in BLOCK and tag not in ("option", "optgroup")):
                pop_to(out)
        if tag == "br" and not out:
            words.append(" ")
        if tag in VOID:
            if tag == "hr" and not out:
                flush()
            continue
        if tag in RAW:
            if not (out and m[3].endswith("/") and tree.last("svg", "math") >= out):
                at = _after(page, at, tag)
            if tag in BLOCK and not out:
                flush()
            continue
        if tag in BLOCK:
            k = tree.last("p")
            close(k if k > tree.skips[-1] else 0, True)
        while tag in CLOSES:
            k = tree.last(*CLOSES[tag])
            if not k or k < tree.scopes[-1]:
                break
            name = stack[k][0]
            close(k, tag in BLOCK)
            if tag != "tr" or name == "tr":
                break
        if tag in ("td", "th") and not out:
            words.append(" ")
        if not m[3].endswith("/"):
            # the container around counts anew after an element was closed
            container = OUT
            if not out:
                container, hidden = _container(tag, m[3], stack[-1][1])
                if hidden or tag in SKIP:
                    container, out = OUT, len(stack)
                    if tag not in OPTIONAL and ended is None:
                        ended = _ended(page)
                    loose = tag not in OPTIONAL and m.start() not in ended
            tree.push(tag, container, count)
            links += tag == "a"
            count += 1
    if out:
        pop_to(out)
    flush()
    return found


def _after(page: str, at: int, tag: str) -> int:
    """Where a raw element ends: at its end tag, or the page's end."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


def _ended(page: str) -> set[int]:
    """Where the start tags of elements stand that have an end tag; elements of one name nest."""
    found, still = set(), {}
    for m in _TAG.finditer(page):
        tag = (m[2] or "").lower()
        if tag and not m[1]:
            if not m[3].endswith("/"):
                still.setdefault(tag, []).append(m.start())
        elif still.get(tag):
            found.add(still[tag].pop())
    return found


FEATURES = 8 + 3 + 2 + 4


def shape(block: Block) -> np.ndarray:
    """One-hot features of a block's text: how long, how much of it linked, whether it ends a sentence, its tag."""
    out = np.zeros(FEATURES)
    n = block.text.count(" ") + 1
    out[min(7, n.bit_length() - 1)] = 1
    share = block.linked / max(1, len(block.text))
    out[8 + (0 if share == 0 else 1 if share < 0.5 else 2)] = 1
    out[11 + block.text.endswith((".", "!", "?", ":", ";", '"', "”", "»", "…"))] = 1
    for k, tags in enumerate((("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("tr",))):
        out[13 + k] = block.tag in tags
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the shape features: logistic regression on the blocks of about `sample` pages (chosen by the
    hash of their id) whose containers are known. Spark counts blocks of each feature set, a few
    thousand at most. Without known containers all weights are 0."""
    taken = sampled(in_batches(pages), F.col("page_id"), sample).where("html is not null").select("html")

    @F.pandas_udf("array<string>")
    def labelled(column: pd.Series) -> pd.Series:
        return column.map(lambda page: ["".join("1" if v else "0" for v in shape(b)) + ("+" if b.container > 0 else "-") for b in blocks(page) if b.container])

    rows = taken.select(F.explode(labelled("html")).alias("f")).groupBy("f").count().collect()
    weight = np.zeros(FEATURES)
    if rows:
        x = np.array([[c == "1" for c in r.f[:-1]] for r in rows], dtype=float)
        y = np.array([r.f[-1] == "+" for r in rows], dtype=float)
        n = np.array([r["count"] for r in rows], dtype=float)
        n[y == 1] *= 0.5 / max(1.0, n[y == 1].sum())  # both sides count alike
        n[y == 0] *= 0.5 / max(1.0, n[y == 0].sum())
        for _ in range(60):  # Newton's method with a ridge
            p = 1 / (1 + np.exp(-x @ weight))
            gradient = x.T @ (n * (y - p)) - 1e-3 * weight
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(FEATURES)
            weight += np.linalg.solve(curve, gradient)
    return weight


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: a node with gain g costs g (or -g) on the other
    side, an edge its weight if its ends are parted. A node whose gain outweighs its undecided edges is settled at
    once, which no minimum cut contradicts; the rest is left to augmenting paths. Ties fall to the sink."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    left, side = list(gain), [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is None and abs(left[k]) >= sum(w for j, w in near[k].items() if side[j] is None):
            side[k] = left[k] > 0
            for j, w in near[k].items():
                if side[j] is None:
                    left[j] += w if side[k] else -w
                    queue.append(j)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {k: {j: w for j, w in near[k].items() if side[j] is None} for k in rest}
        room[source], room[sink] = {}, {}
        for k in rest:
            a, b = (source, k) if left[k] > 0 else (k, sink)
            room[a][b] = room[a].get(b, 0) + abs(left[k])
            room[b].setdefault(a, 0.0)
        while True:
            # shortest paths only, all of one length before the next search
            depth, queue = {source: 0}, deque([source])
            while queue:
                k = queue.popleft()
                for j, w in room[k].items():
                    if w > 1e-12 and j not in depth:
                        depth[j] = depth[k] + 1
                        queue.append(j)
            if sink not in depth:
                break
            ahead = {k: [j for j in room[k] if depth.get(j) == d + 1] for k, d in depth.items()}
            path = [source]
            while path:
                k = path[-1]
                if k == sink:
                    push = min(room[a][b] for a, b in zip(path, path[1:]))
                    full = len(path)
                    for at in range(len(path) - 1, 0, -1):
                        a, b = path[at - 1], path[at]
                        room[a][b] -= push
                        room[b][a] += push
                        if room[a][b] <= 1e-12:
                            full = at
                    del path[full:]
                    continue
                while ahead[k] and room[k][ahead[k][-1]] <= 1e-12:
                    ahead[k].pop()
                if ahead[k]:
                    path.append(ahead[k][-1])
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()
        for k in rest:
            side[k] = k in depth
    return side


def main_text(page: str, weight: np.ndarray) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page)
    if not found:
        return ""
    score = np.clip(np.stack([shape(b) for b in found]) @ weight, -SHAPE, SHAPE)
    named = NAMED if any(b.container == CONTENT for b in found) else NAMED_ALONE
    worth = {CONTENT: CONTAINER, 0: 0.0, BOILER: -CONTAINER, BY_CLASS: -named}
    # comments and the like can be taken for the page only if there is nothing else
    worth[BY_LIST] = -NAMED if any(s + worth[b.container] > 0 for s, b in zip(score, found) if b.container != BY_LIST) else -NAMED_ALONE
    gain = [float(s) + worth[b.container] for s, b in zip(score, found)]
    edges = [(k - 1, k, NEXT * 2.0 ** (-b.step / 2)) for k, b in enumerate(found) if k]
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(gain, edges)) if keep)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """pages (page_id, url, html, more), one row per row: page_id, url, text, n_chars (code points).

    The whole html is read; null or empty html, and a page without content, gives an empty text. Character
    references are decoded, white space inside a block is one blank, blocks are joined by one line feed.
    Hidden elements, scripts, styles and form fields have no text. Rows that repeat a page_id are
    extracted each. Other columns are ignored."""
    weight = fit(pages, sample)

    @F.pandas_udf("string")
    def content(column: pd.Series) -> pd.Series:
        return column.map(lambda page: main_text(page or "", weight))

    out = pages.select("page_id", "url", content(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
