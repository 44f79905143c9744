"""Operator 3: main text of HTML pages by minimum-cut labelling.

A page becomes blocks of text in page order. A linear classifier over a block's ancestors, links and length gives the cost
of calling it content or boilerplate; the two costs are its capacities to the terminals. Neighbours in page order, and
neighbours under one parent element, are joined by smoothness edges. The minimum cut (maximum flow) separates content.

Costs and edges have one scale: what a single element's name or class says (at most 4) can be outweighed by the block's
length (up to 2.4), its links (4) and its neighbours (up to 3.4), so a paragraph between others of one article stays whatever
its class, and a box of its own goes. Only what a browser doesn't show is out of question.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|video|audio|textarea|select|title|xmp|noframes)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = {"nav": -4, "menu": -4, "footer": -4, "aside": -4, "form": -4, "dialog": -4, "button": -4, "label": -3, "fieldset": -3, "article": 2, "main": 2, "head": -20}
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLASS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox banner sponsor sponsored promo promotion promoted menu nav navbar navigation"
    " breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup"
    " modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments reply replies"
    " disqus respond discussion widget pagination pager copyright legal disclaimer skip hidden paywall form".split()
)
_WRAPPER = frozenset("with has without no".split())
_CONTENT = frozenset("article content main post entry story body text".split())
#: Log odds: of an element whose class or role names boilerplate, or content; of one that isn't shown; of a block of no words
#: outside everything, for each doubling of its words up to 64, and of standing wholly in links.
NAMED, CONTENT, HIDDEN, BASE, DOUBLING, LINKED = -4.0, 1.0, -20.0, -0.3, 0.45, -4.0
#: Capacities between neighbours in page order, and under one parent.
ADJACENT, SIBLING = 0.7, 1.0


class _Open:
    __slots__ = ("article", "id", "prior", "tag")

    def __init__(self, tag: str, prior: float, article: bool, number: int) -> None:
        self.tag, self.prior, self.article, self.id = tag, prior, article, number


def _prior(tag: str, attrs: str, article: bool) -> float:
    """What an element says about the text under it, as log odds of content; article: whether it stands in one."""
    w = _TAG.get(tag, 0)
    if tag == "header":
        w = 0 if article else _TAG["nav"]
    if not attrs.strip(" /") or tag in ("html", "body"):
        return w
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
    names = set(re.split(r"[\s_-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if names & _CLASS and not names & _WRAPPER and not (tag == "article" or tag[0] == "h" and tag[1:].isdigit()):
        w = min(w, NAMED)
    elif names & _CONTENT and w >= 0:
        w += CONTENT
    if found.get("role", "").lower() in _ROLE:
        w = min(w, NAMED)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        w = HIDDEN
    return w


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, score, parent) of the page's blocks in order; score is the log odds of being content, by the classifier."""
    out: list[tuple[str, float, int]] = []
    stack = [_Open("", 0.0, False, 0)]
    parts: list[str] = []
    linked = 0  # characters of the block that stand in links
    links, number = 0, 0  # links: the depth at which an open link stands

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            n = text.count(" ") + 1
            score = top.prior + BASE + DOUBLING * min(6.0, math.log2(1 + n)) + LINKED * min(1.0, linked / len(text))
            own = top.id
            if top.tag in ("p", "li", "td", "dd", "dt", "b", "h1", "h2", "h3", "h4", "h5", "h6", "pre") and len(stack) > 1:
                own = stack[-2].id
                score += 0.5 * (top.tag[0] == "h")
            out.append((text, score, own))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    for m in _MARKUP.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if m["close"] else len(stack)
            continue
        if tag in _BLOCKS:
            flush()
        elif tag not in _TAG and tag != "span":
            continue  # other inline elements change nothing
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in _BLOCKS:
                        flush()
                    del stack[i:]
                    break
            links = links if links <= len(stack) else 0  # a link that isn't closed ends with its block
            continue
        if tag == "p" or tag in _BLOCKS and stack[-1].tag == "p":
            while stack[-1].tag == "p":
                stack.pop()
        elif tag == "li" and stack[-1].tag == "li" or tag in ("td", "th", "tr") and stack[-1].tag in ("td", "th") or tag in ("dd", "dt") and stack[-1].tag in ("dd", "dt"):
            stack.pop()
        links = links if links <= len(stack) else 0
        if tag in _VOID or m["attrs"].endswith("/") and tag not in _BLOCKS:
            continue
        top = stack[-1]
        prior = _prior(tag, m["attrs"], top.article)
        if tag == "span" and prior >= 0:
            continue
        if prior < 0 and tag not in _BLOCKS:
            flush()
        number += 1
        # Boilerplate within content is boilerplate, and content within boilerplate isn't content.
        within = min(top.prior, 0) + prior if prior < 0 else top.prior if top.prior < 0 else max(top.prior, prior)
        stack.append(_Open(tag, within, top.article or tag in ("article", "main"), number))
    say(page[at:])
    flush()
    return out


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the content side of a minimum cut.

    A node whose own capacity exceeds all its edges is on its own side in every minimum cut, so it is fixed and its edges
    become capacities of its neighbours; maximum flow (breadth-first augmenting paths) settles what is left.
    """
    n = len(scores)
    score = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(score[i]) > sum(near[i].values()):
            side[i] = score[i] > 0
            for j, w in near[i].items():
                score[j] += w if side[i] else -w
                del near[j][i]
                if side[j] is None:
                    todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {source: {}, sink: {}}
        for i in left:
            if score[i] > 0:
                room[source][i], room[i][source] = score[i], 0.0
            elif score[i] < 0:
                room[i][sink], room[sink][i] = -score[i], 0.0
        while True:
            came = {source: source}
            queue = deque([source])
            while queue and sink not in came:
                a = queue.popleft()
                for b, w in room[a].items():
                    if w > 1e-12 and b not in came:
                        came[b] = a
                        queue.append(b)
            if sink not in came:
                break
            path, b = [], sink
            while b != source:
                path.append((came[b], b))
                b = came[b]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
        for i in left:
            side[i] = i in came
    return [bool(x) for x in side]


def labelled(found: list[tuple[str, float, int]]) -> list[bool]:
    """Which of the blocks (text, score, parent) are content."""
    edges: dict[tuple[int, int], float] = {(i, i + 1): ADJACENT for i in range(len(found) - 1)}
    last: dict[int, int] = {}
    for i, (_, _, parent) in enumerate(found):
        if parent in last:
            pair = (last[parent], i)
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        last[parent] = i
    return minimum_cut([s for _, s, _ in found], edges)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(text for (text, _, _), keep in zip(found, labelled(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null or empty html gives an empty text. Cut-off tags, comments and scripts end with the page; character references
    without a semicolon are decoded as browsers do. A page without any structure is all main text. Repeated rows give
    repeated rows; a null page_id is kept; an empty table gives none; other columns are ignored. Very long pages are taken
    whole, in time by their blocks and what the cut has left to settle.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
