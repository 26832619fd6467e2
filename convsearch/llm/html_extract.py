"""Main text of web pages by minimum cut.

Method: a page is cut into blocks of text. A linear classifier gives each block
a cost for being content and one for being boilerplate; they are the capacities
of its edges from the source and to the sink. Neighbouring blocks, and blocks
of one parent, are tied by edges that weigh more the more of the DOM path they
share. The maximum flow's minimum cut is the labelling of least total cost:
short lines within an article stay, long ones within a menu go.

The classifier is fitted on at most ``sample`` pages (the smallest hashes of
their id). Its labels come from the pages that say so themselves: blocks within
``article`` or ``main`` against those in navigation, headers, footers, asides,
forms and containers named as such; it sees the text and its surroundings, not
those containers. Where a page does say so, a bounded cost is added, less than
the classifier's greatest, so that clear text evidence and ties outweigh it.

Never content: scripts, styles, other raw elements, comments and the head.

Defined cases: null or empty html has an empty text; broken and truncated tags
end with the page, a ``<`` without a name is text; equal pages have equal texts;
very long pages keep all their blocks; an empty table gives no rows; extra
columns are ignored."""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import Linear, fit_linear

SAMPLE, SAID, TIE = 2000, 6.0, 1.0
# fixed values: element names of HTML
RAW = frozenset("script style noscript template iframe textarea title select button".split())
# of these, those that are ordinary elements to HTML: without an end tag their text stays
ORDINARY = frozenset("select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var svg math object".split())
CONTENT = frozenset("article main".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
# fixed values: words in class, id and role that name furniture
NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget".split())
# an attribute is a name, and after = a quoted or unquoted value; a quote elsewhere is a character like others,
# and a quoted value without an end stops at white space or the end of the tag
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]++"
_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)"
    rf"((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE})?+)?+|=)*+)(?:>|\Z))", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\s\xa0]+")


@dataclass
class Block:
    """A run of text without block elements: its place in the DOM and counts."""
    path: tuple[int, ...]
    tag: str
    said: int
    text: str
    linked: int = 0
    parts: list = field(default_factory=list, repr=False)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. ``said`` is 1 in an article, -1 in furniture,
    0 elsewhere. Furniture elements stay furniture for all descendants; in a form
    or a container of a furniture class, an article or main that is not named so
    itself counts as an article again."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, number, said (-2: furniture for good)
    parts, linked, serial, at, size = [], 0, 0, 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                outer = [s for s in stack if s[0] not in INLINE]
                out.append(Block(tuple(s[1] for s in outer), outer[-1][0] if outer else "", max(stack[-1][2], -1) if stack else 0, text, min(linked, len(text))))
            parts, linked = [], 0

    def close(upto: int):
        if any(s[0] not in INLINE for s in stack[upto:]):
            flush()
        del stack[upto:]

    while at < size:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if any(s[0] == "a" for s in stack):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name in VOID:
            if name in ("br", "hr"):
                parts.append(" ")
            continue
        if name in RAW or name == "head":
            if name == "head":
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (end.end() if end[0][1] == "/" else end.start()) if end else at
            elif not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else at if name in ORDINARY else size
            if name not in ("script", "style", "template", "noscript"):
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"p", name} if name in ("li", "td", "th", "tr", "dt", "dd") else {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        said = stack[-1][2] if stack else 0
        if said > -2:
            named = bool(m[3]) and any(not NAMES.isdisjoint("".join(v).lower().split()) for v in _NAMED.findall(m[3]))
            if name in FURNITURE and name != "form" and not (name == "header" and said > 0):
                said = -2
            elif name in CONTENT:
                said = said if said < 0 and named else 1
            elif name == "form" or named and name not in ("body", "html"):
                said = -1
        serial += 1
        stack.append((name, serial, said))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: text and surroundings."""
    x = np.zeros((len(found), 10), np.float32)
    for k, b in enumerate(found):
        n, words = len(b.text), b.text.count(" ") + 1
        x[k] = (np.log1p(n) / 5, np.log1p(words) / 4, b.linked / n, sum(map(b.text.count, ".,;:!?")) / words,
                n / words / 10, b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "td", "th", "dt", "dd"),
                b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), len(b.path) / 10, any(c in b.text for c in "©|»›·"))
    return x


def shared_path(a: Block, b: Block) -> float:
    """The share of the DOM path that two blocks have in common."""
    same = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        same += 1
    return same / max(len(a.path), len(b.path), 1)


def minimum_cut(cost: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a node that is not labelled content pays
    ``cost`` (if positive), one that is pays its negative; a tie is paid when
    its ends differ. Maximum flow along shortest augmenting paths in levels."""
    n = len(cost)
    s, t = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to, left = [], []

    def edge(a, b, forth, back):
        near[a].append(len(to))
        to.append(b)
        left.append(forth)
        near[b].append(len(to))
        to.append(a)
        left.append(back)

    for k, c in enumerate(cost):
        edge(s, k, c, 0.0) if c > 0 else edge(k, t, -c, 0.0)
    for a, b, w in ties:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                least = min(left[e] for e in path)
                for e in path:
                    left[e] -= least
                    left[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if left[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while turn[a] < len(near[a]):
                e = near[a][turn[a]]
                if left[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(near[a]):
                path.append(near[a][turn[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                a = to[path.pop() ^ 1]
                turn[a] += 1


def main_text(page: str | None, model: Linear, said: float = SAID, tie: float = TIE) -> str:
    """The content blocks of ``page``, joined by one space."""
    found = blocks(page or "")
    if not found:
        return ""
    p = np.clip(model.predict(features(found)), 1e-3, 1 - 1e-3)
    cost = (np.log(p / (1 - p)) + said * np.array([b.said for b in found])).tolist()
    ties = [(k, k + 1, tie * shared_path(a, b)) for k, (a, b) in enumerate(zip(found, found[1:]))]
    last: dict[tuple[int, ...], int] = {}
    for k, b in enumerate(found):
        if (before := last.get(b.path[:-1], k)) < k - 1:
            ties.append((before, k, tie * 0.5))
        last[b.path[:-1]] = k
    return " ".join(b.text for b, keep in zip(found, minimum_cut(cost, [x for x in ties if x[2] > 0])) if keep)


def fit(pages: DataFrame, sample: int = SAMPLE, rows_per_page: int = 100) -> Linear:
    """The block classifier, from at most ``sample`` pages, and of the features
    of their blocks the first ``sample * rows_per_page`` in the order of a hash."""
    own = pages.filter("page_id is not null and html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(0):
                found = [b for b in blocks(text.as_py() or "")]
                for b, x in zip(found, features(found).tolist()):
                    if b.said:
                        rows.append((b.said > 0, *x))
            # a page's share of the sample is bounded by its distinct rows
            rows = sorted(set(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([list(r[1:]) for r in rows], pa.list_(pa.float64()))], names=["content", "x"])

    # at most ``sample`` ids
    data = pages.join(F.broadcast(own), "page_id", "left_semi").select("html").mapInArrow(run, "content boolean, x array<double>").orderBy(F.xxhash64("content", "x"), "content", "x").limit(rows_per_page * sample).collect()
    x = np.array([r["x"] for r in data], np.float32).reshape(-1, 10)
    model = fit_linear(x, np.array([r["content"] for r in data], np.float32))
    return model if model.weights is not None else Linear(np.array([2, 2, -4, 2, 0, 1, -1, 0, 0, -1], np.float32), -2.5)


def extract(pages: DataFrame, model: Linear) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(t.as_py(), model) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
