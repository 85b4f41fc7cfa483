"""The article of a page without an article element, by scores over its element tree.

The elements of a batch of pages are rows of arrays (parent, depth, weight, text counts), so one
pass scores all pages of the batch:

1. A paragraph is a p, pre, td or blockquote element, or a div with text of its own, of at least
   25 characters of which no more than half are link text. It scores 1, plus 1 for each comma, plus
   1 for each 100 characters up to 3. Its parent gets the whole score, its grandparent half.
2. Elements that received a score are candidates. They start with a bonus for their tag and the
   weight of their class and id words, and end with the share of their text that is no link text.
3. The best candidate wins, the first of equal ones. Siblings join it when they are candidates
   with at least a fifth of its score (and at least 10), or p elements of 80 characters or more
   with less than a quarter of link text.
4. Text inside elements with negative words (menus, comments, promotions) is left out, at first
   also from the scores; if no candidate is left, the words are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from tidemark.operators.markup import BLOCKS, VOID, TextParser, tidy

SCORED = frozenset({"p", "pre", "td", "blockquote"})
# Chosen bonuses and words; a name counts as a whole word of a class or an id.
BONUS = {"article": 10, "main": 10, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "li": -3, "dl": -3, "form": -3, "th": -5}
GOOD = frozenset({"article", "body", "content", "entry", "main", "page", "post", "prose", "story", "text"})
BAD = frozenset({
    "ad", "ads", "advert", "banner", "breadcrumb", "comment", "comments", "cookie", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar",
    "newsletter", "pager", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "subscribe", "toolbar", "widget",
})
WEIGHT = 25
LEAST_TEXT = 25
SIBLING_TEXT = 80
_WORD = re.compile(r"[A-Za-z]+")


class Tree(TextParser):
    """Elements in order of their start tags, and the texts with the element that holds them."""

    def __init__(self) -> None:
        super().__init__()
        self.tags, self.parents, self.weights = ["#page"], [-1], [0]
        self.texts: list[tuple[int, str]] = []
        self._ids: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # A new block ends a paragraph, a new item the last one.
        if tag in BLOCKS and tag != "br" and "p" in self.open:
            self._close("p")
        elif tag == "li" and self.open and self.open[-1] == "li":
            self._close("li")
        super().handle_starttag(tag, attrs)
        if tag not in VOID:
            del self._ids[len(self.open) - 1 :]
            self.parents.append(self._ids[-1] if self._ids else 0)
            self._ids.append(len(self.tags))
            self.tags.append(tag)
            words = {w.lower() for name, value in attrs if name in ("class", "id") and value for w in _WORD.findall(value)}
            self.weights.append(0 if tag in ("html", "body") else WEIGHT * (bool(words & GOOD) - bool(words & BAD)))

    def _add(self, data: str) -> None:
        if not self.hidden():
            self.texts.append((self._ids[len(self.open) - 1] if self.open else 0, data))


def _passed_up(values: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Each element's value with those of all elements inside it."""
    total = values.copy()
    for d in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == d)
        np.add.at(total, parent[at], total[at])
    return total


def scored_articles(pages: Sequence[str]) -> list[str | None]:
    """The article text of every page, None where no element is a candidate."""
    trees = []
    for html in pages:
        tree = Tree()
        tree.feed(html)
        tree.close()
        trees.append(tree)
    sizes = np.array([len(t.tags) for t in trees], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    if not len(trees):
        return []
    page = np.repeat(np.arange(len(trees)), sizes)
    parent = np.concatenate([np.array(t.parents) + np.where(np.array(t.parents) < 0, 0, b) for t, b in zip(trees, begin, strict=True)])
    tags = np.array([x for t in trees for x in t.tags], dtype=object)
    weight = np.array([x for t in trees for x in t.weights])
    depth = np.zeros(len(tags), dtype=np.int64)
    muted, linked = weight < 0, tags == "a"
    for i in np.flatnonzero(parent >= 0):  # parents come first
        depth[i] = depth[parent[i]] + 1
        muted[i] |= muted[parent[i]]
        linked[i] |= linked[parent[i]]
    texts = [[(int(b) + n, s) for n, s in t.texts] for t, b in zip(trees, begin, strict=True)]
    own, commas = np.zeros(len(tags), dtype=np.int64), np.zeros(len(tags), dtype=np.int64)
    for node, s in (x for part in texts for x in part):
        own[node] += len(" ".join(s.split()))
        commas[node] += s.count(",")
    size = _passed_up(np.ones(len(tags), dtype=np.int64), parent, depth)

    def choose(mute: bool) -> list[list[int]]:
        heard = ~muted if mute else np.ones(len(tags), dtype=bool)
        length, comma, link = (_passed_up(np.where(heard & on, v, 0), parent, depth) for v, on in ((own, True), (commas, True), (own, linked)))
        para = heard & (np.isin(tags, list(SCORED)) | ((tags == "div") & (own > 0))) & (length >= LEAST_TEXT) & (2 * link <= length)
        points = 1 + comma[para] + np.minimum(length[para] // 100, 3)
        score, got = np.zeros(len(tags)), np.zeros(len(tags), dtype=bool)
        above = parent[para]
        for share in (1.0, 0.5):
            there = above >= 0
            np.add.at(score, above[there], share * points[there])
            got[above[there]] = True
            above = np.where(there, parent[above], -1)
        got &= tags != "#page"
        score += np.array([BONUS.get(t, -5 if re.fullmatch(r"h[1-6]", t) else 0) for t in tags]) + (weight if mute else 0)
        density = link / np.maximum(length, 1)
        score = np.where(got, score * (1 - density), -np.inf)
        out = []
        for p in range(len(trees)):
            mine = np.arange(begin[p], begin[p] + sizes[p])
            best = int(mine[np.argmax(score[mine])])
            if score[best] == -np.inf:
                out.append([])
                continue
            beside = mine[(parent[mine] == parent[best]) & heard[mine] & (mine != best)]
            good = score[beside] >= max(10.0, 0.2 * score[best])
            good |= (tags[beside] == "p") & (length[beside] >= SIBLING_TEXT) & (density[beside] < 0.25)
            out.append(sorted([best, *beside[good].tolist()]))
        return out

    chosen, second = choose(True), None
    out: list[str | None] = []
    for p, nodes in enumerate(chosen):
        mute = bool(nodes)
        if not nodes:
            second = second or choose(False)
            nodes = second[p]
        inside = np.zeros(sizes[p], dtype=bool)
        for n in nodes:
            inside[n - begin[p] : n - begin[p] + size[n]] = True
        if mute:
            inside &= ~muted[page == p] if len(trees) > 1 else ~muted
        out.append(tidy([s for n, s in texts[p] if inside[n - begin[p]]]) or None)
    return out
