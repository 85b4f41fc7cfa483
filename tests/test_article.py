"""Scored article extraction against a recursive scorer over made element trees."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import article, extract

WORDS = "alpha beta, gamma delta epsilon, zeta eta theta iota kappa lambda mu".split(" ")


def make(rng, depth=0):
    """(tag, class words, children); a child is an element or a text."""
    inline = lambda: ("a", "", [" ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))])
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(1, 45)))
    tag = rng.choice(("div", "section", "p", "p", "ul", "blockquote", "form")) if depth < 4 else "p"
    names = rng.choice(("", "", "", "content", "sidebar", "post comments", "x-menu", "story text", "other"))
    if tag == "p":
        return tag, names, [rng.choice((text, inline))() for _ in range(rng.randrange(1, 4))]
    if tag == "ul":
        return tag, names, [("li", "", [inline() if rng.random() < 0.7 else text()]) for _ in range(rng.randrange(1, 5))]
    kids = [make(rng, depth + 1) for _ in range(rng.randrange(1, 5))]
    return tag, names, [text(), *kids] if tag == "div" and rng.random() < 0.2 else kids


def render(node):
    if isinstance(node, str):
        return node
    tag, names, kids = node
    return f'<{tag} class="{names}">' + "".join(map(render, kids)) + f"</{tag}>"


class Node:
    def __init__(self, node, parent=None):
        self.tag, names, kids = node
        self.parent, self.score, self.got = parent, 0.0, False
        words = set(re.findall("[A-Za-z]+", names))
        self.weight = 25 * (bool(words & article.GOOD) - bool(words & article.BAD))
        self.muted = self.weight < 0 or bool(parent and parent.muted)
        self.kids = [k if isinstance(k, str) else Node(k, self) for k in kids]

    def all(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.all()

    def texts(self, mute, linked=False):
        linked = linked or self.tag == "a"
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.texts(mute, linked)
            elif not (mute and self.muted):
                yield k, linked


def plain(root, mute):
    size = lambda n, only=False: sum(len(" ".join(t.split())) for t, linked in n.texts(mute) if linked or not only)
    inside_link = lambda n: n is not None and (n.tag == "a" or inside_link(n.parent))
    links = lambda n: size(n) if inside_link(n) else size(n, True)
    for n in root.all():
        n.score, n.got = 0.0, False
    for n in root.all():
        if mute and n.muted:
            continue
        whole = any(isinstance(k, str) and k.strip() for k in n.kids)
        if (n.tag in article.SCORED or (n.tag == "div" and whole)) and size(n) >= 25 and 2 * links(n) <= size(n):
            points = 1 + sum(t.count(",") for t, _ in n.texts(mute)) + min(size(n) // 100, 3)
            for up, share in ((n.parent, 1), (n.parent and n.parent.parent, 0.5)):
                if up is not None:
                    up.score += share * points
                    up.got = True
    for n in root.all():
        n.score = (n.score + article.BONUS.get(n.tag, 0) + (n.weight if mute else 0)) * (1 - links(n) / max(1, size(n)))
    found = [n for n in root.all() if n.got]
    if not found:
        return None
    best = max(found, key=lambda n: n.score)
    out = []
    for n in [best] if best.parent is None else [k for k in best.parent.kids if isinstance(k, Node)]:
        if n is not best and mute and n.muted:
            continue
        long_p = n.tag == "p" and size(n) >= 80 and links(n) < 0.25 * size(n)
        if n is best or (n.got and n.score >= max(10, 0.2 * best.score)) or long_p:
            out.append(" ".join(t for t, _ in n.texts(mute)))
    return " ".join(" ".join(out).split())


def test_scores_are_the_plain_ones():
    rng = random.Random(4)
    trees = [("div", "", [make(rng) for _ in range(rng.randrange(1, 6))]) for _ in range(300)]
    got = article.scored_articles([render(t) for t in trees])
    want = []
    for t in trees:
        root = Node(t)
        want.append(plain(root, True) or plain(root, False))
    flat = [None if g is None else " ".join(g.split()) for g in got]
    squeeze = lambda t: None if t is None else t.replace(" ", "")
    assert [squeeze(g) for g in flat] == [squeeze(w) for w in want]
    assert sum(w is not None for w in want) > 200 and len({w for w in want}) > 200
    assert article.scored_articles([render(trees[5])]) == [got[5]] and article.scored_articles([]) == []


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><div id=menu><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div>
<div class="sidebar"><p>Subscribe to our letter, it is free, it is short, and it comes once each week without fail.</p></div>
<div class="post"><h2>Title</h2><p>First paragraph of the article, which is long enough to count, with commas, and more.
<p>Second paragraph of the article, also long enough to count as one.<div class="share"><p>Share this page with all of your many friends today.</p></div></div>
<p>A paragraph beside the post that is long enough to belong to the article, though it stands outside of it.</p>
<div class="comments"><p>What a post, I have never read anything like it, and I read a lot, really, a lot, you know, all day.</p></div></body></html>"""


def test_pages(spark):
    want = "Title\nFirst paragraph of the article, which is long enough to count, with commas, and more.\nSecond paragraph of the article, also long enough to count as one."
    want += "\nA paragraph beside the post that is long enough to belong to the article, though it stands outside of it."
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>short"), (5, "<article><p>Own</p></article>" + PAGE), (6, '<div class="menu"><p>Only a menu text here, but long enough to be one.</p></div>'), (7, "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: (r.text_content, r.error) for r in extract.extract_article(df).collect()}
    assert got[1] == (want, None) and got[2] == got[3] == (None, extract.NO_ARTICLE) and got[4] == ("short", None) and got[5][0] == "Own"
    assert got[6][0].startswith("Only a menu") and got[7][0] == "deep"
    assert df.limit(0).select(F.col("html")).count() == 0 == extract.extract_article(df.limit(0)).count()
