"""Readable text of markup: a stack of open tags, and what each of them does to the text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements whose text is no reading text, and elements that begin a new line.
SKIPPED = frozenset({"script", "style", "nav", "noscript", "template", "title", "header", "footer", "aside"})
BLOCKS = frozenset(
    {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "table", "section", "article", "main", "blockquote", "pre", "figure"}
)
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
# Elements that only stand in the head; anything else ends an open head.
HEAD = frozenset({"base", "link", "meta", "noscript", "script", "style", "template", "title"})
# An article or a main part is never inside a menu, header or footer that was left open.
OPENERS = frozenset({"article", "main", "body"})


class TextParser(HTMLParser):
    """Collects readable text, apart for <article> and for the whole body.

    A stack of open tags decides what a text belongs to, so an end tag that is missing or
    too many affects no more than its own element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.article: list[str] = []
        self.body: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "head" in self.open and tag not in HEAD and tag != "head":
            self._close("head")
        if tag in OPENERS:
            skipped = [i for i, t in enumerate(self.open) if t in SKIPPED]
            if skipped:
                del self.open[skipped[0] :]
        if tag in BLOCKS:
            self._add("\n")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)
        if tag in BLOCKS:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        if "head" in self.open and data.strip() and not any(t in HEAD for t in self.open):
            self._close("head")
        self._add(data)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] == tag:
                del self.open[i:]
                return

    def hidden(self) -> bool:
        return any(t in SKIPPED or t == "head" for t in self.open)

    def _add(self, data: str) -> None:
        if not self.hidden():
            self.body.append(data)
            if "article" in self.open:
                self.article.append(data)


def tidy(parts: list[str]) -> str:
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)
