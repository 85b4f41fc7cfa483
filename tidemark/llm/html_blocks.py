"""Main text of web pages by a bidirectional LSTM over their text blocks.

A page is cut into leaf blocks of text. Each block has a hashed vector of its tag path (tags and
the words of class, id and role), a hashed bag of its words and a few ratios. A bidirectional
LSTM in numpy reads the blocks of the whole page in both directions and labels each one as main
text or not, so what surrounds a block decides with it. The network is trained here on pages that
a grammar composes from the usual parts of a site, with the label of every part known.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

PATH_DIM = 256
WORD_DIM = 48
HIDDEN = 24
TRAIN_PAGES = 1000
EPOCHS = 9
SEED = 5
#: Distinct paths and words that a worker remembers.
REMEMBERED = 200_000

# Fixed element sets.
# Raw text: no element starts before the end tag; without one it is the rest of the page.
RAW = frozenset("script style title iframe textarea".split())
# Ordinary elements that may stand inside a paragraph; their text makes blocks of its own.
EMBEDDED = frozenset("noscript template svg object select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul label option".split()
) | EMBEDDED
CLOSES_P = BLOCK - EMBEDDED - frozenset("td th tr tbody thead tfoot caption body html head label option".split())
#: An open element of the first kind ends when one of the same set starts, unless a holder is between.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "body": ("head",)}
HOLDERS = frozenset("ul ol dl table menu dir select article section div main body".split())
SCOPES = frozenset("article main section aside nav body td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?a-zA-Z][^>]*>", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z][a-z]*")


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """Tag and the words of its naming attributes."""
    out = [f"<{tag}"]
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("hidden", "aria-hidden"):
                out += ["hidden"] * (value.lower() != "false")
            elif name == "style":
                out += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            else:
                for word in _WORD.findall(value):
                    word = word.lower()
                    out += [word, f"{word[:4]}-"] if len(word) > 3 else [word]
    return tuple(out)


def blocks(page: str | None) -> list[tuple[tuple, str, float]]:
    """(path, text, share of linked characters) of every block with text, in page order."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[tuple, str, float]] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(e for _, e in stack), text, min(1.0, linked / len(text))))
            parts, linked = [], 0

    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            linked += len(piece) * in_link
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                flush()
                where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if where is not None:
                    del stack[where:]
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
        elif tag in ("br", "wbr", "img", "input"):
            parts.append(" " if tag != "wbr" else "")
        elif tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in HOLDERS:
                    break
            if tag not in VOID:
                stack.append((tag, _element(tag, m[3])))
        elif tag == "a":
            in_link = True
    flush()
    return out


class Vectors:
    """Input rows of blocks; remembers the paths and words it has seen."""

    DIM = PATH_DIM + WORD_DIM + 10

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple) -> np.ndarray:
        row = self.paths.get(path)
        if row is None:
            if len(self.paths) > REMEMBERED // 50:
                self.paths.clear()
            row = np.zeros(PATH_DIM, dtype=np.float32)
            names = [n for e in path for n in e] + [f"leaf{e[0]}" for e in path[-1:]] + [f"near{n}" for e in path[-2:] for n in e[1:]]
            for n in set(names):
                row[zlib.crc32(n.encode()) % PATH_DIM] = 1
            self.paths[path] = row
        return row

    def page(self, found: list[tuple[tuple, str, float]]) -> np.ndarray:
        x = np.zeros((len(found), self.DIM), dtype=np.float32)
        for i, (path, text, linked) in enumerate(found):
            words = text.split()
            n, size = len(words), len(text)
            x[i, :PATH_DIM] = self._path(path)
            if len(self.words) > REMEMBERED:
                self.words.clear()
            known = self.words
            for w in set(words).difference(known):
                known[w] = zlib.crc32(w.strip(".,:;!?()").lower().encode()) % WORD_DIM
            bag = np.bincount(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n), minlength=WORD_DIM)
            x[i, PATH_DIM : PATH_DIM + WORD_DIM] = bag / n
            leaf = path[-1][0] if path else ""
            x[i, -10:] = (
                np.log1p(size) / 6, np.log1p(n) / 5, linked, text[-1] in ".!?…»\"", min(1.0, text.count(",") / n), sum(map(str.isdigit, text)) / size,
                leaf in ("<h1", "<h2", "<h3", "<h4", "<h5", "<h6"), leaf in ("<p", "<blockquote", "<pre"), i / len(found), "©" in text,
            )
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs over a padded batch (steps, pages, inputs) and a logistic output per block."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"x{d}": wide(inputs, 4 * hidden) * 0.7 for d in (0, 1)} | {f"h{d}": wide(hidden, 4 * hidden) for d in (0, 1)}
        self.p |= {f"b{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32) for d in (0, 1)}
        self.p |= {"v": wide(2 * hidden, 1), "u": np.zeros((inputs, 1), np.float32), "c": np.zeros(1, np.float32)}
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        p, n = self.p, self.hidden
        states, saved = [], []
        for d in (0, 1):
            order = range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
            into = x @ p[f"x{d}"] + p[f"b{d}"]
            h = np.zeros((x.shape[1], n), np.float32)
            c = np.zeros_like(h)
            hs = np.zeros((len(x), x.shape[1], n), np.float32)
            trail = []
            for t in order:
                z = into[t] + h @ p[f"h{d}"]
                gates = _sigmoid(z[:, : 3 * n])
                i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
                m = mask[t][:, None]
                new = f * c + i * g
                if keep:
                    trail.append((t, h, c, i, f, o, g, np.tanh(new)))
                c = np.where(m, new, c)
                h = np.where(m, o * np.tanh(new), h)
                hs[t] = h
            states.append(hs)
            saved.append(trail)
        both = np.concatenate(states, axis=2)
        return (both @ p["v"] + x @ p["u"])[:, :, 0] + p["c"], [both, saved]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, self.hidden
        logit, (both, saved) = self.forward(x, mask, keep=True)
        error = ((_sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        flat = lambda a: a.reshape(-1, a.shape[2])
        g = {"v": flat(both).T @ flat(error), "u": flat(x).T @ flat(error), "c": error.sum(axis=(0, 1))}
        for d in (0, 1):
            dh = np.zeros((x.shape[1], n), np.float32)
            dc = np.zeros_like(dh)
            dz_all = np.zeros((len(x), x.shape[1], 4 * n), np.float32)
            g[f"h{d}"] = np.zeros_like(p[f"h{d}"])
            out = error @ p["v"][d * n : (d + 1) * n].T
            for t, h, c, i, f, o, cell, squashed in reversed(saved[d]):
                m = mask[t][:, None]
                dh = dh + out[t]
                inner = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([inner * cell * i * (1 - i), inner * c * f * (1 - f), dh * squashed * o * (1 - o), inner * i * (1 - cell**2)], axis=1) * m
                dz_all[t] = dz
                g[f"h{d}"] += h.T @ dz
                dh = np.where(m, dz @ p[f"h{d}"].T, dh)
                dc = np.where(m, inner * f, dc)
            g[f"x{d}"] = flat(x).T @ flat(dz_all)
            g[f"b{d}"] = dz_all.sum(axis=(0, 1))
        return g


# Names that sites give to their parts: fixed word lists.
MAIN_NAMES = "article content post entry story article-body post-content entry-content main-content body-text page-content text news-text articleBody prose".split()
PARTS = {
    "menu": "menu nav navbar navigation main-menu breadcrumb breadcrumbs topnav site-nav tabs pagination pager toc skip-link".split(),
    "header": "header site-header masthead page-header top-bar topbar branding logo".split(),
    "footer": "footer site-footer page-footer bottom copyright legal colophon foot".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending archive tags right-column more-stories teaser most-read latest".split(),
    "notice": "cookie cookie-banner notice consent gdpr alert newsletter subscribe popup modal overlay paywall disclaimer announcement banner privacy".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promoted adsense banner-ad ad-slot commercial".split(),
    "form": "search search-form login signup contact-form subscribe-form register poll survey".split(),
    "comments": "comments comment comment-list discussion responses replies disqus reader-comments reply feedback-list thread user-comments respond".split(),
    "share": "share social social-links sharing share-buttons follow byline-share".split(),
}
CUES = {
    "menu": "Home About Contact News Archive Products Blog Sports Start".split(),
    "header": "Daily Journal Magazine Welcome Login Register".split(),
    "footer": "© Copyright rights reserved Imprint Privacy Terms Sitemap".split(),
    "sidebar": "Related Popular Recent Trending More Categories Tags Read".split(),
    "notice": "cookies accept consent newsletter subscribe privacy policy agree dismiss".split(),
    "advert": "Advertisement Sponsored Buy now discount offer sale free shipping".split(),
    "form": "Search Email Name Password Submit Send Message".split(),
    "comments": "Reply says wrote commented ago Comments likes report great thanks".split(),
    "share": "Share Tweet Facebook Twitter Follow Email Print".split(),
}


class Grammar:
    """Composes pages with known labels from random words."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.controls = np.random.default_rng(seed + 1)

    def pick(self, options: list) -> object:
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        letters = "etaoinshrdlucmfwypvbgéèäöüñç"
        share = np.array([10, 9, 8, 7, 7, 7, 6, 6, 6, 4, 4, 3, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], dtype=float)
        sizes = self.rng.integers(2, 11, n)
        flat = "".join(np.array(list(letters))[self.rng.choice(len(letters), int(sizes.sum()), p=share / share.sum())])
        ends = np.cumsum(sizes)
        out = [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        if self.chance(0.1):
            out = [w + str(self.pick(["%%%", "###", "&amp;&amp;", "$$$", "!!"])) for w in out]
        return " ".join(out).capitalize()

    def sentence(self, low: int, high: int) -> str:
        text = self.words(low, high)
        for mark in (", ", ". "):
            for _ in range(text.count(" ") // 12):
                at = int(self.rng.integers(text.count(" ")))
                bits = text.split(" ")
                text = " ".join(bits[: at + 1]) + mark + " ".join(bits[at + 1 :])
        return text + str(self.pick([".", ".", ".", "!", "?", ""]))

    def named(self, tag: str, names: list[str]) -> str:
        name = str(self.pick(names))
        return f'<{tag} {self.pick(["class", "class", "id"])}="{name}{self.pick(["", "", " wide", " box", "-inner"])}">'

    def cue(self, kind: str) -> str:
        return " ".join(str(self.pick(CUES[kind])) for _ in range(int(self.rng.integers(1, 4))))

    def short(self, kind: str) -> str:
        return self.cue(kind) if self.chance(0.35) else self.words(1, 5) if self.chance(0.6) else f"{self.cue(kind)} {self.sentence(3, 14)}"

    def part(self, kind: str) -> list[tuple[str, str]]:
        """Fragments (markup, text of label 0) of a part that is not main text."""
        plain = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        use_plain = plain and self.chance(0.5)
        tag = plain if use_plain else str(self.pick(["div", "div", "section", "ul" if kind in ("menu", "share") else "div", "aside" if kind in ("advert", "sidebar") else "div"]))
        names = PARTS[kind]
        # Without a telling tag the name tells; with one the name may be missing or different.
        start = f"<{tag}>" if use_plain and self.chance(0.6) else self.named(tag, names)
        out = [(start, "")]
        if kind in ("menu", "share"):
            lists = tag != "ul" and self.chance(0.7)
            out.append(("<ul>" if lists else "", ""))
            for _ in range(int(self.rng.integers(2, 9))):
                item = self.words(1, 2) if self.chance(0.7) else self.cue(kind)
                out += [('<li><a href="/x">' if lists or tag == "ul" else '<a href="/x">', ""), ("", item), ("</a></li>" if lists or tag == "ul" else "</a> ", "")]
            out.append(("</ul>" if lists else "", ""))
        elif kind == "comments":
            out += [("<h3>", ""), ("", f"{self.cue(kind)} {self.words(1, 2)}"), ("</h3>", "")]
            for _ in range(int(self.rng.integers(1, 5))):
                out += [(self.named("div", names) if self.chance(0.6) else "<div>", "")]
                if self.chance(0.5):
                    out += [("<span>", ""), ("", f"{self.words(1, 2)} {self.cue(kind)}"), ("</span>", "")]
                out += [("<p>", ""), ("", self.sentence(3, 50)), ("</p></div>", "")]
        elif kind == "form":
            if tag != "form":
                out.append(("<form>", ""))
            for _ in range(int(self.rng.integers(1, 4))):
                out += [("<label>", ""), ("", self.short(kind)), ('</label><input name="q">', "")]
            out.append(("</form>" if tag != "form" else "", ""))
        else:
            for _ in range(int(self.rng.integers(1, 5))):
                leaf = str(self.pick(["p", "p", "div", "h4", "li", ""]))
                link = self.chance(0.4)
                text = self.sentence(2, 30) if kind in ("notice", "advert", "footer", "sidebar", "header") and self.chance(0.6) else self.short(kind)
                out += [(f"<{leaf}>" if leaf else "", ""), ('<a href="/y">' if link else "", ""), ("", ("&copy; " if kind == "footer" and self.chance(0.5) else "") + text)]
                out += [("</a>" if link else "", ""), (f"</{leaf}>" if leaf and not self.chance(0.1) else "", "")]
        if kind in ("form", "notice", "share", "advert") and self.controls.random() < 0.5:
            for _ in range(int(self.controls.integers(1, 4))):
                text = CUES[kind][int(self.controls.integers(len(CUES[kind])))]
                markup = [("<button>", "</button>"), ('<button class="btn">', "</button>"), ("<select><option>", "</option></select>"), ("<button>", "")][int(self.controls.integers(4))]
                out += [(markup[0], ""), ("", text), (markup[1], "")]
        if not self.chance(0.06):
            out.append((f"</{tag}>", ""))
        return out

    def page(self) -> tuple[str, dict[str, int]]:
        labels: dict[str, int] = {}
        out: list[str] = ["<!DOCTYPE html><html><head><title>", self.words(3, 9), "</title><style>p{margin:0}</style>"]
        out.append("</head>" if self.chance(0.95) else "")
        out.append("<body>" if self.chance(0.95) else "")

        def add(fragments: list[tuple[str, str]], label: int = 0) -> None:
            for markup, text in fragments:
                out.append(markup)
                if text:
                    out.append(text)
                    labels[" ".join(html.unescape(text).split())] = label

        for kind in ("notice", "header", "menu", "advert", "share", "form"):
            if self.chance(0.75 if kind in ("header", "menu") else 0.4):
                add(self.part(kind))
        if self.chance(0.15):
            add(self.part("sidebar"))
        outer = str(self.pick(["", "", "<main>", '<div id="main">', '<div class="container">', '<div id="page">', '<div class="row">']))
        wrapper = str(self.pick(["<article>"] * 6 + ["<div>", "<main>", "<section>"] + [self.named("div", MAIN_NAMES)] * 6 + [self.named("section", MAIN_NAMES), self.named("article", MAIN_NAMES)]))
        out += [outer, wrapper]
        if self.chance(0.9):
            head = self.chance(0.2)
            add([("<header>" if head else "", ""), (f"<h{self.pick([1, 1, 1, 2])}>", ""), ("", self.words(1, 14)), ("</h1></h2>", ""), ("</header>" if head else "", "")], 1)
        for i in range(int(self.rng.integers(1, 14))):
            roll = self.rng.random()
            if roll < 0.68:
                add([("<p>", ""), ("<b>" if self.chance(0.1) else "", "")], 1)
                text = self.sentence(1, 8) if self.chance(0.25) else self.sentence(8, 90)
                add([("", text), ("<br>" if self.chance(0.1) else "", ""), ("</p>" if self.chance(0.9) else "", "")], 1)
            elif roll < 0.78:
                add([(f"<h{self.pick([2, 3, 4])}>", ""), ("", self.words(1, 8)), ("</h2></h3></h4>", "")], 1)
            elif roll < 0.86:
                add([("<ul>", "")] + [f for _ in range(int(self.rng.integers(2, 6))) for f in (("<li>", ""), ("", self.sentence(2, 20)), ("</li>", ""))] + [("</ul>", "")], 1)
            elif roll < 0.9:
                add([("<blockquote><p>", ""), ("", self.sentence(5, 40)), ("</p></blockquote>", "")], 1)
            elif roll < 0.92:
                add([("<pre>", ""), ("", self.words(3, 20)), ("</pre>", "")], 1)
            elif roll < 0.94:
                add([("<table><tr>", "")] + [f for _ in range(4) for f in (("<td>", ""), ("", self.words(1, 4)), ("</td>", ""))] + [("</tr></table>", "")], 1)
            elif i:
                add(self.part(str(self.pick(["advert", "share", "sidebar", "notice", "form"]))))
        if self.chance(0.15):
            add(self.part("comments"))
        out += [re.sub(r"<(\w+).*", r"</\1>", wrapper)]
        for kind in ("share", "comments", "sidebar", "advert"):
            if self.chance(0.4):
                add(self.part(kind))
        out += [re.sub(r"<(\w+).*", r"</\1>", outer)]
        for kind in ("sidebar", "notice", "form", "menu"):
            if self.chance(0.2):
                add(self.part(kind))
        if self.chance(0.8):
            add(self.part("footer"))
        out += ["</body></html>"]
        return "".join(out), labels


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLstm:
    """The network after a fixed number of epochs over composed pages; the same every time."""
    grammar, vectors = Grammar(seed), Vectors()
    data = []
    for _ in range(pages):
        page, labels = grammar.page()
        found = blocks(page)
        # A block that joins several texts has the label of its first words.
        y = [labels.get(text, next((v for k, v in labels.items() if text.startswith(k)), 0)) for _, text, _ in found]
        if found:
            data.append((vectors.page(found), np.array(y, dtype=np.float32)))
    data.sort(key=lambda d: len(d[1]))
    net = BiLstm(Vectors.DIM, seed=seed)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    for epoch in range(epochs):
        rate = 0.008 * 0.5 ** (epoch / 3)
        for b in rng.permutation(len(batches)):
            x, mask, y = padded([d[0] for d in batches[b]], [d[1] for d in batches[b]])
            step += 1
            for k, g in net.gradient(x, mask, y).items():
                g = g + 1e-5 * net.p[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def padded(rows: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(rows)), bool)
    y = np.zeros((steps, len(rows)), np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i] = r
        mask[: len(r), i] = True
        if labels is not None:
            y[: len(r), i] = labels[i]
    return x, mask, y


def label_pages(net: BiLstm, vectors: Vectors, pages: list[str | None]) -> list[list[tuple[str, float]]]:
    """(text, probability of main text) of every block of every page."""
    found = [blocks(p) for p in pages]
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    low = 0
    while low < len(order):
        # Pages of like length share a batch, and a batch holds a bounded number of blocks.
        high = low + 1
        while high < len(order) and high - low < 128 and len(found[order[high]]) * (high - low + 1) <= 8192:
            high += 1
        part = order[low:high]
        x, mask, _ = padded([vectors.page(found[i]) for i in part])
        p = _sigmoid(net.forward(x, mask)[0])
        for column, i in enumerate(part):
            out[i] = [(text, float(v)) for (_, text, _), v in zip(found[i], p[:, column], strict=False)]
        low = high
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), *, threshold: float = 0.5, with_blocks: bool = False) -> DataFrame:
    """(id, kept columns, text[, blocks, scores]) of every row.

    Blocks whose probability reaches the threshold are joined by a blank line. A null or empty
    page and one without main text have an empty text. Columns that are not named are not read.
    """
    common.configure(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained().p)
    frame = pages.select(id_col, *keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLstm(Vectors.DIM)
        net.p = shared.value
        vectors = Vectors()
        for batch in batches:
            labelled = label_pages(net, vectors, batch.column("_html").to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns.append(pa.array(["\n\n".join(t for t, p in b if p >= threshold) for b in labelled], pa.string()))
            names = [*batch.schema.names[:-1], "text"]
            if with_blocks:
                columns += [pa.array([[t for t, _ in b] for b in labelled], pa.list_(pa.string())), pa.array([[p for _, p in b] for b in labelled], pa.list_(pa.float64()))]
                names += ["blocks", "scores"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{schema}, text string" + ", blocks array<string>, scores array<double>" * with_blocks)
