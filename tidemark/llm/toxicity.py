"""Toxicity scores from gradient-boosted trees over dense text features.

A lexicon of word stems comes from labelled rows: stems (word beginnings of four to nine letters,
and whole words) that toxic texts hold more often. Every blank-separated word has a row of
attributes (lexicon weight, second person, capitals, punctuation, obfuscation), computed once per
distinct word; a text's features are sums, maxima and proximity counts of those rows. Trees are
fitted on features whose lexicon was learned from the other half of the sample, and an isotonic
regression on out-of-fold margins turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled rows of each class that training reads, about.
SAMPLE_ROWS = 6000
#: Stems of a lexicon, and the toxic texts that must hold one.
LEXICON = 600
LEAST = 4
TREES = 80
DEPTH = 4
BINS = 48
RATE = 0.15
NEAR = 4
REMEMBERED = 300_000

# Fixed word lists.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")


def core(word: str) -> str:
    """Letters of a word in lower case, with digits and signs that stand for letters read as such."""
    if word.isalpha():
        return word.lower()
    inner = word.strip("".join(c for c in set(word) if not c.isalnum()))
    if any(c.isalpha() for c in inner):
        inner = inner.translate(_LEET)
    return "".join(c for c in inner if c.isalpha()).lower()


def stems(word: str) -> set[str]:
    return {word[:n] for n in range(4, 10) if len(word) >= n} | {word + "$"}


def learn_lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int, size: int = LEXICON, least: int = LEAST) -> dict[str, float]:
    """Log odds of the strongest stems; a stem that adds nothing to a shorter one is left out."""
    scored = {}
    for stem, (hit, miss) in counts.items():
        if hit >= least:
            odds = float(np.log((hit + 0.5) / (toxic + 1)) - np.log((miss + 0.5) / (clean + 1)))
            if odds > 1.0:
                scored[stem] = (hit * odds, odds)
    best = sorted(scored, key=lambda s: (-scored[s][0], s))[: 4 * size]
    kept: dict[str, float] = {s: 5.0 for s in (w + "$" for w in SEED_WORDS)}
    for stem in sorted(best, key=lambda s: (len(s), s)):
        shorter = max((kept.get(stem[:n], 0.0) for n in range(4, len(stem))), default=0.0)
        if scored[stem][1] > shorter + 0.2:
            kept[stem] = scored[stem][1]
    order = sorted(kept, key=lambda s: (-scored.get(s, (1e9, 0))[0], s))
    return {s: kept[s] for s in order[:size]}


#: Attribute columns of a word.
WEIGHT, STRONG, MILD, PERSON, CAPS, OBFUSCATED, STRETCHED, PUNCT, BANG, UPPER, LETTER, LENGTH, VEILED = range(13)
_EDGES = ".,;:!?\"'()[]{}<>%&#$*-"
_STRETCH = re.compile(r"(.)\1\1")


class Lexicon:
    """Stem weights with a quick answer for the many words that hold no stem."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {s[:4] for s in weights if not s.endswith("$")}

    def weight(self, base: str) -> float:
        get = self.weights.get
        top = get(base + "$", 0.0)
        if base[:4] in self.heads:
            top = max(top, *(get(base[:n], 0.0) for n in range(4, 10)))
        return top


def _attributes(word: str, lexicon: Lexicon) -> tuple:
    n = len(word)
    inner = word if word.isalpha() else word.strip(_EDGES)
    if inner.isalpha():
        # Letters, with signs at the ends only: nothing to undo.
        base, letter, veiled, plain = inner.lower(), len(inner), False, n - len(inner)
        upper = 0 if base == inner else sum(map(str.isupper, inner))
    else:
        base = core(word)
        letter, upper = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
        plain = sum(not c.isalnum() for c in word)
        veiled = letter > 0 and any(not c.isalpha() and c not in "-'’." for c in inner)
    weight = lexicon.weight(base) if base else 0.0
    bang = word.count("!") + word.count("?") if plain else 0
    stretched = _STRETCH.search(word) is not None
    return weight, weight > 2.5, 0 < weight <= 2.5, base in SECOND_PERSON, letter > 1 and upper == letter, veiled, stretched, plain, bang, upper, letter, n, veiled and weight > 0


class Features:
    """Dense features of texts under one lexicon; remembers the words it has seen."""

    names = (
        "log_words strong mild weight strong_share mild_share weight_share top second third near person "
        "caps obfuscated stretched punct bang upper letters length veiled distinct"
    ).split()

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = Lexicon(lexicon)
        self.known: dict[str, int] = {}
        # Room for the remembered words; rows are filled as words come.
        self.table = np.zeros((1 << 10, 13), dtype=np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        fresh = list(set(words).difference(self.known))
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = list(set(words))
            at = len(self.known)
            while at + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(fresh)] = [_attributes(w, self.lexicon) for w in fresh]
            self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]

    def one(self, text: str | None) -> list[float]:
        words = (text or "").split()
        if not words:
            return [0.0] * len(self.names)
        rows = self._rows(words)
        n = len(words)
        total = rows.sum(axis=0, dtype=np.float64)
        hits = np.flatnonzero(rows[:, WEIGHT] > 0)
        top = np.sort(rows[hits, WEIGHT])[::-1][:3] if len(hits) else np.zeros(0)
        top = np.append(top, np.zeros(3 - len(top)))
        near = 0
        if len(hits):
            person = np.flatnonzero(rows[:, PERSON])
            if len(person):
                near = int((np.searchsorted(person, hits + NEAR, side="right") > np.searchsorted(person, hits - NEAR)).sum())
        letters = max(total[LETTER], 1.0)
        chars = max(total[LENGTH], 1.0)
        return [
            np.log1p(n), total[STRONG], total[MILD], total[WEIGHT], total[STRONG] / n, total[MILD] / n, total[WEIGHT] / n, *top, near, total[PERSON] / n,
            total[CAPS] / n, total[OBFUSCATED] / n, total[STRETCHED] / n, total[PUNCT] / chars, total[BANG] / n, total[UPPER] / letters,
            total[LETTER] / chars, total[LENGTH] / n, total[VEILED], len(set(words)) / n,
        ]


class Trees:
    """Boosted trees of one depth on binned features, logistic loss, with row weights."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH):
        self.trees, self.depth = trees, depth
        self.edges: list[np.ndarray] = []
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0.01, 0.99, BINS)), np.quantile(c[c > c.min()], np.linspace(0, 1, 8)) if (c > c.min()).any() else []])) for c in x.T]
        bins = self._bin(x)
        width = max(len(e) for e in self.edges) + 1
        share = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth, dtype=np.int64), np.full(2**self.depth, width, dtype=np.int64)
            for level in range(self.depth):
                nodes = 2**level
                best = np.full(nodes, 1e-6)
                for j in range(x.shape[1]):
                    key = node * width + bins[:, j]
                    gs = np.bincount(key, weights=g, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1)
                    hs = np.bincount(key, weights=h, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), at]
                    better = value > best
                    best[better] = value[better]
                    spots = nodes - 1 + np.flatnonzero(better)
                    feature[spots], cut[spots] = j, at[better]
                at = nodes - 1 + node
                node = 2 * node + (bins[np.arange(len(y)), feature[at]] > cut[at])
            leaves = 2**self.depth
            value = RATE * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + 1)
            self.splits.append((feature, cut, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bin(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (bins[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the weighted non-decreasing fit; pools adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t, v in zip(score[order], y[order], w[order], strict=True):
        blocks.append([t * v, v, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks for _ in range(2)])
    return x, np.maximum.accumulate(p)


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.lexicon = lexicon
        self.trees = None
        self.knots = (np.array([0.0]), np.array([float(np.average(y, weights=w)) if len(y) else 0.0]))
        if len(y) < 20 or y.min() == y.max():
            return
        fold = np.arange(len(y)) % 3
        out = np.zeros(len(y))
        for k in range(3):
            part = fold != k
            out[~part] = Trees().fit(x[part], y[part], w[part]).margin(x[~part])
        self.knots = isotonic(out, y, w)
        self.trees = Trees().fit(x, y, w)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x) if self.trees is not None else np.zeros(len(x))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about `sample_rows` rows of each class among the labelled rows that `use` admits.

    Only the sample's stem counts and dense features reach the driver. Rows are weighted back to
    the share of their class, so probabilities refer to all labelled rows.
    """
    common.configure(docs.sparkSession)
    known = labels.filter(use & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).distinct()
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for y, n in totals.items():
        chosen = F.when(F.col("y") == y, common.drawn(F.xxhash64("id"), sample_rows, n)).otherwise(chosen)
    chosen = known.filter(chosen).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))
    # The sample's ids are bounded by its documented size.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = common.stored(sample, "labelled").repartition(16, "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: tuple[Counter, Counter] = (Counter(), Counter())
        misses: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
                found = set().union(*(stems(w) for w in {core(w) for w in set((text or "").split())} if w))
                (hits if y else misses)[half].update(found)
        # A stem can only pass if toxic texts hold it, wherever they were read.
        rows = [(half, s, hits[half][s], misses[half][s]) for half in (0, 1) for s in hits[half].keys() | misses[half].keys()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["half", "stem", "hit", "miss"])

    counted = sample.select("text", "y", "half").mapInArrow(count, "half int, stem string, hit long, miss long")
    counted = counted.groupBy("half", "stem").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    both = counted.groupBy("stem").agg(*(F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("hit", "miss")))
    both = both.filter(F.col("hit0") + F.col("hit1") >= LEAST).withColumn("odds", (F.col("hit0") + F.col("hit1") + 0.5) / (F.col("miss0") + F.col("miss1") + 0.5))
    # Candidates are ranked before they leave the cluster; learn_lexicon uses fewer than these.
    both = both.orderBy(F.desc((F.col("hit0") + F.col("hit1")) * F.log("odds")), "stem").limit(20 * LEXICON).collect()
    sizes = {(r["y"], r["half"]): r["n"] for r in sample.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda y, *halves: sum(sizes.get((y, h), 0) for h in halves)
    lexicons = [learn_lexicon({r["stem"]: (r[f"hit{1 - h}"], r[f"miss{1 - h}"]) for r in both}, n(1, 1 - h), n(0, 1 - h)) for h in (0, 1)]
    full = learn_lexicon({r["stem"]: (r["hit0"] + r["hit1"], r["miss0"] + r["miss1"]) for r in both}, n(1, 0, 1), n(0, 0, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_half = [Features(x) for x in lexicons]
        for batch in batches:
            rows = [by_half[h].one(t) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sorted((r["id"], r["y"], r["x"]) for r in sample.select("id", "y", "text", "half").mapInArrow(measure, "id long, y int, x array<double>").collect())
    y = np.array([r[1] for r in rows], dtype=float)
    w = np.array([totals[r[1]] / max(1, n(r[1], 0, 1)) for r in rows])
    w = w * len(w) / w.sum() if len(w) else w
    return Model(full, np.array([r[2] for r in rows]).reshape(-1, len(Features.names)), y, w)


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns with score (0 to 1); null, empty and blank texts score as texts without words.

    Columns that are not kept are not read. Where a kept column is named score, the new one takes
    the name that common.free_name gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(*keep).columns
    frame = docs.select(*keep, F.col(text_col).alias(common.free_name("_text", taken)))
    added = common.free_name("score", taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        measured = Features(model.lexicon)
        for batch in batches:
            x = np.array([measured.one(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, len(Features.names))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x))], names=[*batch.schema.names[:-1], added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{schema}, {added} double")
