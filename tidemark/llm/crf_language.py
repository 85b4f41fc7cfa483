"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its letter bigrams and trigrams and its membership in a
learned lexicon of each language, hashed to a fixed number of weights. Training sequences are
cut from a bounded sample of labelled documents and glued from one to three languages, so the
transitions learn how rarely a text switches. Scoring runs forward-backward over every word of
every text; the language with the largest summed posterior wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled documents of one language that training reads, about; each gives one passage.
SAMPLE_DOCS = 600
PASSAGE_CHARS = 600
SEQUENCE_WORDS = 48
WEIGHTS = 1 << 15
LEXICON = 400
ROUNDS = 60
SEED = 7
#: Words that one forward-backward pass holds, and words a worker remembers.
PASS_WORDS = 500_000
REMEMBERED = 400_000
#: Log score of a language for an unseen feature set is zero; scores are kept within this.
CLIP = 30.0


_EDGES = ".,;:!?\"'()[]{}<>%&#$*-|0123456789"


def letters(word: str) -> str:
    """The word from its first to its last letter, in lower case; empty without a letter."""
    if word.isalpha():
        return word.lower()
    inner = word.strip(_EDGES)
    if inner.isalpha():
        return inner.lower()
    spots = [i for i, c in enumerate(inner) if c.isalpha()]
    return inner[spots[0] : spots[-1] + 1].lower() if spots else ""


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all words, and the word of each.

    A word between edge marks has its byte bigrams and trigrams, the first four and the last
    four bytes (longer affixes; the shorter ones are n-grams with a mark), and its lexicon.
    """
    marked = [b"^" + w.encode() + b"$" for w in words]
    size = np.array([len(x) for x in marked])
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    begin = end - size
    owner = np.repeat(np.arange(len(words)), size)
    left = end[owner] - np.arange(len(data))
    ids, owners = [], []
    for n in (2, 3, 4):
        at = np.flatnonzero(left >= n)
        if n == 4:
            # Only at the two ends of a word.
            at = at[(at == begin[owner[at]]) | (left[at] == 4)]
        code = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[at + k]
        ids.append(64 + (common.mix(code) % np.uint64(WEIGHTS - 64)).astype(np.int64))
        owners.append(owner[at])
    held = [i for i, w in enumerate(words) if w in lexicon]
    ids.append(np.array([lexicon[words[i]] % 64 for i in held], dtype=np.int64))
    owners.append(np.array(held, dtype=np.int64))
    return np.concatenate(ids), np.concatenate(owners)


def _sums(flat: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Sum of the weight rows of each word's features."""
    return np.stack([np.bincount(owner, weights=weights[flat, i], minlength=n) for i in range(weights.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of every word, log likelihood per sequence, and expected transitions.

    `scores` holds the words of all sequences one after another. Sequences advance together,
    the longest first, so step t touches only those that have a word t.
    """
    order = np.argsort(-lengths, kind="stable")
    length = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    peak = scores.max(axis=1, keepdims=True)
    local = np.exp(scores - peak)
    move = np.exp(transitions)
    alpha = np.empty_like(local)
    scale = np.empty(len(local))
    for t, n in enumerate(active):
        at = first[:n] + t
        now = local[at] * (alpha[at - 1] @ move if t else np.exp(start))
        total = now.sum(axis=1)
        scale[at] = total
        alpha[at] = now / total[:, None]
    beta = np.ones_like(local)
    pairs = np.zeros_like(transitions)
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        ahead = local[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = ahead @ move.T
        pairs += alpha[at - 1].T @ ahead
    owner = np.repeat(np.arange(len(lengths)), lengths)
    likelihood = np.bincount(owner, weights=np.log(scale) + peak[:, 0], minlength=len(lengths))
    return alpha * beta, likelihood, pairs * move


class Model:
    """Weights, transitions and lexicon of the learned languages."""

    def __init__(self, languages: list[str], passages: list[tuple[str, str]]):
        self.languages = languages
        self.lexicon: dict[str, int] = {}
        k = len(languages)
        self.weights = np.zeros((WEIGHTS, k))
        self.transitions = np.zeros((k, k))
        self.start = np.zeros(k)
        place = {x: i for i, x in enumerate(languages)}
        texts = [(place[lang], [w for w in map(letters, text.split()[1:-1] or text.split()) if w]) for lang, text in passages]
        texts = [x for x in texts if x[1]]
        if k < 2 or not texts:
            return
        counts = [Counter() for _ in languages]
        for lang, words in texts:
            counts[lang].update(words)
        total = sum(counts, Counter())
        for lang, own in enumerate(counts):
            common_words = [w for w, n in sorted(own.items(), key=lambda x: (-x[1], x[0])) if n > 2 and n > 0.8 * total[w]]
            self.lexicon.update((w, lang) for w in common_words[:LEXICON])
        self._fit(self._sequences(texts))

    def _sequences(self, texts: list[tuple[int, list[str]]]) -> list[tuple[list[str], list[int]]]:
        rng = np.random.default_rng(SEED)
        out = []
        for lang, words in texts:
            sequence, labels = words[:SEQUENCE_WORDS], [lang] * min(len(words), SEQUENCE_WORDS)
            for _ in range(int(rng.choice(3, p=[0.6, 0.3, 0.1]))):
                other, more = texts[rng.integers(len(texts))]
                take = more[: int(rng.integers(6, 24))]
                keep = len(sequence) - len(take) // 2
                sequence, labels = sequence[:keep] + take, labels[:keep] + [other] * len(take)
            out.append((sequence, labels))
        return out

    def _fit(self, sequences: list[tuple[list[str], list[int]]]) -> None:
        k = len(self.languages)
        types = sorted({w for s, _ in sequences for w in s})
        number = {w: i for i, w in enumerate(types)}
        flat, owner = features(types, self.lexicon)
        tokens = np.array([number[w] for s, _ in sequences for w in s])
        labels = np.array([x for _, y in sequences for x in y])
        lengths = np.array([len(s) for s, _ in sequences])
        firsts = np.cumsum(lengths) - lengths
        inside = np.ones(len(labels), dtype=bool)
        inside[firsts] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (labels[np.flatnonzero(inside) - 1], labels[inside]), 1)
        begun = np.bincount(labels[firsts], minlength=k).astype(float)
        gold = np.eye(k)[labels]
        params = [self.weights, self.transitions, self.start]
        mean = [np.zeros_like(p) for p in params]
        square = [np.zeros_like(p) for p in params]
        for step in range(1, ROUNDS + 1):
            scores = _sums(flat, owner, len(types), self.weights)[tokens]
            posterior, _, pairs = forward_backward(np.clip(scores, -CLIP, CLIP), lengths, self.transitions, self.start)
            error = gold - posterior
            by_type = np.stack([np.bincount(tokens, weights=error[:, i], minlength=len(types)) for i in range(k)], axis=1)
            grad = np.stack([np.bincount(flat, weights=by_type[owner, i], minlength=WEIGHTS) for i in range(k)], axis=1)
            grads = [grad - 0.3 * self.weights, seen - pairs - 0.3 * self.transitions, begun - posterior[firsts].sum(axis=0) - 0.3 * self.start]
            for p, g, m, v in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, owner = features(words, self.lexicon)
        return np.clip(_sums(flat, owner, len(words), self.weights), -CLIP, CLIP)


def train(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about `sample_docs` documents of each language among the rows that `use` admits.

    The sample is chosen by a hash of id and text; of a chosen text one passage of fixed length
    at a hashed place is read. Labels of any number of rows cost the driver one bounded sample.
    """
    rows = docs.filter(use & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], [])
    digest = F.xxhash64(F.col(id_col), F.col(text_col))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = F.when(F.col(lang_col) == lang, common.drawn(digest, sample_docs, n)).otherwise(chosen)
    begin = F.pmod(F.xxhash64(F.col(text_col), F.lit(1)), F.greatest(F.length(text_col) - PASSAGE_CHARS, F.lit(1))).cast("int") + 1
    sample = rows.filter(chosen).select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), begin, F.lit(PASSAGE_CHARS)).alias("passage"))
    return Model(languages, sorted((r["lang"], r["passage"]) for r in sample.collect()))


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """The kept columns with lang_pred and score (mean posterior of that language over words).

    A null text and one without a letter are `und` with score 0. A single learned language wins
    wherever there is a letter; of languages with equal posteriors the first by name does. Columns
    that are not kept are not read. Where a kept column has one of the two names, the new column
    takes the name that common.free_name gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # With carry_text the kept columns hold the text, which then travels once.
    frame = docs.select(*keep)
    kept, taken = len(frame.columns), frame.columns
    source = taken.index(text_col) if carry_text else kept
    if not carry_text:
        frame = docs.select(*keep, F.col(text_col).alias(common.free_name("_text", taken)))
    added = [common.free_name(n, taken) for n in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        # Row of each remembered word, and of the letters that words share.
        known: dict[str, int] = {}
        rows_of: dict[str, int] = {"": -1}
        table = np.zeros((1 << 10, max(len(model.languages), 1)))

        def number(texts: list[list[str]]) -> None:
            nonlocal table, known, rows_of
            fresh = set().union(*texts).difference(known)
            if len(known) + len(fresh) > REMEMBERED:
                known, rows_of = {}, {"": -1}
                fresh = set().union(*texts)
            cores = {w: letters(w) for w in fresh}
            words = sorted(set(cores.values()).difference(rows_of))
            at = len(rows_of) - 1
            while at + len(words) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            if words and model.languages:
                table[at : at + len(words)] = model.emissions(words)
            rows_of.update(zip(words, range(at, at + len(words)), strict=True))
            known.update((w, rows_of[c]) for w, c in cores.items())

        def close(held: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            texts = [t for _, ts in held for t in ts]
            live = [i for i, t in enumerate(texts) if len(t)] if model.languages else []
            pred = np.full(len(texts), -1)
            score = np.zeros(len(texts))
            if live:
                lengths = np.array([len(texts[i]) for i in live])
                posterior, _, _ = forward_backward(np.concatenate([texts[i] for i in live]), lengths, model.transitions, model.start)
                mass = np.add.reduceat(posterior, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
                pred[live] = mass.argmax(axis=1)
                score[live] = np.clip(mass.max(axis=1), 0.0, 1.0)
            names = np.array([*model.languages, "und"], dtype=object)
            low = 0
            for batch, ts in held:
                high = low + len(ts)
                columns = [batch.column(i) for i in range(kept)]
                columns += [pa.array(names[pred[low:high]].tolist(), pa.string()), pa.array(score[low:high])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], *added])
                low = high

        held, size = [], 0
        for batch in batches:
            words = [(t or "").split() for t in batch.column(source).to_pylist()]
            number(words)
            rows = []
            for t in words:
                at = np.fromiter(map(known.__getitem__, t), dtype=np.int64, count=len(t))
                rows.append(table[at[at >= 0]])
            held.append((batch, rows))
            size += sum(map(len, rows))
            if size > PASS_WORDS:
                yield from close(held)
                held, size = [], 0
        if held:
            yield from close(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:kept])
    return frame.mapInArrow(run, f"{schema}, {added[0]} string, {added[1]} double")
