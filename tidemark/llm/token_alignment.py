"""Alignment of two tokenizers by pointer jumping, and how often ids meet in it.

Both tokenizers cut the same bytes. A token overlaps those of the other side that share a byte
with it; tokens that are linked by overlaps make a group, and a group ends where both sides do.

1. Every token points to the token that overlaps it and reaches farthest right: an A token to the
   B token that holds its last byte, a B token that ends inside an A token to that one. The B
   token at a group's end points to itself.
2. Successors are doubled (s = s[s]) for all tokens of many texts at once until nothing changes.
   Then every token points to the terminal token of its group, which labels it.
3. A document's links are the pairs of an A and a B token of one group, kept as distinct id pairs
   with their number. Texts are dealt into chunks of bounded size, and a chunk's distinct id pairs
   are its dictionary: documents are counted by dictionary rows, the counts are joined to them,
   and they return to the chunk's documents. No row is made per document and pair.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.byte_bpe import REMEMBERED, ByteBpe, TokenBytes

#: Characters of texts that are aligned together, and of one chunk.
TOGETHER = 1 << 20
CHUNK = 1 << 23
#: Id pairs of groups that are expanded at once.
EXPANDED = 1 << 21

# The split of the byte-level pre-tokenizer, and the bytes that its alphabet shows
# as themselves; the other bytes take the code points from 256 on.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
# Characters that every version of the split treats alike.
_COMMON = regex.compile(r"[\t\n\r\x20-\x7E¡-¬®-ſ]*")


class ByteLevel:
    """Ids by a byte-level tokenizer file. Special tokens inside a text are plain text."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        self.whole.encode_special_tokens = True
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        as_bytes = lambda t: bytes(map(_ALPHABET.__getitem__, t)) if set(t) <= set(_ALPHABET) else t.encode()
        tokens = {as_bytes(t): i for t, i in vocab.items()}
        self.text_of = TokenBytes({i: t for t, i in tokens.items()})
        self.short = self._merges(json.loads(content), tokens, as_bytes)

    @staticmethod
    def _merges(spec: dict, tokens: dict[bytes, int], as_bytes) -> ByteBpe | None:
        """Merges by matrices where the file says just that; None where the whole tokenizer is needed."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        plain &= spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if not plain or not all(bytes([b]) in tokens for b in range(256)):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rows = np.array([[tokens[as_bytes(a)], tokens[as_bytes(b)], tokens[as_bytes(a + b)]] for a, b in pairs], dtype=np.int32).reshape(-1, 3)
        return ByteBpe(tokens, _PATTERN, rows) if (np.diff(rows[:, 2]) > 0).all() else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        common_ = [self.short is not None and _COMMON.fullmatch(t) is not None for t in texts]
        rare = [i for i, plain in enumerate(common_) if not plain]
        out = self.short.encode([t for t, plain in zip(texts, common_, strict=True) if plain]) if self.short is not None else []
        for i, e in zip(rare, self.whole.encode_batch_fast([texts[i] for i in rare], add_special_tokens=False), strict=True):
            out.insert(i, np.array(e.ids, dtype=np.int32))
        return out


class Pieces:
    """Ids by a sentence-piece model.

    Where no piece goes on after a blank, nothing merges across blanks, and the words of a text
    with single blanks are encoded one by one; a worker remembers them. Other texts go whole.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        as_bytes = lambda i, p: bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.text_of = TokenBytes({i: as_bytes(i, p) for i, p in enumerate(pieces)})
        self.by_word = all("▁" not in p.lstrip("▁") for p in pieces) and self.model.encode("a", out_type=str)[0].startswith("▁")
        self.known: dict[str, bytes] = {}
        self.room = REMEMBERED

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        short = [self.by_word and "  " not in t and "▁" not in t and t[:1] != " " and t[-1:] != " " for t in texts]
        words = [t.split(" ") for t, plain in zip(texts, short, strict=True) if plain]
        new = set().union(*words).difference(self.known)
        self.room -= sum(map(len, new))
        if self.room < 0:
            self.known.clear()
            new = set().union(*words)
            self.room = REMEMBERED - sum(map(len, new))
        listed = list(new)
        for word, ids in zip(listed, self.model.encode(listed, num_threads=1), strict=True):
            self.known[word] = array("i", ids).tobytes()
        by_word = iter(words)
        rare = iter(self.model.encode([t for t, plain in zip(texts, short, strict=True) if not plain], num_threads=1))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, next(by_word))), np.int32) if plain else np.array(next(rare), dtype=np.int32) for plain in short]


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and of every B token, numbered from the left.

    The ends are ascending byte offsets of two cuts of the same bytes, of one text or of many
    behind each other; both end at the same byte.
    """
    n = len(ends_a)
    succ = np.empty(n + len(ends_b), dtype=np.int64)
    succ[:n] = n + np.searchsorted(ends_b, ends_a)
    holder = np.searchsorted(ends_a, ends_b)
    succ[n:] = np.where(ends_a[holder] > ends_b, holder, n + np.arange(len(ends_b))) if n else 0
    while True:
        twice = succ[succ]
        if (twice == succ).all():
            break
        succ = twice
    terminals = np.flatnonzero(succ == np.arange(len(succ)))
    label = np.searchsorted(terminals, succ)
    return label[:n], label[n:]


def id_pairs(label_a: np.ndarray, label_b: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, times): how often a document links an id pair; key is a * size_b + b.

    `owner` is each group's document. Equal ids of one group are counted before they are paired.
    """

    def counted(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, n = np.unique(label << 32 | ids, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, n

    la, ia, na = counted(label_a, a.astype(np.int64))
    lb, ib, nb = counted(label_b, b.astype(np.int64))
    first = np.searchsorted(lb, np.arange(len(owner)))
    width = np.bincount(lb, minlength=len(owner))
    row = width[la]
    end = np.cumsum(row)
    none = np.zeros(0, dtype=np.int64)
    out = (none, none, none)
    low = 0
    while low < len(la):
        high = max(low + 1, int(np.searchsorted(end, end[low] - row[low] + EXPANDED, side="right")))
        x = np.repeat(np.arange(low, high), row[low:high])
        y = first[la[x]] + np.arange(len(x)) - np.repeat(end[low:high] - row[low:high] - (end[low] - row[low]), row[low:high])
        part = (owner[la[x]], ia[x] * size_b + ib[y], na[x] * nb[y])
        # Equal pairs of one document become one row before more are added.
        doc, key, times = (np.concatenate(p) for p in zip(out, part, strict=True))
        order = np.lexsort((key, doc))
        doc, key, times = doc[order], key[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        out = (doc[new], key[new], np.add.reduceat(times, new))
        low = high
    return out


class Aligner:
    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        # What a token writes: A ids end with , or |, B ids with , or ; or nothing.
        written = [b"%d%s" % (i, s) for i in range(self.a.size) for s in (b",", b"|")]
        written += [b"%d%s" % (i, s) for i in range(self.b.size) for s in (b",", b";", b"")]
        self.written = TokenBytes(dict(enumerate(written)))

    def align(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, keys, times) of each text."""
        whole = [t for t in texts if t]
        found = zip(whole, self.a.encode([" " + t for t in whole]), self.b.encode(whole), strict=True)
        good = []
        for text, a, b in found:
            raw = b" " + text.encode()
            good.append((a, b) if all(x is not None and x.tobytes() == raw for x in (self.a.text_of.join(a), self.b.text_of.join(b))) else None)
        used = [g for g in good if g]
        rows = self._rows([a for a, _ in used], [b for _, b in used])
        none = np.zeros(0, dtype=np.int64)
        pairs = iter(good)
        for text in texts:
            yield next(rows) if text and next(pairs) else (0, 0, 0, 0, "", none, none)

    def _rows(self, lists_a: list[np.ndarray], lists_b: list[np.ndarray]) -> Iterator[tuple]:
        if not lists_a:
            return
        a, b = np.concatenate(lists_a), np.concatenate(lists_b)
        at_a, at_b = (np.concatenate([[0], np.cumsum([len(x) for x in lists])]) for lists in (lists_a, lists_b))
        la, lb = group_labels(np.cumsum(self.a.text_of.lengths[a]), np.cumsum(self.b.text_of.lengths[b]))
        groups = np.concatenate([[0], lb[at_b[1:] - 1] + 1])
        owner = np.repeat(np.arange(len(lists_a)), np.diff(groups))
        in_a, in_b = (np.bincount(x, minlength=len(owner)) for x in (la, lb))
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])
        doc, key, times = id_pairs(la, lb, a, b, owner, self.b.size)
        cut = np.searchsorted(doc, np.arange(len(lists_a) + 1))
        # A token's place among all tokens, a group's A tokens before its B tokens.
        before_a, before_b = (np.concatenate([[0], np.cumsum(x)]) for x in (in_a, in_b))
        last_a = np.append(la[1:] != la[:-1], True)
        last_b = np.append(lb[1:] != lb[:-1], True).astype(np.int64)
        last_b[at_b[1:] - 1] = 2
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + before_b[la]] = a * 2 + last_a
        code[np.arange(len(b)) + before_a[lb + 1]] = 2 * self.a.size + b.astype(np.int64) * 3 + last_b
        texts = self.written.join(code).tobytes()
        letters = np.concatenate([[0], np.cumsum(self.written.lengths[code])])[at_a + at_b].tolist()
        for i in range(len(lists_a)):
            text = texts[letters[i] : letters[i + 1]].decode()
            part = slice(cut[i], cut[i + 1])
            n_links = int(links[groups[i + 1]] - links[groups[i]])
            yield len(lists_a[i]), len(lists_b[i]), int(groups[i + 1] - groups[i]), n_links, text, key[part], times[part]


@functools.lru_cache(maxsize=1)
def load(a: str, b: bytes) -> Aligner:
    return Aligner(a, b)


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "")
        if part and size + n > TOGETHER:
            yield part
            part, size = [], 0
        part.append(text)
        size += n
    if part:
        yield part


def align(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, chunk, keys, times) of every row.

    A encodes a space and the text, B the text. `groups` writes the ids of each group, A's before
    B's: `a1,a2|b1;a3|b2,b3`. `keys` are the distinct linked id pairs (A id * pieces of B + B id),
    `times` their links. `chunk` numbers runs of neighbouring rows of bounded size. Texts that are
    null or empty or that a tokenizer changes have no tokens: zeros, an empty text, empty arrays.
    Rows are independent, so repeated rows and null ids stay as they are, and an empty table gives
    an empty one. Other columns are not read, whatever their names.
    """
    common.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    n_pairs = len(json.loads(a_json)["model"]["vocab"]) + len(json.loads(a_json).get("added_tokens") or [])
    wide = n_pairs * Pieces(b_model).size > 0x7FFFFFFF
    key_type = pa.int64() if wide else pa.int32()
    numbers = ("n_a", "n_b", "n_groups", "n_links", "groups", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(*shared.value)
        chunk, room = TaskContext.get().partitionId() << 32, CHUNK
        for batch in batches:
            done = 0
            for texts in _runs(batch.column(1).to_pylist()):
                rows = list(aligner.align(texts))
                chunks = []
                for text in texts:
                    room -= len(text or "") + 1
                    if room < 0:
                        chunk, room = chunk + 1, CHUNK
                    chunks.append(chunk)
                columns = [*list(zip(*rows, strict=True))[:5], chunks]
                lists = []
                for i, kind in ((5, key_type), (6, pa.int64())):
                    offsets = np.concatenate([[0], np.cumsum([len(r[i]) for r in rows])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[i] for r in rows])).cast(kind)))
                plain = [pa.array(c, pa.string() if k == "groups" else pa.int64()) for c, k in zip(columns, numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *plain, *lists], names=["id", *numbers, "keys", "times"])
                done += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = "long" if wide else "int"
    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, keys array<{key}>, times array<long>"
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def with_link_counts(aligned: DataFrame, pieces: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of `align`, with n_best and count_sum in place of chunk, keys and times.

    An id pair's count is the number of rows that link it. n_best is the number of a row's links
    whose count is the highest of their A id, ties included; count_sum adds the counts of all its
    links. `pieces` is the number of pieces of B. More columns may have been added to the rows;
    they are kept. Repeated rows count as often as they occur.
    """
    spark = aligned.sparkSession
    aligned = common.stored(aligned, "aligned")
    words = aligned.select("chunk", F.explode("keys").alias("key")).groupBy("chunk", "key").agg(F.count(F.lit(1)).alias("n"))
    words = common.stored(words, "dictionaries")
    counts = common.stored(words.groupBy("key").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("key") / F.lit(pieces))), "counts")
    # One row per id of A at most.
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    graded = counts.join(top, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    graded = words.select("chunk", "key").join(graded, "key").select("chunk", "key", "n", "best")
    kept = [c for c in aligned.columns if c not in ("chunk", "keys", "times")]

    def grade(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
        key = dictionary.column("key").to_numpy()
        order = np.argsort(key)
        n, best = dictionary.column("n").to_numpy()[order], dictionary.column("best").to_numpy()[order]
        keys, times = rows.column("keys").combine_chunks(), rows.column("times").combine_chunks()
        at = np.searchsorted(key[order], keys.flatten().to_numpy())
        times = times.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
        sums = []
        for values in (times * best[at], times * n[at]):
            total = np.concatenate([[0], np.cumsum(values)])
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
        return pa.table([*(rows.column(c) for c in kept), *sums], names=[*kept, "n_best", "count_sum"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return aligned.groupBy("chunk").cogroup(graded.groupBy("chunk")).applyInArrow(grade, f"{fields}, n_best long, count_sum long")
