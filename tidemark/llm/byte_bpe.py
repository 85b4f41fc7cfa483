"""Byte-level BPE on padded numpy matrices, and its inverse.

A text is cut by a pattern into pieces, and a piece's ids depend on the piece alone, so a worker
encodes each new piece once and remembers it. New pieces are dealt into buckets of like length,
each a matrix of byte tokens padded to one width:

1. The rank of every adjacent pair is looked up in an open-addressing hash table.
2. In each round every row merges its leftmost pair of minimum rank. What lies right of the pair
   moves one place left, so all rows are one token narrower, and only the two pairs beside the
   new token are looked up again.
3. Rows without a mergeable pair are done and leave the matrix, which is compacted.

A piece of more than WIDEST bytes is a row of its own. Equal minimum pairs of such a row are
merged in one round, from the left up to the first one that makes a pair of the same or a lower
rank; merging them one by one gives the same tokens.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

NONE = np.int32(0x7FFFFFFF)
#: Widths of the matrices, and cells of one matrix.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
WIDEST = WIDTHS[-1]
CELLS = 1 << 20
#: Characters of pieces that a worker remembers before it starts anew.
REMEMBERED = 1 << 22
#: Characters of the texts that are encoded together.
TOGETHER = 1 << 21
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_ODD = _U(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing with linear probing: (left id, right id) to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = _U(64 - bits), _U((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        key = self._key(left, right)
        at = (key * _ODD) >> self.shift
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] == _EMPTY]
            self.keys[at[free]] = key[free]
            put = self.keys[at[todo]] == key[todo]
            self.values[at[todo[put]]] = merged[todo[put]]
            todo = todo[~put]
            at[todo] = (at[todo] + _U(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << _U(32)) | right.astype(np.uint64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, NONE where a pair does not merge. Ids are not negative."""
        key = self._key(left, right).ravel()
        at = (key * _ODD) >> self.shift
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], NONE)
        todo = np.flatnonzero((seen != key) & (seen != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + _U(1)) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != _EMPTY)]
        return out.reshape(left.shape)


class TokenBytes:
    """The bytes of all ids behind each other; an id without a token has length -1."""

    def __init__(self, tokens: dict[int, bytes]):
        by_id = sorted(tokens.items())
        self.lengths = np.full(by_id[-1][0] + 1, -1, dtype=np.int64)
        self.lengths[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        held = np.maximum(self.lengths, 0)
        self.starts = np.cumsum(held) - held

    def join(self, ids: np.ndarray) -> np.ndarray | None:
        """The bytes of the ids; None if one of them is no token."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            return None
        n = self.lengths[ids]
        if len(n) and n.min() < 0:
            return None
        end = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]


class ByteBpe:
    """Ids of texts and bytes of ids, for tokens of bytes whose ids are their ranks.

    Every single byte must be a token. Any two tokens whose joined bytes are a token merge, and a
    piece that is a token is that token at once. With `pairs` (left, right, merged id; rows in
    order of rank), only these merge and pieces are always built from their bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: np.ndarray | None = None):
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing}")
        self.pieces = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.at_once = ranks if pairs is None else {}
        if pairs is None:
            splits = [(ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t))]
            pairs = np.array([s for s in splits if s[0] is not None and s[1] is not None], dtype=np.int32).reshape(-1, 3)
        self.pairs = PairTable(*pairs.T)
        self.known: dict[str, bytes] = {}
        self.room = REMEMBERED
        self.text_of = TokenBytes({i: t for t, i in ranks.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts; their new pieces are merged together."""
        pieces = [self.pieces(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        self.room -= sum(map(len, new))
        if self.room < 0:
            self.known.clear()
            new = set().union(*pieces)
            self.room = REMEMBERED - sum(map(len, new))
        self._learn(list(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), dtype=np.int32) for p in pieces]

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        open_: list[int] = []
        for i, r in enumerate(raw):
            whole = self.at_once.get(r)
            if whole is None:
                open_.append(i)
            else:
                self.known[pieces[i]] = np.int32(whole).tobytes()
        size = np.array([len(raw[i]) for i in open_], dtype=np.int64)
        bucket = np.searchsorted(WIDTHS, size)
        for b in np.unique(bucket):
            members = [open_[k] for k in np.flatnonzero(bucket == b)]
            if b == len(WIDTHS):
                for i in members:
                    self.known[pieces[i]] = self.merge_long(self.byte_ids[np.frombuffer(raw[i], np.uint8)]).tobytes()
                continue
            step = max(1, CELLS // WIDTHS[b])
            for low in range(0, len(members), step):
                part = members[low : low + step]
                for i, ids in zip(part, self.merge_rows([raw[i] for i in part], WIDTHS[b]), strict=True):
                    self.known[pieces[i]] = ids

    def merge_rows(self, raw: list[bytes], width: int) -> list[bytes]:
        """Ids, as int32 bytes, of pieces of at most `width` bytes."""
        length = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
        tokens = self.byte_ids[flat]
        ranks = self.pairs.find(tokens[:, :-1], tokens[:, 1:])
        ranks[np.arange(1, width) >= length[:, None]] = NONE
        row = np.arange(len(raw))
        out: list[bytes] = [b""] * len(raw)
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            ends = best == NONE
            if ends.any():
                for i, ids, n in zip(row[ends], tokens[ends], length[ends], strict=True):
                    out[i] = ids[:n].tobytes()
                go = ~ends
                row, tokens, ranks, length, at, best = row[go], tokens[go], ranks[go], length[go], at[go], best[go]
                if not len(row):
                    break
            every = np.arange(len(row))
            # What is right of the pair moves left; the merged token takes the pair's first place.
            place = np.arange(tokens.shape[1] - 1)
            tokens = np.where(place > at[:, None], tokens[:, 1:], tokens[:, :-1])
            tokens[every, at] = best
            ranks = np.where(place[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            length = length - 1
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(tokens[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < length - 1)
            ranks[right, at[right]] = self.pairs.find(best[right], tokens[right, at[right] + 1])
            last = np.flatnonzero((at >= length - 1) & (at < ranks.shape[1]))
            ranks[last, at[last]] = NONE
        return out

    def merge_long(self, tokens: np.ndarray) -> np.ndarray:
        """Ids of one piece of any length."""
        ranks = self.pairs.find(tokens[:-1], tokens[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # Of pairs that overlap, every second one from the left.
            start = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]
            # Pairs that each merge makes, when those left of it are done; a missing side is NONE.
            beside = np.concatenate([[False], np.diff(at) == 2])
            before = np.where(beside, best, tokens[np.maximum(at - 1, 0)])
            left = np.where(at > 0, self.pairs.find(before, np.full(len(at), best)), NONE)
            after = tokens[np.minimum(at + 2, len(tokens) - 1)]
            right = np.where(at + 2 < len(tokens), self.pairs.find(np.full(len(at), best), after), NONE)
            low = np.flatnonzero((left <= best) | (right <= best))
            if len(low):
                at = at[: low[0] + 1]
            keep = np.ones(len(tokens), dtype=bool)
            keep[at + 1] = False
            tokens[at] = best
            tokens = tokens[keep]
            ranks = ranks[keep[1:]]
            new = at - np.arange(len(at))
            fresh = np.unique(np.concatenate([new[new > 0] - 1, new[new < len(tokens) - 1]]))
            ranks[fresh] = self.pairs.find(tokens[fresh], tokens[fresh + 1])
        return tokens


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about TOGETHER characters; a longer text is a run of its own."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


@functools.lru_cache(maxsize=2)
def load(ranks: bytes, pattern: str) -> ByteBpe:
    """The tables of a rank file (a base64 token and its rank a line), built once a process."""
    return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}, pattern)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) with the token ids of every row's whole text.

    A null or empty text has no ids. Rows are independent: repeated rows, equal ids and null ids
    stay as they are, and an empty table gives an empty one. Pairs of equal rank merge from the
    left. Other columns are not read, whatever their names.
    """
    common.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(*shared.value)
        for batch in batches:
            found = []
            for part in _steps([t or "" for t in batch.column(1).to_pylist()]):
                found += bpe.encode(part)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, raw) with the bytes of every row's ids.

    No ids give no bytes. A null list, and one with a null or an id that is no token, gives null.
    Other columns are not read, whatever their names.
    """
    common.configure(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(*shared.value)
        for batch in batches:
            raw = []
            for row in batch.column(1):
                whole = row.is_valid and not row.values.null_count
                found = bpe.text_of.join(row.values.to_numpy(zero_copy_only=False)) if whole else None
                raw.append(None if found is None else found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["id", "ids", "raw"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, raw binary").withColumnRenamed("id", id_col)
