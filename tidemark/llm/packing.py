"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the sequence length, so the plan needs only the count of every
length, at most 2048 numbers whatever the corpus size:

1. Large pieces, longest first, are cut into groups of equal cardinality and rounded up to the
   longest of their group.
2. For these few sizes configurations are chosen one after the other: the fullest sum that
   holds the largest size left, used as often as the counts allow.
3. Actual lengths replace the rounded ones, in order, which splits a configuration into runs of
   equal sequences.
4. Small pieces go into the tightest gap that takes them, longest first, by whole runs; the rest
   fill sequences of their own.

The plan is a list of (length, first rank, count, first sequence, offset). A piece finds its
place from its rank among the pieces of its length. Ranks are counted by chunks of documents, so
a length that a third of the pieces share is numbered by many tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

CAPACITY = 2048
GROUPS = 1024
#: Pieces up to this share of a sequence are small.
SMALL = 1 / 4
END_ID = 0
#: Distinct pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000

# Texts of these characters only need none of the tokenizer's rarer rules: blanks, printable
# ASCII and the Latin-1 letters, all of which Unicode normalisation leaves alone.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
# The tokenizer's own pieces, for lower-cased plain text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level alphabet: bytes without a printable form take the code points from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class Encoder:
    """Token ids of texts as little-endian bytes.

    A piece's ids depend on the piece alone, so they are kept by piece. Plain texts are cut into
    pieces here and only new pieces reach the tokenizer's model; any other text, and any that
    may hold the name of a special token, goes through the whole tokenizer.
    """

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(json)
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self._by_blanks(text)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(pieces)
        tokens = self.whole.model.tokenize
        for piece in new:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            self.known[piece] = array("I", [t.id for t in tokens(shown)]).tobytes()
        return b"".join(map(self.known.__getitem__, pieces))

    def _by_blanks(self, text: str) -> bytes:
        """Nothing is joined across blanks, so plain words of other texts take the short way."""
        out, rare = [], []
        for word in text.translate(_BLANKS).split(" "):
            if "<|" in word or not _PLAIN.fullmatch(word):
                rare.append(len(out))
                out.append(word)
            else:
                out.append(self._plain(word) if word else b"")
        found = self.whole.encode_batch_fast([out[i] for i in rare], add_special_tokens=False)
        for i, e in zip(rare, found, strict=True):
            out[i] = array("I", e.ids).tobytes()
        return b"".join(out)


_BLANKS = str.maketrans("\n\t\r", "   ")
#: Pieces of the table for one chunk of a length.
CHUNK_PIECES = 100_000

Run = tuple[tuple[int, ...], int]


def _fullest(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """Places of the items of the fullest configuration with the item `first`; sizes descend."""
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    by = np.full(room + 1, -1, dtype=np.int64)
    for j in range(first, len(sizes)):
        if sizes[j] > room:
            continue
        left = counts[j] - (j == first)
        # The first item to reach a sum is kept, so a path uses every item once at most per round.
        for _ in range(min(left, room // sizes[j])):
            fresh = np.zeros_like(reach)
            fresh[sizes[j] :] = reach[: room + 1 - sizes[j]]
            fresh &= ~reach
            if not fresh.any():
                break
            by[fresh] = j
            reach |= fresh
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    out = [first]
    while at:
        out.append(int(by[at]))
        at -= sizes[int(by[at])]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(places, times) that use every item once; sizes descend and are distinct places."""
    counts = list(counts)
    out = []
    for first in range(len(sizes)):
        while counts[first]:
            # Only what is left takes part, so each call narrows down.
            live = [j for j in range(first, len(sizes)) if counts[j]]
            picked = [live[p] for p in _fullest([sizes[j] for j in live], [counts[j] for j in live], 0, capacity)]
            uses = Counter(picked)
            times = min(counts[j] // n for j, n in uses.items())
            for j, n in uses.items():
                counts[j] -= n * times
            out.append((picked, times))
    return out


def _groups(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Equal-cardinality groups of (length, count), longest first; a length may be in two."""
    total = sum(n for _, n in lengths)
    out: list[list[list[int]]] = []
    seen = 0
    bounds = [total * (g + 1) // groups for g in range(groups)]
    g = 0
    current: list[list[int]] = []
    for length, n in lengths:
        while n:
            while bounds[g] <= seen:
                g += 1
            take = min(n, bounds[g] - seen)
            current.append([length, take])
            seen += take
            n -= take
            if seen == bounds[g]:
                out.append(current)
                current = []
    return out


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[Run]:
    """Runs (lengths, count of equal sequences) that hold every piece of the histogram once."""
    order = sorted(((length, n) for length, n in histogram.items() if n), reverse=True)
    large = [x for x in order if x[0] > small * capacity]
    runs: list[Run] = []
    if large:
        parts = _groups(large, max(1, groups))
        for places, times in configurations([p[0][0] for p in parts], [sum(n for _, n in p) for p in parts], capacity):
            # One queue per slot: the next `times` actual lengths of its group.
            slots = []
            for place in places:
                need, slot = times, []
                while need:
                    head = parts[place][0]
                    take = min(need, head[1])
                    slot.append([head[0], take])
                    head[1] -= take
                    need -= take
                    if not head[1]:
                        parts[place].pop(0)
                slots.append(slot)
            left = times
            while left:
                n = min(s[0][1] for s in slots)
                runs.append((tuple(s[0][0] for s in slots), n))
                left -= n
                for s in slots:
                    s[0][1] -= n
                    if not s[0][1]:
                        s.pop(0)
    gaps: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        gaps[capacity - sum(run[0])].append(run)
    rest: list[tuple[int, int]] = []
    for length, n in (x for x in order if x[0] <= small * capacity):
        gap = length
        while n and gap <= capacity:
            if not gaps[gap]:
                gap += 1
                continue
            inside, count = gaps[gap].pop()
            take = min(n, count)
            if take < count:
                gaps[gap].append((inside, count - take))
            gaps[gap - length].append(((*inside, length), take))
            n -= take
            if gap - length >= length:
                gap = length
        if n:
            rest.append((length, n))
    out = [run for runs in gaps for run in runs]
    if rest:
        sizes = [length for length, _ in rest]
        out += [(tuple(sizes[p] for p in places), times) for places, times in configurations(sizes, [n for _, n in rest], capacity)]
    return out


def places(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), sorted by length and rank."""
    used: Counter[int] = Counter()
    rows = []
    base = 0
    for lengths, count in runs:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], count, base, offset))
            used[length] += count
            offset += length
        base += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row's tokens and the end id.

    Null texts are empty.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(shared.value)
        last = int(end_id).to_bytes(4, "little")
        width = 4 * capacity
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                blob = encode(text or "") + last
                for piece, at in enumerate(range(0, len(blob), width)):
                    part = blob[at : at + width]
                    for column, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    small: float = SMALL,
    end_id: int = END_ID,
    chunk_pieces: int = CHUNK_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece.

    A null or empty text is the end id alone. Only documents longer than a sequence are cut.
    Repeated rows are packed each; rows equal in id, piece and checksum are interchangeable. An
    empty table gives no rows. Other columns are not read.
    """
    common.configure(docs.sparkSession)
    cut = common.stored(pieces(docs, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = max(8, -(-sum(histogram.values()) // chunk_pieces))
    table = places(plan_runs(histogram, capacity, groups, small))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    dealt = cut.withColumn("_chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(chunks)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")).select("length", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_i", number).join(counts, ["length", "_chunk"])
    names = cut.columns
    ranked = ranked.select(*names, (F.col("_before") + F.col("_i")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        span = np.int64(1) << np.int64(48)
        starts = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() * span + rank, side="right") - 1
            columns = [batch.column(n) for n in names]
            columns += [pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, kinds + ", sequence_id long, offset long").withColumnRenamed("id", id_col)
