"""Benchmark decontamination over a distributed positional inverted index.

Documents are grouped into segments of bounded text. A segment is one stored row: its sorted
term hashes and, for every term, its sorted positions, with whole documents side by side and a
gap between them. The index is written to the shared folder once and serves any number of
searches.

A search takes the benchmark in slices of bounded size. In each segment every window starts
from its rarest term; the postings of the next rarest term, shifted by its offset, cut the
candidates down, and so on until all terms agree. What is left are exact phrase matches; with
`slack` the terms may lie that much further apart and in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

WINDOW = 13
#: Text bytes of one segment; a longer document is a segment of its own.
SEGMENT_BYTES = 1 << 17
#: Positions between documents; a phrase or its slack must not reach over it.
GAP = 64
#: Words of the benchmark that one search pass holds in memory.
SLICE_WORDS = 1_000_000

INDEX_SCHEMA = "segment long, doc_ids array<long>, n_words array<int>, doc_at binary, terms binary, starts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all rows. Null texts have no words; null ids stay null."""
    common.configure(docs.sparkSession)

    def segment(number: int, ids: pa.Array, words: common.Words) -> list:
        n = np.diff(words.at)
        doc = np.repeat(np.arange(len(n)), n)
        spot = np.arange(len(doc), dtype=np.int64) + doc * GAP
        order = np.argsort(words.hashes, kind="stable")
        terms, starts = np.unique(words.hashes[order], return_index=True)
        doc_at = np.concatenate([[0], np.cumsum(n + GAP)]).astype(np.int64)
        starts = np.append(starts, len(order)).astype(np.int32)
        return [number, ids.to_pylist(), n.astype(np.int32), doc_at.tobytes(), terms.tobytes(), starts.tobytes(), spot[order].astype(np.int32).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = ["segment", "doc_ids", "n_words", "doc_at", "terms", "starts", "positions"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.binary()] * 4
        for batch in batches:
            rows = []
            for low, high, words in common.steps(batch.column("_raw"), common.ALNUM, SEGMENT_BYTES):
                rows.append(segment(number, batch.column("id").slice(low, high - low), words))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    raw = common.text_bytes(docs, F.col(id_col).cast("long").alias("id"), text=text_col)
    return common.stored(raw.mapInArrow(run, INDEX_SCHEMA), "index")


class Windows:
    """The distinct windows of some items: term numbers by place, and the items of each."""

    def __init__(self, items: list, window: int):
        by_words: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        for row, (_, text) in enumerate(items):
            column = pa.array([(text or "").encode()], pa.binary())
            for _, _, words in common.steps(column, common.ALNUM):
                hashes = words.hashes
                for i in range(max(1, len(hashes) - window + 1) if len(hashes) else 0):
                    part = hashes[i : i + window]
                    by_words.setdefault(part.tobytes(), (part, set()))[1].add(row)
        parts = [p for p, _ in by_words.values()]
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.terms, flat = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
        # Places after the end of a short window repeat its last term.
        self.places = np.minimum(np.arange(window)[None, :], np.maximum(self.lengths, 1)[:, None] - 1)
        self.at = flat[np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)[:, None] + self.places] if parts else np.zeros((0, window), np.int64)
        self.items = [sorted(s) for _, s in by_words.values()]
        self.ids = [i for i, _ in items]


def _search(windows: Windows, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every match in one segment."""
    slot = np.searchsorted(terms, windows.terms)
    found = slot < len(terms)
    found[found] = terms[slot[found]] == windows.terms[found]
    df = np.where(found, np.diff(starts)[np.minimum(slot, len(terms) - 1)], 0) if len(terms) else np.zeros(len(windows.terms), np.int64)
    counts = df[windows.at]
    alive = np.flatnonzero(counts.min(axis=1) > 0) if len(counts) else np.zeros(0, np.int64)
    if not len(alive):
        return alive, alive
    rare = np.argsort(counts[alive], axis=1, kind="stable")
    pick = np.take_along_axis(windows.at[alive], rare, axis=1)
    place = np.take_along_axis(windows.places[alive], rare, axis=1)
    n = df[pick[:, 0]]
    which = np.repeat(np.arange(len(alive)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = positions[np.repeat(starts[slot[pick[:, 0]]], n) + inner].astype(np.int64) - place[which, 0]
    span = np.int64(1) << np.int64(33)
    keyed = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(starts)) * span + positions
    for j in range(1, pick.shape[1]):
        if not len(which):
            break
        key = slot[pick[which, j]].astype(np.int64) * span + begin + place[which, j]
        near = np.minimum(np.searchsorted(keyed, key - slack), len(keyed) - 1)
        ok = (keyed[near] >= key - slack) & (keyed[near] <= key + slack)
        which, begin = which[ok], begin[ok]
    return alive[which], begin


def matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """(segment, ordinal, item_id, first, last): maximal runs of matched words per document and item.

    `ordinal` is the document's place in its segment and `first`, `last` count its words from 0.
    With slack 0 matches are exact phrases; otherwise each term may lie up to `slack` words away
    from its place (slack under half the gap between documents). The benchmark may have any
    size: it is read in slices by the hash of its ids.
    """
    spark = index.sparkSession
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slices = -(-size // (2 * SLICE_WORDS)) or 1
    out = None
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        one = _matches(index, spark.sparkContext.broadcast(Windows([(r["item_id"], r["text"]) for r in part], window)), slack)
        out = one if out is None else out.unionAll(one)
    return out


def _matches(index: DataFrame, shared, slack: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            rows = []
            for segment, at, terms, starts, positions in zip(*(batch.column(c).to_pylist() for c in ("segment", "doc_at", "terms", "starts", "positions")), strict=True):
                at = np.frombuffer(at, np.int64)
                which, begin = _search(windows, np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32), np.frombuffer(positions, np.int32), slack)
                runs: dict[tuple[int, int], list] = {}
                for w, b in sorted(zip(which.tolist(), begin.tolist(), strict=True), key=lambda x: x[1]):
                    end = b + int(windows.lengths[w]) - 1
                    doc = int(np.searchsorted(at, max(b, 0), side="right")) - 1
                    low = int(at[doc])
                    span = (max(b - low, 0), end - low)
                    for row in windows.items[w]:
                        have = runs.setdefault((doc, row), [])
                        if have and span[0] <= have[-1][1] + 1:
                            have[-1][1] = max(have[-1][1], span[1])
                        else:
                            have.append(list(span))
                rows += [(segment, doc, windows.ids[row], first, last) for (doc, row), spans in runs.items() for first, last in spans]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["segment", "ordinal", "item_id", "first", "last"])

    return index.select("segment", "doc_at", "terms", "starts", "positions").mapInArrow(run, "segment long, ordinal int, item_id long, first int, last int")


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """(id, n_words, n_hit, item_ids, contaminated) for every document row.

    A word is hit if any exact window match covers it. A document is contaminated if at least
    `percent` of its words are hit. Null and empty texts have no words and no hits; repeated ids
    are judged row by row; an empty benchmark hits nothing.
    """
    index = build_index(docs, id_col, text_col)
    docs_of = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "_d"))
    docs_of = docs_of.select("segment", "ordinal", F.col("_d.doc_ids").alias(id_col), F.col("_d.n_words").cast("long").alias("n_words"))
    found = common.stored(matches(index, benchmark, window=window), "matches")
    order = Window.partitionBy("segment", "ordinal").orderBy("first", "last", "item_id")
    reach = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reach), F.lit(0))
    hits = found.withColumn("_fresh", fresh).groupBy("segment", "ordinal")
    hits = hits.agg(F.sum("_fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = docs_of.join(hits, ["segment", "ordinal"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct ids of contaminated documents; null ids are never among them."""
    judged = decontamination(docs, benchmark, id_col, text_col)
    return judged.filter(F.col("contaminated") & F.col(id_col).isNotNull()).select(id_col).distinct()
