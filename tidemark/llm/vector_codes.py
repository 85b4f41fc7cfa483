"""Product codes of integer vectors; the nearest codebook entry by slices and bitmasks.

Vectors are scaled to integers and cut into parts, each with a codebook of its own. Codebooks are
refined over all vectors: tasks assign parts and emit sums by entry, Spark adds these, and only
the codebooks (entries x width numbers) pass through the driver.

Nearest entry of a part:
1. For each dimension the entries' coordinates are sorted, and every position of this order
   carries the mask of the entries before it, one bit an entry in uint64 words.
2. The distance to the best of a few entries beside the vector's own coordinates is the initial
   radius. In each dimension it selects a range of the order; the masks at its ends, one without
   the other, are the entries in the range. ANDed over the dimensions they leave the entries of
   the box, which holds every entry as near as the radius.
3. These candidates are compared in whole numbers; ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators.skew import skew_join

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Integers are kept within this bound, so that squared distances are whole numbers of 63 bits.
BOUND = 1 << 24
#: Vectors of one step, and rows of an Arrow batch.
STEP = 1 << 11
_U = np.uint64


class Slices:
    """A codebook (entries x width whole numbers) with sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n, width = entries.shape
        words = -(-n // 64)
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, self.order, axis=0)
        bit = np.zeros((n, words), dtype=np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = _U(1) << (np.arange(n) % 64).astype(np.uint64)
        self.before = np.zeros((width, n + 1, words), dtype=np.uint64)
        for d in range(width):
            self.before[d, 1:] = np.bitwise_or.accumulate(bit[self.order[:, d]], axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every row's nearest entry."""
        n, width = self.entries.shape
        if not width:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        least = np.full(len(x), np.iinfo(np.int64).max)
        for d in range(width):
            beside = self.order[np.minimum(np.searchsorted(self.sorted[:, d], x[:, d]), n - 1), d]
            least = np.minimum(least, self._distance(x, beside))
        # The whole number at or above the root of the least distance.
        radius = np.sqrt(least.astype(np.float64)).astype(np.int64) + 1
        inside = np.full((len(x), self.before.shape[2]), ~_U(0))
        for d in range(width):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, side="right")
            inside &= self.before[d, high] & ~self.before[d, low]
        bits = np.unpackbits(inside.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little", count=n)
        row, entry = np.nonzero(bits)
        distance = self._distance(x[row], entry)
        begin = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(distance, begin)
        # Candidates of a row ascend, so the first at the least distance has the lower index.
        at = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(begin, len(row)))))
        first = at[np.searchsorted(row[at], np.arange(len(x)))]
        return entry[first], best

    def _distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)


def _cuts(width: int, parts: int) -> list[slice]:
    return [slice(width * i // parts, width * (i + 1) // parts) for i in range(parts)]


def _integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """A batch's vectors, all of one width, as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -BOUND, BOUND).astype(np.int64).reshape(-1, width)


def learn(usable: DataFrame, scale: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The final codebook of each part; `usable` has (id, v) with equal widths."""
    spark = usable.sparkSession
    first = usable.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    width = len(first[0]["v"])
    start = _integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, width)
    books = [start[:, cut] for cut in _cuts(width, parts)]
    widest = max(b.shape[1] for b in books)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [Slices(b) for b in shared.value]
            total = [np.zeros_like(s.entries) for s in held]
            count = [np.zeros(len(s.entries), dtype=np.int64) for s in held]
            for batch in batches:
                x = _integers(batch.column(0), scale, width)
                for low in range(0, len(x), STEP):
                    for p, cut in enumerate(_cuts(width, parts)):
                        part = x[low : low + STEP, cut]
                        entry, _ = held[p].nearest(part)
                        np.add.at(total[p], entry, part)
                        count[p] += np.bincount(entry, minlength=len(count[p]))
            for p, (t, n) in enumerate(zip(total, count, strict=True)):
                used = np.flatnonzero(n)
                t = np.pad(t[used], ((0, 0), (0, widest - t.shape[1])))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * widest), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), lists], names=["p", "e", "n", "s"])

        added = usable.select("v").mapInArrow(sums, "p int, e int, n long, s array<long>").groupBy("p", "e")
        added = added.agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)))
        books = [b.copy() for b in books]
        # At most parts x entries rows.
        for row in added.collect():
            book = books[row["p"]]
            book[row["e"]] = [int(row[f"s{i}"]) // row["n"] for i in range(book.shape[1])]
    return books


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, keep: list[Column]) -> DataFrame:
    """(id, kept columns, v) of the rows whose vector is whole."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, code, error, label_error) of every usable row, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out. `code` lists the
    entries' indexes; `error` sums the squared distances of the parts and `label_error` the errors
    of equal labels, nulls together. Repeated rows and rows of one id are rows of their own; null
    ids stay and come last where the smallest ids are sought; equal ids are ordered by vector. All
    vectors have the width of the first row in this order; rows of another width have a null code
    and error. A width that is no multiple of the parts is cut as evenly as it goes. Scaled
    components stay within 2^24. An empty table gives an empty one and no codebooks. Other columns
    are not read, whatever their names.
    """
    common.configure(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vector_col, [F.col(label_col).alias("label")])
    head = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    width = len(head[0]["v"]) if head else 0
    fits = F.size("v") == width
    books = learn(rows.filter(fits).select("id", "v"), scale, parts, entries, rounds)
    shared = spark.sparkContext.broadcast(books)
    kind = rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Slices(b) for b in shared.value]
        for batch in batches:
            x = _integers(batch.column(2), scale, width)
            found = np.zeros((len(x), parts), dtype=np.int32)
            error = np.zeros(len(x), dtype=np.int64)
            for low in range(0, len(x), STEP):
                for p, cut in enumerate(_cuts(width, parts)):
                    found[low : low + STEP, p], distance = held[p].nearest(x[low : low + STEP, cut])
                    error[low : low + STEP] += distance
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], names=["id", "label", "code", "error"])

    coded = rows.filter(fits).select("id", "label", "v").mapInArrow(code, f"id long, label {kind}, code array<int>, error long")
    other = rows.filter(~fits).select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = common.stored(coded.unionAll(other).withColumn("_row", F.monotonically_increasing_id()), "codes")
    # Labels are joined by their text, nulls by a flag of their own.
    keyed = coded.withColumns({"_null": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = common.stored(keyed.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    out = skew_join(keyed, sums.drop("n"), ["_null", "_label"], salt_by="_row", counts=sums.drop("label_error"))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
