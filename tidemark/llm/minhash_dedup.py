"""MinHash near-duplicate detection with exact links and exact components.

1. Every text becomes the set of its 5-word shingles (64-bit hashes). 160 universal hash
   functions give a signature, cut into 32 bands of 5 minima. Equal sets collapse at once.
2. Documents that share a band form a bucket. Each member is verified on full sets against
   the bucket's smallest id, so a bucket of m documents costs m comparisons.
3. Components of the verified links come from alternating large-star and small-star.
4. Buckets that still hold several components are searched exactly: an inverted index of the
   shingles inside a bucket counts every intersection between components. A large bucket is cut
   into chunks and each pair of chunks is one task. Only links leave a task.

A link of similarity 0.75 misses every band with probability 0.0002; nothing else is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 5
SEED = 20240607
#: Shingles of the documents in one chunk of a bucket, on average.
CHUNK_SHINGLES = 1 << 19
_U = np.uint64


def _functions(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)
    return a, rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(out, (shingles[at : at + 512, None] * a + b).min(axis=0), out=out)
    return out


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for low, high, words in common.steps(batch.column("_raw"), common.BLANK):
        for i in range(high - low):
            yield np.unique(common.shingle_hashes(words.hashes[words.at[i] : words.at[i + 1]], shingle))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, two set fingerprints, band keys) of every row; no bands for an empty set."""
    a, b = _functions(bands, rows)
    salts = np.arange(1, bands + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for one in _sets(batch, shingle):
                sizes.append(len(one))
                prints.append((int(one.sum(dtype=np.uint64)) & (2**63 - 1), int(common.mix(one).sum(dtype=np.uint64)) & (2**63 - 1)))
                if not len(one):
                    keys.append(None)
                    continue
                rest = salts.copy()
                for column in _minima(one, a, b).reshape(bands, rows).T:
                    rest = common.mix(rest ^ column) * _U(0x9FB21C651E98DF25)
                keys.append(rest.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "fp1", "fp2", "bands"],
            )

    raw = common.text_bytes(docs, F.col(id_col).cast("long").alias("id"), text=text_col)
    return raw.mapInArrow(run, "id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, shingles) with the sorted 64-bit shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch, shingle)], pa.binary())], names=["id", "shingles"])

    return common.text_bytes(docs, F.col(id_col).cast("long").alias("id"), text=text_col).mapInArrow(run, "id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = small + large - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (small + large - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _cross_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """One link for every two components of a group of sets that have one."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    posting = np.empty(len(values), dtype=np.int64)
    posting[order] = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1
    length = np.diff(np.append(begin, len(values)))
    ends = np.cumsum(sizes)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(len(sets)):
        if sizes[i] == 0:
            continue
        mine = posting[ends[i] - sizes[i] : ends[i]]
        mine = mine[length[mine] > 1]
        n = length[mine]
        total = int(n.sum())
        if not total:
            continue
        spots = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        both = np.bincount(owner[spots], minlength=len(sets))
        hits = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (comps != comps[i]))
        for j in hits[hits > i]:
            pair = (min(comps[i], comps[j]), max(comps[i], comps[j]))
            found.setdefault(pair, (int(ids[i]), int(ids[j])))
    return list(found.values())


def cross_component_links(rows: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Exact links between components that share a bucket; rows: key, id, n_shingles, comp.

    A bucket with more shingles than a chunk is dealt out by id, and every two of its chunks
    meet in one task, so a task's size does not grow with the bucket.
    """
    width = rows.groupBy("key").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.ceil(F.sum("n_shingles") / F.lit(chunk)).cast("int").alias("_chunks")
    )
    width = width.filter("_lo <> _hi").drop("_lo", "_hi")
    tasks = (
        rows.join(width, "key")
        .withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .select("key", F.least("_c", "_o").alias("lo"), F.greatest("_c", "_o").alias("hi"), "id", "comp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: list) -> pa.RecordBatch:
            ids, comps, blobs = zip(*group, strict=True)
            comps = np.array(comps)
            links = _cross_links(np.array(ids), comps, [np.frombuffer(b, dtype=np.uint64) for b in blobs], percent) if (comps != comps[0]).any() else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        at, group = None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "id", "comp", "shingles")), strict=True)
            for key, lo, hi, one, comp, blob in rows:
                if (key, lo, hi) != at:
                    if group:
                        yield close(group)
                    at, group = (key, lo, hi), []
                group.append((one, comp, blob))
        if group:
            yield close(group)

    dealt = tasks.join(sets, "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    return dealt.select("key", "lo", "hi", "id", "comp", "shingles").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    chunk: int = CHUNK_SHINGLES,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Null, empty and blank texts have no shingle and link with nothing; a text of fewer words
    than a shingle is one shingle. Rows of one id are one document: a link of any of them
    links all. A row without id keeps a null component and is kept. Other columns are not read.
    """
    common.configure(docs.sparkSession)
    sig = common.stored(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    least = sig.filter("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("id").alias("rep"))
    members = common.stored(
        sig.filter("n_shingles > 0").join(least, ["fp1", "fp2", "n_shingles"]).select("id", "n_shingles", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")),
        "members",
    )
    keyed = members.filter("id = rep").select("id", "n_shingles", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).filter("leader <> _last")
    buckets = common.stored(keyed.join(shared.drop("_last"), "key"), "buckets")
    wanted = buckets.select(F.col("id").alias("_id")).distinct().hint("shuffle_hash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = common.stored(shingle_sets(texts.join(wanted, F.col("id") == F.col("_id"), "left_semi"), "id", "text", shingle).distinct(), "sets")

    pairs = buckets.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    links = common.stored(verified(pairs, sets, percent), "links")
    first = common.stored(components(links, "a", "b"), "components")
    mapped = buckets.select("key", "id", "n_shingles").join(first.withColumnRenamed("node", "id"), "id", "left")
    mapped = mapped.select("key", "id", "n_shingles", F.coalesce("component", "id").alias("comp"))
    more = common.stored(cross_component_links(mapped, sets, percent, chunk), "links")
    if more.isEmpty():
        final = first
    else:
        final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b")

    grouped = members.select("id", "rep").filter("id is not null").distinct()
    own = grouped.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sig.select("id", "n_shingles").join(own, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
