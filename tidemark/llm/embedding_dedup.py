"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors are compared inside a part only (one label and one dimension). Equal vectors collapse
first. Spherical k-means splits each large part into cells, one home cell per vector, and each
cell that is still large once more, until cells are small or a split would not save work; so
cells follow the counted size of a part. Every split is fitted in a task of its own on a bounded
sample of its cell, and its centres are rows of a table. A pair at cosine c or more is at most a
chord of sqrt(2 - 2c) apart, so if a boundary between two cells separates it, one of the two is
within half that chord of the boundary; such vectors visit the cell beyond. Every link is
therefore met in some cell at each level and counted in the first of the cells both lie in. A
cell is cut into blocks and every two of its blocks are one task: a matrix product, of which only
link counts and a spanning forest of the links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components
from tidemark.operators.skew import skew_join

COSINE = 0.98
#: Vectors of a cell, cells that one split makes, vectors that k-means reads for one split.
CELL_ROWS = 512
FAN_OUT = 64
SAMPLE_ROWS = 2048
#: Vectors of a large cell that one task assigns at a time.
SALT_ROWS = 20_000
BLOCK_ROWS = 1024
SEED = 11
_ROUNDING = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of the rows of x, all of unit length; repeated centroids are dropped."""
    rng = np.random.default_rng(SEED)
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        home = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centers)
    return np.unique(centers, axis=0)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _beyond(x: np.ndarray, home: np.ndarray, other: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distance of each vector from the boundary between its home cell and another."""
    gap = centers[home] - centers[other]
    return (x * gap).sum(axis=1) / np.maximum(np.linalg.norm(gap, axis=1), 1e-12)


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row that has a link, and the smallest row that it reaches."""
    rows = np.flatnonzero(links.any(axis=1))
    near = links[np.ix_(rows, rows)]
    root = np.arange(len(rows))
    while len(rows):
        new = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    return rows, rows[root] if len(rows) else rows


def _visits(x: np.ndarray, centers: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell that a row lies in: its home and those within the margin."""
    home = (x @ centers.T).argmax(axis=1)
    rows, cells = [np.arange(len(x))], [home]
    for cell in range(len(centers)):
        near = np.flatnonzero((home != cell) & (_beyond(x, home, np.full(len(x), cell), centers) <= margin))
        rows.append(near)
        cells.append(np.full(len(near), cell))
    return np.concatenate(rows), np.concatenate(cells)


def fit_split(x: np.ndarray, k: int, margin: float) -> np.ndarray | None:
    """Centres of a split of a cell with the sample x; None where no split into k cells or fewer
    halves the pairs to compare without doubling the vectors."""
    while k >= 2:
        centers = spherical_kmeans(x, k)
        _, cells = _visits(x, centers, margin)
        held = np.bincount(cells, minlength=len(centers)).astype(float)
        if (held**2).sum() * 2 <= len(x) ** 2 and held.sum() <= 2 * len(x):
            return centers
        k //= 4
    return None


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_SPLIT = "part string, path string, n long, centers binary"
_PLACED = "part string, path string, id long, w long, x binary"


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.float64) for b in column.to_pylist()])


def _cells(reps: DataFrame, margin: float, cell_rows: int) -> DataFrame:
    """(part, path, id, w, x): every unit vector in every cell it lies in, a path of splits."""

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        n = rows.column("n")[0].as_py()
        centers = fit_split(_vectors(rows.column("x")), min(FAN_OUT, -(-n // cell_rows), len(rows) // 8), margin)
        found = [] if centers is None else [(key[0].as_py(), key[1].as_py(), n, centers.tobytes())]
        return _table(list(zip(*found, strict=True)) or [[]] * 4, _SPLIT)

    def assign(key: tuple, rows: pa.Table, split: pa.Table) -> pa.Table:
        open_, path = len(split) > 0, key[1].as_py()
        if not len(rows):
            return _table([[]] * 6, _PLACED + ", open boolean")
        at, paths = np.arange(len(rows)), [path] * len(rows)
        if open_:
            x = _vectors(rows.column("x"))
            centers = np.frombuffer(split.column("centers")[0].as_py(), np.float64).reshape(-1, x.shape[1])
            at, cells = _visits(x, centers, margin)
            paths = [f"{path}.{c}" for c in cells.tolist()]
        took = rows.take(pa.array(at))
        return _table([[key[0].as_py()] * len(at), paths, took.column("id").to_pylist(), took.column("w").to_pylist(), took.column("x").to_pylist(), [open_] * len(at)], _PLACED + ", open boolean")

    names = ["part", "path"]
    at, done = reps, []
    while True:
        sizes = common.stored(at.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "sizes")
        if sizes.filter(F.col("n") > cell_rows).isEmpty():
            done.append(at)
            break
        at = common.stored(skew_join(at, sizes, names, salt_by="id", counts=sizes), "sized")
        wide = at.filter(F.col("n") > cell_rows)
        done.append(at.filter(F.col("n") <= cell_rows).drop("n"))
        share = F.xxhash64("id", F.lit("split")).bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(float(1 << 63))
        sample = wide.filter(share <= F.lit(float(SAMPLE_ROWS)) / F.col("n"))
        splits = common.stored(sample.groupBy(*names).applyInArrow(fit, _SPLIT), "splits")
        salts = F.ceil(F.col("n") / SALT_ROWS)
        dealt = wide.withColumn("salt", F.pmod(F.xxhash64("id"), salts))
        copies = splits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        placed = dealt.groupBy(*names, "salt").cogroup(copies.groupBy(*names, "salt")).applyInArrow(assign, _PLACED + ", open boolean")
        placed = common.stored(placed, "cells")
        done.append(placed.filter(~F.col("open")).drop("open"))
        at = placed.filter("open").drop("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    cosine: float = COSINE,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    A null label, a null, empty or zero vector and one with a null or non-finite component link
    with nothing. Vectors of different length are never compared. Repeated rows of one id are one
    vector. A null id is kept with a null component. Other columns are not read.
    """
    common.configure(vectors.sparkSession)
    spark = vectors.sparkSession
    margin = float(np.sqrt(max(0.0, 2 - 2 * cosine))) / 2 + _ROUNDING
    v = F.col("v")
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    valid &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(valid).select("id", F.concat_ws(":", F.size("v"), "label").alias("part"), "v").distinct()
    copies = common.stored(rows.groupBy("part", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")), "copies")
    met = skew_join(rows, copies, ["part", "v"], salt_by="id", counts=copies.withColumnRenamed("w", "n"))
    members = common.stored(met.select("id", "rep", "part", "w", F.when(F.col("id") == F.col("rep"), F.col("v")).alias("v")), "vectors")
    reps = members.filter("id = rep").select("id", "part", "w", "v")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs: list = [None] * len(batch)
            vs = batch.column("v").to_pylist()
            for size in sorted({len(v) for v in vs}):
                at = [i for i, v in enumerate(vs) if len(v) == size]
                for i, row in zip(at, _unit([vs[i] for i in at]), strict=True):
                    blobs[i] = row.tobytes()
            yield _table([batch.column("part"), [""] * len(batch), batch.column("id"), batch.column("w"), blobs], _PLACED).combine_chunks().to_batches()[0]

    cells = _cells(common.stored(reps.select("part", "id", "w", "v").mapInArrow(unit, _PLACED), "units"), margin, cell_rows)
    # The cells of one vector are collected, its home and those whose boundary is near.
    cells = cells.groupBy("part", "id", "w", "x").agg(F.collect_list("path").alias("paths"))
    placed = common.stored(cells.withColumn("path", F.explode("paths")), "placed")
    width = common.stored(placed.groupBy("part", "path").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks")), "widths")
    tasks = skew_join(placed, width.drop("n"), ["part", "path"], salt_by="id", counts=width).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    tasks = tasks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    tasks = tasks.select("part", "path", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"), F.col("_b").alias("b"), "id", "w", "paths", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: tuple, group: list) -> pa.RecordBatch:
            _, path, lo, hi = key
            b, ids, w = (np.array([g[i] for g in group]) for i in range(3))
            x = np.stack([np.frombuffer(g[4], dtype=np.float64) for g in group])
            links = x @ x.T >= cosine
            links &= ids[:, None] != ids[None, :]
            if lo != hi:
                links &= b[:, None] != b[None, :]
            # A link is counted in the first of the cells that both vectors lie in.
            earlier = [[p for p in g[3] if p < path] for g in group]
            number = {p: i for i, p in enumerate(sorted({p for ps in earlier for p in ps}))}
            if number:
                lies = np.zeros((len(group), len(number)), dtype=np.float32)
                for row, ps in enumerate(earlier):
                    lies[row, [number[p] for p in ps]] = 1
                links &= lies @ lies.T == 0
            n = links @ w
            rows, root = _forest(links)
            a = np.concatenate([ids[rows], ids[rows]])
            other = np.concatenate([ids[root], np.full(len(rows), -1)])
            count = np.concatenate([np.zeros(len(rows), np.int64), n[rows]])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64(), mask=count > 0), pa.array(count, pa.int64())], names=["a", "b", "n"])

        at, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != at:
                    if len(group) > 1:
                        yield close(at, group)
                    at, group = row[:4], []
                group.append(row[4:])
        if len(group) > 1:
            yield close(at, group)

    names = ["part", "path", "lo", "hi"]
    dealt = tasks.repartition(*names).sortWithinPartitions(*names, "id")
    found = common.stored(dealt.mapInArrow(compare, "a long, b long, n long"), "links")
    groups = components(found.filter("n = 0"), "a", "b").withColumnRenamed("node", "rep")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    own = members.select("id", "rep", "w").join(counts, "rep", "left").join(groups, "rep", "left")
    own = own.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(own, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
