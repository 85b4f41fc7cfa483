"""Shards along a Hilbert curve over quantised metadata.

Size, language, source and id are each quantised to eight levels at the quantiles of the whole
table, the levels of a row name one of 4096 cells, and cells are ordered along the Hilbert
curve, so that a run of rows is narrow in every dimension and a reader that filters on any of
them skips most files. Runs of equal row counts are cut from that order.

Only cell totals (4096 at most) and quantile edges reach the driver. The rank of a row is the
total of the cells before it, plus the total of the chunks before it in its cell, plus its
number in its chunk; a cell has as many chunks as the table's size asks for, so a source with a
third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

BITS = 3
SHARDS = 24
#: Rows of the table for one chunk of a cell.
CHUNK_ROWS = 50_000


def hilbert_index(levels: Sequence[int], bits: int) -> int:
    """Distance along the Hilbert curve of a point with coordinates of `bits` bits."""
    x = list(levels)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | ((v ^ flip) >> b & 1)
    return out


def name_edges(names: DataFrame, cuts: Sequence[float], chunk_rows: int = CHUNK_ROWS) -> list[str]:
    """The names of a one-column frame at the given shares of its rows, in sort order.

    Whole names are counted, dealt into ranges of about `chunk_rows` names and summed range by
    range; one total per range and one name per cut reach the driver. Nulls sort first and are
    never an edge.
    """
    counts = common.stored(names.toDF("name").groupBy("name").agg(F.count(F.lit(1)).alias("n")), "names")
    ranges = max(1, -(-counts.count() // chunk_rows))
    dealt = counts.repartitionByRange(ranges, "name").withColumn("part", F.spark_partition_id())
    dealt = common.stored(dealt, "ranges")
    at, starts = 0, []
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["n"]
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy("name"))
    # One row per range of names is broadcast.
    starts = F.broadcast(names.sparkSession.createDataFrame(starts, "part int, _start long"))
    placed = dealt.join(starts, "part").withColumn("_to", F.col("_start") + up_to)
    marks = F.array(*[F.lit(max(1, math.ceil(c * at))).cast("long") for c in cuts])
    edges = placed.filter(F.exists(marks, lambda m: (m > F.col("_to") - F.col("n")) & (m <= F.col("_to"))) & F.col("name").isNotNull())
    return sorted(r["name"] for r in edges.select("name").collect())


def hilbert_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    number_cols: Sequence[str] = (),
    name_cols: Sequence[str] = ("lang", "source"),
    *,
    shards: int = SHARDS,
    bits: int = BITS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(id, size, text_crc32, cell, shard, slot) for every row; shard sizes differ by one row at most.

    Size is the UTF-8 length plus 8. A null text has size 8 and checksum 0, as an empty one. A
    null in a dimension is its lowest level; names are told apart by all their characters. Ties follow chunk, id, size and checksum; rows equal
    in all of them are interchangeable. An empty table gives no rows. Other columns are not read.
    """
    common.configure(docs.sparkSession)
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    dims = [(F.octet_length(raw) + 8).cast("long"), *(F.col(c).cast("double") for c in number_cols), *(F.col(c).cast("string") for c in name_cols), F.col(id_col).cast("long")]
    names = [f"_d{i}" for i in range(len(dims))]
    rows = docs.select(F.col(id_col).alias("id"), F.crc32(raw).alias("text_crc32"), *(d.alias(n) for d, n in zip(dims, names, strict=True)))
    rows = common.stored(rows.withColumn("size", F.col("_d0")), "sizes")

    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = names[1 + len(number_cols) : -1]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(n, cuts, 1000).alias(n) for n in names if n not in texts)).first()
    total = stats["n"]
    edges = {n: name_edges(rows.select(n), cuts, chunk_rows) if n in texts else sorted(set(stats[n] or [])) for n in names}
    chunks = max(8, -(-total // chunk_rows))
    code = F.lit(0)
    for n in names:
        level = F.lit(0)
        for edge in edges[n]:
            level = level + F.when(F.col(n) > F.lit(edge), 1).otherwise(0)
        code = code * (1 << bits) + level
    placed = rows.select("id", "size", "text_crc32", code.cast("int").alias("code"), F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"))

    counts = placed.groupBy("code", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("code").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = common.stored(counts.withColumn("_before", F.coalesce(before, F.lit(0))), "chunks")
    cells = counts.groupBy("code").agg(F.sum("_n").alias("n")).collect()
    mask = (1 << bits) - 1
    curve = sorted((hilbert_index([c["code"] >> bits * (len(names) - 1 - i) & mask for i in range(len(names))], bits), c["code"], c["n"]) for c in cells)
    at, starts = 0, []
    for cell, key, n in curve:
        starts.append((key, cell, at))
        at += n
    starts = spark.createDataFrame(starts, "code int, cell int, _start long")

    number = F.row_number().over(Window.partitionBy("code", "chunk").orderBy("id", "size", "text_crc32")) - 1
    # At most one row per cell of the fixed grid is broadcast.
    ranked = placed.withColumn("_i", number).join(counts.drop("_n"), ["code", "chunk"]).join(F.broadcast(starts), "code")
    rank = F.col("_start") + F.col("_before") + F.col("_i")
    n = F.lit(max(total, 1))
    ranked = ranked.select("id", "size", "text_crc32", "cell", rank.alias("_rank")).withColumn("shard", F.expr(f"_rank * {shards}") % n)
    ranked = ranked.withColumn("shard", ((F.col("_rank") * shards - F.col("shard")) / n).cast("int"))
    first = F.ceil((F.col("shard") * n).cast("decimal(38,0)") / shards).cast("long")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "cell", "shard", (F.col("_rank") - first).alias("slot"))
