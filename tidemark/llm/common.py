"""Shared helpers: intermediate tables on the shared folder and vectorised word hashing.

Texts reach Python as UTF-8 bytes in Arrow buffers. Word boundaries and 64-bit word hashes
are computed over the whole buffer at once, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one vectorised step; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of one Arrow batch: long texts must not meet in one large batch.
BATCH_ROWS = "128"

_ODD = 0x9E3779B97F4A7C15
_U = np.uint64

# Word characters of the two tokenisations, by byte; 0 separates. Bytes from 0x80 belong to
# letters outside ASCII and are kept.
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Everything but blank, tab, line ends and their kin.
BLANK_SPLIT = _lower.copy()
BLANK_SPLIT[[0x20, *range(0x09, 0x0E)]] = 0
#: Digits, letters and everything outside ASCII.
ALNUM_SPLIT = _lower.copy()
ALNUM_SPLIT[: 0x80][~np.isin(_lower[:0x80], [*range(48, 58), *range(97, 123)])] = 0
_BLANK_IS_WORD = np.ones(256, dtype=bool)
_BLANK_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM_IS_WORD = ALNUM_SPLIT != 0
BLANK = (_lower, _BLANK_IS_WORD)
ALNUM = (ALNUM_SPLIT, _ALNUM_IS_WORD)


def configure(spark: SparkSession) -> None:
    """Runtime settings of these jobs: adaptive skew handling and small Arrow batches."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@functools.lru_cache(maxsize=1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-llm-")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this process only where none is
    named, as in tests on a single machine."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_root()).rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends, no executor is needed."""
    spark = frame.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    if _open_scopes:
        _open_scopes[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path)


_open_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(paths: list[str]) -> Iterator[None]:
    """Within it, the paths of stored tables are also noted in `paths`."""
    _open_scopes.append(paths)
    try:
        yield
    finally:
        _open_scopes.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that no frame needs any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: Ids that may be broadcast, after they have been counted: 8 MB.
BROADCAST_IDS = 1_000_000


def without_ids(rows: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not in `gone`, a stored one-column frame of distinct ids.

    The ids are counted first. Few are broadcast, so the rows stay where they are; more are
    joined by a shuffle of both sides.
    """
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), id_col, "left_anti").select(*rows.columns)


def drawn(digest: Column, wanted: int, rows: int) -> Column:
    """True for about `wanted` of `rows` rows, chosen by a 64-bit digest: no number of rows is too
    large for it, and a row is chosen alike in every run."""
    if wanted >= rows:
        return F.lit(True)
    return digest.bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(-(-(wanted << 63) // rows))


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that no taken one equals, whatever their case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(frame: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text as UTF-8 bytes, the form Arrow passes without copies."""
    return frame.select(*keep, F.col(text).cast("binary").alias("_raw"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) > n:
        return
    size = max(STEP_BYTES + 1, n + 1)
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        steps = np.full(size, _ODD, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = inverse
        _inverses = np.multiply.accumulate(steps)


class Words:
    """Hashed words of a run of documents: `hashes`, `first` and `last` byte, `at` per document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: tuple[np.ndarray, np.ndarray]):
        lower, is_word = rule
        inside = is_word[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = inside[cut]
        stop[cut - 1] = inside[cut - 1]
        self.first = np.flatnonzero(begin)
        self.last = np.flatnonzero(stop)
        _grow(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((lower[data].astype(np.uint64) + _U(1)) * _powers[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.last + 1] - sums[self.first]) * _inverses[self.first])
        self.at = np.searchsorted(self.first, offsets)


def steps(column: pa.Array, rule: tuple[np.ndarray, np.ndarray], step: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Runs of rows (from, to, words) of a binary column, each of about `step` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + step, side="right")) - 1)
        high = min(high, len(column))
        part = offsets[low : high + 1]
        yield low, high, Words(raw[part[0] : part[-1]], part - part[0], rule)
        low = high


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; fewer words, but not none, make one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    # The run's digits double, or grow by one word, along the bits of n.
    total, width, base = words, 1, 0xD6E8FEB86659FD93
    for bit in bin(n)[3:]:
        total = total[:-width] * _U(pow(base, width, 1 << 64)) + total[width:]
        width *= 2
        if bit == "1":
            total = total[:-1] * _U(base) + words[width:]
            width += 1
    return mix(total + _U(n))
