"""Repeated passages found by compact windows over token min-hashes.

A token is a 5-word shingle and a passage window is a run of 51 words (47 shingles).

1. For each hash function the Cartesian tree of a text's token hashes groups its subsequences by
   their minimum: a node (l, c, r) says that every subsequence inside [l, r] that holds c has the
   min-hash of c. Nodes shorter than a window are never made, so a function leaves about one node
   for 25 words. A node is emitted as the run of window starts that it decides.
2. Runs with equal min-hash in different texts are joined; in each text the runs of all functions
   are swept, which gives the starts at which enough functions are shared.
3. Starts where every function is shared are verified by the hash of all 51 words. This finds each
   passage of 51 words or more that two texts share word for word.
4. Other starts shared by at least two functions are near candidates. Texts that share the
   min-hashes of two functions at one start make a group; in it every start's window is compared,
   aligned at either minimum, with those of all other texts until one reaches a Jaccard similarity
   of 0.75 of shingles, the smallest id first. Windows with too many shingles that no other text
   of the group holds have no partner and are left out. A large group is cut into chunks and each
   pair of chunks is one task; only the smallest near id of a window leaves a task. A window at
   just 0.75 from its partner has two of four functions in common with probability 0.95; longer
   passages have more chances.

Texts equal as a whole are one text until the end, where all copies but the first are one passage.
An exact group of any size costs one row per member and function, and no pairs are formed inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common
from tidemark.operators.skew import skew_join

WORDS = 51
SHINGLE = 5
FUNCTIONS = 4
ENOUGH = 2
PERCENT = 75
SEED = 20240611
#: Shingles of one root of a tree, and of the trees that are built at once.
ROOT = 1 << 15
TOGETHER = 1 << 18
#: Bytes of a shingle's hash by which windows of one group are compared.
TOKEN = 4
#: Bits of that hash from which sets of bits are made, one after the other.
SHIFTS = (0, 8)
#: Rows of one chunk of a group, rows of groups that are verified at once, and windows of one step.
CHUNK_ROWS = 1 << 10
TASK_ROWS = 1 << 11
WINDOWS = 1 << 12
#: Rows of one exact window that one task takes.
WINDOW_ROWS = 20_000
_POSITION = 28
_U = np.uint64


def _slid(x: np.ndarray, window: int, join: np.ufunc) -> np.ndarray:
    """Every run of `window` values joined by an operation that may meet a value twice."""
    width = 1
    while 2 * width <= window:
        x = join(x[:-width], x[width:])
        width *= 2
    rest = window - width
    return join(x[: len(x) - rest], x[rest:]) if rest else x


def cartesian_windows(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (l, c, r) of the Cartesian trees over the ranges [first, last], of `least` width or more.

    A node that wide holds the minimum of some window of `least` places, and so do its parents: the
    trees are those over the windows' minima alone. There a node reaches to the nearest smaller
    minimum on each side, found by following those of the ones between. Equal hashes are ordered by
    scrambled position, so runs of one token make a balanced tree.
    """
    starts = np.maximum(last - first + 2 - least, 0)
    none = np.zeros(0, dtype=np.int64)
    if not starts.sum():
        return none, none, none
    mask = _U((1 << _POSITION) - 1)
    odd = 0x9E3779B1
    key = (hashes & ~mask) | ((np.arange(len(hashes), dtype=np.uint64) * _U(odd)) & mask)
    inverse = _U(pow(odd, -1, 1 << _POSITION))
    tree = np.repeat(np.arange(len(starts)), starts)
    least_at = _slid(key, least, np.minimum)[np.arange(len(tree)) + np.repeat(first - np.cumsum(starts) + starts, starts)]
    # Windows of one minimum follow each other.
    fresh = np.flatnonzero(np.concatenate([[True], (least_at[1:] != least_at[:-1]) | (tree[1:] != tree[:-1])]))
    key, tree = least_at[fresh], tree[fresh]
    place = ((key & mask) * inverse & mask).astype(np.int64)
    new = np.concatenate([[True], tree[1:] != tree[:-1]])
    end, count = len(key), np.arange(len(key))
    key, at = np.append(key, _U(0)), np.append(place, 0)

    def smaller(to: np.ndarray) -> np.ndarray:
        go = np.flatnonzero(key[to] > key[:-1])
        while len(go):
            to[go] = to[to[go]]
            go = go[key[to[go]] > key[go]]
        return to

    left, right = smaller(np.where(new, end, count - 1)), smaller(np.where(np.append(new[1:], True), end, count + 1))
    return np.where(left == end, first[tree], at[left] + 1), place, np.where(right == end, last[tree], at[right] - 1)


def start_runs(shingles: np.ndarray, lengths: np.ndarray, window: int, multipliers: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, c, s0, s1): for every function and node, the window starts s0..s1 it decides.

    Positions count a text's shingles. A long text is cut into roots that overlap by a window, so
    every start belongs to exactly one run of each function.
    """
    begin = np.cumsum(lengths) - lengths
    starts = np.maximum(lengths - window + 1, 0)
    roots = -(-starts // ROOT)
    text = np.repeat(np.arange(len(lengths)), roots)
    inner = (np.arange(len(text)) - np.repeat(np.cumsum(roots) - roots, roots)) * ROOT
    low = begin[text] + inner
    high = np.minimum(low + ROOT + window - 2, begin[text] + lengths[text] - 1)
    at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and high[to] - low[at] < TOGETHER:
            to += 1
        base, part = low[at], shingles[low[at] : high[to - 1] + 1]
        for f, multiplier in enumerate(multipliers):
            hashed = common.mix(part * multiplier)
            l, c, r = cartesian_windows(hashed, low[at:to] - base, high[at:to] - base, window)
            owner = text[at:to][np.searchsorted(low[at:to] - base, l, side="right") - 1]
            # Neighbouring roots overlap: the node's root is the one whose range holds it whole.
            s0, s1 = np.maximum(l, c - window + 1), np.minimum(c, r - window + 1)
            move = base - begin[owner]
            yield owner, common.mix(hashed[c] + _U(f)), c + move, s0 + move, s1 + move
        at = to


def _runs_of(found: common.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every text's runs of n words, and how many a text has: none with fewer words."""
    many = np.diff(found.at)
    if len(found.hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(len(many), np.int64)
    text = np.repeat(np.arange(len(many)), many)
    return common.shingle_hashes(found.hashes, n)[text[: len(text) - n + 1] == text[n - 1 :]], np.maximum(many - n + 1, 0)


def _window_rows(texts: DataFrame, words: int, functions: int) -> DataFrame:
    """(v, fp, c, s0, s1) of every distinct node."""
    window = words - SHINGLE + 1
    multipliers = np.random.default_rng(SEED).integers(0, 1 << 63, functions, dtype=np.uint64) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "fp", "c", "s0", "s1"]
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for low, high, found in common.steps(batch.column("_raw"), common.BLANK):
                flat, lengths = _runs_of(found, SHINGLE)
                for owner, v, c, s0, s1 in start_runs(flat, lengths, window, multipliers):
                    columns = [pa.array(v.view(np.int64)), pa.array(fp[low + owner])] + [pa.array(x.astype(np.int32)) for x in (c, s0, s1)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "v long, fp long, c int, s0 int, s1 int")


def _covered(n: int, s0: np.ndarray, s1: np.ndarray, need: int) -> np.ndarray:
    """Starts of a text that at least `need` functions share; runs of one function do not overlap."""
    count = np.zeros(n + 1, dtype=np.int32)
    np.add.at(count, s0, 1)
    np.add.at(count, np.minimum(s1, n - 1) + 1, -1)
    return np.cumsum(count)[:n] >= need


def _lists(column: pa.Array, *fields: str) -> Iterator[tuple[np.ndarray, ...] | None]:
    """The named fields of each row's list of structs as arrays, without Python objects."""
    for row in column:
        yield None if not row.is_valid else tuple(row.values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _flat_lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The row of every struct in lists of structs, and the named fields of all of them."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), tuple(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(id, fp, n) with the number of blank-separated words of each row."""
    _, is_word = common.BLANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for raw in batch.column("_raw"):
                inside = is_word[np.frombuffer(raw.as_buffer(), dtype=np.uint8)] if raw.is_valid and len(raw.as_buffer()) else np.zeros(1, dtype=bool)
                n.append(int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(n, pa.int32())], names=["id", "fp", "n"])

    return texts.mapInArrow(run, "id long, fp long, n int")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, functions: int = FUNCTIONS, enough: int = ENOUGH, percent: int = PERCENT, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """(id, first_word, last_word, n_words, passage_id, is_first, exact) for every repeated passage.

    Words are blank-separated and compared without the case of A-Z; positions count from 0.
    `passage_id` is the smallest id that holds any part of the passage, and `is_first` says that
    it is this one. Texts that are null or shorter than a window have no passages. A passage that
    repeats inside one text only is not reported. Rows of one id with different texts are reported
    under that id; rows without id are left out. Other columns are not read.
    """
    common.configure(docs.sparkSession)
    window = words - SHINGLE + 1
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col), F.octet_length(text_col)).alias("fp"), F.col(text_col).alias("text"))
    nodes = _window_rows(common.text_bytes(rows, "fp"), words, functions)
    # Half of a text's fingerprint tells texts apart here; it halves what is shuffled.
    half = F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    spent: list[str] = []
    # Every node is made, dealt and sorted once.
    held = Window.partitionBy("v")
    nodes = nodes.withColumn("_lo", F.min(half).over(held)).withColumn("_hi", F.max(half).over(held)).filter("_lo <> _hi").drop("_lo", "_hi")
    with common.scope(spent):
        hits = common.stored(nodes.dropDuplicates(), "nodes")

    reps = rows.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    runs = hits.groupBy("fp").agg(F.collect_list(F.struct("v", "c", "s0", "s1")).alias("runs"))
    wanted = runs.join(reps.select("fp", "id"), "fp").hint("shuffle_hash")
    texts = common.stored(rows.join(wanted, ["fp", "id"]).select("id", "fp", F.col("text").cast("binary").alias("raw"), "runs").dropDuplicates(["id", "fp"]), "texts")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column("id").to_numpy(), batch.column("runs")
            for low, high, found in common.steps(batch.column("raw"), common.BLANK):
                flat, lengths = _runs_of(found, words)
                begin = np.cumsum(lengths) - lengths
                text, (s0, s1) = _flat_lists(runs.slice(low, high - low), "s0", "s1")
                # The starts of all texts are one line; no run leaves its text.
                at = np.flatnonzero(_covered(len(flat), begin[text] + s0, begin[text] + np.minimum(s1, lengths[text] - 1), functions))
                text = np.searchsorted(begin, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), pa.array(ids[low + text]), pa.array((at - begin[text]).astype(np.int32))], names=["w", "id", "s"])

    common.remove(docs.sparkSession, spent)
    with common.scope(spent):
        starts = common.stored(texts.select("id", "raw", "runs").mapInArrow(exact, "w long, id long, s int"), "starts")
    same = starts.groupBy("w").agg(F.min("id").alias("passage_id"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("n")).filter("passage_id <> _last").drop("_last")
    with common.scope(spent):
        same = common.stored(same, "same")
    # A window that very many texts hold is met by several tasks.
    met = skew_join(starts, same.drop("n"), ["w"], salt_by=["id", "s"], counts=same.select("w", "n"), target=WINDOW_ROWS).select("id", "s", "passage_id", (F.col("id") == F.col("passage_id")).alias("is_first"))
    island = F.col("s") - F.row_number().over(Window.partitionBy("id", "is_first").orderBy("s"))
    spans = met.withColumn("_island", island).groupBy("id", "is_first", "_island")
    spans = spans.agg(F.min("s").alias("first_word"), (F.max("s") + words - 1).alias("last_word"), F.min("passage_id").alias("passage_id"))
    spans = common.stored(spans.select("id", "first_word", "last_word", "passage_id", "is_first", F.lit(True).alias("exact")), "spans")
    common.remove(docs.sparkSession, spent)

    near = _near(texts, spans, words, window, enough, percent, chunk)
    own = _word_counts(common.text_bytes(rows, "id", "fp"))
    copies = own.join(reps.filter("copies > 1").withColumnRenamed("id", "passage_id").drop("copies"), "fp").filter(F.col("n") >= words)
    copies = copies.select("id", F.lit(0).alias("first_word"), (F.col("n") - 1).alias("last_word"), "passage_id", (F.col("id") == F.col("passage_id")).alias("is_first"), F.lit(True).alias("exact"))
    out = spans.unionAll(near).unionAll(copies.distinct())
    return out.select(F.col("id").alias(id_col), "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), "passage_id", "is_first", "exact")


def _runs(rows: pa.Table) -> np.ndarray:
    """The number of each row's group (k, lo, hi) among sorted rows."""
    k, lo, hi = (rows.column(c).to_numpy() for c in ("k", "lo", "hi"))
    return np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))])


def _windows_met(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two matrices of shingles are as similar as sets; nx and ny count their distinct ones."""
    both = nx + ny - _distinct(np.concatenate([x, y], axis=1))
    return _similar(both, nx, ny, percent)


def _similar(both: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    return (100 * both >= percent * (nx + ny - both)) & (both > 0)


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = np.sort(rows, axis=1)
    return 1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1)


class Bits:
    """Every window's shingles as a set of 256 bits: a shingle that another window lacks leaves a
    bit that it lacks, or hides behind an equal one, so missing bits never exceed missing shingles."""

    def __init__(self, flat: np.ndarray, window: int):
        one = _U(1) << (flat & 63).astype(np.uint64)
        part = (flat >> 6) & 3
        self.words = [_slid(np.where(part == w, one, _U(0)), window, np.bitwise_or) for w in range(4)]

    def may_meet(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
        """False for pairs of windows that lack too many of each other's shingles to be as similar."""
        only_x, only_y = np.zeros(len(x), dtype=np.int16), np.zeros(len(x), dtype=np.int16)
        for word in self.words:
            a, b = word[x], word[y]
            only_x += np.bitwise_count(a & ~b)
            only_y += np.bitwise_count(b & ~a)
        need = percent * (nx + ny)
        return ((100 + percent) * (nx - only_x) >= need) & ((100 + percent) * (ny - only_y) >= need)


def _pair_key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(low.view(np.uint64)) + high.view(np.uint64)).view(np.int64)


def near_windows(
    group: np.ndarray, ids: np.ndarray, c1: np.ndarray, c2: np.ndarray, s0: np.ndarray, flat: np.ndarray, lengths: np.ndarray, window: int, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, first start, last start, smallest id) of the windows that have a near window of another
    id in their group, as runs of neighbouring starts.

    Rows are sorted by group and id; `flat` holds their shingles (32 bits of hash) from s0 on. Two
    windows are compared where they are aligned at either shared minimum. Every partner is tried,
    smallest id first, until one is near; a window goes untried only if too few of its shingles
    occur in any other text of its group for a partner to exist. Two rows are laid side by side
    once for each alignment that differs, with all their open windows. Bits tell most pairs that
    are not near, equal shingles at equal places most that are; sets are sorted for the others.
    """
    base = np.cumsum(lengths) - lengths
    n = lengths - window + 1
    member = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    at = base[member] + inner
    owner = np.repeat(np.arange(len(n)), lengths)
    # By shingle and place, so by shingle, group and id: rows are in this order.
    place = np.sort((flat.astype(np.uint64) << _U(32)) | np.arange(len(flat), dtype=np.uint64)).view(np.int64) & 0xFFFFFFFF
    row, token = owner[place], flat[place]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(place)), dtype=bool), (token[1:] != token[:-1]) | (group[row[1:]] != group[row[:-1]])]))
    end = np.append(begin[1:], len(place))[: len(begin)]
    # Shingles that two ids of the group hold.
    shared = np.zeros(len(flat) + 1, dtype=np.int64)
    shared[1:][place] = np.repeat(ids[row[begin]] != ids[row[end - 1]], end - begin)
    shared = np.cumsum(shared)
    # Where a shingle was last seen in its row: windows that hold both places have one less.
    before = np.full(len(flat), -1, dtype=np.int32)
    again = np.flatnonzero((token[1:] == token[:-1]) & (row[1:] == row[:-1]))
    before[place[again + 1]] = place[again]
    again, seen = place[again + 1], place[again]
    low = np.maximum(again - window + 1, base[owner[again]])
    again, seen, low = again[low <= seen], seen[low <= seen], low[low <= seen]
    less = np.bincount(low, minlength=len(flat) + 1) - np.bincount(seen + 1, minlength=len(flat) + 1)
    size_at = np.zeros(len(flat) + 1, dtype=np.int64)
    size_at[at] = window - np.cumsum(less)[at]
    alive = 100 * (shared[at + window] - shared[at]) >= percent * size_at[at]
    size_at[at[~alive]] = 0
    open_ = size_at > 0
    left = np.bincount(member[alive], minlength=len(n))
    partners = np.flatnonzero(left)
    first = np.searchsorted(group[partners], group[partners], side="left")
    end = np.searchsorted(group[partners], group[partners], side="right")
    none = np.iinfo(np.int64).max
    best_at = np.full(len(flat) + 1, none, dtype=np.int64)
    if len(partners):
        bits = [Bits(flat >> shift, window) for shift in SHIFTS]
        run, run_before = (np.lib.stride_tricks.sliding_window_view(x, window) for x in (flat, before))
    active = np.arange(len(partners))
    turn = 0
    while len(active := active[(first[active] + turn < end[active]) & (left[partners[active]] > 0)]):
        # Few rows meet several partners at once.
        turns = max(1, WINDOWS // len(active))
        other = (first[active, None] + turn + np.arange(turns)).ravel()
        mine = np.repeat(active, turns)
        has = np.flatnonzero(other < end[mine])
        mine, other = partners[mine[has]], partners[other[has]]
        for c in (c1, c2):
            move = c[other] - c[mine]
            low, high = np.maximum(0, -move), np.minimum(n[mine], n[other] - move)
            pair = np.flatnonzero((low < high) & (ids[mine] != ids[other]) & ((c is c1) | (move != c1[other] - c1[mine])))
            many = high[pair] - low[pair]
            x = np.repeat(base[mine[pair]] + low[pair] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            y = x + np.repeat(base[other[pair]] + move[pair] - base[mine[pair]], many)
            can = np.flatnonzero(open_[x] & (size_at[y] > 0))
            least = np.repeat(np.minimum(ids[mine[pair]], ids[other[pair]]), many)[can]
            x, y = x[can], y[can]
            for some in bits:
                can = some.may_meet(x, y, size_at[x], size_at[y], percent)
                x, y, least = x[can], y[can], least[can]
            met = np.zeros(len(x), dtype=bool)
            for i in range(0, len(x), WINDOWS):
                a, b = x[i : i + WINDOWS], y[i : i + WINDOWS]
                na, nb = size_at[a], size_at[b]
                of_a, of_b = run[a], run[b]
                aligned = np.count_nonzero((of_a == of_b) & (run_before[a] < a.astype(np.int32)[:, None]), axis=1)
                near = _similar(aligned, na, nb, percent)
                rest = np.flatnonzero(~near)
                near[rest] = _windows_met(of_a[rest], of_b[rest], na[rest], nb[rest], percent)
                met[i : i + WINDOWS] = near
            np.minimum.at(best_at, x[met], least[met])
        done = np.flatnonzero(open_ & (best_at != none))
        open_[done] = False
        left -= np.bincount(owner[done], minlength=len(n))
        turn += turns
    best = best_at[at]
    found = np.flatnonzero(best != none)
    member, inner, best = member[found], inner[found], best[found]
    go_on = (member[1:] == member[:-1]) & (inner[1:] == inner[:-1] + 1) & (best[1:] == best[:-1])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), dtype=bool), ~go_on]))
    last = np.append(first[1:], len(found))[: len(first)] - 1
    return ids[member[first]], s0[member[first]] + inner[first], s0[member[first]] + inner[last], best[first]


def _near(texts: DataFrame, spans: DataFrame, words: int, window: int, enough: int, percent: int, chunk: int) -> DataFrame:
    """Spans of verified near passages, at starts that are not in a later copy of an exact passage."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "id", "fp", "c1", "c2", "s0", "s1"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            lists = zip(_lists(batch.column("runs"), "v", "c", "s0", "s1"), _lists(batch.column("done"), "first_word", "last_word"), strict=True)
            for one, fp, ((v, c, s0, s1), done) in zip(batch.column("id").to_pylist(), batch.column("fp").to_pylist(), lists, strict=True):
                open_ = _covered(int(s1.max()) + 1, s0, s1, enough)
                for first, last in zip(*done, strict=True) if done else ():
                    open_[first : last - words + 2] = False
                spots = np.flatnonzero(open_)
                order = np.lexsort((v, s0))
                v, c, s0, s1 = (x[order] for x in (v, c, s0, s1))
                # Every two runs that overlap.
                x = y = np.arange(len(s0))
                if enough > 1:
                    n = np.searchsorted(s0, s1, side="right") - x - 1
                    x = np.repeat(x, n)
                    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                low = np.searchsorted(spots, s0[y])
                high = np.searchsorted(spots, np.minimum(s1[x], s1[y]), side="right") - 1
                some = low <= high
                x, y, low, high = x[some], y[some], spots[low[some]], spots[high[some]]
                swap = v[x] > v[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                k = _pair_key(np.ascontiguousarray(v[x], np.int64), np.ascontiguousarray(v[y], np.int64))
                for column, values in zip(out, (k, np.full(len(k), one), np.full(len(k), fp), c[x], c[y], low, high), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    done = spans.filter("not is_first").groupBy("id").agg(F.collect_list(F.struct("first_word", "last_word")).alias("done"))
    keyed = texts.select("id", "fp", "runs").join(done, "id", "left").mapInArrow(meet, "k long, id long, fp long, c1 int, c2 int, s0 int, s1 int")
    spent: list[str] = []
    with common.scope(spent):
        keyed = common.stored(keyed, "keys")
        width = keyed.groupBy("k").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.count(F.lit(1)).alias("n"))
        width = common.stored(width.filter("_lo <> _hi").select("k", "n"), "groups")
    groups = width.select("k", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    asked = skew_join(keyed, groups, ["k"], salt_by=["fp", "s0"], counts=width, target=chunk)
    asked = common.stored(asked.groupBy("fp").agg(F.collect_list(F.struct("k", "chunks", "c1", "c2", "s0", "s1")).alias("asked")), "asked")
    common.remove(texts.sparkSession, spent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("id").to_numpy(), batch.column("asked")
            for low, high, found in common.steps(batch.column("raw"), common.BLANK):
                flat, lengths = _runs_of(found, SHINGLE)
                flat = flat.view(np.uint32)[::2]
                text, (k, chunks, c1, c2, s0, s1) = _flat_lists(asked.slice(low, high - low), "k", "chunks", "c1", "c2", "s0", "s1")
                begin = (np.cumsum(lengths) - lengths)[text] + s0
                many = s1 - s0 + window
                for at in range(0, len(k), WINDOWS):
                    part = slice(at, at + WINDOWS)
                    offsets = np.append(0, np.cumsum(many[part]))
                    token = flat[np.repeat(begin[part] - offsets[:-1], many[part]) + np.arange(offsets[-1])]
                    tokens = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * TOKEN).astype(np.int32)), pa.py_buffer(token)])
                    columns = [pa.array(k[part], pa.int64()), pa.array(ids[low + text[part]], pa.int64())]
                    columns += [pa.array(x[part].astype(np.int32), pa.int32()) for x in (chunks, c1 - s0, c2 - s0, s0)]
                    yield pa.RecordBatch.from_arrays([*columns, tokens], names=["k", "id", "chunks", "c1", "c2", "s0", "tokens"])

    cuts = texts.select("id", "fp", "raw").join(asked, "fp").mapInArrow(cut, "k long, id long, chunks int, c1 int, c2 int, s0 int, tokens binary")
    # A large group is dealt out, and every two of its chunks meet in one task.
    tasks = cuts.withColumn("_c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = tasks.select("k", F.least("_c", "_o").alias("lo"), F.greatest("_c", "_o").alias("hi"), "id", "c1", "c2", "s0", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table) -> pa.RecordBatch:
            column = {c: rows.column(c).to_numpy() for c in ("id", "c1", "c2", "s0")}
            blobs = pa.chunked_array(rows.column("tokens"), pa.large_binary()).combine_chunks()
            where = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
            flat = np.frombuffer(blobs.buffers()[2], np.uint8)[where[0] : where[-1]].view(np.uint32)
            one, low, high, least = near_windows(_runs(rows), *column.values(), flat, np.diff(where) // TOKEN, window, percent)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((one, low, high, least), kinds, strict=True)], names=["id", "s0", "s1", "passage_id"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= TASK_ROWS:
                rows = pa.Table.from_batches(waiting)
                # The last group may go on in the next batch.
                whole = int(np.searchsorted(runs := _runs(rows), runs[-1]))
                waiting = rows.slice(whole).to_batches()
                if whole:
                    yield close(rows.slice(0, whole))
        if sum(map(len, waiting)):
            yield close(pa.Table.from_batches(waiting))

    dealt = tasks.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "id")
    found = dealt.mapInArrow(verify, "id long, s0 int, s1 int, passage_id long").groupBy("id", "s0", "s1").agg(F.min("passage_id").alias("passage_id"))
    # A text's runs meet before they are starts again.
    found = common.stored(found, "near").repartition("id").select("id", F.explode(F.sequence("s0", "s1")).alias("s"), "passage_id")
    found = found.groupBy("id", "s").agg(F.min("passage_id").alias("passage_id"))
    merged = found.select("id", F.col("s").alias("first_word"), (F.col("s") + words - 1).alias("last_word"), "passage_id", (F.col("id") == F.col("passage_id")).alias("is_first"))
    # Windows of one text that touch make one passage.
    order = Window.partitionBy("id", "is_first").orderBy("first_word", "last_word")
    fresh = F.coalesce(F.col("first_word") > F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    merged = merged.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("id", "is_first", "_run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("passage_id").alias("passage_id"))
    return merged.select("id", "first_word", "last_word", "passage_id", "is_first", F.lit(False).alias("exact"))


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every passage cut out that is not the first of its kind; blank rests go.

    `passages` is what repeated_passages gives for these rows. Texts that hold no later copy of a
    passage are left as they are, byte for byte, null texts and rows without id included. Other
    columns stay, whatever their names.
    """
    names = docs.columns
    key, cut = common.free_name("_id", names), common.free_name("_cut", names)
    later = passages.filter(~F.col("is_first")).groupBy(F.col(id_col).cast("long").alias(key)).agg(F.collect_list(F.struct("first_word", "last_word")).alias(cut))
    joined = docs.join(later, F.col(id_col).cast("long") == F.col(key), "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(cut).to_pylist(), strict=True):
                if spans and text is not None:
                    raw = text.encode()
                    for _, _, found in common.steps(pa.array([raw], pa.binary()), common.BLANK):
                        gone = np.zeros(len(raw), dtype=bool)
                        for span in spans:
                            last = min(span["last_word"], len(found.last) - 1)
                            if span["first_word"] <= last:
                                gone[found.first[span["first_word"]] : found.last[last] + 1] = True
                        text = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode().strip()
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.select(*names, cut).mapInArrow(run, docs.schema)
