"""Document quality by hierarchical empirical Bayes over hosts and paths.

A classifier turns each text into a probability. All documents' evidence (labels where training
may use them, probabilities elsewhere) is summed by path and host. The spread between hosts, and
between the paths of a host, beyond what chance explains gives the strength of each prior by the
method of moments: hosts shrink towards the whole, paths towards their host. A document's score
joins its own evidence with its path's posterior, from which its own share is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled rows of each class that the classifier reads, about.
SAMPLE_ROWS = 6000
KNOTS = 10
RIDGE = 1.0
CLIP = 8.0
NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "beyond_ascii", "lines", "distinct", "stutter", "repeated_lines", "bars", "bangs")

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"#$%&*+/<=>@\\^_`{|}~[]"]] = True
_KIND = np.select([_UPPER, _DIGIT, _SYMBOL, np.arange(256) >= 128], [1, 2, 3, 4], 0).astype(np.int64)
_KIND[ord("|")] = 5
_KIND[ord("!")] = 6
_KIND[ord("\n")] = 7
_KIND[32] = 8


def _features(raw: bytes) -> list[float]:
    data = np.frombuffer(raw, dtype=np.uint8)
    kinds = np.bincount(_KIND[data], minlength=9)
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    filled = max(size - kinds[8] - kinds[7], 1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), filled / n, kinds[1] / filled, kinds[2] / filled, (kinds[3] + kinds[5]) / filled, kinds[4] / filled,
        len(lines) / n, len(set(words)) / n, same / n, 1 - len(set(lines)) / max(len(lines), 1), kinds[5] / n, kinds[6] / n,
    ]


class Classifier:
    """Logistic regression on features cut at their quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, KNOTS + 1)[:-1])) for c in x.T] if len(x) else []
        self.weights = np.zeros(1 + sum(map(len, self.cuts)))
        if not len(y):
            return
        z = self._spread(x)
        share = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
        self.weights[0] = np.log(share / (1 - share))
        penalty = np.full(z.shape[1], RIDGE)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            h = w * np.maximum(p * (1 - p), 1e-5)
            step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(penalty), z.T @ (w * (y - p)) - penalty * self.weights * (np.arange(z.shape[1]) > 0))
            self.weights += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break

    def _spread(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), *((x[:, j : j + 1] > c[None, :]).astype(float) for j, c in enumerate(self.cuts))], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._spread(x) @ self.weights if self.cuts else np.zeros(len(x)), -CLIP, CLIP)


def _known(labels: DataFrame, use: Column, id_col: str, label_col: str) -> DataFrame:
    known = labels.filter(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("y"))


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on the features of about `sample_rows` rows of each class among the admitted labels."""
    known = _known(labels, use, id_col, label_col)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.lit(False)
    for y, n in totals.items():
        drawn = F.when(F.col("y") == y, common.drawn(F.xxhash64("id"), sample_rows, n)).otherwise(drawn)
    # The sample's ids are bounded by its documented size.
    chosen = known.filter(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(t or b"") for t in batch.column("_raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "y", "x"])

    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = sorted((r["id"], r["y"], r["x"]) for r in common.text_bytes(sample, "id", "y").mapInArrow(run, "id long, y int, x array<double>").collect())
    y = np.array([r[1] for r in rows], dtype=float)
    w = np.array([totals[r[1]] for r in rows]) / np.maximum([(y == r[1]).sum() for r in rows], 1) if rows else np.zeros(0)
    return Classifier(np.array([r[2] for r in rows]).reshape(-1, len(NAMES)), y, w * len(w) / max(w.sum(), 1e-9) if rows else w)


def strength(mean: float, groups: int, total: float, squares: float, scatter: float) -> float:
    """Prior strength of a level from its weighted scatter; large if groups differ by chance only.

    scatter is sum n (rate - centre)^2; its expectation under chance is groups * m (1 - m).
    """
    chance = mean * (1 - mean)
    room = total - squares / max(total, 1e-9)
    between = (scatter - max(groups - 1, 0) * chance) / room if room > 0 else 0.0
    return float(np.clip(chance / between - 1 if between > 1e-9 else 1e4, 1.0, 1e4))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(id, doc_score, host_score, path_score, score, kept) for every row.

    Null hosts and paths are a host and a path of their own. A null or blank text is scored as a
    text without words. Repeated rows count each. Without labels every score is the prior.
    """
    common.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, use, id_col, text_col, label_col))
    keys = [F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([_features(t or b"") for t in batch.column("_raw").to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shared.value.logit(x))], names=["id", "host", "path", "logit"])

    raw = common.text_bytes(docs, *keys, text=text_col)
    kind = dict(docs.dtypes)[id_col]
    scored = common.stored(raw.mapInArrow(run, f"id {kind}, host string, path string, logit double"), "evidence")
    value = F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-F.col("logit"))))
    scored = scored.join(_known(labels, use, id_col, label_col), "id", "left").withColumn("value", value)
    scored = common.stored(scored.drop("y"), "evidence")

    paths = common.stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    total = whole["n"] or 0.0
    mean = float(np.clip((whole["s"] or 0.0) / total, 1e-3, 1 - 1e-3)) if total else 0.5
    spread = lambda n, s, centre: F.sum(n * F.pow(s / n - centre, 2))
    level = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("hn") ** 2).alias("q"), spread(F.col("hn"), F.col("hs"), F.lit(mean)).alias("v")).first()
    host_strength = strength(mean, level["k"], total, level["q"] or 0.0, level["v"] or 0.0)
    hosts = hosts.withColumn("host_score", (F.col("hs") + host_strength * mean) / (F.col("hn") + host_strength))
    joined = paths.join(hosts, "host")
    level = joined.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") ** 2 / F.col("hn")).alias("q"), spread(F.col("n"), F.col("s"), F.col("host_score")).alias("v")).first()
    path_strength = strength(mean, level["k"], total, level["q"] or 0.0, level["v"] or 0.0)

    prior = F.lit(path_strength) * F.col("host_score")
    clip = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-4)), F.lit(1e-4))
    logit = lambda c: F.log(c / (1 - c))
    rest = clip((prior + F.col("s") - F.col("value")) / (F.lit(path_strength) + F.col("n") - 1))
    out = scored.join(joined.select("host", "path", "n", "s", "host_score"), ["host", "path"])
    out = out.select(
        F.col("id").alias(id_col),
        (1 / (1 + F.exp(-F.col("logit")))).alias("doc_score"),
        "host_score",
        rest.alias("path_score"),
        (1 / (1 + F.exp(-(F.col("logit") + logit(rest) - F.lit(float(np.log(mean / (1 - mean)))))))).alias("score"),
    )
    return out.withColumn("kept", F.col("score") >= 0.5)
