"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by log-count ratios of the classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.llm.shared import _BASE, _BYTE_CODES, _IS_SPACE, _LOWER, _powers, id_bucket, mix64, slices

#: About so many labelled rows are used at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 6000
BUCKETS = 1 << 18
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 30
THRESHOLD = 0.3
#: Class of each byte for the shapes of words: lower case, upper case, digits; other marks are their own class.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _sums(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    values = values * _powers(int(lengths.max()))[np.arange(len(values)) - np.repeat(first, lengths)]
    return mix64(np.add.reduceat(values, first))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams: words and pairs of words, and one to three shapes in a row.

    A word's shape is the sequence of its classes of bytes without repeats, marked if the word equals the one before.
    """
    if not text:
        return np.empty(0, np.int32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    solid = ~_IS_SPACE[raw]
    edges = np.diff(np.concatenate([[False], solid, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.int32)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    words = _sums(_BYTE_CODES[_LOWER[raw[solid]]], first, lengths)
    kinds = _SHAPE[raw[solid]]
    new = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    new[first] = True
    counts = np.add.reduceat(new.astype(np.int64), first)
    shapes = _sums(_BYTE_CODES[kinds[new]], np.cumsum(counts) - counts, counts)
    shapes[1:][words[1:] == words[:-1]] ^= np.uint64(0x5555555555555555)
    grams = [words, shapes + np.uint64(7), words[:-1] * _BASE + words[1:], shapes[:-1] * _BASE + shapes[1:] + np.uint64(1), (shapes[:-2] * _BASE + shapes[1:-1]) * _BASE + shapes[2:] + np.uint64(2)]
    return np.unique((mix64(np.concatenate(grams)) >> np.uint64(20)).astype(np.int64) % BUCKETS).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -30, 30))))

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / max(1.0, np.sqrt(len(x))) + self.bias)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    up, down = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for x, y in zip(rows, labels):
        (up if y else down)[x] += 1
    return np.log((up / up.sum()) / (down / down.sum()))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the weights are those of the plain indicators.

    The constant feature 1 gives the bias. Errors of a class cost in inverse proportion to its rows. It ends when no
    step of an epoch changes a coefficient by 0.001.
    """
    signs = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (signs == s).sum()) / len(signs) for s in (-1.0, 1.0)])
    limit = cost * 0.5 / share[(signs > 0).astype(int)]
    scaled = [ratios[x] / max(1.0, np.sqrt(len(x))) for x in rows]
    norms = np.array([v @ v for v in scaled]) + 1.0
    alpha, w, bias = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            x, v, s = rows[i], scaled[i], signs[i]
            slack = s * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), limit[i])
            step = (new - alpha[i]) * s
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratios, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps on smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels == 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model | None:
    """The model; its curve is fitted on margins of five parts, each from a model without that part."""
    labels = np.asarray(labels)
    if len(rows) == 0:
        return None
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 3.0 if labels[0] else -3.0)
    part = np.arange(len(rows)) % 5
    margins = np.zeros(len(rows))
    for k in range(5):
        at = np.flatnonzero(part != k)
        if len(set(labels[at].tolist())) < 2:
            continue
        some = [rows[i] for i in at]
        m = Model(*descend(some, labels[at], log_count_ratios(some, labels[at])), 1.0, 0.0)
        for i in np.flatnonzero(part == k):
            margins[i] = m.margin(rows[i])
    slope, shift = calibrate(margins, labels)
    return Model(*descend(rows, labels, log_count_ratios(rows, labels)), slope, shift)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, quality) of a bounded sample of the labelled rows outside the held-out fold (crc32 of the id mod 5 is 0)."""
    usable = labels.filter(F.col("quality").isNotNull() & (id_bucket("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about sample_rows rows at most


def fit(train: DataFrame) -> Model | None:
    """Features are made in tasks; the descent, which takes one row after another, runs on the bounded sample."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": [features(t).tobytes() for t in b["text"]]})

    found = train.mapInPandas(run, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "x"])
    return fit_rows([np.frombuffer(x, np.int32) for x in found["x"]], (found["quality"] > 0).to_numpy().astype(int))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds `score`, the calibrated probability of label 1, to every row of `docs`.

    Null and empty texts have no features and get the score of the bias; without labels every score is 0.5. A map
    over rows: all columns stay (a column named score is replaced), nothing is shuffled. Repeated rows get equal
    scores, an empty table none; the features of a very long text are bounded by the buckets.
    """
    from pyspark.sql import types as T

    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift) if model else None)

    def run(batches):
        import pyarrow as pa

        m = Model(*shared.value) if shared.value else None
        for b in slices(batches):
            found = [m.score(t) if m else 0.5 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)
