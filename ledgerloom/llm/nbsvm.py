"""Quality classifier: Naive Bayes support vectors.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other
characters; a token equal to the one before it is the marker *again*, so a
repeated word looks the same whatever the word. Features are indicators of
token unigrams and bigrams, hashed into ``BUCKETS`` slots.

* The model learns from at most ``LEARN_ROWS`` labelled learning rows (those
  with the smallest digests of their id). Their ids are the only thing that is
  broadcast, so no text is shuffled: each task adds up the class document counts
  of its own rows with numpy, and Spark sums the slots.
* Indicators are scaled by the log-count ratio of their slot, rows to unit
  length, and a linear hinge-loss model is fitted by dual coordinate descent
  on the first ``FIT_ROWS`` of the rows and a logistic link on the next
  ``LINK_ROWS``.
* Scoring is one map over the whole texts with the weight array (1 MB), no
  shuffle.

Defined results: null and empty texts have no features and score by the link's
intercept; null ids are never learned from and are scored like others (their
fold is null: not held out); null labels are not learned from; of repeated
label rows for an id the largest label counts; without two classes to learn
from every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import vectext as vt
from ledgerloom.llm.shared import label_sample

BUCKETS = 1 << 18
LEARN_ROWS = 40_000
FIT_ROWS = 6000
LINK_ROWS = 2000
ALPHA = 1.0
C = 1.0
EPOCHS = 20

_CLASSES = vt.alnum_classes(punctuation=2)
_AGAIN = np.uint64(0x5BD1E995A5A5A5A5)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct indicators of each text, sorted."""
    starts, ends, first = vt.runs(data, offsets, _CLASSES)
    h = vt.hash_runs(data, starts, ends, vt.LOWER)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(h):
        return text, np.zeros(0, np.int64)
    follows = np.zeros(len(h), bool)
    follows[1:] = text[1:] == text[:-1]
    same = follows.copy()
    same[1:] &= h[1:] == h[:-1]
    h = np.where(same, _AGAIN, h)
    pairs = vt.rolling(h, 2)[follows[1:]] if len(h) > 1 else np.zeros(0, np.uint64)
    slot = np.concatenate([vt.mix(h), pairs]) % np.uint64(BUCKETS)
    key = np.unique(np.concatenate([text, text[1:][follows[1:]]]) * BUCKETS + slot.astype(np.int64))
    return key // BUCKETS, key % BUCKETS


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        data, offsets = vt.column_bytes(b.column(column))
        for lo, hi in vt.pieces(offsets):
            yield b, lo, hi, *features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])


def slot_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each slot, by class (2 x BUCKETS), and documents by class;
    ``rows`` has label and text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS + 2, np.int64)
        for b, lo, hi, text, slot in _batches(batches, 1):
            label = b.column(0).to_numpy()[lo:hi].astype(np.int64)
            total[:2 * BUCKETS] += np.bincount(label[text] * BUCKETS + slot, minlength=2 * BUCKETS)
            total[2 * BUCKETS:] += np.bincount(label, minlength=2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["slot", "n"])

    found = (rows.select("label", F.col("text").cast("binary")).mapInArrow(count, "slot long, n long")
             .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())  # 2 * BUCKETS + 2 rows at most
    total = np.zeros(2 * BUCKETS + 2, np.int64)
    total[found["slot"].to_numpy()] = found["n"].to_numpy()
    return total[:2 * BUCKETS].reshape(2, BUCKETS), total[2 * BUCKETS:]


def sample_features(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """(label, slots) of each row; ``rows`` is a bounded sample."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, text, slot in _batches(batches, 1):
            cut = np.searchsorted(text, np.arange(hi - lo + 1))
            slots = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(slot, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), slots], ["label", "slots"])

    got = rows.select("label", F.col("text").cast("binary")).mapInArrow(extract, "label int, slots array<int>").toArrow()
    return [(y, np.asarray(x.values)) for y, x in zip(got["label"].to_pylist(), got["slots"], strict=True)]


def dual_descent(rows: list[tuple[int, np.ndarray]], scale: np.ndarray) -> np.ndarray:
    """Weights (slots, then bias) minimising L2-regularised hinge loss over the
    scaled rows; classes weigh alike. One pass updates one dual variable a row."""
    w, bias = np.zeros(BUCKETS), 0.0
    scaled = [_unit(scale[x]) for _, x in rows]
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    cost = np.where(y > 0, C * len(y) / (2 * max(1, (y > 0).sum())), C * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.array([v @ v + 1.0 for v in scaled])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i][1], scaled[i]
            gradient = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return np.append(w, bias)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(v @ v)
    return v / n if n else v


def logistic_link(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(1 | x) by Newton steps on a lightly penalised
    log-likelihood with softened targets; the slope is never negative."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ x + 1e-3 * a, r.sum()])
        h = np.array([[s @ (x * x) + 1e-3, s @ x], [s @ x, s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1.0, 5.0 / size) if size else 1.0
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return max(float(a), 0.0), float(b)


@dataclass
class Model:
    scale: np.ndarray    # log-count ratio of each slot
    weights: np.ndarray  # of scaled unit rows
    bias: float
    slope: float
    intercept: float

    def margins(self, text: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        r = self.scale[slot]
        length = np.sqrt(np.bincount(text, r * r, n))
        raw = np.bincount(text, r * self.weights[slot], n)
        return raw / np.where(length > 0, length, 1.0) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str, key: str = "doc_id", text: str = "text") -> Model:
    """Model of ``labels.label`` (0/1) from the rows of ``docs`` where ``learn`` holds."""
    sample = label_sample(labels, learn, label, LEARN_ROWS, key)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def rows_of(part: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(part), "key")

    counts, docs_by_class = slot_counts(rows_of(sample))
    scale = np.log((ALPHA + counts[1]) / (2 * ALPHA + docs_by_class[1])) - np.log((ALPHA + counts[0]) / (2 * ALPHA + docs_by_class[0]))
    if not docs_by_class.all():
        share = docs_by_class[1] / docs_by_class.sum() if docs_by_class.any() else 0.5
        return Model(scale, np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    part = sample_features(rows_of(sample.where(F.col("place") < FIT_ROWS)))
    rest = sample_features(rows_of(sample.where((F.col("place") >= FIT_ROWS) & (F.col("place") < FIT_ROWS + LINK_ROWS))))
    if len({y for y, _ in part}) < 2:
        part = rest = sample_features(rows_of(sample))
    weights = dual_descent(part, scale)
    model = Model(scale, weights[:-1], float(weights[-1]), 1.0, 0.0)
    rest = rest if len({y for y, _ in rest}) == 2 else part
    text_no = np.repeat(np.arange(len(rest)), [len(x) for _, x in rest])
    margins = model.margins(text_no, np.concatenate([x for _, x in rest]).astype(np.int64), len(rest))
    model.slope, model.intercept = logistic_link(margins, np.array([y for y, _ in rest], float))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of BUCKETS numbers
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, text_no, slot in _batches(batches, 1):
            margins = shared.value.margins(text_no, slot, hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(margins))],
                                             ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
