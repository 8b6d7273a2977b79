"""Quality classifier: Naive Bayes support vectors.

Whole texts become indicators of hashed byte 2-, 3- and 4-grams, and of how many word bigrams
repeat their word (by powers of two, and as a share of all bigrams in sixteenths). The indicators are scaled by
the log-count ratios of the two classes, counted over all labelled training rows, and a
linear hinge-loss model is fitted on them by dual coordinate descent, on a bounded sample of
labelled rows. Margins become scores between 0 and 1 by a logistic curve fitted on margins of
models that haven't seen the row.

Defined results: null and empty texts have no indicators and are scored by the bias; ids
that are labelled more than once take their highest label; null labels and labels without a
document are ignored; with one class or none the score is the smoothed share of class 1;
repeated rows each keep their row; extra columns pass through.

Scale: the label table is broadcast only up to `BROADCAST_ROWS` rows, else joined by shuffle;
counts have a fixed number of dimensions; the sample is bounded; scoring is a map.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltide.llm.common import map_text

GRAMS = 1 << 16
REPEATS, SHARES = 24, 17
DIMS = GRAMS + REPEATS + SHARES
#: Rows of each class that the hinge-loss model is fitted on.
SAMPLE_PER_CLASS = 2000
BROADCAST_ROWS = 1_000_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def indicators(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-gram indicators that hold."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    seen = np.zeros(DIMS, bool)
    shift = np.uint32(32 - (GRAMS.bit_length() - 1))
    code = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        code = code[:-1] << 8 | b[n - 1 :]
        mixed = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        seen[(mixed * np.uint32(0x85EBCA6B)) >> shift] = True
    w = (text or "").split()
    if len(w) > 1 and (same := sum(map(eq, w, islice(w, 1, None)))):
        seen[GRAMS : GRAMS + min(REPEATS, same.bit_length())] = True
        seen[GRAMS + REPEATS : GRAMS + REPEATS + 1 + 16 * same // (len(w) - 1)] = True
    return np.flatnonzero(seen)


def descend(rows: list[np.ndarray], ys: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS):
    """Dual coordinate descent for the hinge loss; weights over the ratio-scaled, normalised indicators, bias last."""
    w, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    scaled = []
    for r in rows:
        v = ratio[r]
        scaled.append(v / max(float(np.sqrt(v @ v)), 1e-12))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], scaled[i], ys[i]
            q = 1.0 + (1.0 if len(r) else 0.0)  # unit vector and bias
            g = y * (w[r] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / q, 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[r] += step * y * v
                w[-1] += step * y
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(margins: np.ndarray, ys: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(class 1 | margin), by Newton steps with smoothed targets."""
    hi, lo = float(weights[ys > 0].sum()), float(weights[ys < 0].sum())
    target = np.where(ys > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        e, h = weights * (p - target), weights * p * (1 - p) + 1e-9
        g = np.array([(e * margins).sum(), e.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, slope: float, offset: float, constant: float | None = None):
        self.weights, self.ratio, self.slope, self.offset, self.constant = weights, ratio, slope, offset, constant

    def margin(self, r: np.ndarray) -> float:
        v = self.ratio[r]
        return float(self.weights[r] @ v / max(float(np.sqrt(v @ v)), 1e-12) + self.weights[-1])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        x = self.slope * self.margin(indicators(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros((2, DIMS + 1), np.int64)  # the last: documents
    for batch in batches:
        for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
            found[y, indicators(t.as_py())] += 1
            found[y, DIMS] += 1
    at = np.flatnonzero(found.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, found[0, at], found[1, at])], names=["dim", "n0", "n1"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """Learn `label` (0 or 1) from the rows of `docs` where `train` holds."""
    marked = (
        labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    side = F.broadcast(marked) if labels.count() <= BROADCAST_ROWS else marked
    rows = docs.filter(train).select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(side, "id").select("id", "t", "y")
    ratio_rows = (
        rows.select("t", "y")
        .mapInArrow(_class_counts, "dim bigint, n0 bigint, n1 bigint")
        .groupBy("dim")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .collect()
    )
    counts = np.zeros((2, DIMS + 1))
    for r in ratio_rows:
        counts[:, r.dim] = r.n0, r.n1
    docs_of = counts[:, DIMS]
    if not docs_of.all():
        return Model(np.zeros(1), np.zeros(0), 1.0, 0.0, float((docs_of[1] + 1) / (docs_of.sum() + 2)))
    smoothed = counts[:, :DIMS] + SMOOTHING
    shares = smoothed / smoothed.sum(1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])

    odds = [min(1.0, 2 * per_class / n) for n in docs_of]
    h = F.xxhash64("id", "t")
    unit = (F.shiftrightunsigned(h, 1) / F.lit(float(1 << 63))).cast("double")
    drawn = rows.filter(unit < F.when(F.col("y") == 1, odds[1]).otherwise(odds[0])).withColumn("h", h)
    sample = []
    for y in (0, 1):
        sample += drawn.filter(F.col("y") == y).orderBy("h", "id", "t").limit(per_class).select("t", "y").collect()
    features = [indicators(r.t) for r in sample]
    ys = np.array([1.0 if r.y else -1.0 for r in sample])
    del sample
    drawn_of = np.array([(ys < 0).sum(), (ys > 0).sum()])
    if not drawn_of.all():
        return Model(np.zeros(1), np.zeros(0), 1.0, 0.0, float((docs_of[1] + 1) / (docs_of.sum() + 2)))
    weight = docs_of / docs_of.sum() * drawn_of.sum() / drawn_of  # the classes as often as in the corpus
    each = np.where(ys > 0, weight[1], weight[0])
    cost = np.full(len(ys), COST)
    margins, folds = np.zeros(len(ys)), np.arange(len(ys)) % 3
    for f in range(3):
        rest = np.flatnonzero(folds != f)
        w = descend([features[i] for i in rest], ys[rest], ratio, cost[rest])
        part = Model(w, ratio, 1.0, 0.0)
        for i in np.flatnonzero(folds == f):
            margins[i] = part.margin(features[i])
    slope, offset = logistic(margins, ys, each)
    return Model(descend(features, ys, ratio, cost), ratio, slope, offset)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """`docs` with a struct column (score, predicted); returns it and the column's name."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shipped.value

        def work(texts: list) -> list:
            return [(s, int(s >= threshold)) for s in map(model.score, texts)]

        return work

    return map_text(docs, factory, RESULT, text, "quality_score")
