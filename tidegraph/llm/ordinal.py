"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.sampling import sample_rows
from tidegraph.llm.text_hashing import word_features

BUCKETS = 1 << 18


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """One weight for each bucket, shared by all grades, and rising thresholds between them.

    P(grade > k) is the logistic function of the text's score less threshold k.
    """

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        places, values = word_features(text, BUCKETS)
        return _sigmoid(self.weights[places] @ values - self.thresholds)


def fit(texts: list[str | None], grades: list[int], levels: int, epochs: int = 12, rate: float = 0.2, decay: float = 1e-3, least: int = 4, seed: int = 7) -> OrdinalModel:
    """Maximum likelihood by stochastic gradients with a step for each weight (AdaGrad).

    Buckets of fewer than ``least`` of the texts have no weight, as they tell
    these texts apart and no others.
    Thresholds are a first one and logarithms of the gaps, so they stay in order.
    """
    rng = np.random.default_rng(seed)
    bags = [word_features(t, BUCKETS) for t in texts]
    spread = np.bincount(np.concatenate([np.unique(places) for places, _ in bags] or [np.zeros(0, int)]), minlength=BUCKETS)
    bags = [(places[spread[places] >= least], values[spread[places] >= least]) for places, values in bags]
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1.0)
    first, gaps = 0.0, np.zeros(levels - 2)
    cuts = lambda: first + np.r_[0, np.cumsum(np.exp(gaps))]
    shares = np.bincount(grades, minlength=levels) + 1.0
    tail = np.cumsum(shares[::-1])[::-1][1:] / shares.sum()
    start = np.log((1 - tail) / tail)
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    # A few texts are gone through more often.
    for epoch in range(min(60, max(epochs, 24_000 // max(1, len(bags))))):
        for k in rng.permutation(len(bags)):
            places, values = bags[k]
            edges = np.r_[-np.inf, cuts(), np.inf]
            score = weights[places] @ values
            g = grades[k]
            above, below = _sigmoid(score - edges[g]), _sigmoid(score - edges[g + 1])
            # d log P(grade = g) / d score
            slope = 1 - above - below
            grad = -slope * values + decay * weights[places]
            seen[places] += grad * grad
            weights[places] -= rate * grad / np.sqrt(seen[places])
            chance = max(above - below, 1e-9)
            pull = np.zeros(levels + 1)
            pull[g], pull[g + 1] = -above * (1 - above) / chance, below * (1 - below) / chance
            inner = np.clip(pull[1:-1], -1, 1)
            step = 0.02 / (1 + epoch)
            first += step * inner.sum()
            if levels > 2:
                gaps += step * np.cumsum(inner[::-1])[::-1][1:] * np.exp(gaps)
    return OrdinalModel(weights.astype(np.float32), cuts())


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The graded rating behind two labels: 0 toxic, 1 neither toxic nor good, 2 good; null where a label is missing."""
    clean = F.when(F.col(toxic) != 0, 0).when(F.col(quality) != 0, 2).otherwise(1)
    return F.when(F.col(quality).isNotNull() & F.col(toxic).isNotNull(), clean)


def train_ordinal(documents: DataFrame, ratings: DataFrame, levels: int = 3, most: int = 8000) -> OrdinalModel:
    """Fit on about ``most`` rated whole texts of ``ratings(doc_id, grade)``.

    That number bounds what the driver gets, and the ratings that are broadcast
    to pick out the texts. Ratings without an id or a grade from 0 to
    ``levels - 1``, or of no document, are left aside, and so is a fifth of the
    ids, on which the model can be tested (``tested``). An id rated twice has
    its lowest grade. No ratings: all weights are zero.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1) & ~tested(F.col("doc_id")))
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = sample_rows(rated, most, "doc_id")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct()
    found = sorted(rows.collect(), key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text for r in found], [int(r.grade) for r in found], levels)


def tested(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def expected_grades(documents: DataFrame, model: OrdinalModel, at_least: int = 2, keep: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tails, kept`` for each row of ``documents(doc_id, text)``.

    ``tails[k]`` is the probability of a grade over ``k``, their sum the
    expected grade; ``kept`` says that P(grade >= ``at_least``) reaches
    ``keep``. The whole text counts; null is an empty one. Repeated rows are
    treated alike. No rows: none; no ratings: the same chances for every text.
    Other columns are not read and nothing is shuffled; the model that goes to
    the tasks has a fixed number of buckets.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: OrdinalModel = shared.value
        for batch in batches:
            tails = [own.tails(text.as_py()) for text in batch.column(1)]
            made = [pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "expected_grade", "tails"])

    rows = documents.select("doc_id", "text").mapInArrow(predict, "doc_id long, expected_grade double, tails array<double>")
    return rows.withColumn("kept", F.get("tails", at_least - 1) >= keep)
