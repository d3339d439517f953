"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.sampling import sample_by
from tidegraph.llm.text_hashing import subword_buckets

BUCKETS = 1 << 16


@dataclass
class LanguageModel:
    """Languages, the scores that a subword adds for each, and when a prediction is accepted."""

    languages: list[str]
    table: np.ndarray  # subword embeddings times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """Of each language; none for a text without a letter."""
        found = subword_buckets(text, BUCKETS)
        if len(found) == 0 or not self.languages:
            return None
        return _softmax((self.table[found].mean(axis=0) + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(texts: list[str], labels: list[str], size: int = 16, epochs: int = 6, rate: float = 0.5, precision: float = 0.995, seed: int = 7) -> LanguageModel:
    """Train by stochastic gradient descent, one text at a time; every fifth text calibrates.

    The temperature is the one that makes the calibration texts likeliest, the
    threshold the least score above which ``precision`` of them are right.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    bags = [np.unique(subword_buckets(t, BUCKETS), return_counts=True) for t in texts]
    bags = [(places.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)) for places, n in bags]
    goals = np.array([languages.index(x) for x in labels])
    known = np.array([k for k, (places, _) in enumerate(bags) if len(places)], int)
    held = known[::5] if len(known) >= 25 else known[:0]
    train = np.setdiff1d(known, held)
    embeddings = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    weights = rng.normal(0, 0.1, (size, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = epochs * max(1, len(train)), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            places, shares = bags[k]
            mean = shares @ embeddings[places]
            error = _softmax(mean @ weights + bias)
            error[goals[k]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * error
            # A share is small, so its embedding takes longer steps.
            embeddings[places] -= step * 20 * np.outer(shares, back)
            done += 1
    table = embeddings @ weights
    scores = np.array([bags[k][1] @ table[bags[k][0]] + bias for k in held]).reshape(-1, len(languages))
    right = goals[held]
    temperature, threshold = 1.0, 0.0
    if len(held):
        grid = np.geomspace(0.2, 5, 33)
        loss = [np.mean([-np.log(_softmax(s / t)[g] + 1e-12) for s, g in zip(scores, right, strict=True)]) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        best = np.array([_softmax(s / temperature).max() for s in scores])
        order = np.argsort(-best)
        exact = np.cumsum(scores[order].argmax(axis=1) == right[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(exact >= precision)
        threshold = float(best[order][enough[-1]]) if len(enough) else 1.0
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id's text, a null id as the empty text, leaves 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_language_model(documents: DataFrame, per_language: int = 1000) -> LanguageModel:
    """Fit on about ``per_language`` whole texts of each language of ``documents(doc_id, text, lang)``.

    That number bounds what the driver gets. Rows held out, without ``lang`` or
    without text are left aside.
    """
    rows = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = sample_by(rows.select("doc_id", "text", "lang"), "lang", per_language, "doc_id").select("doc_id", "text", "lang")
    found = sorted(sample.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text))
    return fit([r.text for r in found], [r.lang for r in found])


def identify_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for each row of ``documents(doc_id, text)``.

    ``score`` is the calibrated probability of the language, over the whole
    text; ``accepted`` says that it reaches the model's threshold. Null texts,
    those without a letter, and all texts if there were no languages to learn
    are ``und`` with score 0, not accepted. Repeated rows are treated alike. No
    rows: none. Other columns are not read and nothing is shuffled; the model
    that goes to the tasks has a fixed number of buckets.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: LanguageModel = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2):
                found = own.probabilities(text.as_py())
                names.append("und" if found is None else own.languages[int(found.argmax())])
                scores.append(0.0 if found is None else float(found.max()))
            accepted = [n != "und" and s >= own.threshold for n, s in zip(names, scores, strict=True)]
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
