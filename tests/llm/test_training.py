"""Training of the classifiers, held against plain loops over the formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidegraph.llm import langid, ordinal
from tidegraph.llm.text_hashing import subword_buckets, word_features

GRADED = [
    ("Buy now buy cheap!!!", 0),
    ("the garden is green and the tools are clean", 2),
    ("page 12 of 40", 1),
    ("", 1),
    (None, 0),
    ("a well made garden needs good tools", 2),
]


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def chance(score: float, edges: list[float], grade: int) -> float:
    over = 1.0 if grade == 0 else logistic(score - edges[grade - 1])
    under = 0.0 if grade == len(edges) else logistic(score - edges[grade])
    return over - under


def plain_ordinal(texts, grades, levels, rate=0.2, decay=1e-3, seed=7):
    """Weights by bucket and thresholds, with every slope taken from the likelihood by differences."""
    rng = np.random.default_rng(seed)
    weights, seen = {}, {}
    shares = [grades.count(g) + 1 for g in range(levels)]
    tails = [sum(shares[g:]) / sum(shares) for g in range(1, levels)]
    start = [math.log((1 - t) / t) for t in tails]
    first, gaps = start[0], [math.log(max(b - a, 0.05)) for a, b in zip(start, start[1:])]
    h = 1e-6
    for epoch in range(60):
        for k in rng.permutation(len(texts)):
            bag = dict(zip(*map(np.ndarray.tolist, word_features(texts[k], ordinal.BUCKETS)), strict=True))
            score = sum(weights.get(b, 0.0) * v for b, v in bag.items())
            edges = [first + sum(math.exp(x) for x in gaps[:j]) for j in range(levels - 1)]
            g = grades[k]
            slope = (math.log(chance(score + h, edges, g)) - math.log(chance(score - h, edges, g))) / (2 * h)
            pulls = []
            for j in range(levels - 1):
                more, less = list(edges), list(edges)
                more[j], less[j] = edges[j] + h, edges[j] - h
                pull = (math.log(chance(score, more, g)) - math.log(chance(score, less, g))) / (2 * h)
                pulls.append(min(1.0, max(-1.0, pull)))
            for b, v in bag.items():
                back = decay * weights.get(b, 0.0) - slope * v
                seen[b] = seen.get(b, 1.0) + back * back
                weights[b] = weights.get(b, 0.0) - rate * back / math.sqrt(seen[b])
            step = 0.02 / (1 + epoch)
            # A gap lies below every threshold that follows it.
            first += step * sum(pulls)
            gaps = [x + step * sum(pulls[j + 1 :]) * math.exp(x) for j, x in enumerate(gaps)]
    return weights, [first + sum(math.exp(x) for x in gaps[:j]) for j in range(levels - 1)]


def test_ordinal_regression_follows_the_likelihood():
    texts, grades = [t for t, _ in GRADED], [g for _, g in GRADED]
    made = ordinal.fit(texts, grades, 3, least=1)
    weights, edges = plain_ordinal(texts, grades, 3)
    assert set(np.flatnonzero(made.weights)) == {b for b, w in weights.items() if w}
    for b, w in weights.items():
        assert made.weights[b] == pytest.approx(w, abs=1e-4)
    assert made.thresholds.tolist() == pytest.approx(edges, abs=1e-4)
    for text in [*texts, "good tools buy", "word " * 50_000]:
        bag = zip(*map(np.ndarray.tolist, word_features(text, ordinal.BUCKETS)), strict=True)
        score = sum(weights.get(b, 0.0) * v for b, v in bag)
        assert made.tails(text).tolist() == pytest.approx([logistic(score - e) for e in edges], abs=1e-3)


SPOKEN = [
    ("the green garden and the old house", "en"),
    ("der gr\u00fcne Garten und das alte Haus", "de"),
    ("a house of stone", "en"),
    ("ein Haus aus Stein", "de"),
    ("le jardin vert et la vieille maison", "fr"),
    ("12 34", "fr"),
    ("une maison de pierre", "fr"),
]


def softmax(x: list[float]) -> list[float]:
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_languages(texts, labels, size=16, epochs=6, rate=0.5, seed=7):
    """Chances of each language for a text, learnt by loops over single numbers."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.1, (langid.BUCKETS, size))
    weights = rng.normal(0, 0.1, (size, len(names))).tolist()
    bias = [0.0] * len(names)
    rows = {}
    bag_of = []
    for text in texts:
        places = subword_buckets(text, langid.BUCKETS).tolist()
        bag_of.append({b: places.count(b) / len(places) for b in sorted(set(places))})

    def row(b):
        return rows.setdefault(b, start[b].tolist())

    def scores(bag):
        mean = [sum(s * row(b)[d] for b, s in bag.items()) for d in range(size)]
        return mean, [sum(mean[d] * weights[d][c] for d in range(size)) + bias[c] for c in range(len(names))]

    train = np.array([k for k, bag in enumerate(bag_of) if bag])
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            mean, found = scores(bag_of[k])
            error = [p - (names[c] == labels[k]) for c, p in enumerate(softmax(found))]
            step = rate * (1 - done / (epochs * len(train)))
            back = [sum(weights[d][c] * error[c] for c in range(len(names))) for d in range(size)]
            for d in range(size):
                for c in range(len(names)):
                    weights[d][c] -= step * mean[d] * error[c]
            for c in range(len(names)):
                bias[c] -= step * error[c]
            for b, s in bag_of[k].items():
                for d in range(size):
                    row(b)[d] -= step * 20 * s * back[d]
            done += 1

    def chances(text):
        places = subword_buckets(text, langid.BUCKETS).tolist()
        return softmax(scores({b: places.count(b) / len(places) for b in sorted(set(places))})[1])

    return chances


def test_language_model_follows_its_formulas():
    texts, labels = [t for t, _ in SPOKEN], [x for _, x in SPOKEN]
    made = langid.fit(texts, labels)
    chances = plain_languages(texts, labels)
    assert made.languages == ["de", "en", "fr"] and (made.temperature, made.threshold) == (1.0, 0.0)
    for text in [*texts[:5], texts[6], "das Haus", "the " * 2000, "x"]:
        assert made.probabilities(text).tolist() == pytest.approx(chances(text), abs=2e-3)
    assert made.probabilities("12 34") is None and made.probabilities("") is None and made.probabilities(None) is None


def test_rejection_reaches_its_precision():
    # Every fourth text says the other language, so scores decide what is sure.
    texts = [("der Garten " if k % 2 else "the garden ") * (1 + k % 5) + ("und" if k % 2 else "and") for k in range(200)]
    labels = [("de", "en")[(k % 2 == 0) ^ (k % 4 == 3)] for k in range(200)]
    made = langid.fit(texts, labels, precision=0.6)
    held = list(range(200))[::5]
    sure = [(made.probabilities(texts[k]), labels[k]) for k in held]
    sure = [made.languages[int(p.argmax())] == x for p, x in sure if p.max() >= made.threshold - 1e-6]
    assert sure and sum(sure) >= 0.6 * len(sure)
