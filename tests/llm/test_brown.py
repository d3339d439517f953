"""The class model against plain counts over a small corpus."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegraph.llm import brown

CLASSES = 4
END = b""


def small_corpus() -> list[tuple[int, str | None]]:
    rng = np.random.default_rng(3)
    kinds = [["the", "a", "this"], ["dog", "cat", "house", "tree"], ["sees", "likes", "Has"], ["Big", "small", "old"]]
    rows: list[tuple[int, str | None]] = []
    for k in range(120):
        picks = [str(rng.choice(kinds[c])) for c in (0, 3, 1, 2, 0, 1)]
        rows.append((k, " ".join(picks * (1 + k % 3))))
    return [*rows, (200, None), (201, ""), (202, "new words \u00fcber all"), (7, "the dog"), (7, "the dog")]


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def plain_pairs(texts: list[str | None], class_of) -> Counter:
    pairs: Counter = Counter()
    for text in texts:
        before = class_of(END)
        for token in tokens(text):
            pairs[before, class_of(token)] += 1
            before = class_of(token)
    return pairs


def plain_likelihood(pairs: Counter) -> float:
    """Of every token's class after the class before and of the word in its class, up to the words' own counts."""
    before, after = Counter(), Counter()
    for (b, a), n in pairs.items():
        before[b] += n
        after[a] += n
    return sum(n * (math.log(n / before[b]) - math.log(after[a])) for (b, a), n in pairs.items())


def test_scores_and_rounds_follow_plain_counts(spark):
    rows = small_corpus()
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 10 == 0}
    training = [t for d, t in rows if d not in held]
    counts = Counter(x for t in training for x in tokens(t))
    words = brown.vocabulary(brown.word_counts(documents.where(~brown.held_out(documents.doc_id)).select("text")), len(training))
    coded = brown.encode(documents, words).cache()
    places = {w: k for k, w in enumerate(words.words)}

    def class_of(token: bytes) -> int:
        code = words.end_code if token == END else places.get(token, len(places) + brown.ending(token))
        return int(model.class_of_code[code])

    reached = []
    for rounds in range(5):
        model = brown.train(coded, words, CLASSES, rounds)
        reached.append(plain_likelihood(plain_pairs(training, class_of)))
    assert reached == sorted(reached) and reached[-1] > reached[0] + 100

    pairs = plain_pairs(training, class_of)
    before, size, kinds = Counter(), Counter(), Counter()
    for (b, _), n in pairs.items():
        before[b] += n
    for token, n in counts.items():
        size[class_of(token)] += n
        kinds[class_of(token)] += 1

    def score(text: str | None) -> float:
        last, total = class_of(END), 0.0
        for token in tokens(text):
            own = class_of(token)
            total += math.log10((pairs[last, own] + 0.1) / (before[last] + 0.1 * CLASSES))
            total += math.log10((counts[token] + 0.1) / (size[own] + 0.1 * (kinds[own] + 1)))
            last = own
        return total

    found = brown.score_texts(documents, CLASSES, rounds=4).collect()
    expected = sorted((d, d in held, len(tokens(t)), score(t)) for d, t in rows)
    found = sorted((r.doc_id, r.held_out, r.n_tokens, r.score) for r in found)
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in expected], rel=1e-9)


def test_likelihood_of_pairs():
    pairs = np.random.default_rng(5).integers(0, 9, (CLASSES, CLASSES)).astype(float)
    plain = Counter({(b, a): int(n) for (b, a), n in np.ndenumerate(pairs) if n})
    assert brown.likelihood(pairs) == pytest.approx(plain_likelihood(plain))
