"""Spelling variants against edits spelt out one by one."""

import random
import re
import zlib
from collections import Counter

import brute
import pytest

from tidegraph.llm import spelling
from tidegraph.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(words, near):
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("block_chars", [1, 60, 1 << 15])
def test_pairs_whatever_the_blocks(spark, block_chars):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): 0 for _ in range(500)}
    words |= {w + "x" * 400: 0 for w in list(words)[:20]} | {"y" * 3000: 0, "y" * 3001: 0, "y" * 1500 + "z" + "y" * 1499: 0, "": 0, "q": 0}
    words = {w: rng.choice([3, 4, 6, 8, 20, 41]) for w in words}
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    frame = spark.createDataFrame([(w, n, w, 1) for w, n in words.items()], "word string, n long, block string, size int")
    found = spelling.group_variants(frame, block_chars=block_chars).select(COLUMNS).collect()
    brute.same(found, plain_variants(words, near))


def test_all_words_of_a_block_are_alike(spark):
    """A block that no region can split: one end, one beginning, all letters between."""
    words = {f"begin{chr(k)}end": k for k in range(0xE0, 0xFF)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.group_variants(frame, block_chars=1).collect()
    assert {r.n_near for r in found} == {len(words) - 1}


def test_counts(spark, documents, doc_rows):
    counts = Counter()
    for doc_id, text, _, _ in doc_rows:
        for run in re.findall("[a-zÀ-ÿ]+", brute.lower_ascii(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    brute.same(spelling.count_words(documents, every=97).collect(), expected.items())
    assert any("À" <= c for w in expected for c in w)


def test_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "_CHUNK", 7)
    text = "Überlang words ÀÉ of×several lengths, somelongerwordthanachunk"
    runs = [r for part in spelling._runs(text, re.compile("[a-zÀ-ÿ]{5,}")) for r in part]
    assert runs == ["Überlang", "words", "of×several", "lengths", "somelongerwordthanachunk"]


def test_op12(spark, tables, doc_rows):
    found = QUERIES["op12_spelling_variants"](spark, tables).select(COLUMNS).collect()
    words = {r.word: r.n for r in found}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    near = {a: [b for k in (-1, 0, 1) for b in by_size.get(len(a) + k, []) if one_edit(a, b)] for a in words}
    brute.same(found, plain_variants(words, near))
    assert sum(r.form is not None for r in found) > 50
