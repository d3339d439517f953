"""Spelling variants: words one edit apart, found with bit-sliced position indexes.

Two words that are one inserted, deleted or replaced character apart agree on
everything before the edit and on everything behind it. So a pair meets in a
block of words with the same beginning and end around a region that holds the
edit. Each block is searched with one bitset over its words for every position
and letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import sorted_runs, stored
from tidegraph.operators.lookup import lookup
from tidegraph.runtime import SMALL_ROWS, Rounds

# Characters of a text taken at a time, and words a task remembers before it passes their counts on.
_CHUNK, _WORDS_HELD = 1 << 22, 400_000
# Characters of the words of one block; above that its region is split.
BLOCK_CHARS = 1 << 15
# Words and characters searched together; small blocks share a search.
_TOGETHER, _CHARS_TOGETHER = 1024, 1 << 20

WORDS = "word string, n long"
NEAR = "word string, n_near long, form_n long, form string"
_LETTER = re.compile("[a-zÀ-ÿ]")


def _runs(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    """Whole runs of letters of a text with A-Z lowered, those of some characters at a time."""
    text = text.encode("utf-8", "replace").lower().decode()  # bytes know the case of A-Z only
    start = 0
    while start < len(text):
        end = min(start + _CHUNK, len(text))
        while end < len(text) and _LETTER.match(text, end):
            end += 1
        yield pattern.findall(text, start, end)
        start = end


def _count(batches: Iterator[pa.RecordBatch], every: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    # Shorter runs give no word that is long enough.
    pattern = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")
    counts: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        columns = [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for runs in _runs(text or "", pattern):
                own = Counter(runs)
                if every:
                    hit = [(run, h) for run in own if (h := zlib.crc32(run.encode(), prefix)) % every == 0]
                    for run, h in hit:
                        at, n = h % len(run), own.pop(run)
                        counts[run[:at] + run[at + 1 :]] += n
                counts.update(own)
                if len(counts) > _WORDS_HELD:
                    yield passed_on()
    yield passed_on()


def count_words(documents: DataFrame, every: int = 0, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``(word, n)`` of the words of ``documents(doc_id, text)``: runs of ASCII and Latin-1 letters, A-Z lowered.

    ``every`` plants misspellings: a run of a document whose CRC-32, together
    with the id, is a multiple of it loses one character (0: none). Words of at
    least ``min_chars`` characters and ``min_count`` occurrences are kept. A
    null id counts as empty, a null or empty text has no words, a repeated row
    counts again; no rows, no words. Other columns are not read. Words are
    counted in tasks before they are shuffled.
    """
    counted = documents.select("doc_id", "text").mapInArrow(lambda batches: _count(batches, every, min_chars), WORDS)
    counted = counted.where(F.length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``word, n, size, low, high`` with their block: what stands before and behind the region.

    A word has ``size`` characters or one more, and that one is in the region.
    """
    behind = F.col("size") - F.col("high")
    head = F.substring("word", F.lit(1), F.col("low"))
    tail = F.substring("word", F.length("word") - behind + 1, behind)
    return rows.withColumn("block", F.struct("size", "low", "high", head.alias("head"), tail.alias("tail")))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row twice, with the edit in the lower and in the upper half of its region."""
    middle = F.expr("CAST((low + high) DIV 2 AS INT)")
    lower, upper = F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))
    split = rows.withColumn("half", F.explode(F.array(lower, upper)))
    return _placed(split.select("word", "n", "size", "half.low", "half.high"))


def _blocks(words: DataFrame, rounds: Rounds, block_chars: int) -> DataFrame:
    """``word, n, size, low, high, block`` so that every pair one edit apart has one block in common that tells it.

    The region of a block with too many characters is split until it is small
    enough or one character wide; then its words differ in two characters at
    most, so the alphabet bounds them. Only counts of blocks are shuffled here.
    """
    size = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s >= 0))
    rows = words.select("word", "n", size.alias("size")).withColumns({"low": F.lit(0), "high": F.col("size")})
    rows, done = _placed(rows), []
    while True:
        chars = rows.groupBy("block").agg(F.sum(F.length("word")).alias("chars"))
        large = chars.where((F.col("chars") > block_chars) & (F.col("block.high") - F.col("block.low") > 1))
        large, count = rounds.keep(large.select("block"))
        if not count:
            break
        # At most all characters by the limit; broadcast where that is little indeed.
        side = F.broadcast(large) if count <= SMALL_ROWS else large
        done.append(rows.join(side, "block", "left_anti").select(rows.columns))
        rows = _halves(rows.join(side, "block", "left_semi"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _slices(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For each of ``letters`` the bitset of the words that have it in this position."""
    return np.packbits(points[None, :] == letters[:, None], axis=1, bitorder="little")


def one_edit_pairs(points: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the asking word and of the found one, for all pairs one edit apart.

    ``points`` has the characters of a word in each row, filled up with zeros
    to ``size + 1``; words have ``size`` or ``size + 1`` characters. Those of
    ``size`` ask; what they find is as long and has one character replaced, or
    is longer and has one inserted.

    The index is a bitset of the words for each position and letter. Each
    asking word has three sets, moved along character by character, for all
    words at once: ``exact`` agrees so far, ``replaced`` has one other
    character and stands at the same position, ``longer`` has one more and
    stands one further. The latter two take up what leaves ``exact``.
    """
    asking = np.flatnonzero(sizes == size)
    every = np.packbits(np.ones(len(sizes), bool), bitorder="little")
    exact = np.tile(every, (len(asking), 1))
    replaced, longer = np.zeros_like(exact), np.zeros_like(exact)
    for k in range(size):
        letters, own = np.unique(points[asking, k], return_inverse=True)
        here, ahead = _slices(points[:, k], letters)[own], _slices(points[:, k + 1], letters)[own]
        longer |= exact
        longer &= ahead
        replaced &= here
        replaced |= exact & ~here
        exact &= here
    long_ones = np.packbits(sizes == size + 1, bitorder="little")
    found = ((longer | exact) & long_ones) | (replaced & ~long_ones)
    row, byte = np.nonzero(found)
    which, bit = np.nonzero(np.unpackbits(found[row, byte][:, None], axis=1, bitorder="little"))
    return asking[row[which]], byte[which] * 8 + bit


def _search(words: list[str], n: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> pa.RecordBatch:
    """For each word how many near words its blocks tell, and the best of them."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    filled = "".join(w.ljust(size + 1, "\0") for w in words).encode("utf-32-le")
    points = np.frombuffer(filled, "<u4").reshape(len(words), size + 1)
    a, b = one_edit_pairs(points, sizes, size)
    # The block whose region holds the first difference tells a pair, no other.
    same = (low[a] == low[b]) & (high[a] == high[b])
    a, b = a[same], b[same]
    step = max(1, _CHARS_TOGETHER // (size + 1))
    first = np.concatenate([np.zeros(0, np.int64)] + [
        np.argmax(points[a[k : k + step]] != points[b[k : k + step]], axis=1) for k in range(0, len(a), step)
    ])
    told = (low[a] <= first) & ((first < high[a]) | (high[a] == size))
    a, b = a[told], b[told]
    # Words of one length ask each other; the longer ones do not ask.
    longer = sizes[b] > size
    word, near = np.r_[a, b[longer]], np.r_[b, a[longer]]
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((alphabetic[near], -n[near], word))
    word, near = word[order], near[order]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(word)])
    best = near[starts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[k] for k in word[starts]], pa.string()), pa.array(counts, pa.int64()),
            pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string()),
        ],
        ["word", "n_near", "form_n", "form"],
    )


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by size and key; blocks are searched some together."""
    for rows in sorted_runs(batches, "key"):
        words = rows.column("word").to_pylist()
        n, size, low, high, key = (rows.column(c).to_numpy() for c in ("n", "size", "low", "high", "key"))
        ends = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (size[1:] != size[:-1])) + 1, len(words)]
        start = previous = 0
        for end in ends.tolist():
            grown = end - start > _TOGETHER or (end - start) * (size[start] + 1) > _CHARS_TOGETHER
            if previous > start and (grown or size[end - 1] != size[start]):
                own = slice(start, previous)
                yield _search(words[own], n[own], low[own], high[own], int(size[start]))
                start = previous
            previous = end
        own = slice(start, previous)
        yield _search(words[own], n[own], low[own], high[own], int(size[start]))


def near_words(words: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, n, n_near, best)`` for distinct ``words(word, n)``.

    ``n_near`` counts the words one inserted, deleted or replaced character
    away, ``best`` is the one of the largest ``n`` (ties: the smallest), with
    ``form_n`` and ``form``, and null where there is none. Each pair is told by
    one block only, so counts add up; a word's rows are reduced to one for each
    search before they are shuffled.
    """
    rounds = Rounds(words.sparkSession, "spelling")
    try:
        blocks = _blocks(words, rounds, block_chars)
        dealt = blocks.select("word", "n", "size", "low", "high", F.xxhash64("block").alias("key"))
        dealt = dealt.repartition("key").sortWithinPartitions("size", "key")
        found = dealt.mapInArrow(_search_blocks, NEAR)
        best = F.struct((-F.col("form_n")).alias("order"), "form")
        rows = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best"))
        alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(rows.schema["best"].dataType).alias("best"))
        told = rows.unionByName(alone).groupBy("word").agg(
            F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")
        )
        found = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.order")).alias("form_n"), F.col("best.form").alias("form")))
        return stored(told.withColumn("best", found), "near-words")
    finally:
        rounds.forget_all_but()


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for ``links(word, form)`` without loops; steps double each round."""
    rounds = Rounds(links.sparkSession, "roots")
    try:
        current, more = rounds.keep(links.select("word", F.col("form").alias("root")))
        while more:
            further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
            joined = lookup(current, further, ["root"])
            moved, _ = rounds.keep(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
            more = not moved.where("more").isEmpty()
            rounds.forget_all_but(moved)
            current = moved.drop("more")
        return stored(current, "roots")
    finally:
        rounds.forget_all_but()


def group_variants(words: DataFrame, times: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for distinct ``words(word, n)``.

    The form of a word is its near word of the largest ``n`` if that is at
    least ``times`` (over 1) the word's own, else null. The root is the last
    form on the way from a word, the word itself if it has none; as ``n`` grows
    at each step the way ends. No words: no rows.
    """
    if times < 2:
        raise ValueError("forms have to be more frequent by a factor of two at least")
    words = stored(words.select("word", "n"), "words")
    near = near_words(words, block_chars)
    better = F.col("best.form_n") >= times * F.col("n")
    near = near.withColumns({"form": F.when(better, F.col("best.form")), "form_n": F.when(better, F.col("best.form_n"))})
    roots = _roots(near.where("form IS NOT NULL").select("word", "form"))
    return lookup(near, roots, ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
