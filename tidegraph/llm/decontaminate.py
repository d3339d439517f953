"""Benchmark decontamination: n-gram windows of test items looked up in training texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import stored

# A-Z in lower case; all other ASCII characters that are no digits or letters become blanks.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class WindowIndex:
    """The windows of some items, by length: sorted hashes, and item numbers by the words of a window."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int):
        self.words: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})
        numbers = {name: k for k, name in enumerate(self.items)}
        found: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            split = words_of(text)
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in split], np.int64)
            length = min(width, len(ids))
            for at in range(len(ids) - length + 1 if length else 0):
                found[length][ids[at : at + length].tobytes()].add(numbers[name])
        self.windows = {length: {w: sorted(n) for w, n in own.items()} for length, own in found.items()}
        self.hashes = {
            length: np.unique(_hashes(np.stack([np.frombuffer(w, np.int64) for w in own]).ravel(), length)[::length])
            for length, own in self.windows.items()
        }

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(begin, end, items) of every window that occurs in ``ids``, where 0 is a word of no item."""
        hits = []
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            known = np.cumsum(np.r_[0, ids > 0])
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if len(at) == 0:
                continue
            some = _hashes(ids, length)[at]
            place = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
            own = self.windows[length]
            for begin in at[hashes[place] == some].tolist():
                # Equal hashes are no proof, equal words are.
                named = own.get(ids[begin : begin + length].tobytes())
                if named:
                    hits.append((begin, begin + length, named))
        return hits


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every window of ``length`` ids."""
    values = ids.astype(np.uint64)
    count = len(values) - length + 1
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * _BASE + values[k : k + count]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


MARKS = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def item_blocks(benchmark: DataFrame, most_words: int) -> tuple[DataFrame, int]:
    """``benchmark`` with a number ``block``, so that no block has over ``most_words`` words, and the number of blocks.

    An item of more words is a block's only one of that size; the driver sees
    one sum for each block.
    """
    size = F.length(F.coalesce("text", F.lit(""))) / 2 + 1  # words at most
    total = benchmark.agg(F.sum(size), F.max(size)).first()
    blocks = max(1, int((total[0] or 0) // most_words + 1))
    while True:
        dealt = benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= max(most_words, total[1] or 0) or blocks > 2 * (total[0] or 0):
            return dealt, blocks
        blocks *= 2


def mark_contaminated(
    documents: DataFrame, benchmark: DataFrame, width: int = 10, most_words: int = 1 << 20
) -> DataFrame:
    """``documents`` with ``n_words``, merged ``spans`` of words inside test windows, and the ``items`` they are from.

    A window is ``width`` consecutive words of an item of
    ``benchmark(item_id, text)``, or the whole of a shorter one. The windows of
    up to ``most_words`` words of test items go to all tasks as one hash set,
    which is the bound on what is broadcast; a larger benchmark is held against
    the documents block by block, with the marks so far written to the shared
    folder between. Texts stay whole and where they are, nothing is shuffled.

    Null and empty texts have no words, so no hits; null items and items
    without a word have no windows. An item without ``item_id`` is known as
    the empty string, items of the same id are one item. Repeated rows are
    marked alike. Empty tables: no rows, or no hits. Other columns are passed
    on, except those named like the marks, which are replaced.
    """
    base = documents.drop("n_words", "spans", "items")
    dealt, blocks = item_blocks(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), most_words)
    marked = base
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item_id", F.col("text").cast("binary")).collect()
        if block:
            marked = stored(marked, "marked")
        marked = _mark_block(marked, [(r[0], None if r[1] is None else bytes(r[1])) for r in rows], width)
    return marked


def _mark_block(documents: DataFrame, items: list[tuple[str, bytes | None]], width: int) -> DataFrame:
    spark = documents.sparkSession
    names = [c for c in documents.columns if c not in ("n_words", "spans", "items")]
    again = "spans" in documents.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*names).schema)
    shared = spark.sparkContext.broadcast(WindowIndex(items, width))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: WindowIndex = shared.value
        get = index.words.get
        for batch in batches:
            texts = batch.column(names.index("text")).cast(pa.binary())
            before = batch.column(len(names) + 1).to_pylist() if again else repeat(None)
            named = batch.column(len(names) + 2).to_pylist() if again else repeat(None)
            counts, spans, found = [], [], []
            for text, own, own_items in zip(texts, before, named):
                split = words_of(text.as_py())
                ids = np.fromiter(map(get, split, repeat(0)), np.int64, len(split))
                hits = index.scan(ids)
                merged = _merged([(s["begin"], s["end"]) for s in own or ()] + [(a, b) for a, b, _ in hits])
                numbers = {k for _, _, some in hits for k in some}
                counts.append(len(split))
                spans.append([{"begin": a, "end": b} for a, b in merged])
                found.append(sorted({*(own_items or ()), *(index.items[k] for k in numbers)}))
            made = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), *made], names=[*names, "n_words", "spans", "items"]
            )

    return documents.select(*names, *(["n_words", "spans", "items"] if again else [])).mapInArrow(mark, f"{schema}, {MARKS}")


def hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def items_digest(items: str) -> Column:
    """SHA-256 of item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = 10) -> DataFrame:
    """``documents`` without those that hold a test window, or with the hit words cut out of them.

    ``remove`` is ``"documents"`` or ``"spans"``. With spans, a run of hit
    words goes together with what stands between them, and one blank takes its
    place; all else of the text stays as it is. Edge cases as in
    ``mark_contaminated``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    # The other columns travel as one, so their names cannot clash with the marks.
    others = [c for c in documents.columns if c != "text"]
    rest = F.struct(F.lit(0).alias("text_follows"), *others).alias("rest")
    marked = mark_contaminated(documents.select(rest, "text"), benchmark, width)
    if remove == "documents":
        kept = marked.where(F.size("spans") == 0).select("rest", "text")
    else:
        kept = marked.select("rest", "text", "spans").mapInArrow(_cut, documents.select(rest, "text").schema)
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in documents.columns])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        cut = pa.array([_without(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), cut], names=["rest", "text"])


def _without(text: str | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return text
    data = text.encode()
    plain = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
    starts = np.flatnonzero(plain & ~np.r_[False, plain[:-1]])
    ends = np.flatnonzero(plain & ~np.r_[plain[1:], False]) + 1
    parts, at = [], 0
    for span in spans:
        parts.append(data[at : starts[span["begin"]]])
        at = ends[span["end"] - 1]
    parts.append(data[at:])
    return b" ".join(parts).decode()
