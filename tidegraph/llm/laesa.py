"""Vector codes: parts of integer vectors by their nearest codebook entry, searched with fixed pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import stored
from tidegraph.operators.lookup import lookup

# Integers beyond this could make a squared distance too large for a LONG.
LARGEST = 1 << 26
# Parts compared at a time, and entries tried at a time in the order of their bounds.
_ROWS, _TRIED = 4096, 8
# What rounding may do to a bound at most; distances are below 2**32.
_MARGIN = 1e-4


@dataclass
class Codebooks:
    """Entries (part, entry, component) and the pivots (part, pivot, component) that stay throughout."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, whole`` of the rows whose vector can be coded; ``whole`` is floor(scale * x) for each x.

    Dropped: vectors that are null, empty, or hold null or non-finite
    components, and such whose integers exceed ``LARGEST`` in size, for which
    squared distances do not fit. Repeated rows stay.
    """
    x = F.col(vector)
    fits = F.forall(x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) <= LARGEST / scale), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & fits).select("vec_id", "label", whole.alias("whole"))


def _fixed_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Of each part some first entries far from each other: always the one farthest from those there are."""
    chosen = []
    for own in entries:
        picked = [0]
        nearest = ((own - own[0]) ** 2).sum(1)
        while len(picked) < min(count, len(own)):
            picked.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((own - own[picked[-1]]) ** 2).sum(1))
        chosen.append(own[picked])
    return np.stack(chosen)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(2).astype(np.float64))


def nearest_entries(
    points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of the nearest of ``entries`` for each of ``points``, the exact squared distance, and how many were worked out.

    By the triangle inequality an entry is at least as far from a point as
    their distances to a pivot differ. Entries are tried in the order of their
    largest such bound, some at a time, until the next bound is above the best
    distance found. Distances are integers and ties go to the lower place.
    """
    bounds = np.abs(to_pivots[:, None, 0] - entry_pivots[None, :, 0])
    for k in range(1, to_pivots.shape[1]):
        np.maximum(bounds, np.abs(to_pivots[:, None, k] - entry_pivots[None, :, k]), out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    best = np.full(len(points), np.iinfo(np.int64).max)
    place = np.zeros(len(points), np.int64)
    open_rows, evaluated = np.arange(len(points)), 0
    for start in range(0, len(entries), _TRIED):
        tried = order[open_rows, start : start + _TRIED]
        exact = ((points[open_rows, None, :] - entries[tried]) ** 2).sum(2)
        evaluated += exact.size
        least = exact.min(axis=1)
        # The lowest of the places that have the least distance.
        where = np.where(exact == least[:, None], tried, len(entries)).min(axis=1)
        better = (least < best[open_rows]) | ((least == best[open_rows]) & (where < place[open_rows]))
        place[open_rows] = np.where(better, where, place[open_rows])
        best[open_rows] = np.minimum(best[open_rows], least)
        if start + _TRIED >= len(entries):
            break
        following = bounds[open_rows, order[open_rows, start + _TRIED]]
        open_rows = open_rows[following <= np.sqrt(best[open_rows].astype(np.float64)) + _MARGIN]
        if not len(open_rows):
            break
    return place, best, evaluated


def _parts_of(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(part, row, component) of a batch with the column ``whole``."""
    flat = batch.column("whole").flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1).transpose(1, 0, 2)


def _with_pivots(parts: int, pivots: np.ndarray):
    """Add the distances of all parts to their pivots, worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.stack([_distances(p, own) for p, own in zip(_parts_of(batch, parts), pivots, strict=True)], axis=1)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), int(found.shape[1] * found.shape[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows.cast(pa.list_(pa.float64()))], [*batch.schema.names, "to_pivots"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], books: Codebooks):
    """Part, rows' codes and exact distances, block by block: ``(batch, codes, distances, parts)``."""
    count = len(books.entries)
    entry_pivots = [_distances(e, p) for e, p in zip(books.entries, books.pivots, strict=True)]
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            points = _parts_of(batch, count)
            to_pivots = batch.column("to_pivots").flatten().to_numpy().reshape(batch.num_rows, count, -1)
            found = [nearest_entries(points[k], to_pivots[:, k], books.entries[k], entry_pivots[k]) for k in range(count)]
            yield batch, np.stack([f[0] for f in found]), np.stack([f[1] for f in found]), points


def _sums(books: Codebooks):
    """Sums and counts of the parts assigned to each entry, once for each task."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, codes, _, points in _blocks(batches, books):
            for k in range(parts):
                np.add.at(sums[k], codes[k], points[k])
                counts[k] += np.bincount(codes[k], minlength=entries)
        part, entry = np.nonzero(counts)
        used = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), used]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def train_codebooks(
    whole: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, pivots: int = 8
) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks for ``whole`` (from ``whole_vectors``), and its rows with ``to_pivots``.

    A part's codebook starts as that part of the vectors with the ``entries``
    smallest ids (rows of one id in the order of their vectors); fewer vectors
    give fewer entries. In each round every part goes to its nearest entry
    (ties: the lower) and an entry becomes floor(sum / count) of its parts;
    unused entries stay. Vectors whose length differs from that of the first
    one are left out, as they cannot be compared. No vectors: no codebooks.

    The pivots are some of the first entries. The distances of all parts to
    them are worked out once and stored with the rows; a round adds those of
    the entries. The driver sees the first vectors and, each round, one sum for
    each entry.
    """
    first = [r.whole for r in whole.select("vec_id", "whole").orderBy("vec_id", "whole").limit(entries).collect()]
    if not first:
        return None, whole.withColumn("to_pivots", F.array().cast("array<double>"))
    width = len(first[0])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    start = np.array([v for v in first if len(v) == width], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    books = Codebooks(start, _fixed_pivots(start, pivots))
    rows = whole.where(F.size("whole") == width)
    schema = rows.withColumn("to_pivots", F.array().cast("array<double>")).schema
    placed = stored(rows.mapInArrow(_with_pivots(parts, books.pivots), schema), "pivots")
    for _ in range(rounds):
        sums = placed.select("whole", "to_pivots").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width // parts)]
        moved = books.entries.copy()
        for part, entry, n, *total in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
            moved[part, entry] = np.array(total, np.int64) // n
        books = Codebooks(moved, books.pivots)
    return books, placed


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes, distances, _ in _blocks(batches, books):
            text = ["".join(f"{c:02x}" for c in row) for row in codes.T.tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(distances.sum(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def encode_vectors(placed: DataFrame, books: Codebooks | None) -> DataFrame:
    """``vec_id, label, code, error`` of ``placed`` (from ``train_codebooks``).

    ``code`` has two hex digits for each part, ``error`` is the sum of the
    exact squared distances. Every row gives one; no codebooks, no rows.
    """
    schema = placed.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if books is None:
        return placed.sparkSession.createDataFrame([], schema)
    if books.entries.shape[1] > 256:
        raise ValueError("two hex digits name 256 entries at most")
    return placed.mapInArrow(_codes(books), schema)


def errors_by_label(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of ``error`` over rows of one label; null labels are one.

    Sums are made in tasks before they meet; a hot label is split over tasks
    when they are joined back.
    """
    codes = stored(codes, "codes").withColumn("own_label", F.struct("label"))
    sums = codes.groupBy("own_label").agg(F.sum("error").alias("label_error"))
    return lookup(codes, sums, ["own_label"]).drop("own_label")
