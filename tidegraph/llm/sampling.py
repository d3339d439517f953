"""Bounded samples of rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*columns: str) -> Column:
    """A number from 0 to 1 that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 11) / F.lit(float(1 << 53))


def sample_by(rows: DataFrame, group: str, most: int, *key: str) -> DataFrame:
    """About ``most`` rows of each ``group``, or all where it has fewer, chosen by a hash of ``key``.

    The driver sees one count for each group.
    """
    counts = rows.groupBy(group).count().collect()
    rate = F.lit(0.0)
    for value, n in counts:
        rate = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(min(1.0, most / n))).otherwise(rate)
    return rows.where(uniform(*key) < rate)


def sample_rows(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` of ``rows``, or all if there are fewer, chosen by a hash of ``key``."""
    return rows.where(uniform(*key) < min(1.0, most / max(1, rows.count())))
