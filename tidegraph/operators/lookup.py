"""Joins of a large table with one row per key, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``facts`` with ``table``, which has at most one row per ``keys``.

    One key may hold a large part of ``facts``. Adaptive execution splits such a
    partition over tasks and repeats the few rows of ``table`` for each, but only
    if both sides come out of a shuffle of this very join. Most lookup tables
    here are aggregates already partitioned by the key and would be read in
    place, so a hash of the key joins as well: that partitioning no longer fits,
    the small side is shuffled once more and a hot key can be split. A table
    small enough to broadcast is broadcast as ever.
    """
    check = F.xxhash64(*keys)
    joined = facts.withColumn("key_hash", check).join(table.withColumn("key_hash", check), [*keys, "key_hash"], how)
    return joined.drop("key_hash")
