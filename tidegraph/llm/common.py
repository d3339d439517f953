"""What several operators share: input tables, the shared folder, groups out of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegraph.runtime import scratch_path

# Words in the sense of the operators: runs of anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation.

    Zstandard, because the default codec keeps buffers outside the heap until
    they happen to be collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by ``key``, of some ``most`` rows each.

    Only the last group of a batch may go on in the next one, so no more than
    one batch and the rows gathered so far are held. Groups have to be bounded
    by the caller, which gives large ones a finer key.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        if rows >= most and held[-1].column(held[-1].schema.get_field_index(key))[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            # Cut before the last group, which may not be complete.
            whole = pa.Table.from_batches(held)
            column = whole.column(key)
            last, low, high = column[-1], 0, whole.num_rows - 1
            while low < high:
                middle = (low + high) // 2
                if column[middle] == last:
                    high = middle
                else:
                    low = middle + 1
            if low:
                yield whole.slice(0, low)
                held = whole.slice(low).to_batches()
                rows = whole.num_rows - low
    if held:
        yield pa.Table.from_batches(held)
