"""Token-id files: ids of many documents end to end, document boundaries in Elias-Fano code.

A folder of token files holds all documents in ascending order of ``doc_id``
(null first, ties by text hash). Each file has

* a header of eight little-endian 64-bit numbers: the mark, bytes for each id,
  documents, ids, documents without a ``doc_id``, low bits of the code, bytes
  of its high part, bytes of its low part;
* the ids, the ``doc_id``s, and the high bits, low bits and samples of the
  boundaries, which are ``n_docs + 1`` numbers that begin with 0.

Which files count is written in the table ``manifest`` next to them. A task
that was run twice leaves a second file that no manifest mentions.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.llm.elias_fano import EliasFano
from tidegraph.llm.tokens import encoder

MARK = int.from_bytes(b"EFTOKENS", "little")
HEADER = struct.Struct("<8Q")
MANIFEST = "part int, file string, n_docs long, n_ids long, ids_before long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes file:/x where Arrow wants file:///x.
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def file_bytes(ids: list[bytes], doc_ids: list[int | None], width: int) -> list[bytes]:
    """The sections of a token file."""
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    bounds = EliasFano.encode(ends)
    high, low, samples = bounds.parts()
    nulls = sum(x is None for x in doc_ids)
    header = HEADER.pack(MARK, width, len(doc_ids), int(ends[-1]), nulls, bounds.low_bits, len(high), len(low))
    return [header, *ids, np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(), high, low, samples]


class TokenFile:
    """A token file that is open for reading; ``ids(k)`` reads one document only."""

    def __init__(self, source):
        self.source = source
        mark, self.width, self.n_docs, self.n_ids, self.nulls, low_bits, high, low = HEADER.unpack(self._read(0, HEADER.size))
        if mark != MARK:
            raise ValueError("not a token file")
        at = HEADER.size + self.n_ids * self.width
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        samples = 4 * (-(-(self.n_docs + 1) // 256))
        rest = self._read(at, high + low + samples)
        self.bounds = EliasFano.from_parts(self.n_docs + 1, low_bits, rest[:high], rest[high : high + low], rest[high + low :])

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def start(self, k: int) -> int:
        return self.bounds.select(k)

    def slice(self, first: int, last: int) -> np.ndarray:
        """The ids from number ``first`` to before number ``last`` of the file."""
        return np.frombuffer(self._read(HEADER.size + first * self.width, (last - first) * self.width), f"<u{self.width}")

    def ids(self, k: int) -> np.ndarray:
        return self.slice(self.bounds.select(k), self.bounds.select(k + 1))

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else int(self.doc_ids[k])


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int, ids_per_file: int = 1 << 23
) -> DataFrame:
    """Write ``documents(doc_id, text)`` as token files below ``folder``; returns the manifest.

    The rows are dealt out by ranges of ``doc_id``, so the one shuffle is that
    of the texts, and each task writes its range file by file; it holds the ids
    of one file and one batch of rows. A null text is an empty one; every
    document ends with ``end_id``, so none has no ids. A repeated ``doc_id`` is
    kept as often as it occurs. No documents: an empty manifest. Other columns
    are not read.
    """
    spark = documents.sparkSession
    tie = F.xxhash64("text")
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        width = known.width
        end = end_id.to_bytes(width, "little")
        system, root = _open(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = before = files = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, before, files
            name = f"part-{part:06d}-{files:05d}-{attempt}.tok"
            with system.open_output_stream(f"{root}/{name}") as out:
                for section in file_bytes(ids, doc_ids, width):
                    out.write(section)
            row = {"part": part, "file": name, "n_docs": len(doc_ids), "n_ids": held, "ids_before": before}
            before, files, held = before + held, files + 1, 0
            ids.clear()
            doc_ids.clear()
            kinds = [("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("ids_before", pa.int64())]
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1), strict=True):
                ids.append(known.encode(text.as_py()) + end)
                doc_ids.append(key)
                held += len(ids[-1]) // width
                if held >= ids_per_file:
                    yield flush()
        if doc_ids:
            yield flush()

    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files with the number of ids before each; one row for a part meets in the running sum."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    running = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(running), F.lit(0)).alias("parts_before"))
    start = (F.col("ids_before") + F.col("parts_before")).alias("start")
    return files.join(parts, "part").select("file", "n_docs", "n_ids", start)


def read_token_files(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """All documents of ``folder``: ``doc_id, start, n_tokens, ids, file``.

    ``start`` counts the ids of all documents before, ``ids`` are little-endian
    unsigned 32-bit numbers. A file is read by one task, about a million ids or
    65,536 documents at a time: ``select`` on the coded boundaries finds where
    such a block ends, and only its own offsets are decoded.
    """
    files = read_manifest(spark, folder)
    if tasks is None:
        most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tasks = max(1, min(files.count(), most))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    opened = TokenFile(source)
                    bounds = opened.bounds
                    first = 0
                    while first < opened.n_docs:
                        # About a million ids at a time, one document at least.
                        begin = bounds.select(first)
                        last = bounds.place_after(begin + (1 << 20), first + 1) - 1
                        last = min(max(last, first + 1), opened.n_docs, first + (1 << 16))
                        # Offsets of this block alone; the code of all others stays as it is.
                        starts = bounds.between(first, last + 1)
                        block = opened.slice(begin, int(starts[-1])).astype("<u4")
                        at = starts - begin
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([opened.doc_id(k) for k in range(first, last)], pa.int64()),
                                "start": pa.array(starts[:-1] + row["start"], pa.int64()),
                                "n_tokens": pa.array(np.diff(at), pa.int64()),
                                "ids": pa.array([block[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                                "file": pa.array([row["file"]] * (last - first), pa.string()),
                            }
                        )
                        first = last

    return files.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, file string")
