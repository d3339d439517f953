"""Vector bin packing of examples into training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
KINDS = pa.schema(
    [
        (name, pa.binary() if kind == "binary" else pa.int64())
        for name, kind in (field.split() for field in PIECES.split(", "))
    ]
)
# Tokens that may wait in a task, so that very long examples do not add up.
WAITING = 1 << 22


class Packer:
    """Packs the examples of one task.

    Up to ``pool`` open examples wait. A sequence is filled by the dot-product
    rule: of the examples that fit, take the one whose demand (tokens, loss
    tokens, one segment; each as a share of its limit) has the largest dot
    product with what is left of the sequence. When none fits any more, the
    longest beginnings that fit are compared in the same way, and the one with
    the largest product is cut off. A sequence so
    ends short only where the limits on segments or loss tokens end it, and at
    the end of the task. What it holds is then dealt out over sequences with a
    power of two of tokens, which need no padding.
    """

    def __init__(self, part: int, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        self.max_tokens, self.max_segments, self.max_loss, self.pool = max_tokens, max_segments, max_loss, pool
        self.next_id = part << 40
        self.rows: list[tuple] = []
        self.items: list[list] = [None] * (2 * pool)  # doc_id, ids, prompt, at, all tokens
        self.tokens = np.zeros(2 * pool)
        self.loss = np.zeros(2 * pool)
        self.count = self.waiting = 0
        self._open()

    def _open(self) -> None:
        self.placed: list[tuple] = []
        self.left = [self.max_tokens, self.max_loss, self.max_segments]

    def _close(self) -> None:
        if not self.placed:
            return
        used = self.max_tokens - self.left[0]
        sizes = [used]
        if used < self.max_tokens:
            sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        pieces = iter(self.placed)
        doc_id, ids, prompt, at, length, total = next(pieces)
        for size in sizes:
            offset = 0
            while offset < size:
                if length == 0:
                    doc_id, ids, prompt, at, length, total = next(pieces)
                take = min(length, size - offset)
                loss = max(0, at + take - max(at, prompt))
                self.rows.append((doc_id, at, take, ids[at : at + take].tobytes(), loss, total, self.next_id, offset))
                at, length, offset = at + take, length - take, offset + take
            self.next_id += 1
        self._open()

    def _place(self, k: int, length: int) -> None:
        item = self.items[k]
        doc_id, ids, prompt, at, total = item
        loss = max(0, at + length - max(at, prompt))
        self.placed.append((doc_id, ids, prompt, at, length, total))
        self.left = [self.left[0] - length, self.left[1] - loss, self.left[2] - 1]
        item[3] = at + length
        self.waiting -= length
        if item[3] < len(ids):
            self.tokens[k], self.loss[k] = len(ids) - item[3], self.loss[k] - loss
            return
        last = self.count = self.count - 1
        self.items[k], self.tokens[k], self.loss[k] = self.items[last], self.tokens[last], self.loss[last]
        self.items[last] = None

    def _step(self) -> None:
        """Place one example, or a part of it, or close the sequence."""
        by_tokens, by_loss = self.left[0] / self.max_tokens**2, self.left[1] / self.max_loss**2
        tokens, loss = self.tokens[: self.count], self.loss[: self.count]
        # What of each example may be placed: its prompt comes first and bears no loss.
        prompt = tokens - loss
        length = np.minimum(np.minimum(tokens, self.left[0]), prompt + self.left[1])
        bears = np.maximum(length - prompt, 0)
        product = length * by_tokens + bears * by_loss  # the segment counts alike for all
        fitting = length == tokens
        k = int(np.argmax(np.where(fitting, product, -1.0) if fitting.any() else product))
        if length[k] == 0:
            self._close()
            return
        self._place(k, int(length[k]))
        if 0 in (self.left[0], self.left[2]):
            self._close()

    def add(self, doc_id: int | None, ids: np.ndarray, prompt: int) -> None:
        total, at = len(ids), 0
        # What fills a sequence by itself need not wait, unless prompts have to go with loss tokens of others.
        while total - at >= self.max_tokens <= self.max_loss:
            loss = max(0, at + self.max_tokens - max(at, prompt))
            piece = ids[at : at + self.max_tokens].tobytes()
            self.rows.append((doc_id, at, self.max_tokens, piece, loss, total, self.next_id, 0))
            self.next_id += 1
            at += self.max_tokens
        if at == total:
            return
        k = self.count
        self.items[k] = [doc_id, ids, prompt, at, total]
        self.tokens[k], self.loss[k] = total - at, max(0, total - max(at, prompt))
        self.count += 1
        if self.count == 2 * self.pool:
            while self.count > self.pool:
                self._step()
        self.waiting += total - at
        while self.waiting > WAITING:
            self._step()

    def finish(self) -> None:
        while self.count:
            self._step()
        self._close()

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KINDS, strict=True)], schema=KINDS)
        self.rows = []
        return made


def with_prompts(documents: DataFrame) -> DataFrame:
    """``doc_id, text, prompt``: the first half of a document's lines, rounded down, is its prompt.

    The line feed between the halves belongs to neither; it makes no token. A
    text of one line has no prompt, a null text is null.
    """
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    half = F.floor(lines / 2).cast("int")

    def part(count: Column) -> Column:
        return F.call_function("substring_index", F.col("text"), F.lit("\n"), count)

    prompt = F.when(half > 0, part(half))
    return documents.select("doc_id", part(half - lines).alias("text"), prompt.alias("prompt"))


def pack_texts(
    examples: DataFrame,
    tokenizer: str,
    end_id: int,
    max_tokens: int = 2048,
    max_segments: int = 128,
    max_loss: int | None = None,
    prompt: str | None = None,
    pool: int = 512,
) -> DataFrame:
    """Pack ``examples(doc_id, text)`` into sequences; one row for each piece of an example.

    ``prompt`` names a column of text that precedes ``text`` and bears no loss;
    without it every token bears loss. A sequence has at most ``max_tokens``
    tokens, ``max_segments`` pieces and ``max_loss`` tokens that bear loss
    (``max_tokens`` unless given). Returns ``doc_id, start, length, ids,
    loss_tokens, doc_tokens, sequence_id, offset``, with ``ids`` as
    little-endian unsigned 32-bit numbers.

    Nothing is shuffled: each task encodes and packs the rows it scans, and
    holds the rests of some thousand examples. Rows with the same ``doc_id``,
    or none, are examples of their own; a null text or prompt is an empty one,
    so every row has ``end_id`` at least. No rows: no pieces. Other columns are
    not read.
    """
    if min(max_tokens, max_segments, max_tokens if max_loss is None else max_loss) < 1:
        raise ValueError("limits have to be positive")
    first = F.lit(None).cast("string") if prompt is None else F.col(prompt)
    rows = examples.select("doc_id", "text", first.alias("prompt"))
    prompted = prompt is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        kind = f"<u{known.width}"
        part = TaskContext.get().partitionId()
        packer = Packer(part, max_tokens, max_segments, max_tokens if max_loss is None else max_loss, pool)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            before = batch.column(2).to_pylist() if prompted else None
            for k, text in enumerate(batch.column(1)):
                lead = known.encode(before[k]) if prompted else b""
                found = np.frombuffer(lead + known.encode(text.as_py()), kind)
                packer.add(keys[k], np.append(found, end_id).astype("<u4"), len(lead) // known.width)
                if len(packer.rows) >= 2000:
                    yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    return rows.mapInArrow(pack, PIECES)
