"""Language-model scoring with Brown class-based n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import sorted_runs, stored
from tidegraph.operators.lookup import lookup

# Added to every count, and once for all words that are not known.
ADD = 0.1
# Words of at least this share of all tokens are looked up inside tasks; so there are a million at most.
KNOWN_SHARE = 1e-6
# Words of at least this share move between classes by themselves, 100,000 at most; the others with their ending.
OWN_SHARE = 1e-5
ENDINGS = 2048


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id's text, a null id as the empty text, divides by 10."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes, so A-Z and ASCII blanks only


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """``word, n`` over all of ``texts(text)``; a task counts up to ``most`` words before it sends them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(words_of(text.as_py()))
                if len(seen) > most:
                    yield flush()
        yield flush()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words in order of their counts, and the sums over all words.

    A token's code is its place among the frequent words, or stands for its
    last three bytes, or for the end of a text.
    """

    words: list[bytes]
    counts: np.ndarray
    own: int  # so many of the words move by themselves
    total: int  # training tokens, with the ends
    kinds: int  # distinct training tokens, with the end
    ends: int  # training texts
    ending_counts: np.ndarray  # of words that are not among the frequent ones
    ending_kinds: np.ndarray

    @property
    def end_code(self) -> int:
        return len(self.words) + ENDINGS

    def unit_of_code(self) -> np.ndarray:
        """What moves between classes: words, endings, and the end."""
        more = [self.own + ending(w) for w in self.words[self.own :]]
        return np.r_[np.arange(self.own), np.array(more, int), self.own + np.arange(ENDINGS + 1)].astype(np.int64)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From all ``counts(word, n)``; the driver gets sums, the frequent words and a row for each ending."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, kinds = int(sums[0] or 0) + texts, int(sums[1]) + (texts > 0)
    least = max(1.0, KNOWN_SHARE * total)
    found = sorted(((bytes(w), n) for w, n in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
    rare = counts.where(F.col("n") < least).groupBy((F.crc32(F.substring("word", -3, 3)) % ENDINGS).alias("ending"))
    tails = np.zeros((2, ENDINGS))
    for place, n, different in rare.agg(F.sum("n"), F.count("*")).collect():
        tails[:, place] = n, different
    numbers = np.array([n for _, n in found], np.int64)
    own = int((numbers >= OWN_SHARE * total).sum())
    return Vocabulary([w for w, _ in found], numbers, own, total, kinds, texts, tails[0], tails[1])


def encode(documents: DataFrame, words: Vocabulary) -> DataFrame:
    """``row, doc_id, held_out, codes, rare``: each text's codes as 32-bit numbers and its words that are not frequent.

    ``row`` tells rows apart once this is written down.
    """
    shared = documents.sparkSession.sparkContext.broadcast((words.words, words.end_code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, end = shared.value
        codes_of = {w: k for k, w in enumerate(frequent)}
        size = len(frequent)
        for batch in batches:
            # A thousand rows at a time, so that long texts do not add up.
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                codes, rare = [], []
                for text in some.column(2).cast(pa.binary()):
                    split = words_of(text.as_py())
                    own = [codes_of.get(w, -1) for w in split]
                    other = [w for w, c in zip(split, own, strict=True) if c < 0]
                    array = np.array([*own, end], "<i4")
                    if other:
                        array[array < 0] = [size + ending(w) for w in other]
                    codes.append(array.tobytes())
                    rare.append(other)
                made = [pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], names=["doc_id", "held_out", "codes", "rare"])

    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    coded = rows.mapInArrow(run, "doc_id long, held_out boolean, codes binary, rare array<binary>")
    return coded.withColumn("row", F.monotonically_increasing_id())


def _token_blocks(batches: Iterator[pa.RecordBatch], tokens: int = 1 << 21) -> Iterator[np.ndarray]:
    """Codes of whole texts end to end, some ``tokens`` at a time."""
    held, size = [], 0
    for batch in batches:
        for codes in batch.column(0):
            held.append(codes.as_py())
            size += len(held[-1]) // 4
            if size >= tokens:
                yield np.frombuffer(b"".join(held), "<i4")
                held, size = [], 0
    if held:
        yield np.frombuffer(b"".join(held), "<i4")


def class_bigrams(codes: DataFrame, class_of_code: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each, over ``codes(codes)``; one sum for each pair reaches the driver."""
    shared = codes.sparkSession.sparkContext.broadcast(class_of_code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        found = np.zeros(classes * classes, np.int64)
        for block in _token_blocks(batches):
            own = of[block]
            found += np.bincount(np.r_[of[-1], own[:-1]] * classes + own, minlength=classes * classes)
        pairs = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(found[pairs])], names=["pair", "n"])

    sums = codes.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect()
    out = np.zeros(classes * classes)
    for pair, n in sums:
        out[pair] = n
    return out.reshape(classes, classes)


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class in which each unit adds most to the likelihood, the others staying where they are.

    ``left`` and ``right`` count the classes before and after each unit, which
    is in class ``own``; its counts are taken out of that class first.
    """
    small = 0.5
    before, after = pairs.sum(axis=1), pairs.sum(axis=0)
    gain = np.log(pairs + small) - np.log(before + small)[:, None] - np.log(after + small)[None, :]
    score = left @ gain + right @ gain.T
    rest_in = np.maximum(pairs[:, own].T - left, 0)
    rest_out = np.maximum(pairs[own] - right, 0)
    size = left.sum(axis=1)
    size_in, size_out = np.maximum(after[own] - size, 0), np.maximum(before[own] - right.sum(axis=1), 0)
    stay = left * (np.log(rest_in + small) - np.log(before + small)[None, :] - np.log(size_in + small)[:, None])
    stay += right * (np.log(rest_out + small) - np.log(after + small)[None, :] - np.log(size_out + small)[:, None])
    score[np.arange(len(own)), own] = stay.sum(axis=1)
    return score.argmax(axis=1)


def likelihood(pairs: np.ndarray) -> float:
    """Natural log-likelihood of the training tokens under these class pairs, less what no class changes."""

    def part(n: np.ndarray) -> float:
        n = n[n > 0]
        return float(n @ np.log(n))

    return part(pairs) - part(pairs.sum(axis=0)) - part(pairs.sum(axis=1))


def exchange(codes: DataFrame, unit_of_code: np.ndarray, class_of_unit: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """One round of exchange clustering: every unit moves to its best class, given the class ``pairs`` so far.

    Tasks count the classes around each unit and send a row for each unit they
    met; a unit's rows are summed by one task, which picks its class. The
    driver gets one class for each unit, of which there are
    ``1 / OWN_SHARE + ENDINGS`` at most.
    """
    classes = len(pairs)
    context = codes.sparkSession.sparkContext
    shared = context.broadcast((unit_of_code, class_of_unit, pairs))
    width = 2 * classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of, classes_of, _ = shared.value
        found = np.zeros(len(classes_of) * width, np.int32)
        for block in _token_blocks(batches):
            unit = units_of[block]
            before = np.r_[units_of[-1], unit[:-1]]
            np.add.at(found, unit * width + classes_of[before], 1)
            np.add.at(found, before * width + classes + classes_of[unit], 1)
        cells = np.flatnonzero(found)
        if len(cells) == 0:
            return
        units, starts = np.unique(cells // width, return_index=True)
        ends = np.r_[starts[1:], len(cells)]
        keys, counts = (cells % width).astype("<u2"), found[cells].astype("<u4")
        columns = {
            "unit": pa.array(units, pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        }
        yield pa.RecordBatch.from_pydict(columns)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, classes_of, sums = shared.value
        for rows in sorted_runs(batches, "unit", 1 << 13):
            units, place = np.unique(rows["unit"].to_numpy(), return_inverse=True)
            keys = [np.frombuffer(x, "<u2") for x in rows["keys"].to_pylist()]
            counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4")
            cells = np.repeat(place, [len(k) for k in keys]) * width + np.concatenate(keys)
            around = np.bincount(cells, counts, len(units) * width).reshape(-1, width)
            best = best_classes(around[:, :classes], around[:, classes:], classes_of[units], sums)
            yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.int64()), "class": pa.array(best, pa.int64())})

    contexts = codes.mapInArrow(count, "unit long, keys binary, counts binary")
    chosen = contexts.repartition("unit").sortWithinPartitions("unit").mapInArrow(choose, "unit long, class long")
    out = class_of_unit.copy()
    for unit, best in chosen.collect():
        out[unit] = best
    return out


@dataclass
class BrownModel:
    """Classes of codes, log10 chances of class pairs, and of an added count in each class."""

    words: Vocabulary
    class_of_code: np.ndarray
    transition: np.ndarray
    emission_base: np.ndarray  # less log10 of a class's smoothed size


def train(codes: DataFrame, words: Vocabulary, classes: int = 64, rounds: int = 5) -> BrownModel:
    """Cluster by exchange, beginning with units dealt out in turn, then count.

    A round counts only if the likelihood rises by it. The first that does not
    raise it, or moves nothing, ends the clustering; ``rounds`` bounds them.
    """
    unit_of_code = words.unit_of_code()
    class_of_unit = np.arange(words.own + ENDINGS + 1) % classes
    training = codes.where(~F.col("held_out")).select("codes")
    pairs = class_bigrams(training, class_of_unit[unit_of_code], classes)
    for _ in range(rounds):
        moved = exchange(training, unit_of_code, class_of_unit, pairs)
        if np.array_equal(moved, class_of_unit):
            break
        after = class_bigrams(training, moved[unit_of_code], classes)
        if likelihood(after) <= likelihood(pairs):
            break
        class_of_unit, pairs = moved, after
    class_of_code = class_of_unit[unit_of_code]
    transition = np.log10((pairs + ADD) / (pairs.sum(axis=1, keepdims=True) + ADD * classes))
    counts = np.r_[words.counts, words.ending_counts, words.ends]
    kinds = np.r_[np.ones(len(words.words)), words.ending_kinds, float(words.ends > 0)]
    sizes = np.bincount(class_of_code, counts, classes) + ADD * (np.bincount(class_of_code, kinds, classes) + 1)
    return BrownModel(words, class_of_code, transition, -np.log10(sizes))


def score_texts(documents: DataFrame, classes: int = 64, rounds: int = 5) -> DataFrame:
    """Log10 probability of each whole text of ``documents(doc_id, text)`` under a class bigram model.

    A text's tokens are its words and an end. The model gives a token the
    chance of its class after the class before, times that of the word in its
    class; both are smoothed by added counts. Words are counted over all rows
    that are not held out, and all of them count. Words of a share of
    ``OWN_SHARE`` or more have a class of their own choice, others that of their last
    three bytes, so every word has one.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``; the base score is that of single words. A null text is empty and
    has the end only; a null id counts as the empty text when rows are held
    out. Repeated rows count as often as they occur. No rows: none. Other
    columns are not read.

    Counts of frequent words are bounded in number and go to the tasks; those
    of all others are joined, so a frequent word is never a join key.
    """
    training = documents.where(~held_out(F.col("doc_id")))
    counts = stored(word_counts(training.select("text")), "word-counts")
    words = vocabulary(counts, training.count())
    coded = stored(encode(documents, words), "codes")
    model = train(coded, words, classes, rounds)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    unit = float(np.log10(words.total + ADD * (words.kinds + 1))) if words.total else 0.0

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: BrownModel = shared.value
        size = len(own.words.words)
        logs = np.r_[np.log10(own.words.counts + ADD), np.zeros(ENDINGS), np.log10(own.words.ends + ADD)]
        known = np.r_[np.ones(size, bool), np.zeros(ENDINGS, bool), own.words.ends > 0]
        end = own.class_of_code[-1]
        for batch in batches:
            out = []
            for codes in batch.column(3):
                array = np.frombuffer(codes.as_py(), "<i4")
                group = own.class_of_code[array]
                chain = own.transition[np.r_[end, group[:-1]], group].sum() + own.emission_base[group].sum()
                out.append((len(array), int(known[array].sum()), float(logs[array].sum()), float(chain)))
            kinds = (("n_tokens", pa.int64()), ("n_local", pa.int64()), ("logs", pa.float64()), ("chain", pa.float64()))
            made = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for _, k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["row", "doc_id", "held_out", *(n for n, _ in kinds)])

    here = coded.select("row", "doc_id", "held_out", "codes")
    here = here.mapInArrow(local, "row long, doc_id long, held_out boolean, n_tokens long, n_local long, logs double, chain double")
    rare = coded.select("row", F.explode("rare").alias("word"))
    rare = lookup(rare, counts, ["word"]).withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + ADD)).alias("more_logs"), F.count_if(F.col("n") > 0).alias("more_known"))
    rows = here.join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_local") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (logs - unit * F.col("n_tokens")).alias("base_score"),
        (logs + F.col("chain")).alias("score"),
    )
