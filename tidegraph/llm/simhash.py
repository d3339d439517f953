"""Near-duplicates by SimHash fingerprints, found through blocks that close pairs share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import sorted_runs, stored
from tidegraph.llm.components import connected_components
from tidegraph.operators.lookup import lookup

SEED = 42
# Sets of at most so many shingles can be 0.8 alike and differ in such a share of fingerprint bits (four of five: 6/16 / 2).
FEW, FEW_SHARE = 6, 0.1875
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of all shingles of ``words`` words, repeats included; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    split = (text or b"").translate(_LOWER).split()
    if not split:
        return np.zeros(0, "<u8")
    joined = b" ".join(split)
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(split))
    spans = zip(starts[: len(split) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(text: bytes | None, words: int = 4, size: int = 1) -> np.ndarray:
    """SimHash of ``size`` times 64 bits over all shingles; zero without words.

    A bit is 1 if it is set in over half the hashes. The first 64 come from
    the hashes themselves, further ones from hashes mixed anew.
    """
    return _majority(shingle_hashes(text, words), size)


def _majority(first: np.ndarray, size: int) -> np.ndarray:
    hashes = np.empty((len(first), size), "<u8")
    with np.errstate(over="ignore"):
        for k in range(size):
            x = first + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
            if k:
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            hashes[:, k] = x
    ones = np.zeros(64 * size, np.int64)
    # So few rows at a time that their sums fit a byte.
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def with_fingerprint(documents: DataFrame, words: int = 4, size: int = 1) -> DataFrame:
    """``documents`` with ``fingerprint``: the 64-bit one of ``text`` as a long, a longer one as bytes."""
    kind, arrow = ("long", pa.int64()) if size == 1 else ("binary", pa.binary())
    schema = documents.withColumn("fingerprint", F.lit(None).cast(kind)).schema
    at = documents.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words, size) for t in batch.column(at).cast(pa.binary())]
            values = [int(x.view(np.int64)[0]) for x in found] if size == 1 else [x.tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, "fingerprint"])

    return documents.mapInArrow(add, schema)


def with_shingle_set(documents: DataFrame, words: int, size: int) -> DataFrame:
    """``documents`` with ``fingerprint`` as bytes, and hash ``node`` and number of ``shingles``, all of the set of shingles of ``text``."""
    from xxhash import xxh64_intdigest

    schema = documents.selectExpr("*", "binary('') as fingerprint", "0L as node", "0L as shingles").schema
    at = documents.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Without repetitions: a passage that recurs in one copy would outvote all others.
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(at).cast(pa.binary())]
            prints = pa.array([_majority(x, size).tobytes() for x in sets], pa.binary())
            nodes = pa.array(np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64))
            counts = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints, nodes, counts], names=schema.names)

    return documents.mapInArrow(add, schema)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of ``blocks - distance`` of the ``blocks`` blocks of a fingerprint.

    Of fingerprints that differ in ``distance`` bits at most, so many blocks
    are equal, so the pair agrees under one of the masks at least.
    """
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    single = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(single, blocks - distance)]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(nodes: np.ndarray, fingerprints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``distance`` bits connect, fewer than there are nodes.

    Each fingerprint is held against those not yet reached, so a dense group
    empties the list in a few steps and costs little more than its size.
    """
    links = []
    rest = np.arange(len(nodes))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            close = _differing(fingerprints[rest], fingerprints[here]) <= distance
            if close.any():
                near = rest[close]
                links += [(nodes[here], nodes[k]) for k in near]
                queue += list(near)
                rest = rest[~close]
    return links


def _links(keys: np.ndarray, nodes: np.ndarray, fingerprints: np.ndarray, distance: int, short: int) -> np.ndarray:
    """Links between rows of equal ``keys``, which are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    found = [np.zeros((0, 2), np.int64)]
    compared = np.flatnonzero(np.repeat(lengths, lengths) <= short)
    for step in range(1, short):
        compared = compared[compared + step < len(keys)]
        compared = compared[keys[compared] == keys[compared + step]]
        if len(compared) == 0:
            break
        close = compared[_differing(fingerprints[compared], fingerprints[compared + step]) <= distance]
        found.append(np.stack([nodes[close], nodes[close + step]], axis=1))
    for k in np.flatnonzero(lengths > short):
        own = slice(starts[k], starts[k] + lengths[k])
        found.append(np.array(_forest(nodes[own], fingerprints[own], distance), np.int64).reshape(-1, 2))
    return np.unique(np.concatenate(found), axis=0)


def _across(keys: np.ndarray, nodes: np.ndarray, fingerprints: np.ndarray, roots: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """All close pairs of rows of equal ``keys``, which are sorted, with different ``roots``."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
        if (roots[a:b] == roots[a]).all():
            continue
        for k in range(a, b - 1):
            rest = k + 1 + np.flatnonzero(roots[k + 1 : b] != roots[k])
            rest = rest[_differing(fingerprints[rest], fingerprints[k]) <= distance]
            if len(rest):
                yield np.stack([np.repeat(nodes[k], len(rest)), nodes[rest]], axis=1)


def _verified(dealt: DataFrame, distance: int, short: int, name_large: bool = False) -> DataFrame:
    """Links ``a, b`` between the nodes of ``dealt(key, node, fingerprint)`` that meet under a key and are close.

    With ``name_large`` a node that met over ``short`` others also has a link to itself.
    """
    dealt = dealt.repartition("key").sortWithinPartitions("key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "key", 1 << 17):
            if pa.types.is_binary(rows.schema.field("fingerprint").type):
                joined = b"".join(rows["fingerprint"].to_pylist())
                prints = np.frombuffer(joined, "<u8").reshape(rows.num_rows, -1)
            else:
                prints = rows["fingerprint"].to_numpy().view(np.uint64).reshape(-1, 1)
            keys, nodes = rows["key"].to_numpy(), rows["node"].to_numpy()
            links = _links(keys, nodes, prints, distance, short)
            if name_large:
                _, inverse, sizes = np.unique(keys, return_inverse=True, return_counts=True)
                large = np.unique(nodes[sizes[inverse] > short])
                links = np.concatenate([links, np.stack([large, large], axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long").distinct()


def close_fingerprints(fingerprints: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """Links ``a, b`` that connect all ``fingerprint``s, each given once, of at most ``distance`` differing bits.

    A fingerprint is cut into ``blocks`` blocks; pairs that close share
    ``blocks - distance`` of them. It is sent once for each choice of so many
    blocks (35 times for 3 of 7), rows meet by the value of those blocks and
    are verified by Hamming distance. More blocks make longer keys, so fewer
    chance meetings, and more rows. Up to 16 rows of a key are compared pair by
    pair; of more, only links that connect them are made, never all pairs.
    Every fingerprint comes in once, so a key has as many rows as there are
    different fingerprints with those bits, however many the copies.
    """
    masks = block_masks(distance, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    value = F.col("fingerprint")
    keys = F.array(*[F.xxhash64(F.lit(k), value.bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    dealt = fingerprints.select(F.explode(keys).alias("key"), F.col("fingerprint").alias("node"), "fingerprint")
    return _verified(dealt, distance, short=16)


def block_places(bits: int, width: int, count: int) -> np.ndarray:
    """``count`` blocks of ``width`` bit places each, cut from shuffled rows of all ``bits`` places."""
    rng = np.random.default_rng(SEED)
    rows = -(-count // (bits // width))
    return np.concatenate([rng.permutation(bits)[: bits // width * width].reshape(-1, width) for _ in range(rows)])[:count]


def block_count(bits: int, width: int, chance: float, distance: int, misses: float) -> int:
    """Blocks of ``width`` bits such that of pairs that differ in a share ``chance`` of all ``bits``, each bit by
    itself, and in ``distance`` at most, no more than a share ``misses`` is expected to share no block."""
    differing = np.arange(distance + 1)
    ways = np.array([lgamma(bits + 1) - lgamma(d + 1) - lgamma(bits - d + 1) for d in differing])
    weight = np.exp(ways + differing * np.log(chance) + (bits - differing) * np.log1p(-chance))
    # Places are drawn without repetition: the chance that no differing bit is among a block's.
    agree = np.prod([(bits - differing - k) / (bits - k) for k in range(width)], axis=0)
    low, high = 1, 1 << 20
    while low < high:
        middle = (low + high) // 2
        if (weight * (1 - agree) ** middle).sum() <= misses:
            high = middle
        else:
            low = middle + 1
    return low


def dealt_blocks(fingerprints: DataFrame, width: int, count: int) -> DataFrame:
    """``key, node, fingerprint, root`` of each of ``count`` blocks of ``fingerprints(node, fingerprint, root)``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                some = batch.slice(first, 2000)
                prints = some.column(1).to_pylist()
                bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
                for k, places in enumerate(block_places(bits.shape[1], width, count)):
                    key = (bits[:, places] @ weights) * count + k
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *some.columns], names=["key", *some.schema.names])

    schema = "key long, " + ", ".join(f"{c} {t}" for c, t in fingerprints.dtypes)
    return fingerprints.mapInArrow(deal, schema)


def similar_roots(nodes: DataFrame, bits: int, chance: float, verify: Callable[[DataFrame, DataFrame], DataFrame], texts_of: Callable[[DataFrame], DataFrame], misses: float = 0.001) -> DataFrame:
    """``node, root`` of components of the ``nodes(node, fingerprint)``, of so many ``bits``, linked by pairs that ``verify(links, texts)`` lets pass.

    Candidates are pairs within the bits that a share ``chance`` makes on
    average and four standard deviations more. Those share no block for
    certain, as pairs within 4 bits do, so there are so many blocks that of
    pairs of that share at most ``misses`` share none. A block
    has so many bits that about a hundred fingerprints meet by chance, whatever
    their number; the number of blocks grows with its fourth root.

    Every candidate that shares a block is verified, except
    where its ends are already in one component, where it can change nothing.
    So a few links of each node go first, and most of a dense group needs no
    more. ``texts_of(ends)`` gives what is verified, for all ends of candidates
    at once. Nodes without a verified link may be missing.
    """
    distance = int(bits * chance + 4 * (bits * chance * (1 - chance)) ** 0.5)
    width = max(12, int(np.ceil(np.log2(max(2, nodes.count())))) - 6)
    count = block_count(bits, width, chance, distance, misses)
    close = stored(_verified(dealt_blocks(nodes.select("node", "fingerprint"), width, count), distance, 128, name_large=True), "close")
    large, untried = close.where("a = b").select(F.col("a").alias("node")), close.where("a <> b")
    texts = stored(texts_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "linked-texts")
    empty = close.where("a <> a")
    links, roots = empty, empty.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for k in range(3):
        if untried.isEmpty():
            break
        few = untried
        if k < 2:
            # The smallest neighbour of each node, from the other end in turn.
            one, other = ("a", "b") if k else ("b", "a")
            few = untried.groupBy(one).agg(F.min(other).alias(other)).select("a", "b")
        links = links.union(stored(verify(few, texts), "verified"))
        roots = connected_components(links)
        untried = stored(_apart(untried, roots), "untried")
    if large.isEmpty():
        return roots
    again = lookup(nodes.select("node", "fingerprint"), large, ["node"], "left_semi")
    again = lookup(again, roots, ["node"]).select("node", "fingerprint", F.coalesce("root", "node").alias("root"))
    dealt = dealt_blocks(again, width, count).repartition("key").sortWithinPartitions("key")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, "key", 1 << 17):
            prints = np.frombuffer(b"".join(rows["fingerprint"].to_pylist()), "<u8").reshape(rows.num_rows, -1)
            found = _across(rows["key"].to_numpy(), rows["node"].to_numpy(), prints, rows["root"].to_numpy(), distance)
            while some := list(islice(found, 1000)):
                made = np.unique(np.sort(np.concatenate(some), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    rest = stored(dealt.mapInArrow(pairs, "a long, b long").distinct(), "across")
    if rest.isEmpty():
        return roots
    return connected_components(links.union(stored(verify(rest, texts), "verified")))


def _apart(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` whose ends have different ``roots``."""
    for end in ("a", "b"):
        found = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        links = lookup(links, found, [end])
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return links.where(apart).select("a", "b")


def jaccard_links(links: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """The ``links(a, b)`` whose ``texts(node, text)`` have sets of shingles of that Jaccard ``similarity`` or more."""
    for end in ("a", "b"):
        links = lookup(links, texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), [end], "inner")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            near = [similar_texts(x, y, similarity, words) for x, y in zip(one, other, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return links.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def similar_texts(one: bytes | None, other: bytes | None, similarity: float, words: int) -> bool:
    """Whether the sets of shingles have that Jaccard ``similarity`` or more; without words they are alike."""
    x, y = (np.unique(shingle_hashes(t, words)) for t in (one, other))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def with_root(fingerprints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fingerprints``, each given once, with the smallest fingerprint of its component as ``root``."""
    roots = connected_components(close_fingerprints(fingerprints.select("fingerprint"), distance, blocks))
    linked = lookup(fingerprints, roots.withColumnRenamed("node", "fingerprint"), ["fingerprint"])
    return linked.withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(documents: DataFrame, distance: int = 4, blocks: int = 7, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``documents(doc_id, text)``.

    Fingerprints link at ``distance`` or fewer differing bits; a component's id
    is its smallest ``doc_id``, null if none of its rows has one. Texts without
    a word, null ones too, have fingerprint zero and link like any other.
    Repeated rows and ids stay and are in one component. No rows: none. Other
    columns are not read. The texts are not shuffled; copies meet as one
    fingerprint, and what is joined back to the rows has one row for each.
    """
    rows = stored(with_fingerprint(documents.select("doc_id", "text"), words).select("doc_id", "fingerprint"), "fingerprints")
    first = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "different")
    rooted = stored(with_root(first, distance, blocks).select("fingerprint", "root", "first_id"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = lookup(rooted, least, ["root"], "inner").select("fingerprint", "component_id")
    return lookup(rows, of, ["fingerprint"], "inner").select("doc_id", "fingerprint", "component_id")


def bit_share(similarity: float) -> float:
    """The share of fingerprint bits that differ, on average, between shingle sets of that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def drop_near_duplicates(documents: DataFrame, similarity: float = 0.8, words: int = 5, size: int = 4) -> DataFrame:
    """``documents`` with one row for each component of texts of that ``similarity``: its smallest ``doc_id``.

    Sets of shingles that are 0.8 alike differ in 15 of 100 fingerprint bits,
    far beyond the 4 of 64 that exact blocks can find, and 64 bits estimate it
    badly. So fingerprints have ``size`` times 64 bits and only name
    candidates: pairs within the bits that this similarity makes on average and
    four standard deviations more. A link is a candidate whose sets of shingles
    have that Jaccard similarity. Texts of a few shingles, whose bits differ in
    a larger share, are compared once more among themselves.

    Of rows with the smallest ``doc_id`` the one with the smallest text hash
    stays, and of rows equal in both, one. A row without a ``doc_id`` stays
    only if no row of its component has one. Null texts and those without a
    word are alike. All columns are kept. No rows: none. Texts with the same
    shingles are one before anything is compared.
    """
    key = F.xxhash64("text").alias("text_hash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = with_shingle_set(documents.select("doc_id", "text"), words, size).select("doc_id", key, "node", "shingles", "fingerprint")
    nodes = rows.groupBy("node").agg(F.min(order).alias("first"), F.first("shingles").alias("shingles"), F.first("fingerprint").alias("fingerprint"))
    nodes = stored(nodes, "different")
    # One text for each node.
    firsts = nodes.select("node", F.col("first.text_hash").alias("text_hash"))

    def texts_of(ends: DataFrame) -> DataFrame:
        wanted = stored(lookup(firsts, ends, ["node"], "left_semi"), "wanted")
        copies = lookup(documents.select("text", key), wanted.select("text_hash"), ["text_hash"], "left_semi")
        return lookup(copies.dropDuplicates(["text_hash"]), wanted, ["text_hash"], "inner").select("node", "text")

    def verify(links: DataFrame, texts: DataFrame) -> DataFrame:
        return jaccard_links(links, texts, similarity, words)

    roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    for some, share in ((nodes, bit_share(similarity)), (nodes.where(F.col("shingles") <= FEW), FEW_SHARE)):
        if not some.isEmpty():
            roots = roots.union(similar_roots(some, 64 * size, share, verify, texts_of))
    roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = lookup(nodes.select("node", "first"), roots, ["node"])
    best = linked.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    best = best.select(F.col("first.doc_id").alias("best_id"), F.col("first.text_hash").alias("best_hash"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", key)
    same = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))
    kept = rows.join(stored(best, "best"), same, "left_semi")
    # What is left are one row for each component and repetitions of it.
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
