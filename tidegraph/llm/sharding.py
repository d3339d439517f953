"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import stored
from tidegraph.operators.lookup import lookup

# Bits of an address: 60 of the document, then 60 of the row, which tell apart rows of one document.
ADDRESS = 120
# Directory entries for each shard that the total would fill, as a power of two.
FINER = 6
# Bits by which entries that are still too large are split at once.
STEP = 12


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text, as zeros and ones."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2), 60, "0")


def _internal(entries: DataFrame, before: int, depth: int, max_bytes: int) -> DataFrame:
    """Prefixes of ``before`` to ``depth`` bits of the directory ``entries`` that have to be split."""
    levels = F.explode(F.sequence(F.lit(before), F.lit(depth))).alias("d")
    nodes = entries.select("bytes", "docs", "entry", levels)
    nodes = nodes.groupBy(F.substring("entry", F.lit(1), F.col("d")).alias("prefix"), "d")
    nodes = nodes.agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    return nodes.where((F.col("bytes") > max_bytes) & (F.col("docs") > 1)).select("prefix", "d")


def directory(rows: DataFrame, max_bytes: int) -> list[tuple[DataFrame, int]]:
    """Tables ``entry, depth`` of the directory entries of ``rows(address, bytes)``, each with the bits of its entries.

    An entry's ``depth`` is that of its bucket: the shortest prefix whose rows
    fit ``max_bytes``. Entries are counted in one pass, with so many bits that
    a bucket has some 64 of them; only rows of entries that are too large by
    themselves are looked at again, with more bits.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(ADDRESS, max(0, (int(total) // max_bytes)).bit_length() + FINER)
    open_rows, before, parts = rows, 0, []
    while True:
        entry = F.substring("address", 1, depth).alias("entry")
        entries = stored(open_rows.groupBy(entry).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "entries")
        internal = stored(_internal(entries, before, depth, max_bytes), "internal")
        levels = entries.select("entry", F.explode(F.sequence(F.lit(before), F.lit(depth))).alias("d"))
        prefix = F.substring("entry", F.lit(1), F.col("d"))
        split = lookup(levels.withColumn("prefix", prefix), internal, ["prefix", "d"], "inner")
        split = split.groupBy("entry").agg(F.max("d").alias("last"))
        depths = lookup(entries.select("entry"), split, ["entry"]).select("entry", (F.coalesce("last", F.lit(before - 1)) + 1).alias("depth"))
        parts.append((stored(depths, "directory"), depth))
        too_large = parts[-1][0].where(F.col("depth") > depth)
        if depth == ADDRESS or too_large.isEmpty():
            break
        open_rows = lookup(open_rows.withColumn("entry", entry), too_large.select("entry"), ["entry"], "left_semi").drop("entry")
        before, depth = depth + 1, min(ADDRESS, depth + STEP)
    return parts


def assign_shards(documents: DataFrame, max_bytes: int) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs`` for each row of ``documents(doc_id, text)``.

    A row's address are bits of the hash of its ``doc_id``, then, for rows that
    share it, of its number. A shard is a prefix of the address: the shortest
    whose rows have at most ``max_bytes`` bytes of text together, so only
    buckets that are too large are split, on another bit, until each fits. A
    single text above the limit has a shard of its own, which is over it.

    Null ids have one address, null texts no bytes; repeated rows are told
    apart by the number they get when the sizes are written down. No rows:
    none. Other columns are not read, and texts are not shuffled. The directory
    stays a table and the driver sees one sum.
    """
    number = F.monotonically_increasing_id()
    rows = stored(documents.select("doc_id", _size("text"), number.alias("row")), "sizes")
    placed, sizes = _places(rows, max_bytes)
    return lookup(placed, sizes, ["shard"], "inner").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")


def _places(rows: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, n_bytes, shard, depth`` of each of ``rows(doc_id, n_bytes, row)``, and the sizes of the shards."""
    address = F.concat(hash_bits(F.col("doc_id")), hash_bits(F.col("row")))
    rows = rows.withColumn("address", address)
    parts = directory(rows.select("address", F.col("n_bytes").alias("bytes")), max_bytes)
    open_rows, found = rows, []
    for k, (depths, depth) in enumerate(parts):
        joined = lookup(open_rows.withColumn("entry", F.substring("address", 1, depth)), depths, ["entry"], "inner")
        last = k == len(parts) - 1
        done = joined if last else joined.where(F.col("depth") <= depth)
        found.append(done.withColumn("depth", F.least("depth", F.lit(depth))))
        open_rows = joined.where(F.col("depth") > depth).drop("entry", "depth")
    placed = found[0]
    for more in found[1:]:
        placed = placed.unionByName(more)
    # The empty prefix is the only shard there is, or there is none of that name.
    placed = placed.withColumn("shard", F.substring("address", F.lit(1), F.col("depth")))
    placed = placed.select("doc_id", "row", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"))
    return placed, placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))


def write_shards(documents: DataFrame, folder: str, max_bytes: int) -> None:
    """Write ``documents`` as Parquet, one folder ``shard=p<prefix>`` for each shard.

    The documents are written once with the numbers of their rows, which are
    what places are found by, so rows with null or repeated ids come out once
    each, in the shard ``assign_shards`` gives them.
    """
    document = F.struct(*documents.drop("shard").columns).alias("document")
    rows = stored(documents.select(document, F.monotonically_increasing_id().alias("row")), "numbered")
    placed, _ = _places(rows.select("document.doc_id", _size("document.text"), "row"), max_bytes)
    places = placed.select("row", F.concat(F.lit("p"), "shard").alias("shard"))
    placed_rows = lookup(rows, places, ["row"], "inner").select("document.*", "shard")
    placed_rows.repartition("shard").write.partitionBy("shard").parquet(folder)
