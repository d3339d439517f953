"""Command logs as text: numbered batch directories and the three dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.runtime import join_small

# The words of each dialect and the operation each stands for.
LONG_WORDS = {
    "addEdge": "addEdge",
    "rmvEdge": "rmvEdge",
    "addNode": "addNode",
    "rmvNode": "rmvNode",
    "loadOld": "loadOld",
}
SHORT_WORDS = {
    "addE": "addEdge",
    "delE": "rmvEdge",
    "rmvE": "rmvEdge",
    "addN": "addNode",
    "delN": "rmvNode",
    "rmvN": "rmvNode",
    "earliest": "earliest",
}
# The layout of a command in each dialect; further words are ignored.
LONG_FORM = (
    r"^(?:(?:addEdge|rmvEdge) [+-]?[0-9]+ [^ ]+ [+-]?[0-9]+"
    r"|(?:addNode|rmvNode) [+-]?[0-9]+"
    r"|loadOld [0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})(?: |$)"
)
SHORT_FORM = (
    r"^(?:(?:addE|delE) [+-]?[0-9]+ [+-]?[0-9]+ [^ ]"
    r"|rmvE [+-]?[0-9]+ [+-]?[0-9]+(?: |$)"
    r"|(?:addN|delN|rmvN) [+-]?[0-9]+(?: |$)"
    r"|earliest(?: |$))"
)
# Fixed value: the format of a restore time.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Bits of a position that count the rows a task has read; the rank of the split stands above.
ROW_BITS = 33
# The number of the directory a file lies in, and that in the name of a file that Spark wrote.
DIRECTORY = r"/(?:[A-Za-z_]+=)?([0-9]+)/[^/]+$"
PART = r"/part-([0-9]+)[^/]*$"


def _valid(form: str, words: dict[str, str], far: int) -> Column:
    """Whether a line is a command, by its layout alone where that is enough.

    The test reads the raw line only, so Spark can filter before it splits.
    Digits may still not fit an id and a date may not exist; both are looked at
    more closely only where they can occur. Only the words that are ids have to
    fit: the second of a node or an edge, and number ``far`` of an edge.
    """
    line = F.col("value")
    split = F.split(line, " ")
    of = lambda *ops: [word for word, op in words.items() if op in ops]
    is_id = lambda n: F.get(split, n - 1).try_cast("long").isNotNull()
    is_edge = split[0].isin(of("addEdge", "rmvEdge"))
    has_ids = is_edge | split[0].isin(of("addNode", "rmvNode"))
    fits = ~line.rlike("[0-9]{19}") | ~has_ids | (is_id(2) & (~is_edge | is_id(far)))
    exists = ~line.startswith("loadOld") | F.try_to_timestamp(
        F.substring(line, 9, 19), F.lit(TIME_FORMAT)
    ).isNotNull()
    return line.rlike(form) & fits & exists


def _split(lines: DataFrame, words: dict[str, str]) -> DataFrame:
    """The valid lines with their words and operation, each worked out once."""
    names = F.create_map(*[F.lit(word) for pair in words.items() for word in pair])
    return lines.select("tick", "pos", "value", F.split("value", " ").alias("words")).select(
        "tick", "pos", "value", "words", F.try_element_at(names, F.col("words")[0]).alias("op")
    )


def _word(index: int) -> Column:
    return F.try_element_at("words", F.lit(index))


def _commands(split: DataFrame, src: Column, label: Column, dst: Column) -> DataFrame:
    return split.select(
        "tick", "pos", "op",
        src.try_cast("long").alias("src"), label.alias("label"), dst.try_cast("long").alias("dst"),
        F.col("value").alias("raw"),
    )


def parse_commands(lines: DataFrame) -> DataFrame:
    """``addEdge src label dst`` and friends, from ``(tick, pos, value)``."""
    op = F.col("op")
    edge = op.isin("addEdge", "rmvEdge")
    return _commands(
        _split(lines.where(_valid(LONG_FORM, LONG_WORDS, 4)), LONG_WORDS),
        F.when(op != "loadOld", _word(2)),
        F.when(edge, _word(3)).when(op == "loadOld", F.concat_ws(" ", _word(2), _word(3))),
        F.when(edge, _word(4)),
    )


def parse_commands_short(lines: DataFrame) -> DataFrame:
    """``addE src dst label`` and friends, normalised to the same columns.

    A node's name takes the label column; a word that may be left out is ''.
    """
    op = F.col("op")
    edge = op.isin("addEdge", "rmvEdge")
    return _commands(
        _split(lines.where(_valid(SHORT_FORM, SHORT_WORDS, 3)), SHORT_WORDS),
        F.when(op != "earliest", _word(2)),
        F.when(op != "earliest", F.coalesce(F.when(edge, _word(4)).otherwise(_word(3)), F.lit(""))),
        F.when(edge, _word(3)),
    )


def rejected_commands(lines: DataFrame, short: bool = False) -> DataFrame:
    """The lines no command can be read from; the rest of the log goes on."""
    valid = _valid(SHORT_FORM, SHORT_WORDS, 3) if short else _valid(LONG_FORM, LONG_WORDS, 4)
    return lines.where(~valid).select("tick", "pos", F.col("value").alias("raw"))


def with_place(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of files with ``batch, file, block``: the split each line was read from.

    ``batch`` is the number of the directory, null where it has none.
    """
    file = F.col("_metadata.file_path")
    return lines.select(
        "value",
        F.regexp_extract(file, DIRECTORY, 1).try_cast("long").alias("batch"),
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``batch, pos, value`` of lines ``with_place``, where ``pos`` rises over the whole log.

    Splits follow each other by batch, number of the part, name and start. A
    position is the rank of its split and then a number that rises with the
    rows of its task, so nothing is assumed of the bytes of a file, compressed
    or not, or of how many splits a task reads. Splits are ranked within their
    batch; one row for each batch meets in the running sum.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    lines = lines.withColumn("row", row)
    splits = lines.select("batch", "file", "block").distinct()
    part = F.regexp_extract("file", PART, 1).try_cast("long")
    within = F.row_number().over(W.partitionBy("batch").orderBy(part, "file", "block"))
    before = W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)
    batches = splits.groupBy("batch").agg(F.count("*").alias("n"))
    batches = batches.select(F.col("batch").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = splits.withColumn("within", within).join(batches, F.col("batch").eqNullSafe(F.col("of")))
    ranked = ranked.select("file", "block", (F.col("before") + F.col("within")).alias("rank"))
    placed = join_small(lines, ranked, ["file", "block"])
    pos = F.shiftleft(F.col("rank"), ROW_BITS).bitwiseOR(F.col("row"))
    return placed.select("batch", pos.alias("pos"), "value")


def read_batch_directories(spark: SparkSession, root: str) -> DataFrame:
    """Lines of ``root/<n>/*`` as ``(tick, pos, value)``; batch ``n`` is tick ``n + 1``.

    Positions rise over the whole log, so it can be folded in order as well.
    Files outside a numbered directory are left aside.
    """
    lines = with_place(spark.read.option("recursiveFileLookup", "true").text(root)).where("batch IS NOT NULL")
    return numbered_lines(lines).select((F.col("batch") + 1).alias("tick"), "pos", "value")


def write_batch_directories(lines: DataFrame, root: str) -> None:
    """Write ``(tick, pos, value)`` as numbered directories, in log order.

    Range partitioning by position keeps a large batch in many files whose numbers
    follow the log, so no task has to hold a whole batch.
    """
    (
        lines.select((F.col("tick") - 1).alias("n"), "pos", "value")
        .repartitionByRange("n", "pos")
        .sortWithinPartitions("n", "pos")
        .select("n", "value")
        .write.partitionBy("n")
        .text(root)
    )
