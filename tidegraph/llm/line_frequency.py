"""Quality rules: lines that many documents of a host share, and base rules on words.

Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import BLANKS
from tidegraph.operators.lookup import lookup
from tidegraph.runtime import SMALL_ROWS

SYMBOLS = r"[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """Lower case, blanks as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many of ``words`` stand in a window of ``width`` words that occurs more than once.

    Windows are known by 64-bit hashes. Where all differ, which a set of them
    shows, nothing more is done; else they are sorted with their places, and
    the union of the windows that equal a neighbour is measured.
    """
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equals_neighbour(ordered: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(ordered, k - 1), F.get(ordered, k + 1)
            return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, twice), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda s, p: F.struct(
            (p + width).alias("end"), (s["n"] + width - F.greatest(F.lit(0), s["end"] - p)).alias("n")
        )
        return F.aggregate(places, start, step, lambda s: s["n"])

    # One pass over an array with one element binds a value that is used more than once.
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    count = bind(hashes, lambda h: F.when(repeats(h), bind(placed, lambda o: covered(equals_neighbour(o)))).otherwise(0))
    return F.when(F.size(words) >= width, count).otherwise(0).cast("long")


def _own_host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")


def document_rules(documents: DataFrame, host: str, *more: Column | str) -> DataFrame:
    """``host, text_hash``, the figures of the base rules and the columns ``more``, in one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    names = ["row_columns", "host", "text_hash", "n_symbols"]
    rows = documents.select(
        F.struct(*more).alias("row_columns"),
        _own_host(host),
        F.xxhash64("text").alias("text_hash"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.split(text, "\n").alias("lines"),
    )
    rows = rows.withColumn("split", F.transform("lines", lambda x: F.array_remove(F.split(x, BLANKS), "")))
    with_word = F.filter("lines", lambda _, k: F.size(F.get("split", k)) > 0)
    rows = rows.select(*names, F.flatten("split").alias("words"), with_word.alias("lines"))
    return rows.select(
        *names,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def frequent_lines(documents: DataFrame, host: str, min_docs: int, share: float) -> DataFrame:
    """``host, text_hash, n_frequent_words, frequent``: texts with lines above the limits, and the lines' hashes.

    Texts are hashed line by line and travel as hashes. Copies count as one
    document of their host, which they are after the first grouping, so a text
    does not make its own lines frequent.
    """
    own = documents.select(_own_host(host), F.xxhash64("text").alias("text_hash"), "text")

    def digest(line: Column) -> Column:
        size = F.size(F.array_remove(F.split(line, BLANKS), ""))
        return F.struct(line_hash(line).alias("hash"), size.alias("words"))

    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), digest), lambda d: d["words"] > 0)
    texts = own.select("host", "text_hash", lines.alias("lines")).groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    hosts = own.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    distinct = texts.select("host", F.explode(F.array_distinct("lines.hash")).alias("line"))
    counts = distinct.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    above = lookup(counts, hosts, ["host"], "inner").where(F.col("n_docs") > F.col("host_docs") * share)
    found = texts.select("host", "text_hash", F.explode("lines").alias("l"))
    found = found.select("host", "text_hash", F.col("l.hash").alias("line"), F.col("l.words").alias("words"))
    found = lookup(found, above.select("host", "line"), ["host", "line"], "inner").groupBy("host", "text_hash")
    return found.agg(F.sum("words").alias("n_frequent_words"), F.collect_set("line").alias("frequent"))


def _judged(rows: DataFrame, frequent: DataFrame, min_words: int, min_left: float) -> DataFrame:
    """``rows`` of ``document_rules`` with what is frequent in them, and the verdict.

    The frequent lines are counted before they are joined: up to ``SMALL_ROWS``
    of them are broadcast, so the texts stay where they are; of more, both
    sides are shuffled.
    """
    frequent = frequent.persist()
    size = frequent.agg(F.sum(F.size("frequent"))).first()[0] or 0
    keys = ["host", "text_hash"]
    joined = rows.join(F.broadcast(frequent), keys, "left") if size <= SMALL_ROWS else lookup(rows, frequent, keys)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("n_frequent_words", F.lit(0).cast("long"))
    left = F.col("n_words") - gone
    # One number, not a conjunction: a part of it pushed below the join would
    # work out the figures once more for every use in a filter on ``kept``.
    rules = [~failed, left >= min_words, left >= min_left * F.col("n_words")]
    kept = F.least(*[rule.cast("int") for rule in rules]) == 1
    return joined.withColumns({"n_frequent_words": gone, "base_failed": failed, "kept": kept})


def quality_rules(
    documents: DataFrame,
    host: str = "source",
    min_docs: int = 20,
    share: float = 0.1,
    min_words: int = 50,
    min_left: float = 0.3,
) -> DataFrame:
    """Base figures and verdict for each row of ``documents(doc_id, text, <host>)``.

    A line is one too many if its normalised form occurs in over ``min_docs``
    documents and over ``share`` of the documents of its host. A document fails
    the base rules with under ``min_words`` words or over half of them in
    repeated windows of three; it is depleted if without its frequent lines
    under ``min_words`` words, or under ``min_left`` of its words, are left.

    Returns ``doc_id, host, text_hash``, the figures, ``base_failed``,
    ``n_frequent_words`` (in frequent lines) and ``kept``. Documents of a host
    with the same text count once, repeated rows too, and get the same verdict.
    A null host is the empty one. Null and empty texts have no words and fail.
    No rows: none. Other columns are not read. Hosts and lines are counted
    inside tasks before they meet.
    """
    rows = document_rules(documents, host, "doc_id")
    judged = _judged(rows, frequent_lines(documents, host, min_docs, share), min_words, min_left)
    return judged.select("row_columns.doc_id", *[c for c in judged.columns if c not in ("row_columns", "frequent")])


def apply_quality_rules(
    documents: DataFrame,
    host: str = "source",
    min_docs: int = 20,
    share: float = 0.1,
    min_words: int = 50,
    min_left: float = 0.3,
) -> DataFrame:
    """``documents`` without the rejected ones and, in the others, without their frequent lines.

    Limits and edge cases are those of ``quality_rules``. All columns are kept.
    """
    rows = document_rules(documents, host, *documents.columns)
    kept = _judged(rows, frequent_lines(documents, host, min_docs, share), min_words, min_left).where("kept")
    text = F.col("row_columns.text")
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("frequent", line_hash(x)))
    cut = F.when(F.col("frequent").isNull(), text).otherwise(F.array_join(lines, "\n"))
    return kept.select(F.col("row_columns").withField("text", cut).alias("row_columns")).select("row_columns.*")
