"""Line dedup through a log-template tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import BLANKS, stored
from tidegraph.operators.lookup import lookup

WILD = "<*>"
# Leading tokens that a leaf of the tree has in common.
LEADING = 3
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def plain(line: Column) -> Column:
    """Tokens with single spaces between."""
    return F.trim(F.when(line.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(line, BLANKS, " ")).otherwise(line))


def masked(line: Column) -> Column:
    """A plain line whose tokens with a digit are wildcards."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, WILD)).otherwise(line)


def token_count(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.size(F.split(line, " ")))


def line_digests(documents: DataFrame, min_tokens: int, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, lines``: for each line its place, hash and tokens, whether it is compared, and its leaf in the tree.

    Lines of fewer tokens, or of tokens with digits only, have no leaf: they
    are compared as they are, the others with their wildcards.
    """

    def digest(line: Column, pos: Column) -> Column:
        tokens = token_count(line["plain"])
        general = (tokens >= min_tokens) & (F.trim(F.replace(line["masked"], F.lit(WILD), F.lit(""))) != "")
        return F.struct(
            pos.alias("pos"),
            F.xxhash64(F.when(general, line["masked"]).otherwise(line["plain"])).alias("line"),
            tokens.alias("tokens"),
            (general | (F.char_length(line["plain"]) >= min_chars)).alias("compared"),
            F.when(general, F.xxhash64(tokens, F.substring_index(line["masked"], " ", LEADING))).alias("leaf"),
        )

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), plain)
    lines = F.transform(lines, lambda line: F.struct(line.alias("plain"), masked(line).alias("masked")))
    digests = F.filter(F.transform(lines, digest), lambda d: d["tokens"] > 0)
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), digests.alias("lines"))


def templates(leaf: Column, line: Column, similar: float) -> Column:
    """The templates below its leaf that ``line`` has, as hashes.

    The tokens after the leading ones are dealt out over blocks in their order,
    each of half the tokens that may vary. A template is the line less two of
    its blocks, or less one where only one token may vary. Lines with a common
    template so agree in ``similar`` of their tokens or more.
    """
    tokens = F.split(line, " ")
    n = F.size(tokens)
    vary = F.floor((1 - similar) * n + 1e-9).cast("int")
    width = F.greatest(F.lit(1), F.floor(vary / 2).cast("int"))
    last = F.ceil((n - LEADING) / width).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(k, F.slice(tokens, LEADING + 1 + k * width, width)))

    def without(parts: Column) -> Column:
        # Hashes of the blocks know their places, so their sum by bits stands for all of them.
        whole = F.aggregate(parts, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
        one = F.transform(parts, lambda a, i: F.xxhash64(leaf, i, whole.bitwiseXOR(a)))

        def two(a: Column, i: Column) -> Column:
            rest = F.slice(parts, i + 2, F.size(parts))
            return F.transform(rest, lambda b, j: F.xxhash64(leaf, i, j, whole.bitwiseXOR(a).bitwiseXOR(b)))

        none = F.array().cast("array<bigint>")
        return F.when(vary >= 2, F.flatten(F.transform(parts, two))).when(vary == 1, one).otherwise(none)

    # Bound to a name by a transform of one, or every template would hash the blocks anew.
    return F.flatten(F.transform(F.array(blocks), without))


def first_places(documents: DataFrame, lines: DataFrame, similar: float) -> DataFrame:
    """``line, keeper`` for ``lines(text_hash, first, line, leaf)`` that have to go from other documents than ``keeper``.

    A line's keeper is the first document that holds it or another line of one
    of its templates.
    """
    seen = lines.groupBy("line").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.first("leaf").alias("leaf"))
    seen = stored(seen, "distinct-lines")
    leaves = seen.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    sharing = stored(lookup(seen.where("leaf IS NOT NULL"), leaves, ["leaf"], "inner").select("line", "leaf", "first"), "leaves")
    # Only lines that have another one to meet are read as texts; copies go together inside tasks.
    texts = documents.select(F.explode(F.transform(F.transform(F.split("text", "\n"), plain), masked)).alias("masked"))
    texts = lookup(texts.withColumn("line", F.xxhash64("masked")), sharing, ["line"], "inner").distinct()
    made = stored(texts.select("line", "first", templates(F.col("leaf"), F.col("masked"), similar).alias("templates")), "templates")
    each = made.select("line", "first", F.explode("templates").alias("template"))
    shared = each.groupBy("template").agg(F.min("first").alias("keeper"), F.count("*").alias("size")).where("size > 1").drop("size")
    alike = lookup(each.select("line", "template"), shared, ["template"], "inner").groupBy("line").agg(F.min("keeper").alias("keeper"))
    found = lookup(seen.select("line", "first", "last"), alike, ["line"])
    return found.select("line", F.least("first", "keeper").alias("keeper"), "last").where("keeper <> last").drop("last")


def line_dedup(
    documents: DataFrame,
    min_tokens: int = 5,
    min_chars: int = 10,
    similar: float = 0.8,
    min_left: float = 0.3,
) -> DataFrame:
    """What line dedup does to each row of ``documents(doc_id, text)``.

    A line is a list of tokens; those with a digit are wild from the start.
    Lines with one token count and the same three leading tokens are a leaf of
    the tree. Below it stand templates, in which one or two stretches of a line
    are wild, no more than ``1 - similar`` of its tokens together (see
    ``templates``); a line has several. Where a line, or another line with one
    of its templates, stands in an earlier document, by ``doc_id``, it is
    dropped. So what becomes of a line follows from the lines that share a
    template with it, however many lines a leaf has.

    Lines of under ``min_tokens`` tokens, or whose tokens all hold a digit, are
    dropped where the same line, digits and all, stands in an earlier document,
    provided that they have ``min_chars`` characters. Shorter ones stay.
    A document of whose tokens less than ``min_left`` stay is dropped as a whole.

    Returns ``doc_id, text_hash, n_tokens, n_lines`` (with a token),
    ``n_dropped, dropped`` (their numbers in the text, from 0) and ``kept``.
    Documents with the same text are one document, which is for another
    operator to reduce, and fare alike; so do repeated rows. Null ids come
    last. Null and empty texts have no lines and are kept. No rows: none.
    Other columns are not read. Only lines that share a leaf with another are
    shuffled as texts, all others as hashes. ``similar`` is 0.5 at least and
    ``min_tokens`` 5.
    """
    if not 0.5 <= similar <= 1 or min_tokens < 5:
        raise ValueError("similar has to be from 0.5 to 1, min_tokens 5 or more")
    digests = stored(line_digests(documents, min_tokens, min_chars), "line-digests")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    texts = digests.groupBy("text_hash").agg(F.min(order).alias("first"), F.first("lines").alias("lines"))
    lines = texts.select("text_hash", "first", F.explode("lines").alias("l")).select("text_hash", "first", "l.*")
    lines = stored(lines.where("compared").drop("compared"), "lines")
    keepers = first_places(documents, lines, similar)
    gone = lookup(lines.drop("leaf"), keepers, ["line"], "inner").where("first <> keeper").groupBy("text_hash")
    dropped = gone.agg(F.array_sort(F.collect_list("pos")).alias("dropped"), F.sum("tokens").alias("gone"))
    sizes = digests.select(
        "doc_id",
        "text_hash",
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, d: n + d["tokens"]).alias("n_tokens"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    rows = lookup(sizes, dropped, ["text_hash"]).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.col("n_tokens") - F.coalesce("gone", F.lit(0)) >= min_left * F.col("n_tokens")
    return rows.select("doc_id", "text_hash", "n_tokens", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", kept.alias("kept"))


def apply_line_dedup(documents: DataFrame, **settings) -> DataFrame:
    """``documents`` without the lines and documents that ``line_dedup`` drops; all columns are kept."""
    verdicts = line_dedup(documents, **settings).where("n_dropped > 0")
    changed = verdicts.groupBy("text_hash").agg(F.first("dropped").alias("dropped"), F.first("kept").alias("kept"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64("text").alias("text_hash"))
    rows = lookup(rows, changed, ["text_hash"]).where(F.coalesce("kept", F.lit(True)))
    text = F.col("row.text")
    left = F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains("dropped", k))
    cut = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(left, "\n"))
    return rows.select(F.col("row").withField("text", cut).alias("row")).select("row.*")
