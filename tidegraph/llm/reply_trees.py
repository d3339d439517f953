"""Chat formatting: root-to-leaf paths of reply trees, ranked by score and written as conversations.

Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.lookup import lookup
from tidegraph.runtime import Rounds, cut_lineage

# Opening and closing marks of a turn, by role; any other role is named in its turn.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
NAMED, NAME_END, NAMED_END = "[ROLE] ", " [/ROLE] ", " </s>"
# A control string, with the backslashes that may stand behind its first character.
CONTROL = r"(<\\*)(/?s>)|(\[\\*)(/?(?:INST|SYS|ROLE)\])"
TURN_STARTS = r"(?=\[INST\] |\[SYS\] |\[ROLE\] |<s> )"


def escape(text: Column) -> Column:
    r"""One more backslash behind the first character of every control string: ``<s>`` becomes ``<\s>``.

    What comes behind that character never holds another first character, so
    no control string overlaps with the next one and ``unescape`` undoes it.
    """
    return F.regexp_replace(text, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<\\*)\\(/?s>)|(\[\\*)\\(/?(?:INST|SYS|ROLE)\])", r"$1$3$2$4")


def reply_paths(
    messages: DataFrame,
    best: int = 1,
    tree: str = "tree_id",
    message: str = "message_id",
    parent: str = "parent_id",
    score: str | None = "score",
) -> DataFrame:
    """The ``best`` root-to-leaf paths of every tree, a row for each message on them.

    A message without a parent, or with one that its tree does not have, is a
    root. The score of a path is the sum of its messages' scores (null: 0), and
    paths of one score go by their leaf. Returns ``node`` and ``leaf`` (structs
    of tree and message), ``position`` (0 at the root), ``rank`` and
    ``path_score``. Rows of one message are one node, with the least of their
    parents and the largest of their scores; null trees are one tree. A loop of
    parents has no root, so neither it nor what hangs on it is on a path. No
    rows: none.

    Leaves walk to their roots by self-joins whose step doubles each round, so
    the rounds are the logarithm of the longest path. Only ids take part. A
    node that many paths share is one key with one row on the side of the
    steps, and Spark splits it.
    """
    spark = messages.sparkSession
    own = F.struct(F.col(tree).alias("tree"), F.col(message).alias("message")).alias("node")
    # Of one type, so that equal ids have equal hashes.
    above = F.col(parent).cast(messages.schema[message].dataType)
    points = messages.select(
        own,
        F.when(above.isNotNull(), F.struct(F.col(tree).alias("tree"), above.alias("message"))).alias("up"),
        (F.lit(0) if score is None else F.coalesce(F.col(score), F.lit(0))).cast("decimal(28,9)").alias("score"),
    )
    points = points.groupBy("node").agg(F.min("up").alias("up"), F.max("score").alias("score"))
    rounds = Rounds(spark, "reply-paths")
    try:
        nodes, count = rounds.keep(points)
        known = nodes.select(F.col("node").alias("up"))
        steps, more = rounds.keep(lookup(nodes.where("up IS NOT NULL").select("node", "up"), known, ["up"], "left_semi"))
        leaves = lookup(nodes.select("node"), steps.select(F.col("up").alias("node")).distinct(), ["node"], "left_anti")
        walked, _ = rounds.keep(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")))
        pieces, length = [walked], 1
        while more and length <= count:
            reached = pieces[0]
            for piece in pieces[1:]:
                reached = reached.unionByName(piece)
            moved = lookup(reached, steps, ["node"], "inner")
            moved = moved.select("leaf", F.col("up").alias("node"), (F.col("above") + length).alias("above"))
            piece, _ = rounds.keep(moved)
            pieces.append(piece)
            further = lookup(
                steps.withColumnRenamed("up", "middle"), steps.select(F.col("node").alias("middle"), "up"), ["middle"], "inner"
            )
            steps, more = rounds.keep(further.select("node", "up"))
            length *= 2
        reached = pieces[0]
        for piece in pieces[1:]:
            reached = reached.unionByName(piece)
        scored = lookup(reached, nodes, ["node"], "inner")
        totals = scored.groupBy("leaf").agg(F.sum("score").alias("path_score"), F.max("above").alias("depth"))
        # A leaf still on its way after as many steps as there are nodes hangs on a loop.
        totals = lookup(totals, steps.select(F.col("node").alias("leaf")), ["leaf"], "left_anti")
        order = Window.partitionBy("leaf.tree").orderBy(F.desc("path_score"), "leaf.message")
        # Spark cuts each task's share of a tree to its first rows before it meets the others.
        chosen = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        paths = lookup(reached, chosen, ["leaf"], "inner")
        return cut_lineage(paths.select("leaf", "node", (F.col("depth") - F.col("above")).alias("position"), "rank", "path_score"))
    finally:
        rounds.forget_all_but()


def _turn(role: Column, text: Column) -> tuple[Column, Column]:
    """The text of a turn with its marks, and the opening mark."""
    opening, closing = F.lit(NAMED), F.lit(NAMED_END)
    opening = F.concat(opening, escape(role), F.lit(NAME_END))
    for name, (left, right) in MARKS.items():
        opening = F.when(role == name, F.lit(left)).otherwise(opening)
        closing = F.when(role == name, F.lit(right)).otherwise(closing)
    return F.concat(opening, escape(text), closing), opening


def format_conversations(
    messages: DataFrame,
    paths: DataFrame,
    tree: str = "tree_id",
    message: str = "message_id",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One conversation for each of ``paths`` (from ``reply_paths``) in the template of this module.

    Returns ``leaf, rank, path_score, formatted`` and ``loss_spans``: places of
    the assistant's texts in ``formatted`` as UTF-8, ``start`` and ``size`` in
    bytes. Rows of one message follow each other in the order of role and escaped text.
    Null roles and texts are empty. A conversation has to fit into one value,
    and its rows meet in one task.
    """
    own = F.struct(F.col(tree).alias("tree"), F.col(message).alias("message")).alias("node")
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turn, opening = _turn(F.col("role"), F.col("text"))
    turns = messages.select(own, role.alias("role"), text.alias("text"))
    turns = lookup(turns, paths, ["node"], "inner").select(
        "leaf", "rank", "path_score", "position", "role", turn.alias("turn"), F.octet_length(opening).alias("left"),
        F.octet_length(escape(F.col("text"))).alias("size"),
    )
    # Texts travel once, as they are written.
    before = Window.partitionBy("leaf").orderBy("position", "role", "turn")
    whole = F.octet_length("turn")
    turns = turns.withColumns({
        "start": F.sum(whole).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - whole + F.col("left"),
        "turn_no": F.row_number().over(before),
    })
    row = F.struct("turn_no", "turn", F.when(F.col("role") == "assistant", F.struct("start", "size")).alias("span"))
    found = turns.groupBy("leaf").agg(
        F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(row)).alias("turns")
    )
    spans = F.filter(F.col("turns.span"), lambda s: s.isNotNull())
    return found.select("leaf", "rank", "path_score", F.array_join("turns.turn", "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of ``role`` and ``text``."""

    def between(piece: Column, left: Column | str, right: str) -> Column:
        skip = F.length(F.lit(left) if isinstance(left, str) else left)
        return unescape(F.substring(piece, skip + 1, F.length(piece) - skip - len(right)))

    def parsed(piece: Column) -> Column:
        named = F.substring_index(F.substring(piece, F.lit(len(NAMED) + 1), F.length(piece)), NAME_END, 1)
        opening = F.concat(F.lit(NAMED), named, F.lit(NAME_END))
        found = F.struct(unescape(named).alias("role"), between(piece, opening, NAMED_END).alias("text"))
        for name, (left, right) in MARKS.items():
            one = F.struct(F.lit(name).alias("role"), between(piece, left, right).alias("text"))
            found = F.when(piece.startswith(left), one).otherwise(found)
        return found

    return F.when(F.length(formatted) > 0, F.transform(F.split(formatted, TURN_STARTS), parsed)).otherwise(F.array())


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """What stands under the loss mask, unescaped and end to end."""
    cut = lambda b: F.transform(loss_spans, lambda s: unescape(F.decode(F.substring(b, s["start"] + 1, s["size"]), "UTF-8")))
    # One pass over an array of one element takes the bytes once, not once for each span.
    return F.array_join(F.flatten(F.transform(F.array(F.encode(formatted, "UTF-8")), cut)), "")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Figures read back from ``conversations`` (from ``format_conversations``), by tree."""
    read = conversations.select(
        F.col("leaf.tree").alias("conv_id"),
        read_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
