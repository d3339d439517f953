"""Column expressions shared by the operators. All of them stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.schema import CHECKPOINT_EVERY, OPEN


def last_pos(condition: Column) -> Column:
    """Last log position at which ``condition`` holds in the group, -1 if never."""
    return F.coalesce(F.max(F.when(condition, F.col("pos"))), F.lit(-1).cast("long"))


# Steps of the path queries, as SQL over ``value`` and the columns of an edge: the
# value at its far end, NULL where the edge cannot be used.
HOP_STEP = "value + 1"
# Arrival over an interval edge; the end of the interval still counts.
CLOCK_STEP = "CASE WHEN value <= start_tick THEN start_tick + 1 WHEN value <= end_tick THEN value + 1 END"
# Arrival over a contact at t, which takes one tick to cross.
CONTACT_STEP = "CASE WHEN t >= value THEN t + 1 END"


def seen_at(tick: Column) -> Column:
    """The end of an interval as known at ``tick``: later closings are unknown."""
    end = F.col("end_tick")
    return F.when(end > tick, F.lit(OPEN)).otherwise(end)


def checkpoint_tick(tick: Column, every: int = CHECKPOINT_EVERY) -> Column:
    """The first checkpoint at or after ``tick``, by integer arithmetic."""
    return (tick + F.lit(every - 1)) - F.pmod(tick + F.lit(every - 1), F.lit(every))


def triplet_text(src: Column, src_attr: Column, dst: Column, dst_attr: Column, label: Column) -> Column:
    return F.concat(
        F.lit("(("), src.cast("string"), F.lit(","), src_attr.cast("string"), F.lit("),("),
        dst.cast("string"), F.lit(","), dst_attr.cast("string"), F.lit("),"), label, F.lit(")"),
    )
