"""Table schemas. Interval ends are flat LONG columns so filters reach the scan."""

from pyspark.sql import types as T

# Fixed value: the end of an interval that is still open.
OPEN = 9223372036854775807

# Fixed value: a checkpoint is taken every fifth tick.
CHECKPOINT_EVERY = 5

COMMANDS = T.StructType(
    [
        T.StructField("tick", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("src", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("dst", T.LongType()),
        T.StructField("raw", T.StringType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("start_tick", T.LongType()),
        T.StructField("end_tick", T.LongType()),
    ]
)

VERTICES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("attr", T.IntegerType()),
        T.StructField("first_tick", T.LongType()),
    ]
)

LABELLED_EDGES = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)
