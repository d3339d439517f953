"""Operators on a graph held as ``vertices(id, attr)`` and ``edges(src, dst, ...)``.

A join here meets edges with at most one row per vertex or pair. A hub's edges all
look up the same row and may be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.lookup import lookup


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).distinct()


def add_nodes(vertices: DataFrame, more: DataFrame) -> DataFrame:
    """One row per id; of two attributes the greater stays."""
    return vertices.unionByName(more).groupBy("id").agg(F.max("attr").alias("attr"))


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop every edge between the given ``(src, dst)`` pairs."""
    return lookup(edges, pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(edges.columns)


def remove_nodes(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the given ``(id)`` vertices and every edge that touches one."""
    ids = ids.select("id").distinct()
    return vertices.join(ids, "id", "left_anti"), _by_endpoints(edges, ids, "left_anti")


def _by_endpoints(edges: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    kept = edges
    for end in ("src", "dst"):
        kept = lookup(kept, ids.select(F.col("id").alias(end)), [end], how)
    return kept.select(edges.columns)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def from_edges(edges: DataFrame, attr: Column) -> DataFrame:
    """The vertices a set of edges implies."""
    return endpoints(edges).withColumn("attr", attr)


def build_vertices(vertices: DataFrame, edges: DataFrame, default: Column) -> DataFrame:
    """Given vertices and implied endpoints; the latter get ``default``.

    One aggregation over both instead of an outer join: endpoints carry no
    attribute, and the maximum ignores NULL.
    """
    implied = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (
        vertices.select("id", "attr")
        .unionByName(implied, allowMissingColumns=True)
        .groupBy("id")
        .agg(F.coalesce(F.max("attr"), default).alias("attr"))
    )


def edge_multiplicity(edges: DataFrame) -> DataFrame:
    """Parallel edges summed, each counting 1."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("attr"))


def label_runs(edges: DataFrame) -> DataFrame:
    """Parallel edges by label: the merged labels of any pair, however many it has."""
    return edges.groupBy("src", "dst", "label").agg(F.count(F.lit(1)).alias("n"))


def group_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges merged into one whose label joins theirs in sorted order.

    Equal labels are counted before anything is gathered, so a pair brings its
    distinct labels only. The merged label is one value and has the size limit
    of one; ``label_runs`` has no such limit.
    """
    runs = label_runs(edges)
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("label", "n"))),
        lambda run: F.repeat(run["label"], run["n"].cast("int")),
    )
    return runs.groupBy("src", "dst").agg(F.array_join(text, "").alias("label"))


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the attributes of both endpoints; other edge columns are kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    for end in ("src", "dst"):
        edges = lookup(edges, vertices.select(F.col("id").alias(end), F.col("attr").alias(f"{end}_attr")), [end])
    return edges.select("src", "src_attr", "dst", "dst_attr", *rest)


def sentences(triplet_rows: DataFrame) -> DataFrame:
    return triplet_rows.select(
        F.format_string("%s is the %s of %s", F.col("src_attr").cast("string"), "label", F.col("dst_attr").cast("string"))
        .alias("sentence")
    )


def incident_triplets(triplet_rows: DataFrame) -> DataFrame:
    """Each triplet under both of its vertices, and once if they are the same."""
    return triplet_rows.withColumn("id", F.explode(F.array_distinct(F.array("src", "dst")))).select(
        "id", *triplet_rows.columns
    )


def subgraph_edges(triplet_rows: DataFrame, predicate: Column) -> DataFrame:
    """Triplets that satisfy an edge predicate; the vertices all stay."""
    return triplet_rows.where(predicate)


def subgraph_vertices(vertices: DataFrame, edges: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Vertices that satisfy ``predicate``, and the edges between them."""
    kept = vertices.where(predicate)
    return kept, _by_endpoints(edges, kept.select("id"), "left_semi")


def outer_join_vertices(vertices: DataFrame, values: DataFrame, default: Column) -> DataFrame:
    """Replace attributes by ``values(id, value)``, or ``default`` where there is none."""
    return vertices.join(values, "id", "left").select("id", F.coalesce("value", default).alias("attr"))


def compare_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row that says how two bags of rows differ, from a single shuffle.

    ``common`` counts distinct rows on both sides, and ``contained`` is the test
    ``|left| = |left ∩ right|``; ``equal`` holds both ways and for duplicates.
    """
    keys = left.columns
    sides = (
        left.withColumn("l", F.lit(1)).withColumn("r", F.lit(0))
        .unionByName(right.select(*keys).withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
        .groupBy(*keys)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    zero = F.lit(0)
    return sides.agg(
        total(F.col("l")).alias("left_rows"),
        total(F.col("r")).alias("right_rows"),
        total(((F.col("l") > 0) & (F.col("r") > 0)).cast("long")).alias("common"),
        total(F.greatest(F.col("l") - F.col("r"), zero)).alias("left_only"),
        total(F.greatest(F.col("r") - F.col("l"), zero)).alias("right_only"),
    ).select(
        "*",
        (F.col("left_rows") == F.col("common")).alias("contained"),
        ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"),
    )


def graph_equal(
    left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """``compare_rows`` of the vertices and of the edges of two graphs."""
    parts = [
        compare_rows(a, b).select(F.lit(name).alias("part"), "*")
        for name, a, b in zip(("vertices", "edges"), left, right)
    ]
    return parts[0].unionByName(parts[1])
