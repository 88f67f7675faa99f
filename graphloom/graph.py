"""The property graph: a frame of vertices and a frame of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """vertices(id, label, ...) and edges(src, dst, type, ...). An undirected graph holds each edge once, src <= dst."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    def undirected(self) -> PropertyGraph:
        """One edge a pair of ends, without loops; types are lost."""
        pairs = self.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        return PropertyGraph(self.vertices, pairs.withColumn("type", F.lit(None).cast("string")), False)

    def adjacency(self) -> DataFrame:
        """Both directions of each edge, distinct: (id, nbr)."""
        return adjacency(self.edges)

    def without_loops(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.where("src <> dst"), self.directed)

    def induced(self, ids: DataFrame) -> PropertyGraph:
        """The subgraph on ids (column id)."""
        return PropertyGraph(self.vertices.join(ids, "id", "left_semi"), induced_edges(self.edges, ids), self.directed)


def adjacency(edges: DataFrame) -> DataFrame:
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).union(e.select("dst", "src")).distinct()


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids: two left-semi joins."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) by distinct neighbours; pre-aggregated."""
    return adjacency(edges).groupBy("id").agg(F.count("*").alias("degree"))


#: Ids of a block of non_edges() at most on the average.
SIDE = 4_096


def non_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Unordered pairs of a set of ids without an edge between them: they grow with the square of ids.

    Ids meet block by block; an id comes to a block with the list of its neighbours there, so that no pair is shuffled to be compared with the edges.
    """
    n = ids.count()
    blocks = max(1, min(12, n // 64), -(-n // SIDE))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    have = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("src", at("dst").alias("dst_at")).agg(F.collect_set("dst").alias("have"))
    asked = ids.select(F.col("id").alias("src"), at("id").alias("src_at"), each.alias("dst_at")).join(have, ["src", "dst_at"], "left")
    held = ids.select(F.col("id").alias("dst"), at("id").alias("dst_at"), each.alias("src_at"))
    tasks = min(blocks * blocks, 512)
    met = asked.repartition(tasks, "src_at", "dst_at").join(held.repartition(tasks, "src_at", "dst_at"), ["src_at", "dst_at"])
    return met.where((F.col("src") < F.col("dst")) & (F.col("have").isNull() | ~F.array_contains("have", F.col("dst")))).select("src", "dst")
