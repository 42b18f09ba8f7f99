"""A graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of keys: the one whose other columns are least, in their order, so the same one wherever rows come from."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__one")).select(*[F.col(c) if c in keys else F.col(f"__one.{c}").alias(c) for c in rows.columns])


@dataclass(frozen=True)
class PropertyGraph:
    """vertices: id and any other columns (state, vtype, ...), one row an id. edges: src, dst, weight and any others, one row a (src, dst)."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> PropertyGraph:
        """From an edge list: one edge for each (src, dst), the least of several; weight 1 unless given; vertices are the ends unless given."""
        edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
        edges = one_each(edges.withColumn("weight", F.col("weight").cast("double")), ["src", "dst"])
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(vertices, edges)

    @classmethod
    def empty(cls, like: PropertyGraph) -> PropertyGraph:
        """No vertices and no edges, with the columns of like (what a reset leaves)."""
        return cls(like.vertices.where("false"), like.edges.where("false"))

    def with_state(self, state: Column) -> PropertyGraph:
        """The state of every vertex replaced; nothing is queued by that."""
        return PropertyGraph(self.vertices.withColumn("state", state), self.edges)

    def symmetric(self) -> PropertyGraph:
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)
        return PropertyGraph.of(self.edges.unionByName(back), self.vertices)

    def without_loops(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.where("src <> dst"))

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("out_weight"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))

    def degrees(self) -> DataFrame:
        """id, out_degree, in_degree, degree of every vertex; a loop counts on both sides."""
        d = self.vertices.select("id").join(self.out_degrees().drop("out_weight"), "id", "left").join(self.in_degrees(), "id", "left").na.fill(0, ["out_degree", "in_degree"])
        return d.withColumn("degree", F.col("out_degree") + F.col("in_degree"))

    def targets(self) -> DataFrame:
        """id, targets: the set of out-neighbours in order, for each vertex that has any."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))

    def vertex(self, vertex_id) -> DataFrame:
        """The row of one vertex; KeyError if there is none."""
        row = self.vertices.where(F.col("id") == F.lit(vertex_id))
        if row.isEmpty():
            raise KeyError(vertex_id)
        return row

    def dangling(self) -> DataFrame:
        """Edges that end at no vertex."""
        return self.edges.join(self.vertices.select(F.col("id").alias("dst")), "dst", "left_anti")

    def to_views(self, prefix: str = "") -> None:
        self.vertices.createOrReplaceTempView(f"{prefix}vertices")
        self.edges.createOrReplaceTempView(f"{prefix}edges")


def expose_inbox(inbox: DataFrame) -> DataFrame:
    """id, signals: for each vertex the map from source to its latest signal."""
    return inbox.groupBy(F.col("dst").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("src", "signal")))).alias("signals"))
