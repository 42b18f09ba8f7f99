"""Clusters, components and how close neighbourhoods are knit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo
from weftgraph.plans.durable import write_table
from weftgraph.plans.engine import run
from weftgraph.plans.program import VertexProgram


def clustering_coefficient(graph: PropertyGraph) -> DataFrame:
    """id, coefficient: over the in-neighbours u of v, the common out-neighbours of v and u, by k(k-1) for v's k out-neighbours.

    0 without an in-neighbour; null if there is one but k(k-1) is 0. Loops don't count. Triangles are listed once each, from their end of
    smallest degree, so the work stays near the power 1.5 of the edges even around hubs.
    """
    edges = graph.edges.where("src <> dst").select("src", "dst").distinct()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    into = edges.select(F.col("dst").alias("id")).distinct().withColumn("heard", F.lit(True))
    low_high = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    sides = low_high.groupBy("a", "b").agg(F.max("up").alias("ab"), F.max(~F.col("up")).alias("ba"))
    degree = sides.select(F.col("a").alias("id")).union(sides.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    ranked = sides.join(degree.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
    ahead = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    # x before y in (degree, id); xy, yx: which of the two edges there are
    half = ranked.select(pick("a", "b").alias("x"), pick("b", "a").alias("y"), F.greatest("da", "db").alias("dy"), pick("ab", "ba").alias("xy"), pick("ba", "ab").alias("yx"))
    half, _ = write_table(half, "triangle-sides")
    one = half.select("x", "y", "dy", "xy", "yx")
    two = half.select("x", F.col("y").alias("z"), F.col("dy").alias("dz"), F.col("xy").alias("xz"), F.col("yx").alias("zx"))
    wedges = one.join(two, "x").where(F.struct("dy", "y") < F.struct("dz", "z"))
    close = half.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("xy").alias("yz"), F.col("yx").alias("zy"))
    triangles = wedges.join(close, ["y", "z"])

    def common(u_v: str, v_w: str, u_w: str, w_v: str, v_u: str, w_u: str):
        """Ways in which one of two vertices u, w points at v, v at the other, and the one at the other."""
        c = lambda *names: F.expr(" AND ".join(names)).cast("long")
        return c(u_v, v_w, u_w) + c(w_v, v_u, w_u)

    counts = F.array(
        F.struct(F.col("x").alias("id"), common("yx", "xz", "yz", "zx", "xy", "zy").alias("n")),
        F.struct(F.col("y").alias("id"), common("xy", "yz", "xz", "zy", "yx", "zx").alias("n")),
        F.struct(F.col("z").alias("id"), common("xz", "zy", "xy", "yz", "zx", "yx").alias("n")),
    )
    shared = triangles.select(F.explode(counts).alias("c")).select("c.id", "c.n").groupBy("id").agg(F.sum("n").alias("n"))
    rows = graph.vertices.select("id").join(out, "id", "left").join(into, "id", "left").join(shared, "id", "left")
    k = F.coalesce("k", F.lit(0))
    value = F.when(F.col("heard").isNull(), 0.0).when(k > 1, F.coalesce("n", F.lit(0)) / (k * (k - 1)))
    return rows.select("id", value.alias("coefficient"))


def components_program() -> VertexProgram:
    """The least id that is heard of."""
    return VertexProgram(
        state_type="bigint",
        initial=lambda: F.col("id"),
        signal=lambda: F.col("src_state"),
        combine={"least": lambda: F.min("signal")},
        collect=lambda: F.least("state", "least"),
        memory="fold",
    )


def components(graph: PropertyGraph, config: ExecutionConfig | None = None) -> tuple[DataFrame, ExecutionInfo]:
    """Weakly connected components, by the least id of each."""
    return run(graph.symmetric(), components_program(), config)


def label_program() -> VertexProgram:
    """The label with the greatest weight around; of equals the smallest. Weights are summed by label before they meet at a vertex."""
    return VertexProgram(
        state_type="bigint",
        initial=lambda: F.col("id"),
        signal=lambda: F.struct(F.col("src_state").alias("label"), F.col("weight").alias("w")),
        by={"label": lambda: F.col("signal.label")},
        partial={"w": lambda: F.sum("signal.w")},
        combine={"best": lambda: F.min(F.struct((-F.col("w")).alias("w"), "label"))},
        collect=lambda: F.col("best.label"),
    )


def label_clustering(graph: PropertyGraph, config: ExecutionConfig | None = None, self_preference: float = 1.0) -> tuple[DataFrame, ExecutionInfo]:
    """Labels start as ids. A vertex also hears itself, with the weight self_preference."""
    own = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(self_preference).alias("weight"))
    edges = graph.edges.select("src", "dst", "weight").union(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return run(PropertyGraph(graph.vertices, edges), label_program(), config)
