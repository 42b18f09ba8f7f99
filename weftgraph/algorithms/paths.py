"""Paths: distances, Hamiltonian paths, patterns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo
from weftgraph.plans.durable import write_table
from weftgraph.plans.engine import run
from weftgraph.plans.program import VertexProgram


def sssp_program(weighted: bool = True) -> VertexProgram:
    """Distance from the vertices whose state is 0 at the start; null if unreachable. Weights count as whole numbers; without weights edges are hops."""
    step = (lambda: F.col("weight").cast("int")) if weighted else (lambda: F.lit(1))
    return VertexProgram(
        state_type="int",
        initial=lambda: F.lit(None),
        signal=lambda: F.col("src_state") + step(),
        combine={"nearest": lambda: F.min("signal")},
        collect=lambda: F.least("state", "nearest"),
        score_signal=lambda: F.when(F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("last_signal_state")), 1.0).otherwise(0.0),
        memory="fold",
    )


def shortest_paths(graph: PropertyGraph, source, config: ExecutionConfig | None = None, weighted: bool = True) -> tuple[DataFrame, ExecutionInfo]:
    v = graph.vertices.withColumn("state", F.when(F.col("id") == F.lit(source), 0).cast("int"))
    return run(PropertyGraph(v, graph.edges), sssp_program(weighted), config)


def hamiltonian_paths(graph: PropertyGraph, most_vertices: int) -> DataFrame:
    """id, path, cost: for each vertex the longest simple path that ends there, of equally long ones the cheapest, of those the first.

    The number of paths grows exponentially, so the longest path looked at has most_vertices vertices. Paths are rows.
    """
    ring = graph.vertices.select("id", F.array("id").alias("path"), F.lit(0.0).alias("cost"))
    found, _ = write_table(ring, "paths")
    everything = found
    edges = graph.edges.select(F.col("src").alias("id"), "dst", "weight")
    for _ in range(most_vertices - 1):
        longer = found.join(edges, "id").where(~F.array_contains("path", F.col("dst")))
        found, _ = write_table(longer.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost")), "paths")
        if found.isEmpty():
            break
        everything = everything.union(found)
    best = F.struct(-F.size("path"), "cost", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("text"), "path")
    return everything.groupBy("id").agg(F.min(best).alias("b")).select("id", F.col("b.path").alias("path"), F.col("b.cost").alias("cost"))


@dataclass(frozen=True)
class Fixed:
    """Matches one vertex, by its id."""

    vertex_id: object


@dataclass(frozen=True)
class Any:
    """Matches one vertex that meets the condition on its columns (all of them without one)."""

    condition: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Star:
    """Matches from least to most vertices in a row that meet the condition."""

    most: int
    condition: Callable[[], Column] | None = None
    least: int = 0


def path_pattern(graph: PropertyGraph, seed, pattern: list[Fixed | Any | Star]) -> DataFrame:
    """path: the distinct walks from the seed whose vertices after it match the pattern, the seed not being one of them.

    Each hop joins the walks so far (rows) with the edges; their number is bounded by the pattern's length alone, so patterns should be narrow.
    """

    def meets(node: Fixed | Any | Star) -> Column:
        if isinstance(node, Fixed):
            return F.col("id") == F.lit(node.vertex_id)
        return F.coalesce(node.condition(), F.lit(False)) if node.condition else F.lit(True)

    steps = graph.edges.select("src", F.col("dst").alias("id")).join(graph.vertices, "id")
    id_type = dict(graph.edges.dtypes)["src"]
    walks = graph.edges.sparkSession.range(1).select(F.lit(seed).cast(id_type).alias("at"), F.array().cast(f"array<{id_type}>").alias("path"))

    def hop(walks: DataFrame, node: Fixed | Any | Star) -> DataFrame:
        near = steps.where(meets(node)).select("src", "id")
        return walks.join(near, walks.at == near.src).select(F.col("id").alias("at"), F.concat("path", F.array("id")).alias("path"))

    for node in pattern:
        if isinstance(node, Star):
            ring, reached = walks, walks if node.least == 0 else None
            for n in range(1, node.most + 1):
                ring = hop(ring, node)
                if n >= node.least:
                    reached = ring if reached is None else reached.union(ring)
            walks = reached if reached is not None else walks.where("false")
        else:
            walks = hop(walks, node)
    return walks.select("path").distinct()
