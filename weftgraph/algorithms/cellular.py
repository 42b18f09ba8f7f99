"""Cells on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo
from weftgraph.plans.engine import run
from weftgraph.plans.program import VertexProgram

FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def grid_graph(spark: SparkSession, width: int, height: int, neighbours: int = 8, wrap: bool = False) -> PropertyGraph:
    """Cells x + width * y with edges to 4 or 8 neighbours; wrap joins opposite borders."""
    cells = spark.range(width * height).select("id", (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in (EIGHT if neighbours == 8 else FOUR)]))
    near = cells.select("id", "x", "y", offsets.alias("o")).select("id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    if wrap:
        near = near.select("id", F.pmod("x", F.lit(width)).alias("x"), F.pmod("y", F.lit(height)).alias("y"))
    near = near.where(f"x >= 0 AND x < {width} AND y >= 0 AND y < {height}")
    edges = near.select(F.col("id").alias("src"), (F.col("x") + F.col("y") * width).alias("dst")).where("src <> dst")
    return PropertyGraph.of(edges, cells)


def life_program() -> VertexProgram:
    """A cell lives on with two or three living neighbours and is born with three."""
    n = F.coalesce
    return VertexProgram(
        state_type="int",
        initial=lambda: F.lit(0),
        signal=lambda: F.col("src_state"),
        combine={"alive": lambda: F.sum("signal")},
        collect=lambda: F.when(n("alive", F.lit(0)) == 3, 1).when(n("alive", F.lit(0)) == 2, F.col("state")).otherwise(0),
    )


def game_of_life(graph: PropertyGraph, state: Column, steps: int) -> tuple[DataFrame, ExecutionInfo]:
    return run(graph.with_state(state), life_program(), ExecutionConfig(steps_limit=steps))


def schelling_program(threshold: float = 0.45) -> VertexProgram:
    """A cell changes sides if less than threshold of the signals it remembers are of its own. Only cells that hear something decide."""
    return VertexProgram(
        state_type="int",
        initial=lambda: F.lit(0),
        signal=lambda: F.col("src_state"),
        combine={"ones": lambda: F.sum("signal"), "heard": lambda: F.count("signal")},
        collect=lambda: F.when(F.when(F.col("state") == 1, F.col("ones")).otherwise(F.col("heard") - F.col("ones")) / F.col("heard") < threshold, 1 - F.col("state")).otherwise(F.col("state")),
    )


def schelling(graph: PropertyGraph, state: Column, steps: int, threshold: float = 0.45) -> tuple[DataFrame, ExecutionInfo]:
    return run(graph.with_state(state), schelling_program(threshold), ExecutionConfig(steps_limit=steps))
