"""Vertex colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import seeded
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo
from weftgraph.plans.engine import run
from weftgraph.plans.program import VertexProgram

STATE = "struct<colour:int,step:int,clash:boolean>"


def colouring_program(colours: int, p_free: float = 0.2, p_stay: float = 0.5, seed: int = 1) -> VertexProgram:
    """A vertex that has a neighbour's colour takes, at odds p_free, a colour that no neighbour has, else any; `fixed` vertices keep theirs.

    Choices are hashes of vertex, step and seed, so a run can be repeated. As all vertices choose at once here, a vertex keeps its
    colour at odds p_stay, or two neighbours would change in step for ever. It signals while it clashes, and when it has changed.
    """

    def draw(n: int, what: int):
        return seeded(n, F.col("id"), F.col("state.step"), F.lit(what), seed=seed)

    def choose():
        now, around = F.col("state.colour"), F.coalesce("around", F.array().cast("array<int>"))
        free = F.array_except(F.array(*[F.lit(c) for c in range(colours)]), around)
        from_free = F.coalesce(F.try_element_at(free, draw(1 << 20, 1) % F.greatest(F.size(free), F.lit(1)) + 1), now)
        other = draw(colours, 2)
        moved = F.when(draw(1000, 3) < int(1000 * p_stay), now).when(draw(1000, 4) < int(1000 * p_free), from_free).otherwise(other)
        clash = F.array_contains(around, now)
        colour = F.when(clash & ~F.coalesce("fixed", F.lit(False)), moved).otherwise(now)
        return F.struct(colour.alias("colour"), (F.col("state.step") + 1).alias("step"), F.array_contains(around, colour).alias("clash"))

    changed = lambda: ~F.col("ever_signalled") | (F.col("state.colour") != F.col("last_signal_state.colour")) | F.col("state.clash")
    return VertexProgram(
        state_type=STATE,
        initial=lambda: F.struct(F.lit(0).alias("colour"), F.lit(0).alias("step"), F.lit(False).alias("clash")),
        signal=lambda: F.col("src_state.colour"),
        combine={"around": lambda: F.collect_set("signal")},
        collect=choose,
        score_signal=lambda: F.when(changed(), 1.0).otherwise(0.0),
    )


def colour(graph: PropertyGraph, colours: int, config: ExecutionConfig | None = None, p_free: float = 0.2, seed: int = 1) -> tuple[DataFrame, ExecutionInfo]:
    """id, colour of every vertex; start colours are in a column `colour` (else 0), vertices to keep in a column `fixed`."""
    v = graph.vertices
    v = v if "fixed" in v.columns else v.withColumn("fixed", F.lit(False))
    start = F.col("colour").cast("int") if "colour" in v.columns else F.lit(0)
    v = v.withColumn("state", F.struct(start.alias("colour"), F.lit(0).alias("step"), F.lit(False).alias("clash")))
    out, info = run(PropertyGraph(v.drop("colour"), graph.edges), colouring_program(colours, p_free, seed=seed), config)
    return out.select("id", F.col("state.colour").alias("colour")), info


def conflicts(coloured: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends have the same colour."""
    a = coloured.select(F.col("id").alias("src"), F.col("colour").alias("c1"))
    b = coloured.select(F.col("id").alias("dst"), F.col("colour").alias("c2"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst")
