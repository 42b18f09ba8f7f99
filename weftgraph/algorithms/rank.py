"""Ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo
from weftgraph.plans.engine import run
from weftgraph.plans.program import VertexProgram, difference

DAMPING = 0.85


def pagerank_program(damping: float = DAMPING) -> VertexProgram:
    """state = (1 - damping) + damping * sum of state * weight / out-weight; not normalised, and vertices without out-edges lose theirs."""
    return VertexProgram(
        state_type="double",
        initial=lambda: F.lit(1.0 - damping),
        signal=lambda: F.col("src_state") * F.col("weight") / F.col("out_weight"),
        combine={"total": lambda: F.sum("signal")},
        collect=lambda: F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("total", F.lit(0.0)),
        score_signal=difference,
    )


def delta_program(damping: float = DAMPING) -> VertexProgram:
    """The same ranks by pushing changes: a message is the change since the last one, shared among out-edges, and is added when it comes."""
    return VertexProgram(
        state_type="double",
        initial=lambda: F.lit(1.0 - damping),
        signal=lambda: (F.col("src_state") - F.coalesce("src_last_signal_state", F.lit(0.0))) / F.col("out_degree"),
        combine={"total": lambda: F.sum("signal")},
        collect=lambda: F.col("state") + F.lit(damping) * F.col("total"),
        score_signal=lambda: F.col("state") - F.coalesce("last_signal_state", F.lit(0.0)),
        memory="fold",
    )


def pagerank(graph: PropertyGraph, config: ExecutionConfig | None = None, damping: float = DAMPING) -> tuple[DataFrame, ExecutionInfo]:
    return run(graph, pagerank_program(damping), config)


def delta_pagerank(graph: PropertyGraph, config: ExecutionConfig | None = None, damping: float = DAMPING) -> tuple[DataFrame, ExecutionInfo]:
    return run(graph, delta_program(damping), config)
