"""Linear fixpoints and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo
from weftgraph.plans.engine import run
from weftgraph.plans.program import VertexProgram, difference


def valuation_program() -> VertexProgram:
    """A company is worth its core (column `core`) and its shares (edge weights) of the others' worth."""
    return VertexProgram(
        state_type="double",
        initial=lambda: F.col("core").cast("double"),
        signal=lambda: F.col("weight") * F.col("src_state"),
        combine={"owned": lambda: F.sum("signal")},
        collect=lambda: F.col("core") + F.coalesce("owned", F.lit(0.0)),
        score_signal=difference,
    )


def company_valuation(graph: PropertyGraph, config: ExecutionConfig | None = None) -> tuple[DataFrame, ExecutionInfo]:
    return run(graph, valuation_program(), config)


def counting_program() -> VertexProgram:
    """Counts the signals delivered and the collect operations run."""
    return VertexProgram(
        state_type="struct<signals:bigint,collects:bigint>",
        initial=lambda: F.struct(F.lit(0).cast("long").alias("signals"), F.lit(0).cast("long").alias("collects")),
        signal=lambda: F.lit(1),
        combine={"n": lambda: F.count_if("fresh")},
        collect=lambda: F.struct((F.col("state.signals") + F.col("n")).alias("signals"), (F.col("state.collects") + 1).alias("collects")),
    )


def counting(graph: PropertyGraph, steps: int) -> tuple[DataFrame, ExecutionInfo]:
    return run(graph, counting_program(), ExecutionConfig(steps_limit=steps))
