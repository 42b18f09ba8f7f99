"""What a vertex program says. Every part is a function without arguments that returns a Column, so programs can be written down without a session.

Columns in reach: a signal sees src, dst, weight, the edge's own columns, src_state, out_weight and out_degree of the source, and
src_<name> for other columns of the source. A combiner sees signal, src and weight. The rest sees the vertex's columns
(id, state, last_signal_state, ever_signalled, edges_dirty_signal, ...) and, in collect, the combined values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Callable[[], Column]


def changed() -> Column:
    """The default signal score: 1 if never signalled, edges changed, or the state is another than was signalled last."""
    fresh = ~F.col("ever_signalled") | F.col("edges_dirty_signal") | ~F.col("state").eqNullSafe(F.col("last_signal_state"))
    return F.when(fresh, 1.0).otherwise(0.0)


def difference() -> Column:
    """|state - last_signal_state|, large before the first signal."""
    return F.when(~F.col("ever_signalled") | F.col("edges_dirty_signal"), F.lit(float("inf"))).otherwise(F.abs(F.col("state") - F.col("last_signal_state")))


def source_state() -> Column:
    return F.col("src_state")


@dataclass(frozen=True)
class VertexProgram:
    """state_type: DDL of the state. initial: the state of a new vertex.

    memory: what collect sees. "latest": the most recent signal of every in-neighbour that ever signalled, recomputed from its last signalled
    state (for signals that are functions of the source's state and fixed columns). "inbox": the same, kept as
    rows, for signals that can be null (no message; the older one stays) and graphs that change between executions. "fold": only
    this step's messages, folded into the state.

    by: keys (functions of the signal) by which messages of a target are combined first, into the columns of partial; combine then
    works on those. A reduction that isn't one aggregate (the heaviest label) so never gathers all messages of a hub.
    """

    state_type: str
    initial: Part
    signal: Part
    combine: dict[str, Part]
    collect: Part
    score_signal: Part = changed
    score_collect: Part = field(default=lambda: F.lit(1.0))
    memory: str = "latest"
    reset_state: Part | None = None
    only_on_change: bool = False
    by: dict[str, Part] | None = None
    partial: dict[str, Part] = field(default_factory=dict)
