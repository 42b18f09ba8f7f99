"""How an execution runs, and what it reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession


class Mode(str, Enum):
    SYNCHRONOUS = "synchronous"
    #: Without a barrier between all vertices: halves of them (by a hash of the id) take turns, and each sees what the other just did. Programs
    #: with one fixpoint give the same result, usually after less work; schedule-dependent ones get a deterministic schedule.
    ASYNCHRONOUS = "asynchronous"
    #: One synchronous step, then the same.
    OPTIMIZED_ASYNCHRONOUS = "optimized_asynchronous"
    CONTINUOUS = "continuous"
    INTERACTIVE = "interactive"


class Reason(str, Enum):
    CONVERGED = "converged"
    GLOBAL_CONSTRAINT = "global_constraint_met"
    STEPS_LIMIT = "steps_limit_reached"
    TIME_LIMIT = "time_limit_reached"
    ONGOING = "ongoing"
    TERMINATED_BY_USER = "terminated_by_user"


@dataclass(frozen=True)
class ExecutionConfig:
    """signal_threshold, collect_threshold: a vertex acts if its score is strictly above.

    should_stop: called with the vertices after every check_every collect steps. on_missing_target: what happens to a message
    for a vertex that doesn't exist: error, drop or create (with create_state). partitions: of edges and vertices; None: the session's, and one for
    graphs of at most local_edges edges, whose steps then are one task each. hub_edges: out-edges of one vertex that a partition takes before they are spread.
    """

    mode: Mode = Mode.SYNCHRONOUS
    signal_threshold: float = 0.01
    collect_threshold: float = 0.0
    steps_limit: int | None = None
    time_limit_s: float | None = None
    should_stop: Callable[[DataFrame], bool] | None = None
    check_every: int = 1
    on_missing_target: str = "error"
    create_state: Callable | None = None
    partitions: int | None = None
    hub_edges: int = 1_000_000
    local_edges: int = 100_000

    def with_(self, **changes) -> ExecutionConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class StepMetrics:
    step: int
    signalled: int
    collected: int
    active_after: int
    seconds: float


@dataclass
class ExecutionInfo:
    mode: Mode
    reason: Reason
    steps: int
    seconds: float
    metrics: list[StepMetrics] = field(default_factory=list)

    @property
    def signal_operations(self) -> int:
        return sum(m.signalled for m in self.metrics)

    @property
    def collect_operations(self) -> int:
        return sum(m.collected for m in self.metrics)

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m.step, m.signalled, m.collected, m.active_after, m.seconds) for m in self.metrics]
        return spark.createDataFrame(rows, "step int, signalled bigint, collected bigint, active_after bigint, seconds double")
