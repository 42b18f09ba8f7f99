"""Interactive execution: single steps, running until a condition breaks in, reset."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo, Mode, Reason
from weftgraph.plans.engine import Computation
from weftgraph.plans.program import VertexProgram

#: Conditions by the phase after which they are looked at.
AFTER_SIGNAL = ("collect_score_above", "collect_score_below")
AFTER_COLLECT = ("state_changes", "state_above", "state_below", "signal_score_above", "signal_score_below")


@dataclass(frozen=True)
class Break:
    """Stops a run when it holds for the vertex. expected: a number, for states above or below; for scores the session's thresholds are meant."""

    kind: str
    vertex_id: object
    expected: float | None = None


class Session:
    """Steps through a computation by phases."""

    def __init__(self, graph: PropertyGraph, program: VertexProgram, config: ExecutionConfig | None = None):
        self.start = graph
        self.computation = Computation(graph, program, (config or ExecutionConfig()).with_(mode=Mode.INTERACTIVE))
        self.began = time.monotonic()
        self.breaks: dict[int, Break] = {}
        self.phase = "signal"
        self.reason = Reason.ONGOING
        self.hits: list[int] = []
        self._paused, self._worker, self._failed = threading.Event(), None, None

    @property
    def vertices(self) -> DataFrame:
        return self.computation.vertices

    def add_break(self, condition: Break) -> int:
        """The number of the condition; ValueError if it makes no sense, KeyError if the vertex doesn't exist."""
        if condition.kind not in AFTER_SIGNAL + AFTER_COLLECT:
            raise ValueError(f"unknown condition: {condition.kind}")
        if condition.kind in ("state_above", "state_below"):
            float(condition.expected)
        self.computation.graph.vertex(condition.vertex_id)
        number = max(self.breaks, default=0) + 1
        self.breaks[number] = condition
        return number

    def remove_break(self, number: int) -> None:
        del self.breaks[number]

    def step(self) -> str:
        """The next phase, signal or collect; says which it was."""
        done = self.phase
        self.computation.step(signal=done == "signal", collect=done == "collect")
        self.phase = "collect" if done == "signal" else "signal"
        return done

    def collect(self) -> None:
        """Phases up to the end of a collect step."""
        while self.step() != "collect":
            pass

    def _holds(self, condition: Break) -> Column:
        c, p = self.computation.config, self.computation.program
        state = F.col("state").cast("double")
        return {
            "collect_score_above": lambda: p.score_collect() > c.collect_threshold,
            "collect_score_below": lambda: p.score_collect() <= c.collect_threshold,
            "signal_score_above": lambda: p.score_signal() > c.signal_threshold,
            "signal_score_below": lambda: p.score_signal() <= c.signal_threshold,
            "state_changes": lambda: ~F.col("state").eqNullSafe(F.col("last_signal_state")),
            "state_above": lambda: state > float(condition.expected),
            "state_below": lambda: state < float(condition.expected),
        }[condition.kind]()

    def broken(self, phase: str) -> list[int]:
        """Numbers of the conditions that hold after the phase."""
        kinds = AFTER_SIGNAL if phase == "signal" else AFTER_COLLECT
        due = {n: b for n, b in self.breaks.items() if b.kind in kinds}
        if not due:
            return []
        tests = [F.bool_or((F.col("id") == F.lit(b.vertex_id)) & F.coalesce(self._holds(b), F.lit(False))).alias(str(n)) for n, b in due.items()]
        row = self.vertices.agg(*tests).first()
        return [n for n in due if row[str(n)]]

    def run(self, until: Callable[[DataFrame], bool] | None = None, most_phases: int | None = None) -> list[int]:
        """Phases until a condition holds (its numbers), `until` is true of the vertices, nothing is active, or a number of phases."""
        n = 0
        while most_phases is None or n < most_phases:
            if self._paused.is_set():
                return []
            done = self.step()
            n += 1
            if hit := self.broken(done):
                return hit
            if done == "collect" and self.computation.active == 0:
                self.reason = Reason.CONVERGED
                return []
            if until is not None and until(self.vertices):
                return []
        return []

    def start(self, **options) -> None:
        """Run in the background (see run), until its end or pause; `hits` then holds what run gave."""
        if self._worker and self._worker.is_alive():
            raise RuntimeError("the session is running")
        self._paused.clear()

        def work() -> None:
            try:
                self.hits = self.run(**options)
            except Exception as e:  # shown by wait, where the caller is
                self._failed = e

        self._worker = threading.Thread(target=work, daemon=True)
        self._worker.start()

    def wait(self) -> None:
        if self._worker:
            self._worker.join()
        if self._failed:
            failed, self._failed = self._failed, None
            raise failed

    def pause(self) -> None:
        """Stop a run in the background after the phase it is in; start goes on from there."""
        self._paused.set()
        self.wait()

    def reset(self) -> None:
        """Back to the graph as it was at the start."""
        old = self.computation
        old.close()
        self.computation, self.phase, self.reason = Computation(self.start, old.program, old.config), "signal", Reason.ONGOING

    def terminate(self) -> ExecutionInfo:
        c = self.computation
        c.close()
        if self.reason is Reason.ONGOING:
            self.reason = Reason.TERMINATED_BY_USER
        return ExecutionInfo(Mode.INTERACTIVE, self.reason, c.steps, time.monotonic() - self.began, c.metrics)
