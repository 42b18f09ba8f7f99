"""Watching computations, and holding two plans against each other."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.config import ExecutionInfo
from weftgraph.plans.engine import Computation

log = logging.getLogger("weftgraph")
TRACED = ("step", "execute", "send", "change", "recalculate_scores", "close")


def traced(computation: Computation, to: Callable[[str], None] = log.info) -> Computation:
    """The same computation, whose calls are reported before and after."""
    for name in TRACED:
        call = getattr(computation, name)

        @functools.wraps(call)
        def reported(*args, name=name, call=call, **kwargs):
            to(f"{name}{args if args else ''}{kwargs if kwargs else ''}")
            out = call(*args, **kwargs)
            to(f"{name}: {out}")
            return out

        setattr(computation, name, reported)
    return computation


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other, with `only_in` saying which; no rows if both hold the same."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).union(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def verified(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, after a check that b holds the same rows; AssertionError names a row that differs."""
    row = differences(a, b).first()
    if row is not None:
        raise AssertionError(f"only the {row['only_in']} result has {row.asDict()}")
    return a


def top_activity(info: ExecutionInfo, n: int) -> list[tuple[int, float]]:
    """The n steps that took longest: (step, seconds)."""
    return sorted(((m.step, m.seconds) for m in info.metrics), key=lambda x: (-x[1], x[0]))[:n]


def most_messages(computation: Computation, n: int) -> DataFrame:
    """The n vertices that the most messages of one step can reach (id, messages): those that take longest to collect."""
    return computation.graph.in_degrees().withColumnRenamed("in_degree", "messages").orderBy(F.desc("messages"), "id").limit(n)
