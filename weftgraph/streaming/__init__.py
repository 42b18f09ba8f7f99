"""Continuous execution on Structured Streaming."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.graph import PropertyGraph
from weftgraph.operators.mutate import add_edges, add_vertices
from weftgraph.plans.config import ExecutionConfig
from weftgraph.plans.durable import new_path, write_table
from weftgraph.plans.engine import Computation
from weftgraph.plans.program import VertexProgram


class Continuous:
    """A computation that goes on while edges and signals come in as streams.

    Each micro-batch changes the graph, queues what changed, and runs supersteps until nothing is active; only what the change reaches is
    computed again. The vertices live in the shared folder between batches.
    """

    def __init__(self, graph: PropertyGraph, program: VertexProgram, config: ExecutionConfig | None = None):
        self.computation = Computation(graph, program, config)
        self.computation.execute()
        self.queries: list[StreamingQuery] = []

    @property
    def vertices(self) -> DataFrame:
        return self.computation.vertices

    def _start(self, stream: DataFrame, apply, **options) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", new_path(stream.sparkSession, "stream"))
        query = writer.trigger(**(options or {"availableNow": True})).start()
        self.queries.append(query)
        return query

    def add_edges_from(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """A stream of (src, dst, weight): vertices that don't exist are added, edges that exist are left as they are."""

        def apply(batch: DataFrame, _: int) -> None:
            # through the shared folder into the computation's own session, whose plans outlive the batch
            rows, path = write_table(batch.select("src", "dst", F.col("weight").cast("double").alias("weight")), "arrived")
            rows = self.computation.spark.read.schema(rows.schema).parquet(path)
            ends = rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()
            ends = ends.withColumn("state", self.computation.program.initial().cast(self.computation.program.state_type))
            self.computation.change(add_edges(add_vertices(self.computation.graph, ends), rows))
            self.computation.execute()

        return self._start(stream, apply, **trigger)

    def signals_from(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """A stream of (dst, signal), delivered without a source."""

        def apply(batch: DataFrame, _: int) -> None:
            rows, path = write_table(batch.select("dst", "signal"), "arrived")
            self.computation.send(self.computation.spark.read.schema(rows.schema).parquet(path))
            self.computation.execute()

        return self._start(stream, apply, **trigger)

    def await_idle(self, timeout_s: float | None = None) -> bool:
        """Wait until all that came in is worked off, at most timeout_s; whether it was. Under a millisecond: no wait, False."""
        if timeout_s is not None and timeout_s < 0.001:
            return False
        ends = None if timeout_s is None else time.monotonic() + timeout_s
        for query in self.queries:
            while query.isActive and (query.status["isDataAvailable"] or query.status["isTriggerActive"] or not query.recentProgress):
                if ends is not None and time.monotonic() > ends:
                    return False
                time.sleep(0.05)
            if not query.isActive and query.exception():
                raise query.exception()
        return True

    def stop(self) -> None:
        for query in self.queries:
            query.stop()
        self.computation.close()


def one_hop_totals(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Streaming data flow over one hop: signals (src, value) go along static edges; id, total as they stand so far (update or complete mode)."""
    return signals.join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") * F.col("weight")).alias("total"))


def work_list(items: DataFrame, key: str, keep, process, at_a_time: int = 1000) -> DataFrame:
    """A stateful stream whose state is a list of items by key, worked off as batches come: keep says which items are work, process turns an item
    into text. Rows: key, item, result, n_done (how many of the key were done by then).

    In each batch a key's new work joins its list, in the order of the items, and the first at_a_time are done; the others wait in the state for the key's
    next batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def drain(k, frames, state):
        import pandas as pd

        done, waiting = state.get if state.exists else (0, [])
        waiting = sorted([*waiting, *(x for f in frames for x in f["item"] if keep(x))])
        work, waiting = waiting[:at_a_time], waiting[at_a_time:]
        state.update((done + len(work), waiting))
        yield pd.DataFrame({"key": [k[0]] * len(work), "item": work, "result": [process(x) for x in work], "n_done": range(done + 1, done + len(work) + 1)})

    kind = dict(items.dtypes)
    schema = f"key {kind[key]}, item {kind['item']}, result string, n_done bigint"
    return items.groupBy(key).applyInPandasWithState(drain, schema, f"n bigint, waiting array<{kind['item']}>", "append", GroupStateTimeout.NoTimeout)
