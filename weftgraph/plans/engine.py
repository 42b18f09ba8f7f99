"""The superstep loop: supersteps are joins and aggregations, the driver only sees counts.

A step joins signalling vertices with edges, combines messages for each target (partially before the shuffle) and joins the result to the
vertices. The new vertices are written to the shared folder in the same job that counts what is active, so lineage stays one step
long, a lost executor costs one step, and each step is one job. Edges are partitioned by source once and kept, vertices lie in as many buckets of
their id: a step exchanges the messages, combined as far as they can be, and nothing else. A small graph is one partition, and exchanges nothing.

Whether a vertex acts is a stored flag, set by events and cleared when it acts, not a score looked at again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, ExecutionInfo, Mode, Reason, StepMetrics
from weftgraph.plans.durable import delete, write_buckets, write_table
from weftgraph.plans.program import VertexProgram

FLAGS = ("ever_signalled", "q_signal", "q_collect", "edges_dirty_signal", "edges_dirty_collect")
#: Below this share of signalling vertices a step looks only at the targets of messages.
SPARSE = 0.2


class MissingVertexError(Exception):
    """A message or edge names a vertex that doesn't exist."""


def prepared(vertices: DataFrame, program: VertexProgram, threshold: float) -> DataFrame:
    """vertices with the working columns; those that lack them get the state of a vertex just added, which may signal."""
    if "q_signal" in vertices.columns:
        return vertices
    v = vertices if "state" in vertices.columns else vertices.withColumn("state", program.initial())
    v = v.withColumn("state", F.col("state").cast(program.state_type)).withColumn("last_signal_state", F.lit(None).cast(program.state_type))
    for flag in FLAGS:
        v = v.withColumn(flag, F.lit(False))
    return v.withColumn("q_signal", F.coalesce(program.score_signal() > threshold, F.lit(False)))


class Computation:
    """A graph under a program: steps, execution to an end, and state that later executions go on from."""

    def __init__(self, graph: PropertyGraph, program: VertexProgram, config: ExecutionConfig | None = None):
        self.program, self.config = program, config or ExecutionConfig()
        self.spark = graph.edges.sparkSession
        self.steps = 0
        self.metrics: list[StepMetrics] = []
        self.injected: DataFrame | None = None
        self.inbox: DataFrame | None = None
        self._kept: list[tuple[str, str | None]] = []
        self._edges: DataFrame | None = None
        self._last_sent: DataFrame | None = None
        self._set(graph)

    def _set(self, graph: PropertyGraph) -> None:
        """Take over graph. Its edges are computed once, its vertices are written, since every step reads them."""
        if self._edges is not None:
            self._edges.unpersist()
        self._plain_edges = graph.edges
        edges = graph.edges.select("*").persist(StorageLevel.MEMORY_AND_DISK)
        self.n_edges = edges.count()
        self.small = self.config.partitions is None and self.n_edges <= self.config.local_edges
        self.partitions = 1 if self.small else self.config.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.small:
            edges = edges.coalesce(1)
        out = edges.groupBy("src").agg(F.sum("weight").alias("out_weight"), F.count(F.lit(1)).alias("out_degree"))
        # a hub's edges are dealt over several partitions, and it is sent to each of them
        shares = F.ceil(F.col("out_degree") / self.config.hub_edges)
        watched = Observation()
        v = self._one(prepared(graph.vertices.drop("shares"), self.program, self.config.signal_threshold))
        v = v.join(self._hashed(out.select(F.col("src").alias("id"), shares.alias("shares"))), "id", "left").na.fill(1, ["shares"])
        v = v.observe(watched, F.count(F.lit(1)).alias("all"), F.count_if("q_signal").alias("active"), F.coalesce(F.max("shares"), F.lit(1)).alias("shares"))
        self._keep(v, watched)
        self.shares = watched.get["shares"]
        if self.shares > 1:  # at most n_edges / hub_edges hubs, which are broadcast so that none of their edges meet in one task before they are dealt
            hubs = F.broadcast(out.where(F.col("out_degree") > self.config.hub_edges))
            rest = edges.join(hubs.select("src"), "src", "left_anti").join(out, "src")
            salted = edges.join(hubs, "src").unionByName(rest).withColumn("salt", F.pmod(F.xxhash64("dst"), shares))
            self._edges = salted.repartition(self.partitions, "src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
        else:
            with_out = edges.join(self._hashed(out), "src")
            self._edges = (with_out if self.small else with_out.repartition(self.partitions, "src")).persist(StorageLevel.MEMORY_AND_DISK)
        # where every edge ends at a vertex, only injected messages can miss
        ends = self._edges.join(self._hashed(self.vertices.select(F.col("id").alias("dst"))), "dst", "left_anti")
        self.dangling = self.config.on_missing_target != "drop" and not ends.isEmpty()
        if not self.small:
            self._edges.count()
            edges.unpersist()

    def _one(self, df: DataFrame) -> DataFrame:
        """df in one partition, where the graph is small: its steps then need no exchange."""
        return df.coalesce(1) if self.small else df

    def _hashed(self, df: DataFrame) -> DataFrame:
        """df as the side of a join that is hashed rather than sorted or broadcast, where the graph is small."""
        return df.hint("shuffle_hash") if self.small else df

    def _keep(self, new: DataFrame, watched: Observation) -> None:
        """Write the vertices, by buckets of their id if there are many; only their last two states stay on disk."""
        if self.small:
            (table, path), name = write_table(new, "vertices"), None
            self.vertices = table.coalesce(1)
        else:
            self.vertices, path, name = write_buckets(new, "vertices", "id", self.partitions)
        seen = watched.get
        self.active, self.size = seen["active"], seen["all"]
        self._kept.append((path, name))
        while len(self._kept) > 2:
            self._forget(*self._kept.pop(0))

    def _forget(self, path: str, name: str | None) -> None:
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, path)

    @property
    def graph(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, self._plain_edges)

    def change(self, graph: PropertyGraph) -> None:
        """Go on with a changed graph (see weftgraph.operators.mutate, which sets the flags of what changed)."""
        self._set(graph)

    def send(self, messages: DataFrame) -> None:
        """messages (dst, signal, and src, null for no source) arrive in the next step."""
        m = messages.select("dst", (F.col("src") if "src" in messages.columns else F.lit(None)).alias("src"), "signal")
        self.injected = m if self.injected is None else self.injected.unionByName(m)

    def recalculate_scores(self, vertex_id=None) -> None:
        """Look at all scores again (or at those of one vertex) and queue what is above its threshold."""
        here = F.lit(True) if vertex_id is None else F.col("id") == F.lit(vertex_id)
        v = self.vertices.withColumn("q_signal", F.col("q_signal") | (here & F.coalesce(self.program.score_signal() > self.config.signal_threshold, F.lit(False))))
        v = v.withColumn("q_collect", F.col("q_collect") | (here & F.coalesce(self.program.score_collect() > self.config.collect_threshold, F.lit(False))))
        self._set(PropertyGraph(v, self._plain_edges))

    # one step

    def _messages(self, sources: DataFrame, state: str) -> DataFrame:
        """Messages of sources (rows of vertices), signalling the column `state`; fresh: from a vertex that signals now."""
        taken = {"id": "src", state: "src_state", "q_signal": "fresh"}
        others = [c for c in sources.columns if c not in (*FLAGS, "id", "shares", "q_wait", "state", state)]
        cols = [F.col(k).alias(v) for k, v in taken.items()] + [F.col(c).alias(f"src_{c}") for c in others]
        if self.shares > 1:
            salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
            out = sources.select(*cols, salts.alias("salt")).join(self._edges, ["src", "salt"])
        else:
            out = self._one(self._edges).join(self._hashed(sources.select(*cols)), "src")
        return out.withColumn("signal", self.program.signal()).where("signal IS NOT NULL")

    def _turn(self) -> Column | None:
        """Which vertices may signal in this step; None for all."""
        mode = self.config.mode
        alternating = mode is Mode.ASYNCHRONOUS or (mode is Mode.OPTIMIZED_ASYNCHRONOUS and self.steps > 0)
        return F.pmod(F.xxhash64("id"), F.lit(2)) == self.steps % 2 if alternating else None

    def step(self, *, signal: bool = True, collect: bool = True) -> StepMetrics:
        """One signal step and one collect step (or one of them)."""
        began = time.monotonic()
        watched = Observation()
        new = self._stepped(signal, collect)
        new = new.observe(watched, F.count_if("did_signal").alias("signalled"), F.count_if("did_collect").alias("collected"), F.count_if("q_signal").alias("active"), F.count(F.lit(1)).alias("all"))
        self._keep(new.drop("did_signal", "did_collect"), watched)
        self.injected = None
        seen = watched.get
        self.steps += collect
        self.metrics.append(StepMetrics(self.steps, seen["signalled"], seen["collected"], seen["active"], time.monotonic() - began))
        return self.metrics[-1]

    def _stepped(self, signal: bool, collect: bool) -> DataFrame:
        """The vertices after a step, with what they did."""
        p, c, turn = self.program, self.config, self._turn()
        v = self.vertices
        if turn is not None:
            v = v.withColumns({"q_wait": F.col("q_signal") & ~turn, "q_signal": F.col("q_signal") & turn})
        sent = self._messages(v.where("q_signal"), "state").select("dst", "src", "signal", "weight") if signal else None
        if sent is not None and p.only_on_change:
            if self._last_sent is not None:
                before = self._last_sent.withColumnRenamed("signal", "before")
                sent = sent.join(before, ["src", "dst"], "left").where(~F.col("signal").eqNullSafe(F.col("before"))).select("dst", "src", "signal", "weight")
                kept = self._last_sent.join(sent.select("src", "dst"), ["src", "dst"], "left_anti")
                self._last_sent = write_table(kept.unionByName(sent.select("src", "dst", "signal")), "sent")[0]
            else:
                self._last_sent = write_table(sent.select("src", "dst", "signal"), "sent")[0]
        if self.injected is not None:
            extra = self.injected.select("dst", "src", F.col("signal"), F.lit(None).cast("double").alias("weight"))
            sent = extra if sent is None else sent.unionByName(extra)
        after = v
        if signal:
            q = F.col("q_signal")
            after = v.withColumns(
                {
                    "last_signal_state": F.when(q, F.col("state")).otherwise(F.col("last_signal_state")),
                    "ever_signalled": F.col("ever_signalled") | q,
                    "edges_dirty_signal": F.col("edges_dirty_signal") & ~q,
                    "state": F.when(q, p.reset_state()).otherwise(F.col("state")) if p.reset_state else F.col("state"),
                    "did_signal": q,
                    "q_signal": F.lit(False),
                }
            )
        else:
            after = v.withColumn("did_signal", F.lit(False))
        if sent is not None and c.on_missing_target != "drop" and (self.dangling or self.injected is not None):
            after = self._missing(sent, after)
        combined = self._one(self._combined(v, sent, signal))
        if collect or p.memory == "fold":
            new = self._collected(after, combined)
        else:  # messages wait: their targets are queued
            got = combined.select(F.col("dst").alias("id"), "got")
            queued = F.col("q_collect") | (F.coalesce("got", F.lit(False)) & (p.score_collect() > c.collect_threshold))
            new = after.join(self._hashed(got), "id", "left").withColumn("q_collect", queued).drop("got").withColumn("did_collect", F.lit(False))
        if turn is not None:
            new = new.withColumn("q_signal", F.col("q_signal") | F.coalesce("q_wait", F.lit(False))).drop("q_wait")
        return new

    def _missing(self, sent: DataFrame, after: DataFrame) -> DataFrame:
        lost = sent.join(self._hashed(after.select(F.col("id").alias("dst"))), "dst", "left_anti").select(F.col("dst").alias("id")).distinct()
        if self.config.on_missing_target == "error":
            first = lost.first()
            if first is not None:
                raise MissingVertexError(f"a message was sent to {first['id']}, which doesn't exist")
            return after
        lost, _ = write_table(lost, "created")
        if lost.isEmpty():
            return after
        made = lost.withColumn("state", (self.config.create_state or self.program.initial)())
        made = prepared(made, self.program, self.config.signal_threshold).withColumns({"did_signal": F.lit(False), "shares": F.lit(1).cast("long")})
        return self._one(after.unionByName(made, allowMissingColumns=True))

    def _combined(self, before: DataFrame, sent: DataFrame | None, signalling: bool) -> DataFrame:
        """dst, got (a message came in this step) and the combined values, for targets of messages and queued vertices at least."""
        p = self.program
        if p.memory == "fold":
            if sent is None:
                sent = self._messages(before.where("false"), "state").select("dst", "src", "signal", "weight")
            return self._grouped(sent.withColumn("fresh", F.lit(True)))
        if p.memory == "inbox":
            box = None
            if sent is not None:
                box = sent.groupBy("dst", "src").agg(F.max_by("signal", F.hash("signal")).alias("signal"), F.first("weight").alias("weight"), F.lit(True).alias("fresh"))
            if self.inbox is not None:
                old = self.inbox.withColumn("fresh", F.lit(False))
                if box is not None:
                    new = box.select(F.col("dst").alias("d"), F.col("src").alias("s"))
                    old = old.join(new, (F.col("dst") == F.col("d")) & F.col("src").eqNullSafe(F.col("s")), "left_anti")
                box = old if box is None else box.unionByName(old)
            if box is None:
                box = self._messages(before.where("false"), "state").select("dst", "src", "signal", "weight", "fresh")
            box, _ = write_table(box, "inbox")
            self.inbox = box.drop("fresh")
            return self._grouped(box)
        # latest: every in-neighbour that ever signalled, at the state it signalled last
        spoke = before.where("ever_signalled")
        if signalling:
            now = F.when(F.col("q_signal"), F.col("state")).otherwise(F.col("last_signal_state"))
            spoke = before.where("ever_signalled OR q_signal").withColumn("last_signal_state", now)
        else:
            spoke = spoke.withColumn("q_signal", F.lit(False))
        every = self._messages(spoke, "last_signal_state").select("dst", "src", "signal", "weight", "fresh")
        if sent is not None and self.active < SPARSE * self.size:
            due = sent.select("dst").union(before.where("q_collect").select(F.col("id").alias("dst"))).distinct()
            every = every.join(self._hashed(due), "dst", "left_semi")
        if self.injected is not None:
            every = every.unionByName(self.injected.select("dst", "src", "signal", F.lit(None).cast("double").alias("weight"), F.lit(True).alias("fresh")))
        return self._grouped(every)

    def _grouped(self, messages: DataFrame) -> DataFrame:
        p, fresh = self.program, F.max("fresh")
        aggs = [part().alias(name) for name, part in p.combine.items()]
        if p.by:
            keys = [part().alias(name) for name, part in p.by.items()]
            partial = [part().alias(name) for name, part in p.partial.items()]
            messages = messages.groupBy("dst", *keys).agg(fresh.alias("fresh"), *partial)
        return messages.groupBy("dst").agg(fresh.alias("got"), *aggs)

    def _collected(self, after: DataFrame, combined: DataFrame) -> DataFrame:
        p, c = self.program, self.config
        joined = after.join(self._hashed(combined.withColumnRenamed("dst", "id")), "id", "left")
        got = F.coalesce("got", F.lit(False))
        due = got if p.memory == "fold" else F.col("q_collect") | (got & (p.score_collect() > c.collect_threshold))
        joined = joined.withColumn("did_collect", F.coalesce(due, F.lit(False)))
        new = joined.withColumn("state", F.when(F.col("did_collect"), p.collect().cast(p.state_type)).otherwise(F.col("state")))
        new = new.withColumns({"edges_dirty_collect": F.col("edges_dirty_collect") & ~F.col("did_collect"), "q_collect": F.lit(False)})
        new = new.withColumn("q_signal", F.col("q_signal") | (F.col("did_collect") & F.coalesce(p.score_signal() > c.signal_threshold, F.lit(False))))
        return new.drop("got", *p.combine)

    # to an end

    def execute(self, config: ExecutionConfig | None = None) -> ExecutionInfo:
        """Steps until converged, else the global condition holds, else a limit is met; at least one unless a limit holds before."""
        if config is not None:
            self.config = config
        c, began, first = self.config, time.monotonic(), len(self.metrics)
        done = 0

        def limit() -> Reason | None:
            if c.steps_limit is not None and done >= c.steps_limit:
                return Reason.STEPS_LIMIT
            if c.time_limit_s is not None and time.monotonic() - began >= c.time_limit_s:
                return Reason.TIME_LIMIT
            return None

        reason = limit()
        while reason is None:
            self.step()
            done += 1
            if self.active == 0:
                reason = Reason.CONVERGED
            elif c.should_stop is not None and done % c.check_every == 0 and c.should_stop(self.vertices):
                reason = Reason.GLOBAL_CONSTRAINT
            else:
                reason = limit()
        return ExecutionInfo(c.mode, reason, done, time.monotonic() - began, self.metrics[first:])

    def __iter__(self) -> Iterator[StepMetrics]:
        while self.active or self.injected is not None:
            yield self.step()

    def close(self) -> None:
        """Give back cached edges and tables; the last vertices stay readable."""
        if self._edges is not None:
            self._edges.unpersist()
        path, name = self._kept[-1]
        if name:
            self.vertices = self.spark.read.schema(self.vertices.schema).parquet(path)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def run(graph: PropertyGraph, program: VertexProgram, config: ExecutionConfig | None = None) -> tuple[DataFrame, ExecutionInfo]:
    """Vertices after an execution, and its report."""
    computation = Computation(graph, program, config)
    info = computation.execute()
    computation.close()
    return computation.vertices, info
