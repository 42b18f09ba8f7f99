import random

import pytest
from interp import supersteps
from pyspark.sql import functions as F

from weftgraph.algorithms import counting, delta_pagerank, pagerank, shortest_paths
from weftgraph.algorithms.linear import company_valuation
from weftgraph.algorithms.rank import pagerank_program
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig, Reason
from weftgraph.plans.engine import Computation, MissingVertexError, run
from weftgraph.plans.program import VertexProgram
from weftgraph.plans.session import Break, Session


def graph(spark, edges):
    if len(edges[0]) == 2:
        return PropertyGraph.of(spark.createDataFrame(edges, "src bigint, dst bigint"))
    return PropertyGraph.of(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"))


def circle(n):
    return [(i, i % n + 1) for i in range(1, n + 1)]


def states(result):
    return {r["id"]: r["state"] for r in result[0].select("id", "state").collect()}


STAR = [(0, 4), (1, 4), (2, 4), (3, 4)]
SYMMETRIC_STAR = STAR + [(b, a) for a, b in STAR]


def test_pagerank_of_a_cycle_is_one(spark):
    found = states(pagerank(graph(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]), ExecutionConfig(signal_threshold=0.001)))
    assert all(abs(s - 1) < 0.01 for s in found.values()) and len(found) == 5


def test_pagerank_of_a_star(spark):
    found = states(pagerank(graph(spark, STAR)))
    assert abs(found[4] - 0.66) < 1e-5 and all(abs(found[i] - 0.15) < 1e-5 for i in range(4))


def test_one_step_of_a_large_cycle_meets_the_steps_limit(spark):
    out, info = pagerank(graph(spark, circle(1000)), ExecutionConfig(signal_threshold=0.0, steps_limit=1))
    assert abs(out.where("id = 1").first()["state"] - 0.2775) < 1e-9
    assert info.reason is Reason.STEPS_LIMIT and info.steps == 1 and info.signal_operations == info.collect_operations == 1000


def test_global_constraint(spark):
    stop = lambda v: 20 < v.agg(F.sum("state")).first()[0] < 29
    _, info = pagerank(graph(spark, circle(30)), ExecutionConfig(signal_threshold=0.0, should_stop=stop))
    assert info.reason is Reason.GLOBAL_CONSTRAINT


def test_limits_hold_before_the_first_step(spark):
    assert pagerank(graph(spark, circle(3)), ExecutionConfig(time_limit_s=0))[1].reason is Reason.TIME_LIMIT
    assert pagerank(graph(spark, circle(3)), ExecutionConfig(steps_limit=0))[1].steps == 0


def test_counting(spark):
    out, _ = counting(graph(spark, circle(10)), 12)
    assert {tuple(r["state"]) for r in out.collect()} == {(12, 12)}


def test_sssp(spark):
    found = states(shortest_paths(graph(spark, [(1, 2), (2, 3), (3, 4), (1, 5), (4, 6), (5, 6)]), 1))
    assert found == {1: 0, 2: 1, 3: 2, 4: 3, 5: 1, 6: 2}
    assert states(shortest_paths(graph(spark, SYMMETRIC_STAR), 4)) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}
    assert states(shortest_paths(graph(spark, [(0, 1), (2, 0)]), 0)) == {0: 0, 1: 1, 2: None}


def test_delta_pagerank_has_the_same_fixpoint(spark):
    g = graph(spark, SYMMETRIC_STAR)
    a, b = states(pagerank(g, ExecutionConfig(signal_threshold=1e-4))), states(delta_pagerank(g, ExecutionConfig(signal_threshold=1e-4)))
    assert all(abs(a[v] - b[v]) < 5e-3 for v in a)


def test_company_valuation(spark):
    g = graph(spark, [(1, 2, 0.444), (2, 1, 0.15)])
    g = PropertyGraph(g.vertices.withColumn("core", F.when(F.col("id") == 1, 37.0).otherwise(14.0)), g.edges)
    found = states(company_valuation(g, ExecutionConfig(signal_threshold=1e-6)))
    n = (37 + 0.15 * 14) / (1 - 0.444 * 0.15)
    assert abs(found[1] - n) < 1e-3 and abs(found[2] - (14 + 0.444 * n)) < 1e-3


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("memory", ["latest", "inbox"])
def test_thresholded_pagerank_against_the_interpreter(spark, seed, memory):
    """Vertices below the threshold stay silent, and their stale signals stay in what others collect."""
    rng = random.Random(seed)
    edges = {(rng.randrange(12), rng.randrange(12)): float(rng.randint(1, 3)) for _ in range(40)}
    g = graph(spark, [(s, d, w) for (s, d), w in edges.items()])
    ids = {v for e in edges for v in e}
    wanted, _ = supersteps(ids, edges, initial=lambda v: 0.15, signal=lambda s, l, w, t, n: s * w / t, collect=lambda s, m: 0.15 + 0.85 * sum(m), score=lambda s, l, e: abs(s - l) if e else float("inf"), threshold=0.03, steps=7)
    program = pagerank_program()
    program = VertexProgram(**{**program.__dict__, "memory": memory})
    found = states(run(g, program, ExecutionConfig(signal_threshold=0.03, steps_limit=7)))
    assert found.keys() == wanted.keys() and all(abs(found[v] - wanted[v]) < 1e-9 for v in wanted)


def test_hubs_are_spread_without_changing_results(spark):
    edges = [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40)] + circle(39)
    a = states(pagerank(graph(spark, edges), ExecutionConfig(signal_threshold=0.0, steps_limit=3)))
    b = states(pagerank(graph(spark, edges), ExecutionConfig(signal_threshold=0.0, steps_limit=3, hub_edges=5)))
    assert all(abs(a[v] - b[v]) < 1e-12 for v in a)


def test_missing_target_policies(spark):
    g = graph(spark, [(1, 2), (2, 3)])
    g = PropertyGraph(g.vertices.where("id < 3"), g.edges)
    with pytest.raises(MissingVertexError):
        pagerank(g)
    assert set(states(pagerank(g, ExecutionConfig(on_missing_target="drop")))) == {1, 2}
    assert set(states(pagerank(g, ExecutionConfig(on_missing_target="create")))) == {1, 2, 3}


def test_only_changed_signals_go_out(spark):
    program = VertexProgram("int", lambda: F.lit(1), lambda: F.lit(7), {"n": lambda: F.count("signal")}, lambda: F.col("state") + F.col("n").cast("int"), memory="fold", only_on_change=True)
    out, info = run(graph(spark, [(1, 2), (2, 1)]), program, ExecutionConfig(steps_limit=5))
    assert states((out,)) == {1: 2, 2: 2} and info.reason is Reason.CONVERGED


def test_injected_messages_reset_and_recalculation(spark):
    program = VertexProgram("double", lambda: F.lit(0.0), lambda: F.col("src_state"), {"n": lambda: F.sum("signal")}, lambda: F.col("state") + F.col("n"), score_signal=lambda: F.col("state"), memory="fold", reset_state=lambda: F.lit(0.0))
    c = Computation(graph(spark, [(1, 2), (2, 3)]), program, ExecutionConfig(signal_threshold=0.5))
    assert c.execute().reason is Reason.CONVERGED
    c.send(spark.createDataFrame([(1, 5.0)], "dst bigint, signal double"))
    c.execute()
    assert states((c.vertices,)) == {1: 0.0, 2: 0.0, 3: 0.0}  # passed on and reset, as 3 has nowhere to send to and resets too
    c.change(PropertyGraph(c.vertices.withColumn("state", F.lit(2.0)), c.graph.edges))
    assert c.active == 0
    c.recalculate_scores()
    assert c.active == 3


def test_session_steps_breaks_and_resets(spark):
    s = Session(graph(spark, STAR), pagerank_program())
    assert s.step() == "signal" and s.step() == "collect"
    assert abs(s.vertices.where("id = 4").first()["state"] - 0.66) < 1e-9
    s.reset()
    assert s.vertices.where("id = 4").first()["state"] == pytest.approx(0.15)
    with pytest.raises(KeyError):
        s.add_break(Break("state_above", 99, 0.5))
    with pytest.raises(ValueError):
        s.add_break(Break("nonsense", 4))
    number = s.add_break(Break("state_above", 4, 0.5))
    assert s.run() == [number]
    s.remove_break(number)
    assert s.run() == [] and s.terminate().reason is Reason.CONVERGED
