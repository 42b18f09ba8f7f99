import logging

import pytest

from weftgraph.algorithms.rank import pagerank_program
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig
from weftgraph.plans.engine import Computation
from weftgraph.plans.trace import top_activity, traced, verified
from weftgraph.sources.logs import JsonLines, read_logs
from weftgraph.sources.text import crawl


def test_traced_computation_and_activity(spark):
    said = []
    c = traced(Computation(PropertyGraph.of(spark.createDataFrame([(0, 1), (1, 0)], "src bigint, dst bigint")), pagerank_program(), ExecutionConfig(steps_limit=2)), said.append)
    info = c.execute()
    assert said[0].startswith("execute") and sum(s.startswith("step") for s in said) == 4
    assert len(top_activity(info, 1)) == 1 and info.metrics_frame(spark).count() == 2


def test_verified(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert verified(a, a.orderBy("x")).count() == 3
    with pytest.raises(AssertionError):
        verified(a, a.distinct())


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log.json")
    log = logging.Logger("tests")
    log.addHandler(JsonLines(path))
    for i in range(5):
        (log.warning if i % 2 else log.info)("message %d", i)
    assert read_logs(spark, path).count() == 5 and [r["message"] for r in read_logs(spark, path, "WARNING", most=1).collect()] == ["message 1"]


def test_crawl(spark):
    pages = spark.createDataFrame([("a", '<a href="b">'), ("b", '<a href="c"> <a href="a">'), ("c", '<a href="d">'), ("x", '<a href="a">')], "url string, html string")
    g = crawl(pages, ["a"], 2)
    assert sorted(r["id"] for r in g.vertices.collect()) == ["a", "b", "c"] and sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [("a", "b"), ("b", "a"), ("b", "c")]
