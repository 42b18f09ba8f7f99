"""Snapshots of a graph as Parquet. What waits (queued vertices, messages) isn't part of one."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.durable import delete
from weftgraph.plans.engine import FLAGS


def save(graph: PropertyGraph, path: str) -> None:
    graph.vertices.drop(*FLAGS, "last_signal_state", "shares").write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def restore(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph as saved; under a program its vertices are as if just added, with the states they had."""
    return PropertyGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a snapshot; nothing if there is none."""
    delete(spark, path)
