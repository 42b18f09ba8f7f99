"""Aggregations over all vertices. Spark combines them partially on the executors, then once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(vertices: DataFrame, **parts: Column) -> DataFrame:
    """Any number of named aggregates in one pass."""
    return vertices.agg(*[c.alias(n) for n, c in parts.items()])


def of_type(vertices: DataFrame, vtype: str | None) -> DataFrame:
    return vertices if vtype is None else vertices.where(F.col("vtype") == vtype)


def sum_of_states(vertices: DataFrame, vtype: str | None = None) -> DataFrame:
    """sum_state; null without vertices or states."""
    return of_type(vertices, vtype).agg(F.sum("state").alias("sum_state"))


def product_of_states(vertices: DataFrame, vtype: str | None = None) -> DataFrame:
    return of_type(vertices, vtype).agg(F.product("state").alias("product_state"))


def reduce_states(vertices: DataFrame, part: Column, neutral=None) -> DataFrame:
    """Any reduction of the states that aren't null; neutral without any."""
    return vertices.where("state IS NOT NULL").agg(F.coalesce(part, F.lit(neutral)).alias("reduced"))


def numeric_state(column: str = "state", neutral: float | None = None) -> Column:
    """A state as a double; neutral where it isn't a number."""
    return F.coalesce(F.col(column).cast("string").try_cast("double"), F.lit(neutral).cast("double"))


def count_vertices(vertices: DataFrame, vtype: str | None = None) -> DataFrame:
    return of_type(vertices, vtype).agg(F.count(F.lit(1)).alias("n"))


def count_by_type(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("vtype").agg(F.count(F.lit(1)).alias("n"))


def id_states(vertices: DataFrame) -> DataFrame:
    """id and state as rows: the map of the whole graph, which doesn't go to the driver."""
    return vertices.select("id", "state")


def sample_ids(vertices: DataFrame, n: int) -> DataFrame:
    """At most n ids, the same ones for the same graph: those of the least hashes."""
    return vertices.select("id").orderBy(F.xxhash64("id"), "id").limit(n)


def top_k(vertices: DataFrame, k: int, by: Column | None = None, largest: bool = True) -> DataFrame:
    """The k rows (id, state) with the largest (or smallest) value, ties by id."""
    value = F.col("state") if by is None else by
    rows = vertices.select("id", "state", value.alias("__by")).where("__by IS NOT NULL")
    return rows.orderBy(F.desc("__by") if largest else F.asc("__by"), "id").limit(k).drop("__by")


def all_hold(vertices: DataFrame, predicate: Column) -> bool:
    """Whether the predicate holds for every vertex (so for none at all)."""
    return bool(vertices.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias("ok")).first()["ok"])


def map_reduce(vertices: DataFrame, mapped: Column, reduce: Callable[[Column], Column], neutral=None) -> DataFrame:
    """A column of each vertex, then an aggregate of it; vertices without a value don't count."""
    return vertices.select(mapped.alias("m")).where("m IS NOT NULL").agg(F.coalesce(reduce(F.col("m")), F.lit(neutral)).alias("reduced"))


@dataclass(frozen=True)
class Aggregation:
    """An aggregation of one's own in two halves. extract: a column of each vertex (null: it doesn't count). worker: named aggregates of that column `x`, which Spark
    combines on the executors first. final: a column of the worker's names. neutral: the result without any vertex that counts."""

    extract: Callable[[], Column]
    worker: dict[str, Callable[[], Column]]
    final: Callable[[], Column]
    neutral: object = None

    def over(self, vertices: DataFrame) -> DataFrame:
        """One row, column `result`."""
        halves = vertices.select(self.extract().alias("x")).where("x IS NOT NULL").agg(F.count(F.lit(1)).alias("__n"), *[part().alias(name) for name, part in self.worker.items()])
        return halves.select(F.when(F.col("__n") > 0, self.final()).otherwise(F.lit(self.neutral)).alias("result"))
