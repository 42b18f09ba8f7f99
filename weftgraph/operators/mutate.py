"""Changes of a graph, with policies for what is there already or missing. Each is a join of the change with the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import PropertyGraph, one_each
from weftgraph.plans.durable import new_path


class MissingSourceError(Exception):
    """An edge starts at a vertex that doesn't exist."""


def _dirty(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """Queue the vertices (column id of ids) whose edges changed, if the graph has been under a program."""
    if "q_signal" not in vertices.columns:
        return vertices
    marked = vertices.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    flags = {f: F.col(f) | hit for f in ("edges_dirty_signal", "edges_dirty_collect", "q_signal")}
    return marked.withColumns(flags).drop("__hit")


def _like(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """rows with the columns of frame; working flags that they lack are those of a vertex just added."""
    new = {"ever_signalled": False, "q_signal": True, "q_collect": False, "edges_dirty_signal": False, "edges_dirty_collect": False}
    types = dict(frame.dtypes)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(new.get(c))).cast(types[c]).alias(c) for c in frame.columns])


def add_vertices(
    graph: PropertyGraph,
    rows: DataFrame,
    merge: dict[str, Callable[[], Column]] | None = None,
    order: Column | None = None,
    after_initialization: Callable[[DataFrame], None] | None = None,
) -> PropertyGraph:
    """Add rows (id and other columns). An id that exists stays as it is; of several new rows with an id the first by `order`, else the least one, is added.

    merge: instead, column name to an aggregate over all rows of the id (`old` says which is the graph's). after_initialization: called with the vertices that are new.
    """
    v = graph.vertices
    new = _like(rows, v)
    if merge:
        everything = v.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
        kept = [F.max_by(c, F.struct("old", F.hash(c))).alias(c) for c in v.columns if c != "id" and c not in merge]
        merged = everything.groupBy("id").agg(*[part().alias(c) for c, part in merge.items()], *kept)
        if after_initialization:
            after_initialization(merged.join(v.select("id"), "id", "left_anti").select(*v.columns))
        return PropertyGraph(merged.select(*v.columns), graph.edges)
    if order is not None:
        ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(order)))
        new = _like(ranked.where("__n = 1").drop("__n"), v)
    first = one_each(new, ["id"]).join(v.select("id"), "id", "left_anti").select(*v.columns)
    if after_initialization:
        after_initialization(first)
    return PropertyGraph(v.unionByName(first), graph.edges)


def add_edges(
    graph: PropertyGraph, rows: DataFrame, on_missing_source: str = "error", create: dict[str, Column] | None = None, on_attach: Callable[[DataFrame], None] | None = None
) -> PropertyGraph:
    """Add rows (src, dst, and weight or others). A (src, dst) that exists is left as it is; of several new ones the least is added. on_attach: called with the edges that are new.

    on_missing_source: error, ignore (the edge is dropped) or create (a vertex with the columns of create, or nulls).
    """
    v, e = graph.vertices, graph.edges
    new = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    types = dict(e.dtypes)
    new = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(types[c]).alias(c) for c in e.columns])
    new = one_each(new, ["src", "dst"]).join(e.select("src", "dst"), ["src", "dst"], "left_anti")
    missing = new.join(v.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("src").alias("id")).distinct()
    if on_missing_source == "error":
        first = missing.first()
        if first is not None:
            raise MissingSourceError(f"an edge starts at {first['id']}, which doesn't exist")
    elif on_missing_source == "ignore":
        new = new.join(v.select(F.col("id").alias("src")), "src", "left_semi")
    elif on_missing_source == "create":
        v = v.unionByName(_like(missing.withColumns(create or {}), v))
    else:
        raise ValueError(on_missing_source)
    if on_attach:
        on_attach(new.select(*e.columns))
    return PropertyGraph(_dirty(v, new.select(F.col("src").alias("id"))), e.unionByName(new.select(*e.columns)))


def remove_vertices(graph: PropertyGraph, ids: DataFrame, before_removal: Callable[[DataFrame], None] | None = None) -> PropertyGraph:
    """Remove the vertices of ids (column id) and their out-edges. Edges to them stay; ids that don't exist change nothing."""
    gone = ids.select("id").distinct()
    if before_removal:
        before_removal(graph.vertices.join(gone, "id", "left_semi"))
    return PropertyGraph(graph.vertices.join(gone, "id", "left_anti"), graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(*graph.edges.columns))


def remove_edges(graph: PropertyGraph, keys: DataFrame) -> PropertyGraph:
    """Remove the edges (src, dst) of keys; those that don't exist change nothing."""
    keys = keys.select("src", "dst").distinct()
    gone = graph.edges.join(keys, ["src", "dst"], "left_semi")
    left = graph.edges.join(keys, ["src", "dst"], "left_anti").select(*graph.edges.columns)
    return PropertyGraph(_dirty(graph.vertices, gone.select(F.col("src").alias("id"))), left)


def remove_all_edges(graph: PropertyGraph, ids: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """Remove all out-edges of ids; also a frame (id, removed) of how many each had."""
    gone = ids.select("id").distinct()
    removed = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("removed"))
    left = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(*graph.edges.columns)
    return PropertyGraph(_dirty(graph.vertices, gone), left), removed


def for_vertex(graph: PropertyGraph, vertex_id, changes: dict[str, Column]) -> PropertyGraph:
    """Set columns of one vertex, which must exist (KeyError); nothing is queued."""
    graph.vertex(vertex_id)
    hit = F.col("id") == F.lit(vertex_id)
    return PropertyGraph(graph.vertices.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in changes.items()}), graph.edges)


def for_each_vertex(
    graph: PropertyGraph,
    changes: dict[str, Column],
    new_edges: Callable[[DataFrame], DataFrame] | None = None,
    new_vertices: Callable[[DataFrame], DataFrame] | None = None,
    gone_edges: Callable[[DataFrame], DataFrame] | None = None,
    gone: Column | None = None,
    **policy,
) -> PropertyGraph:
    """Set columns of every vertex; nothing is queued by that. Then edit the graph as the vertices say: each part is a function of the vertices.

    In this order: new_vertices (rows with id), new_edges (src, dst, ...; policy says what a missing source does), gone_edges (src, dst), and vertices that `gone` holds for.
    """
    out = PropertyGraph(graph.vertices.withColumns(changes), graph.edges)
    v = out.vertices
    if new_vertices:
        out = add_vertices(out, new_vertices(v))
    if new_edges:
        out = add_edges(out, new_edges(v), **policy)
    if gone_edges:
        out = remove_edges(out, gone_edges(v))
    return out if gone is None else remove_vertices(out, v.where(gone))


def modify_graph(graph: PropertyGraph, functions: list[Callable[[PropertyGraph], PropertyGraph]], near: str | None = None, n: int | None = None) -> PropertyGraph:
    """A load as functions of the graph, applied in turn. near: a vertex column whose equal values the result keeps together, in n partitions."""
    for f in functions:
        graph = f(graph)
    if near is None:
        return graph
    v = graph.vertices.repartition(n, near) if n else graph.vertices.repartition(near)
    return PropertyGraph(v, graph.edges)


def load_iterator(graph: PropertyGraph, edits: Iterable[tuple], batch: int = 10_000) -> PropertyGraph:
    """A load as an iterator of ("vertex", id) and ("edge", src, dst, weight) on the driver; `batch` of them are held at a time and written to the shared folder.

    Vertices come before edges, whatever their order in the iterator.
    """
    spark, paths = graph.edges.sparkSession, {"vertex": new_path(graph.edges.sparkSession, "loaded"), "edge": new_path(graph.edges.sparkSession, "loaded")}
    types = dict(graph.edges.dtypes)
    schemas = {"vertex": f"id {types['src']}", "edge": f"src {types['src']}, dst {types['dst']}, weight double"}
    for kind, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(paths[kind])
    source = iter(edits)
    while part := list(islice(source, batch)):
        for kind, schema in schemas.items():
            if rows := [e[1:] for e in part if e[0] == kind]:
                spark.createDataFrame(rows, schema).write.mode("append").parquet(paths[kind])
    loaded = {kind: spark.read.schema(schema).parquet(paths[kind]) for kind, schema in schemas.items()}
    return add_edges(add_vertices(graph, loaded["vertex"]), loaded["edge"])


def changes(before: PropertyGraph, after: PropertyGraph) -> dict[str, int]:
    """How many vertices and edges were added and removed."""

    def n(a: DataFrame, b: DataFrame, key: list[str]) -> int:
        return a.select(*key).join(b.select(*key), key, "left_anti").count()

    return {
        "vertices_added": n(after.vertices, before.vertices, ["id"]),
        "vertices_removed": n(before.vertices, after.vertices, ["id"]),
        "edges_added": n(after.edges, before.edges, ["src", "dst"]),
        "edges_removed": n(before.edges, after.edges, ["src", "dst"]),
    }
