"""Look-ups in a graph: by id, substring, rank, score, and vicinity; induced sub-graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.aggregate import numeric_state, sample_ids
from weftgraph.operators.graph import PropertyGraph

#: Largest values that a request may ask for.
MOST_IDS, MOST_RADIUS = 1000, 4


def by_ids(vertices: DataFrame, names: list[str]) -> DataFrame:
    """Vertices whose id, as text, is one of names."""
    return vertices.where(F.col("id").cast("string").isin(list(names)))


def by_substring(vertices: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    found = vertices.where(F.col("id").cast("string").contains(part)).select("id")
    return found if limit is None else found.orderBy("id").limit(limit)


def top_degree(graph: PropertyGraph, n: int) -> DataFrame:
    """The n vertices with the largest out + in degree (a loop counts twice; a vertex without edges has 0)."""
    ends = graph.edges.select(F.col("src").alias("id")).union(graph.edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.select("id").join(ends, "id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(n)


def top_state(vertices: DataFrame, n: int, lowest: bool = False) -> DataFrame:
    """The n highest (lowest) numeric states."""
    rows = vertices.select("id", numeric_state().alias("state")).where("state IS NOT NULL")
    return rows.orderBy(F.asc("state") if lowest else F.desc("state"), "id").limit(n)


def above_threshold(vertices: DataFrame, score: Column, threshold: float, n: int) -> DataFrame:
    """The n highest scores strictly above the threshold."""
    return vertices.select("id", score.alias("score")).where(F.col("score") > threshold).orderBy(F.desc("score"), "id").limit(n)


def neighbours(graph: PropertyGraph, ids: DataFrame, incoming: bool = True) -> DataFrame:
    """ids' direct neighbours: targets, and sources too if incoming."""
    near = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    if incoming:
        near = near.union(graph.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src"))
    return near.distinct()


def vicinity(graph: PropertyGraph, ids: DataFrame, radius: int = 3, incoming: bool = False) -> DataFrame:
    """Ids within radius hops of ids, themselves included; each hop looks only at the last ring."""
    everything = ring = ids.select("id").distinct()
    for _ in range(radius):
        ring = neighbours(graph, ring, incoming).join(everything, "id", "left_anti")
        everything = everything.union(ring)
    return everything


def induced(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The vertices of ids and the edges between them."""
    ids = ids.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(graph.vertices.join(ids, "id", "left_semi"), edges.select(*graph.edges.columns))


def describe(graph: PropertyGraph, ids: DataFrame, score_signal: Callable[[], Column] | None = None, score_collect: Callable[[], Column] | None = None) -> DataFrame:
    """One row for each vertex of ids: state as text, its edges to others of ids, scores, and the least and greatest numeric state of all vertices."""
    sub = induced(graph, ids)
    v = sub.vertices
    edges = sub.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"), F.array_sort(F.collect_set("dst")).alias("targets"))
    span = graph.vertices.agg(F.min(numeric_state()).alias("lowest"), F.max(numeric_state()).alias("highest")).first()
    out = v.select(
        "id",
        F.col("state").cast("string").alias("state"),
        (score_signal() if score_signal else F.lit(None).cast("double")).alias("signal_score"),
        (score_collect() if score_collect else F.lit(None).cast("double")).alias("collect_score"),
        (F.col("vtype") if "vtype" in v.columns else F.lit(None).cast("string")).alias("vtype"),
    )
    out = out.join(edges, "id", "left").na.fill(0, ["n_edges"])
    return out.withColumns({c: F.lit(span[c]).cast("double") for c in ("lowest", "highest")})


def query(graph: PropertyGraph, kind: str, *, n: int = 5, threshold: float = 0.0, part: str = "", names: list[str] | None = None, score: Column | None = None, radius: int = 0, incoming: bool = False) -> DataFrame:
    """One request: ids of the kind asked for, with their vicinity of radius hops.

    kind: ids, substring, highest_state, lowest_state, highest_degree, above_score or sample. ValueError beyond MOST_IDS vertices or names, or MOST_RADIUS hops.
    """
    if n > MOST_IDS or len(names or ()) > MOST_IDS or radius > MOST_RADIUS:
        raise ValueError(f"a request may ask for {MOST_IDS} vertices and {MOST_RADIUS} hops at most")
    v = graph.vertices
    if kind == "ids":
        found = by_ids(v, names or [])
    elif kind == "substring":
        found = by_substring(v, part, n)
    elif kind in ("highest_state", "lowest_state"):
        found = top_state(v, n, kind == "lowest_state")
    elif kind == "highest_degree":
        found = top_degree(graph, n)
    elif kind == "above_score":
        if score is None:
            raise ValueError("above_score needs a score")
        found = above_threshold(v, score, threshold, n)
    elif kind == "sample":
        found = sample_ids(v, n)
    else:
        raise ValueError(f"unknown kind of request: {kind}")
    return vicinity(graph, found, radius, incoming) if radius else found.select("id")


def fetch_graph(graph: PropertyGraph, names: list[str], kind: str | None = None, *, radius: int = 0, incoming: bool = False, score_signal: Callable[[], Column] | None = None, score_collect: Callable[[], Column] | None = None, **request) -> DataFrame:
    """One request as a console makes it: the vertices of names and those a request finds, with their vicinity, described (see describe)."""
    found = by_ids(graph.vertices, names).select("id")
    if kind:
        found = found.union(query(graph, kind, **request)).distinct()
    near = vicinity(graph, found, radius, incoming) if radius else found
    return describe(graph, near, score_signal, score_collect)
