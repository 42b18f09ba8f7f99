"""Connected components over links of any number, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import remove_dir, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node links its larger (large) or its smaller-or-equal neighbours to the smallest of its neighbourhood."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (two columns of longs) to rows (node, component): the smallest node reachable, for each node with a link.

    Each round writes its links to the shared folder, so lineage stays short and lost executors cost one round. The
    driver sees two numbers a round. Rounds grow with the logarithm of the longest chain; RuntimeError beyond most_rounds.
    """
    a, b = links.columns
    edges, path = store(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "star")
    before = None
    for _ in range(most_rounds):
        stepped, stepped_path = store(_star(_star(edges, True), False), "star")
        now = tuple(stepped.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        remove_dir(edges.sparkSession, path)
        edges, path = stepped, stepped_path
        if now == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
