"""Text formats: integers, adjacency lists, edge lists, triples, links in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.graph import PropertyGraph


def _tokens(lines: DataFrame) -> DataFrame:
    """lines (value) with words: the parts between spaces and tabs; # starts a comment."""
    return lines.withColumn("words", F.filter(F.split(F.regexp_replace("value", "#.*", ""), r"[ \t\r]+"), lambda w: w != ""))


def read_ints(spark: SparkSession, path: str) -> DataFrame:
    """value: the non-negative integers of a text, separated by blanks, tabs or line ends; # starts a comment and ends a number. Anything else raises."""
    words = _tokens(spark.read.text(path)).select(F.explode("words").alias("w"))
    checked = F.when(F.col("w").rlike("^[0-9]+$"), F.col("w").cast("long"))
    return words.select(F.coalesce(checked, F.raise_error(F.concat(F.lit("not a number: "), F.col("w"))).cast("long")).alias("value"))


def read_adjacency(spark: SparkSession, path: str, lines_matter: bool = True) -> DataFrame:
    """id, targets: records `id n target1 ... targetn`.

    Usually one record stands on one line, and files are split freely. With lines_matter=False a record may run over lines: the
    numbers of a file then stay together in one task, as nothing in the text says where a record begins.
    """
    if lines_matter:
        words = _tokens(spark.read.text(path)).where(F.size("words") > 0).select(F.transform("words", lambda w: w.cast("long")).alias("n"))
        wrong = ~F.coalesce(F.size("n") == F.get("n", F.lit(1)) + 2, F.size("n") == 0)
        rows = words.select(F.when(wrong, F.raise_error(F.lit("a record is not as long as it says"))).otherwise(F.col("n")).alias("n"))
        return rows.where(F.size("n") > 0).select(F.get("n", F.lit(0)).alias("id"), F.slice("n", 3, F.size("n")).alias("targets"))

    def records(batches):
        import pandas as pd

        for b in batches:
            for text in b["value"]:
                numbers = iter([int(w) for line in text.split("\n") for w in line.partition("#")[0].split()])
                rows = [(i, [next(numbers) for _ in range(next(numbers))]) for i in numbers]
                yield pd.DataFrame({"id": [r[0] for r in rows], "targets": [r[1] for r in rows]})

    return spark.read.text(path, wholetext=True).mapInPandas(records, "id bigint, targets array<bigint>")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from lines of two integers, in any order; # starts a comment. A line with one number raises."""
    words = _tokens(spark.read.text(path)).where(F.size("words") > 0)
    both = F.when(F.size("words") >= 2, F.col("words")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), "value")).cast("array<string>"))
    return words.select(both[0].cast("long").alias("src"), both[1].cast("long").alias("dst"))


def grouped_by_source(edges: DataFrame) -> DataFrame:
    """id, targets of edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def adjacency_graph(lists: DataFrame) -> PropertyGraph:
    """A graph from (id, targets) rows; vertices are the ids and all their targets."""
    edges = lists.select(F.col("id").alias("src"), F.explode("targets").alias("dst"))
    vertices = lists.select("id").union(edges.select("dst")).distinct()
    return PropertyGraph.of(edges, vertices)


def read_triples(spark: SparkSession, path: str, prefix: str = "", separator: str = "\t") -> DataFrame:
    """src, predicate, dst of triples whose object starts with prefix; <>-brackets and the final dot are taken off."""
    parts = F.split("value", separator)
    clean = lambda i: F.regexp_replace(F.trim(parts[i]), r"^<|>?\s*\.?$", "")
    rows = spark.read.text(path).where(F.size(parts) >= 3).select(clean(0).alias("src"), clean(1).alias("predicate"), clean(2).alias("dst"))
    return rows.where(F.col("dst").startswith(prefix))


def neighbourhood(triples: DataFrame, seeds: list[str], depth: int) -> PropertyGraph:
    """The graph of triples (src, dst) within depth steps of the seeds: each level follows only the objects found last."""
    edges = triples.select("src", "dst").distinct()
    level = found = triples.sparkSession.createDataFrame([(s,) for s in seeds], "id string").distinct()
    taken = edges.where("false")
    for _ in range(depth):
        out = edges.join(level.withColumnRenamed("id", "src"), "src", "left_semi")
        taken = taken.union(out)
        level = out.select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti")
        found = found.union(level)
    return PropertyGraph.of(taken, found)


HREF = r"""<a\s[^>]*?href=["']?([^"'\s>]+)"""


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """src (the page), dst (the href): distinct links of pages; null pages have none."""
    hrefs = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1)))
    return pages.select(F.col(id_col).alias("src"), hrefs.alias("dst")).distinct()


def consecutive(rows: DataFrame, key: str, order: list[str], block: str) -> DataFrame:
    """Distinct (src, dst) of keys that follow one another in the order of all rows, without loops.

    block: an expression of which rows with smaller values come before rows with larger (a day of a time). Blocks are put in order each by
    itself, and joined end to start, so only one row a block meets in one task.
    """
    b = rows.withColumn("__block", F.expr(block))
    w = Window.partitionBy("__block").orderBy(*order)
    inside = b.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst IS NOT NULL")
    at = F.struct(*order)
    ends = b.groupBy("__block").agg(F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("__block")).alias("dst")).where("dst IS NOT NULL")
    return inside.union(across).where("src <> dst").distinct()


def crawl(pages: DataFrame, seeds: list[str], depth: int, url_col: str = "url", html_col: str = "html") -> PropertyGraph:
    """The link graph within depth clicks of the seed addresses: vertices are addresses, edges go from a page to the hrefs on it.

    pages stand for the web: an address without a page has no links. Each level joins only the addresses found last.
    """
    return neighbourhood(page_links(pages, url_col, html_col), seeds, depth)
