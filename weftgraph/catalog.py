"""Registered queries of the graph engine over the tables of a folder, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import algorithms as A
from weftgraph.algorithms import linear, rank
from weftgraph.algorithms import sudoku as S
from weftgraph.algorithms.paths import Any, Fixed, Star, path_pattern
from weftgraph.operators import aggregate as agg
from weftgraph.operators import mutate, query
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig
from weftgraph.plans.durable import new_path, write_table
from weftgraph.plans.engine import Computation, run
from weftgraph.sources import snapshot, text

EXACT = ExecutionConfig(signal_threshold=0.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# graphs


def trade(spark: SparkSession, d: str) -> PropertyGraph:
    """Customers and suppliers (as -key - 1) that trade, both ways."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("c"), (-F.col("l_suppkey") - 1).alias("s")).distinct()
    edges = pairs.select(F.col("c").alias("src"), F.col("s").alias("dst")).union(pairs.select("s", "c")).withColumn("weight", F.lit(1.0))
    return PropertyGraph(edges.select(F.col("src").alias("id")).distinct(), edges)


def copart(spark: SparkSession, d: str) -> PropertyGraph:
    """Suppliers (as -key - 1) and the parts they sell, both ways."""
    pairs = table(spark, d, "lineitem").select((-F.col("l_suppkey") - 1).alias("s"), F.col("l_partkey").alias("p")).distinct()
    edges = pairs.select(F.col("s").alias("src"), F.col("p").alias("dst")).union(pairs.select("p", "s")).withColumn("weight", F.lit(1.0))
    return PropertyGraph(edges.select(F.col("src").alias("id")).distinct(), edges)


def flow(spark: SparkSession, d: str) -> PropertyGraph:
    """Users that follow one another in the order of events."""
    edges = text.consecutive(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "date_trunc('day', ts)")
    edges, _ = write_table(edges.select("src", "dst", (1 + (F.col("src") + F.col("dst")) % 5).cast("double").alias("weight")), "flow")
    return PropertyGraph.of(edges)


def geo(spark: SparkSession, d: str) -> PropertyGraph:
    """Regions, nations (100 +), customers (1000 +) and suppliers (-key - 1): parent to child; a customer's or supplier's state is its balance."""
    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    of = lambda i, kind, state: [i.cast("long").alias("id"), F.lit(kind).alias("vtype"), state.cast("double").alias("state")]
    v = r.select(*of(F.col("r_regionkey"), "region", F.lit(None))).union(n.select(*of(100 + F.col("n_nationkey"), "nation", F.lit(None))))
    v = v.union(c.select(*of(1000 + F.col("c_custkey"), "customer", F.col("c_acctbal")))).union(s.select(*of(-F.col("s_suppkey") - 1, "supplier", F.col("s_acctbal"))))
    e = n.select(F.col("n_regionkey").cast("long").alias("src"), (100 + F.col("n_nationkey")).cast("long").alias("dst"))
    e = e.union(c.select((100 + F.col("c_nationkey")).cast("long"), 1000 + F.col("c_custkey"))).union(s.select((100 + F.col("s_nationkey")).cast("long"), -F.col("s_suppkey") - 1))
    return PropertyGraph(v, e.withColumn("weight", F.lit(1.0)))


def links(spark: SparkSession, d: str) -> PropertyGraph:
    e = text.page_links(table(spark, d, "pages")).select(F.concat(F.lit("page:"), "src").alias("src"), "dst", F.lit(1.0).alias("weight"))
    return PropertyGraph.of(e)


def same_text(spark: SparkSession, d: str) -> PropertyGraph:
    """Documents, linked to the least one with the same text."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    e = docs.join(least, "h").where("doc_id <> src").select("src", F.col("doc_id").alias("dst"), F.lit(1.0).alias("weight"))
    return PropertyGraph(docs.select(F.col("doc_id").alias("id")), e)


TRADE = """pairs AS (SELECT DISTINCT o_custkey AS c, -l_suppkey - 1 AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT c AS src, s AS dst FROM pairs UNION ALL SELECT s, c FROM pairs), v AS (SELECT DISTINCT src AS id FROM e),
deg AS (SELECT src, count(*) AS n FROM e GROUP BY src)"""
COPART = TRADE.replace("o_custkey AS c, -l_suppkey - 1 AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "l_partkey AS c, -l_suppkey - 1 AS s FROM lineitem")
FLOW = """follows AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst, (1 + (src + dst) % 5)::DOUBLE AS weight FROM follows WHERE dst IS NOT NULL AND src <> dst),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), deg AS (SELECT src, count(*) AS n, sum(weight) AS w FROM e GROUP BY src)"""
GEO = """v AS (SELECT r_regionkey::BIGINT AS id, 'region' AS vtype, NULL::DOUBLE AS state FROM region UNION ALL SELECT 100 + n_nationkey, 'nation', NULL FROM nation
UNION ALL SELECT 1000 + c_custkey, 'customer', c_acctbal FROM customer UNION ALL SELECT -s_suppkey - 1, 'supplier', s_acctbal FROM supplier),
e AS (SELECT n_regionkey::BIGINT AS src, (100 + n_nationkey)::BIGINT AS dst FROM nation UNION ALL SELECT 100 + c_nationkey, 1000 + c_custkey FROM customer
UNION ALL SELECT 100 + s_nationkey, -s_suppkey - 1 FROM supplier)"""
HREFS = """h AS (SELECT DISTINCT 'page:' || page_id AS src, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=["'']?([^"''\\s>]+)', 1)) AS dst FROM pages),
e AS (SELECT DISTINCT src, dst FROM h), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), deg AS (SELECT src, count(*) AS n FROM e GROUP BY src)"""


def rank_sql(graph: str, steps: int, tail: str) -> str:
    parts = [graph, "s0 AS (SELECT id, 0.15::DOUBLE AS s FROM v)"]
    for k in range(1, steps + 1):
        parts.append(f"m{k} AS (SELECT e.dst AS id, sum(s.s / deg.n) AS t FROM e JOIN s{k - 1} s ON s.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst)")
        parts.append(f"s{k} AS (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(t, 0) AS s FROM v LEFT JOIN m{k} ON m{k}.id = v.id)")
    return f"WITH {', '.join(parts)} {tail.format(last=f's{steps}')}"


RANKS = "SELECT id, round(s, 6) AS rank FROM {last}"


def ranks(result) -> DataFrame:
    return result[0].select("id", F.round("state", 6).alias("rank"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top_k(A.pagerank(trade(spark, sf_dir), EXACT.with_(steps_limit=5))[0], 10)


# ranking and paths


@registered(rank_sql(TRADE, 5, RANKS))
def pagerank_k5(spark, d):
    return ranks(A.pagerank(trade(spark, d), EXACT.with_(steps_limit=5)))


@registered(rank_sql(COPART, 4, RANKS))
def delta_pagerank_k4(spark, d):
    return ranks(A.delta_pagerank(copart(spark, d), EXACT.with_(signal_threshold=-1e300, steps_limit=4)))


@registered(rank_sql(TRADE, 5, "SELECT id, round(s, 6) AS rank FROM {last} ORDER BY round(s, 6) DESC, id LIMIT 20"))
def pagerank_top20(spark, d):
    out = A.pagerank(trade(spark, d), EXACT.with_(steps_limit=5))[0]
    return agg.top_k(out.select("id", F.round("state", 6).alias("state")), 20).withColumnRenamed("state", "rank")


@registered(rank_sql(HREFS, 3, RANKS))
def crawl_pagerank(spark, d):
    return ranks(A.pagerank(links(spark, d), EXACT.with_(steps_limit=3)))


@registered(f"WITH {HREFS} SELECT src, dst FROM e")
def href_extract(spark, d):
    return links(spark, d).edges.select("src", "dst")


def distance_sql(step: str, most: int) -> str:
    return f"""WITH RECURSIVE {FLOW}, d(id, dist) AS (SELECT min(id), 0 FROM v UNION SELECT e.dst, (d.dist + {step})::INT FROM d JOIN e ON e.src = d.id WHERE d.dist + {step} <= {most})
SELECT v.id, min(d.dist)::INT AS distance FROM v LEFT JOIN d ON d.id = v.id GROUP BY v.id"""


def distances(spark, d, weighted):
    g = flow(spark, d)
    source = g.vertices.agg(F.min("id")).first()[0]
    return A.shortest_paths(g, source, EXACT, weighted)[0].select("id", F.col("state").alias("distance"))


@registered(distance_sql("e.weight", 60))
def sssp_weighted(spark, d):
    return distances(spark, d, True)


@registered(distance_sql("1", 30))
def sssp_hops(spark, d):
    return distances(spark, d, False)


@registered(f"SELECT * FROM ({distance_sql('1', 30)}) WHERE distance IS NOT NULL ORDER BY distance, id LIMIT 50")
def nearest_50(spark, d):
    near = distances(spark, d, False).withColumnRenamed("distance", "state")
    return agg.top_k(near, 50, largest=False).withColumnRenamed("state", "distance")


# look-ups


@registered(f"WITH {FLOW} SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM v LEFT JOIN deg o ON o.src = v.id LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = v.id")
def out_in_degree(spark, d):
    return flow(spark, d).degrees()


@registered(f"WITH {TRADE} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 25")
def top_degree(spark, d):
    return query.top_degree(trade(spark, d), 25)


@registered(f"WITH {GEO} SELECT id, state FROM v WHERE state IS NOT NULL ORDER BY state DESC, id LIMIT 15")
def top_state(spark, d):
    return query.top_state(geo(spark, d).vertices, 15)


@registered(f"WITH {GEO} SELECT id, state FROM v WHERE state IS NOT NULL ORDER BY state, id LIMIT 15")
def bottom_state(spark, d):
    return query.top_state(geo(spark, d).vertices, 15, lowest=True)


@registered(f"WITH {GEO} SELECT id, state FROM v WHERE state IS NOT NULL ORDER BY state DESC, id LIMIT 12")
def top_k_states(spark, d):
    return agg.top_k(geo(spark, d).vertices, 12)


@registered(f"WITH {GEO} SELECT id, state AS score FROM v WHERE state > 5000 ORDER BY score DESC, id LIMIT 40")
def above_signal_threshold(spark, d):
    return query.above_threshold(geo(spark, d).vertices, F.col("state"), 5000.0, 40)


@registered(f"WITH {GEO} SELECT id FROM v WHERE contains(id::VARCHAR, '17')")
def substring_ids(spark, d):
    return query.by_substring(geo(spark, d).vertices, "17")


@registered(f"WITH {GEO} SELECT id, vtype FROM v WHERE id::VARCHAR IN ('1', '101', '1005', '-3', 'none')")
def vertices_by_ids(spark, d):
    return query.by_ids(geo(spark, d).vertices, ["1", "101", "1005", "-3", "none"]).select("id", "vtype")


@registered(f"WITH {GEO} SELECT least(30, count(*)) AS n, least(30, count(*)) AS n_valid, least(30, count(*)) AS n_distinct FROM v")
def sample_ids_hash(spark, d):
    v = geo(spark, d).vertices
    return agg.sample_ids(v, 30).join(v.select("id", F.lit(1).alias("there")), "id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("n_valid"), F.count_distinct("id").alias("n_distinct"))


SEEDS = "SELECT id FROM v WHERE id IN (SELECT id FROM v ORDER BY id LIMIT 2)"


def seeds(g: PropertyGraph) -> DataFrame:
    return g.vertices.select("id").orderBy("id").limit(2)


def ring_sql(both: bool) -> str:
    e = "SELECT src, dst FROM e UNION SELECT dst, src FROM e" if both else "SELECT src, dst FROM e"
    return f"""WITH {FLOW}, b AS ({e}), r0 AS ({SEEDS}), r1 AS (SELECT id FROM r0 UNION SELECT dst FROM b JOIN r0 ON b.src = r0.id), r2 AS (SELECT id FROM r1 UNION SELECT dst FROM b JOIN r1 ON b.src = r1.id)
SELECT id FROM r2"""


@registered(ring_sql(False))
def vicinity_out_2(spark, d):
    g = flow(spark, d)
    return query.vicinity(g, seeds(g), 2)


@registered(ring_sql(True))
def vicinity_both_2(spark, d):
    g = flow(spark, d)
    return query.vicinity(g, seeds(g), 2, incoming=True)


@registered(f"WITH {FLOW}, s AS (SELECT id FROM v ORDER BY id LIMIT 20) SELECT s.id, count(e.dst) AS n_edges, (s.id % 7)::VARCHAR || '.0' AS state, (s.id % 3)::DOUBLE AS signal_score, (SELECT min(id % 7) FROM v)::DOUBLE AS lowest, (SELECT max(id % 7) FROM v)::DOUBLE AS highest FROM s LEFT JOIN (SELECT * FROM e WHERE dst IN (SELECT id FROM s)) e ON e.src = s.id GROUP BY s.id")
def induced_subgraph(spark, d):
    g = flow(spark, d)
    g = PropertyGraph(g.vertices.withColumn("state", (F.col("id") % 7).cast("double")), g.edges)
    found = query.describe(g, g.vertices.select("id").orderBy("id").limit(20), score_signal=lambda: (F.col("id") % 3).cast("double"))
    return found.select("id", "n_edges", "state", "signal_score", "lowest", "highest")


# aggregations


@registered(f"WITH {GEO} SELECT round(sum(state), 4) AS sum_state FROM v WHERE vtype = 'customer'")
def sum_states(spark, d):
    return agg.sum_of_states(geo(spark, d).vertices, "customer").select(F.round("sum_state", 4).alias("sum_state"))


@registered(f"WITH {GEO} SELECT round(product(1 + state / 1000000), 6) AS product_state FROM v WHERE vtype = 'supplier'")
def product_states(spark, d):
    v = geo(spark, d).vertices.withColumn("state", 1 + F.col("state") / 1000000)
    return agg.product_of_states(v, "supplier").select(F.round("product_state", 6).alias("product_state"))


@registered(f"WITH {GEO} SELECT vtype, count(*) AS n FROM v GROUP BY vtype")
def count_by_vtype(spark, d):
    return agg.count_by_type(geo(spark, d).vertices)


@registered(f"WITH {GEO} SELECT round(sum(state), 4) AS total, max(state) AS highest, min(state) AS lowest, count(*) AS n, count(state) AS n_states FROM v")
def multi_agg(spark, d):
    v = geo(spark, d).vertices
    return agg.aggregate(v, total=F.round(F.sum("state"), 4), highest=F.max("state"), lowest=F.min("state"), n=F.count(F.lit(1)), n_states=F.count("state"))


@registered(f"WITH {GEO} SELECT id, state FROM v")
def id_state_map(spark, d):
    return agg.id_states(geo(spark, d).vertices)


@registered(f"WITH {GEO} SELECT max(length(vtype)) AS reduced FROM v")
def map_reduce(spark, d):
    return agg.map_reduce(geo(spark, d).vertices, F.length("vtype"), F.max, 0).select(F.col("reduced").cast("long").alias("reduced"))


# clusters


@registered(
    f"""WITH {FLOW}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT src AS id, count(*) AS k FROM s GROUP BY src),
t AS (SELECT a.dst AS id, count(*) AS n FROM s a JOIN s b ON a.dst = b.src JOIN s c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.dst GROUP BY a.dst)
SELECT v.id, round(coalesce(t.n, 0) / (k.k * (k.k - 1)), 6) AS coefficient FROM v JOIN k ON k.id = v.id LEFT JOIN t ON t.id = v.id"""
)
def clustering_coefficient(spark, d):
    return A.clustering_coefficient(flow(spark, d).symmetric()).select("id", F.round("coefficient", 6).alias("coefficient"))


@registered("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def components_min_label(spark, d):
    return A.components(same_text(spark, d), EXACT)[0].select("id", F.col("state").alias("component"))


@registered(
    f"""WITH {GEO}, r AS (SELECT r_regionkey::BIGINT AS id, r_regionkey AS r FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation
UNION ALL SELECT 1000 + c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT -s_suppkey - 1, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id, min(id) OVER (PARTITION BY r) AS component FROM r"""
)
def components_geo(spark, d):
    g = geo(spark, d)
    return A.components(PropertyGraph(g.vertices.select("id"), g.edges), EXACT)[0].select("id", F.col("state").alias("component"))


def label_sql(steps: int) -> str:
    parts = [FLOW, "s0 AS (SELECT id, id AS l FROM v)", "own AS (SELECT src, dst, weight FROM e UNION ALL SELECT id, id, 1 FROM v)"]
    for k in range(1, steps + 1):
        parts.append(f"w{k} AS (SELECT dst, l, sum(weight) AS w FROM own JOIN s{k - 1} s ON s.id = own.src GROUP BY dst, l)")
        parts.append(f"s{k} AS (SELECT dst AS id, l FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, l) AS n FROM w{k}) WHERE n = 1)")
    return f"WITH {', '.join(parts)} SELECT id, l AS label FROM s{steps}"


@registered(label_sql(3))
def label_clustering_k3(spark, d):
    return A.label_clustering(flow(spark, d), EXACT.with_(steps_limit=3))[0].select("id", F.col("state").alias("label"))


# mutation


@registered(f"WITH {FLOW} SELECT id, 1.0::DOUBLE AS state FROM v UNION ALL SELECT max(id) + 1, 2.0 FROM v")
def add_vertices_keep_first(spark, d):
    g = flow(spark, d)
    g = PropertyGraph(g.vertices.withColumn("state", F.lit(1.0)), g.edges)
    top = g.vertices.agg(F.max("id").alias("id"))
    new = top.select((F.col("id") + 1).alias("id"), F.lit(2.0).alias("state")).union(top.select((F.col("id") + 1).alias("id"), F.lit(2.0).alias("state"))).union(top.select("id", F.lit(9.0).alias("state")))
    return mutate.add_vertices(g, new).vertices.select("id", "state")


@registered(f"WITH {FLOW} SELECT id, CASE WHEN id = (SELECT max(id) FROM v) THEN 10.0 ELSE 1.0 END::DOUBLE AS state FROM v UNION ALL SELECT max(id) + 1, 4.0 FROM v")
def add_vertices_merge(spark, d):
    g = flow(spark, d)
    g = PropertyGraph(g.vertices.withColumn("state", F.lit(1.0)), g.edges)
    top = g.vertices.agg(F.max("id").alias("id"))
    new = top.select((F.col("id") + 1).alias("id"), F.lit(2.0).alias("state"))
    new = new.union(new).union(top.select("id", F.lit(9.0).alias("state")))
    return mutate.add_vertices(g, new, merge={"state": lambda: F.sum("state")}).vertices.select("id", "state")


@registered(f"WITH {FLOW} SELECT src, dst, weight FROM e UNION ALL (SELECT id, id, 7.0 FROM v)")
def add_edges_dedupe(spark, d):
    g = flow(spark, d)
    loops = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(7.0).alias("weight"))
    again = g.edges.select("src", "dst", F.lit(99.0).alias("weight"))
    return mutate.add_edges(g, loops.union(again)).edges.select("src", "dst", "weight")


@registered(f"WITH {FLOW} SELECT src, dst FROM e WHERE src % 3 <> 0")
def remove_vertices(spark, d):
    g = flow(spark, d)
    return mutate.remove_vertices(g, g.vertices.where("id % 3 = 0")).edges.select("src", "dst")


@registered(f"WITH {FLOW} SELECT src, dst FROM e WHERE (src + dst) % 4 <> 0")
def remove_edges(spark, d):
    g = flow(spark, d)
    return mutate.remove_edges(g, g.edges.where("(src + dst) % 4 = 0")).edges.select("src", "dst")


@registered(f"WITH {FLOW} SELECT id FROM v UNION SELECT id + 1000000 FROM v")
def missing_source_create(spark, d):
    g = flow(spark, d)
    return mutate.add_edges(g, g.vertices.select((F.col("id") + 1000000).alias("src"), F.col("id").alias("dst")), on_missing_source="create").vertices.select("id")


@registered(f"WITH {FLOW}, kept AS (SELECT id FROM v WHERE id % 3 <> 0) SELECT k.id, count(e.src) AS heard FROM kept k LEFT JOIN (SELECT * FROM e WHERE src % 3 <> 0) e ON e.dst = k.id GROUP BY k.id")
def undeliverable_drop(spark, d):
    g = flow(spark, d)
    g = mutate.remove_vertices(g, g.vertices.where("id % 3 = 0"))
    out, _ = run(g, linear.counting_program(), EXACT.with_(steps_limit=1, on_missing_target="drop"))
    return out.select("id", F.col("state.signals").alias("heard"))


# cells, linear systems, counters


def grid_sql(steps: int, n: int, seed: str, step: str, offsets: str) -> str:
    parts = [f"c AS (SELECT i AS id, i % {n} AS x, i // {n} AS y FROM range({n * n}) t(i))", f"o AS (SELECT * FROM (VALUES {offsets}) o(dx, dy))"]
    parts += ["e AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN o ON true JOIN c b ON b.x = a.x + dx AND b.y = a.y + dy)", f"s0 AS (SELECT id, ({seed})::INT AS s FROM c)"]
    for k in range(1, steps + 1):
        parts.append(f"m{k} AS (SELECT e.dst AS id, sum(s) AS ones, count(*) AS heard FROM e JOIN s{k - 1} s ON s.id = e.src GROUP BY e.dst)")
        parts.append(f"s{k} AS (SELECT s.id, ({step})::INT AS s FROM s{k - 1} s JOIN m{k} m ON m.id = s.id)")
    return f"WITH {', '.join(parts)} SELECT id, s AS state FROM s{steps}"


EIGHT = "(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)"
SEED = "(id * 7919 + id * id * 31) % 5 < 2"


@registered(grid_sql(4, 40, SEED, "CASE WHEN ones = 3 THEN 1 WHEN ones = 2 THEN s ELSE 0 END", EIGHT))
def game_of_life_k4(spark, d):
    out, _ = A.game_of_life(A.grid_graph(spark, 40, 40), F.expr(f"int({SEED})"), 4)
    return out.select("id", "state")


@registered(grid_sql(3, 40, SEED, "CASE WHEN (CASE WHEN s = 1 THEN ones ELSE heard - ones END) / heard < 0.45 THEN 1 - s ELSE s END", EIGHT))
def schelling_k3(spark, d):
    out, _ = A.schelling(A.grid_graph(spark, 40, 40), F.expr(f"int({SEED})"), 3)
    return out.select("id", "state")


@registered("SELECT id, 6::BIGINT AS signals, 6::BIGINT AS collects FROM range(1, 11) t(id)")
def sync_counting(spark, d):
    cycle = spark.range(1, 11).select(F.col("id").alias("src"), (F.col("id") % 10 + 1).alias("dst"))
    return A.counting(PropertyGraph.of(cycle), 6)[0].select("id", "state.signals", "state.collects")


def valuation_sql(steps: int) -> str:
    parts = [FLOW, "c AS (SELECT id, (10 + id % 7)::DOUBLE AS core FROM v)", "w AS (SELECT e.src, e.dst, e.weight / (2 * i.w) AS share FROM e JOIN (SELECT dst, sum(weight) AS w FROM e GROUP BY dst) i ON i.dst = e.dst)", "s0 AS (SELECT id, core AS s FROM c)"]
    for k in range(1, steps + 1):
        parts.append(f"s{k} AS (SELECT c.id, c.core + coalesce(m.t, 0) AS s FROM c LEFT JOIN (SELECT w.dst, sum(w.share * s.s) AS t FROM w JOIN s{k - 1} s ON s.id = w.src GROUP BY w.dst) m ON m.dst = c.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(s, 6) AS worth FROM s{steps}"


@registered(valuation_sql(4))
def company_valuation(spark, d):
    g = flow(spark, d)
    into = g.edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    e = g.edges.join(into, "dst").select("src", "dst", (F.col("weight") / (2 * F.col("into"))).alias("weight"))
    v = g.vertices.withColumn("core", (10 + F.col("id") % 7).cast("double"))
    return A.company_valuation(PropertyGraph(v, e), EXACT.with_(steps_limit=4))[0].select("id", F.round("state", 6).alias("worth"))


# patterns and search


@registered(
    f"""WITH {GEO} SELECT '100' AS nation, s.dst AS supplier FROM e s WHERE s.src = 100 AND s.dst < 0
UNION ALL SELECT '101', s.dst FROM e s WHERE s.src = 101 AND s.dst < 0"""
)
def path_pattern_geo(spark, d):
    g = geo(spark, d)
    supplier = Any(lambda: F.col("vtype") == "supplier")
    region = {n: (g.edges.where(F.col("dst") == n).first() or {"src": -1})["src"] for n in (100, 101)}
    found = [path_pattern(g, region[n], [Fixed(n), Star(2, lambda: F.col("vtype") == "customer"), supplier]) for n in (100, 101)]
    return found[0].union(found[1]).select(F.col("path")[0].cast("string").alias("nation"), F.col("path")[1].alias("supplier"))


PATH6 = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 2), (2, 5)]


@registered(
    f"""WITH RECURSIVE e(src, dst) AS (VALUES {', '.join(map(str, PATH6))}), w(place, n, path) AS (SELECT 0, 0, '' UNION ALL SELECT dst, n + 1, path || ',' || dst FROM w JOIN e ON e.src = w.place WHERE n < 4)
SELECT DISTINCT path FROM w WHERE place = 2 AND n >= 1"""
)
def path_pattern_star(spark, d):
    g = PropertyGraph.of(spark.createDataFrame(PATH6, "src bigint, dst bigint"))
    return path_pattern(g, 0, [Star(3), Fixed(2)]).select(F.concat(F.lit(","), F.concat_ws(",", F.transform("path", lambda x: x.cast("string")))).alias("path"))


HAMILTON = [("a", "d", 3), ("a", "b", 1), ("d", "b", 2), ("d", "c", 1), ("b", "c", 1), ("e", "a", 1)]
BOTH_WAYS = HAMILTON + [(b, a, w) for a, b, w in HAMILTON]


@registered(
    f"""WITH RECURSIVE e(src, dst, w) AS (VALUES {', '.join(map(str, BOTH_WAYS))}), v AS (SELECT DISTINCT src AS id FROM e),
p(id, path, cost) AS (SELECT id, [id], 0 FROM v UNION ALL SELECT e.dst, list_append(p.path, e.dst), p.cost + e.w FROM p JOIN e ON e.src = p.id WHERE NOT list_contains(p.path, e.dst))
SELECT id, path, cost::DOUBLE AS cost FROM (SELECT id, array_to_string(path, '>') AS path, cost, row_number() OVER (PARTITION BY id ORDER BY len(path) DESC, cost, array_to_string(path, '>')) AS n FROM p) WHERE n = 1"""
)
def hamiltonian_small(spark, d):
    g = PropertyGraph.of(spark.createDataFrame([(a, b, float(w)) for a, b, w in BOTH_WAYS], "src string, dst string, weight double"))
    return A.hamiltonian_paths(g, 5).select("id", F.concat_ws(">", "path").alias("path"), "cost")


def board(n: int) -> list[int]:
    """A solved board by rule: rows are shifts of one another."""
    return [(3 * (r % 3) + r // 3 + c + n) % 9 + 1 for r in range(9) for c in range(9)]


SOLVED = board(0)


@registered(f"SELECT unnest(range(81))::BIGINT AS id, unnest({SOLVED})::INT AS value")
def sudoku_simple(spark, d):
    return S.solve_sudoku(spark, {c: v for c, v in enumerate(SOLVED) if (c * 7 + c // 9) % 9 > 3})


@registered("SELECT 0::BIGINT AS conflicts, 144::BIGINT AS coloured")
def coloring_valid(spark, d):
    g = A.grid_graph(spark, 12, 12, neighbours=4)
    out, _ = A.colour(g, 4, EXACT.with_(steps_limit=60))
    clashes = A.conflicts(out, g.edges).count()
    return out.agg(F.lit(clashes).cast("long").alias("conflicts"), F.count(F.lit(1)).alias("coloured"))


# sources and sinks


def written(spark: SparkSession, lines: list[str]) -> str:
    path = new_path(spark, "literal")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


@registered("SELECT * FROM (VALUES (4::BIGINT, 5::BIGINT), (2, 1), (2, 5), (2, 4)) t(src, dst)")
def adjacency_parse(spark, d):
    lists = text.read_adjacency(spark, written(spark, ["# a comment", "1 0", "4 1 5", "2 3 1 5 4", "5 0"]))
    return text.adjacency_graph(lists).edges.select("src", "dst")


@registered("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (0, 1), (1, 0), (3, 2)) t(src, dst)")
def edge_list_parse(spark, d):
    return text.read_edge_list(spark, written(spark, ["# one", "# two", "0\t0", "0\t1", "1\t0 # end", "3\t2"]))


@registered("SELECT unnest([1234, 3525, 123, 436, 43663, 33, 44, 0])::BIGINT AS value")
def ints_parse(spark, d):
    return text.read_ints(spark, written(spark, ["1234 3525\t123", "436#7 8", "# 9", "43663  33 44 # end", "0"]))


@registered(f"WITH {FLOW} SELECT id, 0.15::DOUBLE AS state FROM v")
def snapshot_roundtrip(spark, d):
    g = flow(spark, d)
    g = PropertyGraph(g.vertices.withColumn("state", F.lit(0.15)), g.edges)
    path = new_path(spark, "snapshot")
    snapshot.save(g, path)
    A.pagerank(g, ExecutionConfig(steps_limit=2))
    return snapshot.restore(spark, path).vertices.select("id", "state")


# ends of executions


def cycle(spark: SparkSession, n: int) -> PropertyGraph:
    return PropertyGraph.of(spark.range(1, n + 1).select(F.col("id").alias("src"), (F.col("id") % n + 1).alias("dst")))


def ended(spark: SparkSession, computation: Computation, info) -> DataFrame:
    return computation.vertices.agg(F.lit(info.reason.value).alias("reason"), F.lit(info.steps).alias("steps"), F.round(F.sum("state"), 3).alias("total"))


def rank_of(graph: PropertyGraph, config: ExecutionConfig):
    c = Computation(graph, rank.pagerank_program(), config)
    return c, c.execute()


@registered("SELECT 'steps_limit_reached' AS reason, 1 AS steps, 277.5::DOUBLE AS total")
def termination_steps(spark, d):
    return ended(spark, *rank_of(cycle(spark, 1000), EXACT.with_(steps_limit=1)))


@registered("SELECT 'global_constraint_met' AS reason, 6 AS steps, round(30 * (1 - 0.85 ** 7), 3)::DOUBLE AS total")
def termination_global(spark, d):
    stop = lambda v: 20 < v.agg(F.sum("state")).first()[0] < 29
    return ended(spark, *rank_of(cycle(spark, 30), EXACT.with_(should_stop=stop)))


@registered("SELECT 'converged' AS reason, 2 AS steps, round(0.6 + 0.15 + 0.85 * 4 * 0.15, 3)::DOUBLE AS total")
def termination_converged(spark, d):
    star = PropertyGraph.of(spark.createDataFrame([(i, 4) for i in range(4)], "src bigint, dst bigint"))
    return ended(spark, *rank_of(star, ExecutionConfig()))


@registered("SELECT 'time_limit_reached' AS reason, 0 AS steps, 1.5::DOUBLE AS total")
def termination_time(spark, d):
    return ended(spark, *rank_of(cycle(spark, 10), EXACT.with_(time_limit_s=0.0)))


@registered(f"WITH {FLOW} SELECT e.dst AS id, round(sum(x.value * e.weight), 2) AS total FROM (SELECT user_id, value FROM events) x JOIN e ON e.src = x.user_id GROUP BY e.dst")
def continuous_updates(spark, d):
    from weftgraph.streaming import one_hop_totals

    g, path = flow(spark, d), new_path(spark, "totals")
    # the stream is the table's own file, read by its folder and name
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    totals = one_hop_totals(stream.select(F.col("user_id").alias("src"), "value"), g.edges)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    q = totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/{q.lastProgress['batchId']}").select("id", F.round("total", 2).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from weftgraph import catalog_more  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)

