"""Registered queries of editing, sessions, programs, set functions, sources and streams."""

from __future__ import annotations

import json
import logging
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import algorithms as A
from weftgraph import functions as fn
from weftgraph.algorithms import linear
from weftgraph.algorithms.clustering import components_program
from weftgraph.algorithms.paths import sssp_program
from weftgraph.catalog import EXACT, FLOW, GEO, HREFS, TRADE, distance_sql, flow, geo, links, registered, same_text, table, trade
from weftgraph.operators import aggregate as agg
from weftgraph.operators import mutate, query
from weftgraph.operators.graph import PropertyGraph, expose_inbox
from weftgraph.plans import trace
from weftgraph.plans.config import Mode
from weftgraph.plans.console import Console
from weftgraph.plans.durable import new_path, write_table
from weftgraph.plans.engine import Computation, run
from weftgraph.plans.program import VertexProgram
from weftgraph.plans.session import Break, Session
from weftgraph.sources import binary, logs, snapshot, text
from weftgraph.streaming import Continuous, work_list


def adder(initial, signal=lambda: F.lit(1), **options) -> VertexProgram:
    """state: what came in so far, and the initial value."""
    return VertexProgram("bigint", initial, lambda: signal().cast("long"), {"n": lambda: F.sum("signal")}, lambda: F.col("state") + F.coalesce("n", F.lit(0)), memory="fold", **options)


# edits


@registered(f"WITH {FLOW} SELECT src AS id, count(*) AS removed FROM e WHERE src % 5 = 0 GROUP BY src")
def remove_all_edges(spark, d):
    g = flow(spark, d)
    return mutate.remove_all_edges(g, g.vertices.where("id % 5 = 0"))[1]


@registered(f"WITH {FLOW} SELECT id, id % 2 * 3 AS state FROM v")
def send_signal(spark, d):
    g = flow(spark, d)
    c = Computation(PropertyGraph(g.vertices, g.edges.where("false")), adder(lambda: F.lit(0)), EXACT)
    c.send(g.vertices.where("id % 2 = 1").select(F.col("id").alias("dst"), F.lit(3).cast("long").alias("signal")))
    c.execute()
    c.close()
    return c.vertices.select("id", "state")


@registered(f"WITH {FLOW} SELECT id, CASE WHEN id = (SELECT max(id) FROM v) THEN -1 ELSE id * 2 END AS state FROM v")
def for_vertex(spark, d):
    g = flow(spark, d)
    g = mutate.for_each_vertex(PropertyGraph(g.vertices.withColumn("state", F.col("id")), g.edges), {"state": F.col("state") * 2})
    return mutate.for_vertex(g, g.vertices.agg(F.max("id")).first()[0], {"state": F.lit(-1).cast("long")}).vertices.select("id", "state")


@registered(f"""WITH {FLOW}, more AS (SELECT src, dst FROM e UNION SELECT id, id + 1000000 FROM v WHERE id % 2 = 0 UNION SELECT id, id FROM v)
SELECT src, dst FROM more WHERE NOT (src = dst AND src % 3 = 0) AND src % 7 <> 0""")
def for_each_vertex_edit(spark, d):
    even = lambda v: v.where("id % 2 = 0").select((F.col("id") + 1000000).alias("id"))
    new = lambda v: v.where("id % 2 = 0").select(F.col("id").alias("src"), (F.col("id") + 1000000).alias("dst")).union(v.select("id", "id"))
    gone = lambda v: v.where("id % 3 = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return mutate.for_each_vertex(flow(spark, d), {}, new_edges=new, new_vertices=even, gone_edges=gone, gone=F.expr("id % 7 = 0")).edges.select("src", "dst")


@registered("SELECT count(*) FILTER (doc_id <> least) AS of_all, count(DISTINCT CASE WHEN doc_id <> least THEN least END) > 0 AS some FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS least FROM documents)")
def recalculate_scores(spark, d):
    """States are set behind the engine's back, which queues nothing; looking at the scores again queues what differs from what was signalled."""
    c = Computation(same_text(spark, d), components_program(), EXACT)
    c.execute()
    c.change(mutate.for_each_vertex(c.graph, {"state": F.col("id")}))
    before = c.active
    c.recalculate_scores()
    out = c.vertices.where("ever_signalled").agg(F.count_if("q_signal").alias("of_all")).select("of_all", F.expr(f"of_all > {before}").alias("some"))
    c.close()
    return out


@registered(f"WITH {FLOW} SELECT (SELECT count(*) FROM v) AS vertices_removed, (SELECT count(*) FROM e) AS edges_removed")
def reset(spark, d):
    g = flow(spark, d)
    gone = mutate.changes(g, PropertyGraph.empty(g))
    return spark.createDataFrame([(gone["vertices_removed"], gone["edges_removed"])], "vertices_removed bigint, edges_removed bigint")


@registered(f"WITH {FLOW} SELECT 'added' AS hook, id FROM (SELECT id + 500000 AS id FROM v WHERE id % 4 = 0) UNION ALL SELECT 'attached', src FROM e WHERE src % 9 = 1 UNION ALL SELECT 'removed', id FROM v WHERE id % 3 = 0")
def lifecycle_hooks(spark, d):
    g, seen = flow(spark, d), {}
    g = mutate.add_vertices(g, g.vertices.where("id % 4 = 0").select((F.col("id") + 500000).alias("id")).union(g.vertices), after_initialization=lambda v: seen.update(added=v.select("id")))
    lone = PropertyGraph(g.vertices, g.edges.where("src % 9 <> 1"))
    mutate.add_edges(lone, g.edges, on_attach=lambda e: seen.update(attached=e.select(F.col("src").alias("id"))))
    mutate.remove_vertices(g, flow(spark, d).vertices.where("id % 3 = 0"), before_removal=lambda v: seen.update(removed=v.select("id")))
    parts = [rows.select(F.lit(hook).alias("hook"), "id") for hook, rows in seen.items()]
    return parts[0].union(parts[1]).union(parts[2])


@registered(f"WITH {FLOW} SELECT src, dst FROM e UNION SELECT n_nationkey + 900000, n_regionkey + 900000 FROM nation UNION SELECT r_regionkey + 900000, r_regionkey + 900000 FROM region")
def function_and_iterator_load(spark, d):
    def nations(g):
        rows = table(spark, d, "nation").select((F.col("n_nationkey") + 900000).alias("src"), (F.col("n_regionkey") + 900000).alias("dst"))
        return mutate.add_edges(g, rows, on_missing_source="create")

    regions = [r[0] + 900000 for r in table(spark, d, "region").select("r_regionkey").toLocalIterator()]
    edits = [x for r in regions for x in (("edge", r, r, 1.0), ("vertex", r))]
    g = mutate.modify_graph(flow(spark, d), [nations, lambda g: mutate.load_iterator(g, iter(edits), batch=3)], near="id", n=2)
    return g.edges.select("src", "dst")


# programs


@registered(f"WITH {FLOW} SELECT v.id, coalesce(sum(e.weight) FILTER (e.weight > 2), 0)::BIGINT AS state FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def optional_signal(spark, d):
    program = adder(lambda: F.lit(0), lambda: F.when(F.col("weight") > 2, F.col("weight")))
    return run(flow(spark, d), program, EXACT.with_(steps_limit=1))[0].select("id", "state")


@registered(f"WITH {FLOW} SELECT v.id, count(e.src) AS state FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def only_on_change(spark, d):
    program = adder(lambda: F.lit(0), only_on_change=True)
    return run(flow(spark, d), program, EXACT.with_(steps_limit=3))[0].select("id", "state")


@registered(f"""WITH {FLOW}, s1 AS (SELECT v.id, count(e.src) AS s FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id)
SELECT v.id, coalesce(sum(s1.s), 0)::BIGINT AS state FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN s1 ON s1.id = e.src GROUP BY v.id""")
def reset_after_signalling(spark, d):
    """Every vertex sends its state along its edges and is left with nothing; after two steps states are the walks of two edges that end there."""
    program = adder(lambda: F.lit(1), lambda: F.col("src_state"), reset_state=lambda: F.lit(0).cast("long"), score_signal=lambda: F.col("state").cast("double"))
    return run(flow(spark, d), program, EXACT.with_(steps_limit=2))[0].select("id", "state")


@registered(f"WITH {TRADE}, s AS (SELECT src AS id, 6 * n AS signals FROM deg) SELECT id, signals, 6::BIGINT AS collects FROM s")
def sync_counting_trade(spark, d):
    return A.counting(trade(spark, d), 6)[0].select("id", "state.signals", "state.collects")


@registered(f"WITH {FLOW} SELECT e.dst AS id, count(*) AS sources, sum(e.weight)::BIGINT AS total, min(e.src) AS first FROM e GROUP BY e.dst")
def expose_inboxes(spark, d):
    program = VertexProgram("bigint", lambda: F.lit(0), lambda: F.col("weight").cast("long"), {"n": lambda: F.sum("signal")}, lambda: F.coalesce("n", F.lit(0)), memory="inbox")
    c = Computation(flow(spark, d), program, EXACT)
    c.step()
    seen = expose_inbox(c.inbox)
    c.close()
    keys = F.map_keys("signals")
    return seen.select("id", F.size(keys).cast("long").alias("sources"), F.aggregate(F.map_values("signals"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(keys).alias("first"))


@registered("SELECT p_partkey AS id, p_partkey // 12 * 12 AS component FROM part")
def components_chain(spark, d):
    """Chains of twelve parts: labels take eleven steps to the end."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    e = parts.where("id % 12 <> 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return A.components(PropertyGraph(parts, e), EXACT)[0].select("id", F.col("state").alias("component"))


def in_turns(mode: Mode):
    def distances(spark: SparkSession, d: str) -> DataFrame:
        g = flow(spark, d)
        return A.shortest_paths(g, g.vertices.agg(F.min("id")).first()[0], EXACT.with_(mode=mode), False)[0].select("id", F.col("state").alias("distance"))

    return distances


for _name, _mode in (("asynchronous_paths", Mode.ASYNCHRONOUS), ("optimized_asynchronous_paths", Mode.OPTIMIZED_ASYNCHRONOUS)):
    _query = in_turns(_mode)
    _query.__name__ = _name
    registered(distance_sql("1", 30))(_query)


# aggregations, look-ups, sessions


@registered(f"WITH {GEO} SELECT round(max(state) - min(state), 4) AS reduced FROM v")
def reduce_states(spark, d):
    return agg.reduce_states(geo(spark, d).vertices, F.round(F.max("state") - F.min("state"), 4), 0.0)


@registered(f"WITH {GEO} SELECT bool_and(state > -2000) AS above, bool_and(state > 0) AS positive FROM v WHERE state IS NOT NULL")
def all_hold(spark, d):
    v = geo(spark, d).vertices.where("state IS NOT NULL")
    return spark.createDataFrame([(agg.all_hold(v, F.col("state") > -2000), agg.all_hold(v, F.col("state") > 0))], "above boolean, positive boolean")


@registered(f"WITH {GEO} SELECT round(sqrt(avg(state * state)), 6) AS result FROM v")
def own_aggregation(spark, d):
    rms = agg.Aggregation(lambda: F.col("state"), {"total": lambda: F.sum(F.col("x") * F.col("x")), "n": lambda: F.count("x")}, lambda: F.round(F.sqrt(F.col("total") / F.col("n")), 6), 0.0)
    return rms.over(geo(spark, d).vertices)


@registered(f"WITH {FLOW} SELECT dst AS id, count(*) AS messages FROM e GROUP BY dst ORDER BY messages DESC, id LIMIT 10")
def top_activity(spark, d):
    c = Computation(flow(spark, d), linear.counting_program(), EXACT)
    c.close()
    return trace.most_messages(c, 10)


@registered(f"""WITH {GEO} SELECT 'highest_state' AS kind, id FROM (SELECT id FROM v WHERE state IS NOT NULL ORDER BY state DESC, id LIMIT 4)
UNION ALL SELECT 'lowest_state', id FROM (SELECT id FROM v WHERE state IS NOT NULL ORDER BY state, id LIMIT 4)
UNION ALL SELECT 'highest_degree', id FROM (SELECT v.id, count(e.src) AS n FROM v LEFT JOIN (SELECT src, src AS end FROM e UNION ALL SELECT src, dst FROM e) e ON e.end = v.id GROUP BY v.id ORDER BY n DESC, v.id LIMIT 4)
UNION ALL SELECT 'above_score', id FROM (SELECT id FROM v WHERE state > 9000 ORDER BY state DESC, id LIMIT 4)
UNION ALL SELECT 'substring', id FROM (SELECT id FROM v WHERE contains(id::VARCHAR, '11') ORDER BY id LIMIT 4)
UNION ALL SELECT 'ids', id FROM v WHERE id IN (0, 104)""")
def request_router(spark, d):
    g, found = geo(spark, d), None
    for kind, options in {"highest_state": {}, "lowest_state": {}, "highest_degree": {}, "above_score": {"score": F.col("state"), "threshold": 9000.0}, "substring": {"part": "11"}, "ids": {"names": ["0", "104", "none"]}}.items():
        rows = query.query(g, kind, n=4, **options).select(F.lit(kind).alias("kind"), "id")
        found = rows if found is None else found.union(rows)
    return found


FETCHED = f"""WITH {GEO}, picked AS (SELECT id FROM v WHERE id IN (100, 101) UNION SELECT id FROM (SELECT id FROM v WHERE state IS NOT NULL ORDER BY state DESC, id LIMIT 3)),
near AS (SELECT id FROM picked UNION SELECT dst FROM e JOIN picked ON src = id UNION SELECT src FROM e JOIN picked ON dst = id)
SELECT v.id, v.vtype, round(v.state, 4) AS state, (SELECT count(*) FROM e WHERE e.src = v.id AND e.dst IN (SELECT id FROM near)) AS n_edges, (SELECT min(state) FROM v) AS lowest, (SELECT max(state) FROM v) AS highest FROM v WHERE id IN (SELECT id FROM near)"""


@registered(FETCHED)
def fetch_graph(spark, d):
    found = query.fetch_graph(geo(spark, d), ["100", "101"], "highest_state", n=3, radius=1, incoming=True)
    return found.select("id", "vtype", F.round(F.col("state").cast("double"), 4).alias("state"), "n_edges", "lowest", "highest")


@registered(FETCHED.replace("SELECT v.id, v.vtype, round(v.state, 4) AS state, (", "SELECT v.id, (").split(", (SELECT min(state)")[0] + " FROM v WHERE id IN (SELECT id FROM near)")
def console_request(spark, d):
    """The same request as JSON, and its reply read back."""
    g = geo(spark, d)
    keep = VertexProgram("double", lambda: F.col("state"), lambda: F.col("src_state"), {"n": lambda: F.sum("signal")}, lambda: F.col("state"))
    session = Session(g, keep)
    reply = json.loads(Console(session).handle(json.dumps({"provider": "graph", "query": "top", "topCriterium": "Highest state", "targetCount": 3, "vertexIds": ["100", "101"], "vicinityRadius": 1, "vicinityIncoming": True})))
    session.terminate()
    return spark.createDataFrame([(int(i), len(reply["edges"].get(i, []))) for i in reply["vertices"]], "id bigint, n_edges bigint")


@registered(f"WITH {GEO}, w AS (SELECT id, state FROM v WHERE state IS NOT NULL ORDER BY id LIMIT 30) SELECT id, 'state_above' AS kind FROM w WHERE state > 5000 UNION ALL SELECT id, 'state_below' FROM w WHERE state < 1000")
def break_conditions(spark, d):
    g = geo(spark, d)
    keep = VertexProgram("double", lambda: F.col("state"), lambda: F.col("src_state"), {"n": lambda: F.sum("signal")}, lambda: F.col("state"))
    session = Session(PropertyGraph(g.vertices.where("state IS NOT NULL"), g.edges.where("false")), keep)
    watched = {}
    for r in g.vertices.where("state IS NOT NULL").orderBy("id").limit(30).collect():
        for kind, bound in (("state_above", 5000.0), ("state_below", 1000.0)):
            watched[session.add_break(Break(kind, r["id"], bound))] = (r["id"], kind)
    hits = session.run(most_phases=2)
    session.terminate()
    return spark.createDataFrame([watched[n] for n in hits], "id bigint, kind string")


@registered("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0) THEN 'added' ELSE 'no such vertex' END AS result FROM nation")
def break_validation(spark, d):
    regions = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").cast("long").alias("id"))
    loops = regions.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    session, rows = Session(PropertyGraph.of(loops, regions), linear.counting_program()), []
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        try:
            session.add_break(Break("state_changes", r["n_regionkey"]))
            rows.append((r["n_nationkey"], "added"))
        except KeyError:
            rows.append((r["n_nationkey"], "no such vertex"))
    session.terminate()
    return spark.createDataFrame(rows, "id bigint, result string")


# functions


@registered("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def merge_maps(spark, d):
    """Counts by type of even and odd events as two maps, which are merged."""
    n = table(spark, d, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("odd")).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda odd: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("odd") == odd, F.struct("event_type", "n")))))
    maps = n.groupBy("user_id").agg(pairs(0).alias("a"), pairs(1).alias("b"))
    return maps.select("user_id", F.explode(fn.merge_maps(F.col("a"), F.col("b"), lambda x, y: x + y)).alias("event_type", "n"))


@registered(f"""WITH {FLOW}, o AS (SELECT src AS id, list(dst) AS l FROM e GROUP BY src), i AS (SELECT dst AS id, list(src) AS l FROM e GROUP BY dst)
SELECT id, len(list_distinct(list_concat(o.l, i.l))) AS n_union, len(list_intersect(o.l, i.l)) AS n_both, len(list_filter(o.l, lambda x: NOT list_contains(i.l, x))) AS n_only_out,
len(list_distinct(list_append(o.l, id))) AS n_own, len(list_filter(o.l, lambda x: x < id)) AS n_below, list_contains(o.l, id + 1) AS has_next, list_sum(o.l)::BIGINT AS decoded FROM o JOIN i USING (id)""")
def set_functions(spark, d):
    g = flow(spark, d)
    into = g.edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("sources"))
    o, i, size = F.col("targets"), F.col("sources"), lambda c: F.size(c).cast("long")
    back = F.aggregate(fn.delta_decoded(fn.delta_encoded(o)), F.lit(0).cast("long"), lambda a, x: a + x)
    return g.targets().join(into, "id").select(
        "id", size(fn.set_union(o, i)).alias("n_union"), size(fn.set_intersection(o, i)).alias("n_both"), size(fn.set_difference(o, i)).alias("n_only_out"), size(fn.set_insert(o, F.col("id"))).alias("n_own"),
        size(fn.split_at(o, F.col("id"))["below"]).alias("n_below"), fn.set_contains(o, F.col("id") + 1).alias("has_next"), back.alias("decoded"),
    )


@registered("SELECT user_id, bit_or(1::BIGINT << (event_id % 60)::INT) AS bits, count(DISTINCT event_id % 60) AS n FROM events GROUP BY user_id")
def bit_sets(spark, d):
    bits = table(spark, d, "events").groupBy("user_id").agg(fn.bits_of(F.collect_set(F.col("event_id") % 60)).alias("bits"))
    return bits.select("user_id", "bits", F.size(fn.numbers_of(F.col("bits"))).cast("long").alias("n"))


@registered("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def times_and_json(spark, d):
    return table(spark, d, "events").select("event_id", fn.log_time(F.col("ts")).alias("at"), fn.as_json("event_id", "event_type").alias("json"))


@registered("SELECT id FROM (SELECT id FROM (SELECT 1000 + c_custkey AS id FROM customer WHERE contains((1000 + c_custkey)::VARCHAR, '2') UNION SELECT s_suppkey + 0 FROM supplier WHERE s_suppkey % 2 = 0)) ORDER BY id LIMIT 60")
def union_with_cap(spark, d):
    c = table(spark, d, "customer").select((1000 + F.col("c_custkey")).alias("id"))
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))
    return query.by_substring(c, "2").union(s).distinct().orderBy("id").limit(60)


# sources and sinks


@registered(f"WITH {FLOW} SELECT src, dst FROM e")
def varint_splits(spark, d):
    """The graph as varint files, three splits, and read again."""
    path, lists = new_path(spark, "varints"), text.grouped_by_source(flow(spark, d).edges)
    for k in range(3):
        binary.write_varint_split(spark, f"{path}/split-{k}", ((r["id"], r["targets"]) for r in lists.where(F.col("id") % 3 == k).toLocalIterator()))
    return text.adjacency_graph(binary.read_varint_splits(spark, path)).edges.select("src", "dst")


@registered(f"WITH {HREFS}, e1 AS (SELECT src, dst FROM e WHERE src = 'page:1' OR src = 'page:2') SELECT src, dst FROM e1 UNION SELECT e.src, e.dst FROM e JOIN e1 ON e.src = e1.dst")
def linked_data(spark, d):
    """Links as triples in a file; those within two steps of two pages."""
    path = new_path(spark, "triples")
    triples = links(spark, d).edges.select(F.concat(F.lit("<"), "src", F.lit(">\t<links>\t<"), "dst", F.lit("> .")).alias("value"))
    triples.union(spark.createDataFrame([("<a>\t<named>\t\"text\" .",)], "value string")).write.text(path)
    return text.neighbourhood(text.read_triples(spark, path).where("predicate = 'links'"), ["page:1", "page:2"], 2).edges.select("src", "dst")


@registered("SELECT r_name AS message, CASE WHEN r_regionkey % 2 = 0 THEN 'INFO' ELSE 'WARNING' END AS level FROM region WHERE r_regionkey > 0")
def log_lines(spark, d):
    folder = tempfile.mkdtemp(prefix="weftgraph-log-")  # a log of the driver's, as logging writes it
    handler, log = logs.JsonLines(os.path.join(folder, "log.json")), logging.getLogger("weftgraph.regions")
    log.setLevel(logging.INFO)
    log.propagate = False
    log.addHandler(handler)
    for r in table(spark, d, "region").where("r_regionkey > 0").orderBy("r_regionkey").collect():
        log.log(logging.INFO if r["r_regionkey"] % 2 == 0 else logging.WARNING, r["r_name"])
    log.removeHandler(handler)
    with open(handler.path, encoding="utf-8") as f:
        rows = [json.loads(line) for line in f]
    path, _ = new_path(spark, "log"), None
    spark.createDataFrame([(r["at"], r["level"], r["source"], r["message"]) for r in rows], logs.SCHEMA).write.json(path)
    return logs.read_logs(spark, path).select("message", "level")


@registered(f"WITH {GEO} SELECT id, vtype FROM v")
def state_sink(spark, d):
    """Every vertex handed to a sink, here lines of JSON, and read again."""
    path = new_path(spark, "sink")
    geo(spark, d).vertices.select(fn.as_json("id", "vtype").alias("value")).write.text(path)
    return spark.read.schema("id bigint, vtype string").json(path)


@registered(f"WITH {FLOW} SELECT count(*) AS n, false AS there FROM v")
def snapshot_removed(spark, d):
    g, path = flow(spark, d), new_path(spark, "snapshot")
    snapshot.save(g, path)
    n = snapshot.restore(spark, path).vertices.count()
    snapshot.remove(spark, path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.createDataFrame([(n, p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))], "n bigint, there boolean")


# incremental and streaming


@registered(distance_sql("1", 30))
def incremental_edges(spark, d):
    """Distances over half of the edges; then the other half comes, and only what it reaches is computed again."""
    g = flow(spark, d)
    source = g.vertices.agg(F.min("id")).first()[0]
    v = g.vertices.withColumn("state", F.when(F.col("id") == source, 0))
    c = Computation(PropertyGraph(v, g.edges.where("(src + dst) % 2 = 0")), sssp_program(False), EXACT)
    c.execute()
    c.change(mutate.add_edges(c.graph, g.edges.where("(src + dst) % 2 = 1")))
    c.execute()
    c.close()
    return c.vertices.select("id", F.col("state").alias("distance"))


@registered(distance_sql("1", 30))
def continuous_paths(spark, d):
    """Distances while edges come as a stream of files, to the same end as at once."""
    g = flow(spark, d)
    source, path = g.vertices.agg(F.min("id")).first()[0], new_path(spark, "arriving")
    g.edges.select("src", "dst", "weight").repartition(3, "src").write.parquet(path)
    start = PropertyGraph(g.vertices.where(F.col("id") == source).withColumn("state", F.lit(0)), g.edges.where("false"))
    engine = Continuous(start, sssp_program(False), EXACT)
    stream = spark.readStream.schema("src bigint, dst bigint, weight double").option("maxFilesPerTrigger", 2).parquet(path)
    engine.add_edges_from(stream).awaitTermination()
    engine.stop()
    return engine.vertices.select("id", F.col("state").alias("distance"))


@registered("SELECT user_id AS key, event_id AS item, 'done ' || event_id AS result FROM events WHERE event_id % 3 = 0")
def work_lists(spark, d):
    path, out = new_path(spark, "items"), new_path(spark, "worked")
    table(spark, d, "events").select("user_id", F.col("event_id").alias("item")).repartition(2).write.parquet(path)
    stream = spark.readStream.schema("user_id bigint, item bigint").option("maxFilesPerTrigger", 1).parquet(path)
    done = work_list(stream, "user_id", lambda x: x % 3 == 0, lambda x: f"done {x}", at_a_time=1 << 20)
    q = done.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("key bigint, item bigint, result string").parquet(out)


@registered(f"WITH {FLOW} SELECT count(*) AS n FROM e")
def verified_plans(spark, d):
    """Two ways to the same edges, held against each other."""
    e, _ = write_table(flow(spark, d).edges.select("src", "dst"), "plan")
    twice = flow(spark, d).symmetric().symmetric().edges.select("src", "dst").join(e, ["src", "dst"], "left_semi")
    return trace.verified(e, twice).agg(F.count(F.lit(1)).alias("n"))
