import pytest
from pyspark.sql import functions as F

from weftgraph import functions as W
from weftgraph.algorithms import clustering_coefficient, colour, conflicts, grid_graph, hamiltonian_paths, path_pattern, solve_sudoku
from weftgraph.algorithms.paths import Any, Fixed, Star
from weftgraph.algorithms.rank import pagerank
from weftgraph.catalog import HAMILTON
from weftgraph.operators import aggregate, mutate, query
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig
from weftgraph.plans.engine import Computation
from weftgraph.algorithms.rank import pagerank_program
from weftgraph.sources import binary, snapshot, text


def vertices(spark, rows):
    return spark.createDataFrame(rows, "id bigint, state double")


def edges(spark, rows):
    return PropertyGraph.of(spark.createDataFrame(rows, "src bigint, dst bigint")).edges


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_aggregations(spark):
    v = vertices(spark, [(1, 1.0), (2, 1.0)])
    assert aggregate.sum_of_states(v).first()[0] == 2 and aggregate.product_of_states(v).first()[0] == 1
    assert aggregate.sum_of_states(v.where("false")).first()[0] is None
    states = vertices(spark, [(1, 0.7), (2, 0.9), (3, 0.8), (4, 0.6)])
    assert [tuple(r) for r in aggregate.top_k(states, 2).collect()] == [(2, 0.9), (3, 0.8)]
    many = spark.range(1, 1001)
    for n in (0, 50, 1000):
        assert len(set(ids(aggregate.sample_ids(many, n)))) == n
    assert aggregate.all_hold(states, F.col("state") > 0.5) and aggregate.all_hold(states.where("false"), F.lit(False))
    mixed = spark.createDataFrame([(1, "2.5"), (2, "x")], "id bigint, state string")
    assert aggregate.reduce_states(mixed.withColumn("state", aggregate.numeric_state(neutral=1.0)), F.sum("state")).first()[0] == 3.5


def test_mutation_counts(spark):
    start = PropertyGraph(vertices(spark, []), edges(spark, [(9, 9)]).where("false"))
    full = mutate.add_edges(mutate.add_vertices(start, vertices(spark, [(i, 0.0) for i in range(4)])), spark.createDataFrame([(0, 1), (1, 3)], "src bigint, dst bigint"))
    assert mutate.changes(start, full) == {"vertices_added": 4, "vertices_removed": 0, "edges_added": 2, "edges_removed": 0}
    seen = []
    less = mutate.remove_vertices(full, spark.createDataFrame([(0,), (2,), (77,)], "id bigint"), lambda gone: seen.extend(ids(gone)))
    assert mutate.changes(full, less) == {"vertices_added": 0, "vertices_removed": 2, "edges_added": 0, "edges_removed": 1} and sorted(seen) == [0, 2]
    bare, removed = mutate.remove_all_edges(full, spark.createDataFrame([(0,)], "id bigint"))
    assert bare.edges.count() == 1 and removed.first()["removed"] == 1
    with pytest.raises(mutate.MissingSourceError):
        mutate.add_edges(full, spark.createDataFrame([(50, 1)], "src bigint, dst bigint"))
    assert mutate.add_edges(full, spark.createDataFrame([(50, 1)], "src bigint, dst bigint"), "ignore").edges.count() == 2
    assert PropertyGraph.empty(full).vertices.count() == 0


def test_duplicates_are_dropped_or_merged(spark):
    none = PropertyGraph(vertices(spark, []), edges(spark, [(9, 9)]).where("false"))
    rows = vertices(spark, [(133, 1.0), (134, 1.0), (133, 1.0)])
    assert aggregate.sum_of_states(mutate.add_vertices(none, rows).vertices).first()[0] == 2
    assert aggregate.sum_of_states(mutate.add_vertices(none, rows, merge={"state": lambda: F.sum("state")}).vertices).first()[0] == 3


def test_a_changed_graph_goes_on_from_where_it_was(spark):
    c = Computation(PropertyGraph.of(spark.createDataFrame([(0, 4), (1, 4)], "src bigint, dst bigint")), pagerank_program())
    c.execute()
    c.change(mutate.add_edges(c.graph, spark.createDataFrame([(0, 1)], "src bigint, dst bigint")))
    assert c.active == 1
    c.execute()
    found = {r["id"]: r["state"] for r in c.vertices.collect()}
    one = 0.15 + 0.85 * 0.15 / 2
    assert found == pytest.approx({0: 0.15, 1: one, 4: 0.15 + 0.85 * (0.15 / 2 + one)})
    moved = mutate.for_vertex(c.graph, 0, {"state": F.lit(9.0)})
    assert moved.vertices.where("id = 0").first()["state"] == 9 and not moved.vertices.where("q_signal").count()
    with pytest.raises(KeyError):
        mutate.for_vertex(c.graph, 123, {"state": F.lit(9.0)})


def test_queries(spark):
    g = PropertyGraph.of(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 1), (1, 1)], "src bigint, dst bigint"))
    g = PropertyGraph(g.vertices.withColumn("state", F.col("id").cast("double")), g.edges)
    one = spark.createDataFrame([(1,)], "id bigint")
    assert ids(query.vicinity(g, one, 2)) == [1, 2, 3] and ids(query.vicinity(g, one, 1, incoming=True)) == [1, 2, 5]
    assert query.top_degree(g, 1).first()["id"] == 1 and query.top_degree(g, 1).first()["degree"] == 4
    assert ids(query.query(g, "lowest_state", n=2)) == [1, 2] and ids(query.query(g, "ids", names=["3"], radius=1)) == [3, 4]
    assert ids(query.query(g, "substring", part="5")) == [5] and ids(query.query(g, "above_score", score=F.col("state"), threshold=4)) == [5]
    assert len(ids(query.query(g, "sample", n=3))) == 3 and ids(query.query(g, "highest_degree", n=1)) == [1]
    with pytest.raises(ValueError):
        query.query(g, "no such kind")
    rows = {r["id"]: r for r in query.describe(g, spark.createDataFrame([(1,), (2,)], "id bigint")).collect()}
    assert rows[1]["n_edges"] == 2 and rows[2]["n_edges"] == 0 and rows[1]["highest"] == 5


def test_clustering_coefficient(spark):
    pairs = [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 3), (3, 5), (5, 6)]
    g = PropertyGraph.of(spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src bigint, dst bigint"))
    found = {r["id"]: r["coefficient"] for r in clustering_coefficient(g).collect()}
    assert found == {1: 0.3, 2: 1.0, 3: pytest.approx(4 / 6), 4: None, 5: pytest.approx(4 / 6), 6: 1.0}
    one_way = PropertyGraph.of(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (2, 4)], "src bigint, dst bigint"))
    assert {r["id"]: r["coefficient"] for r in clustering_coefficient(one_way).collect()} == {1: 0.0, 2: 0.5, 3: None, 4: None}


def test_colouring_has_no_conflicts(spark):
    g = grid_graph(spark, 4, 4, neighbours=4)
    out, _ = colour(g, 3, ExecutionConfig(steps_limit=60))
    assert out.count() == 16 and conflicts(out, g.edges).count() == 0


def test_paths(spark):
    both = [(a, b, float(w)) for a, b, w in HAMILTON] + [(b, a, float(w)) for a, b, w in HAMILTON]
    found = {r["id"]: (r["path"], r["cost"]) for r in hamiltonian_paths(PropertyGraph.of(spark.createDataFrame(both, "src string, dst string, weight double")), 5).collect()}

    def longest(v):
        best = []
        def go(path, cost):
            best.append((-len(path), cost, ">".join(path)))
            for a, b, w in both:
                if a == path[-1] and b not in path:
                    go([*path, b], cost + w)
        for s in "abcde":
            go([s], 0.0)
        return min(x for x in best if x[2].endswith(v))

    assert all((-len(p), c, ">".join(p)) == longest(v) for v, (p, c) in found.items()) and len(found) == 5
    g = PropertyGraph.of(spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 2), (2, 5)], "src bigint, dst bigint"))
    ends = {tuple(r["path"]) for r in path_pattern(g, 0, [Star(1), Fixed(2), Any(lambda: F.col("id") > 3)]).collect()}
    assert ends == {(2, 5), (1, 2, 5)}
    assert path_pattern(g, 0, [Star(3, least=1), Fixed(5)]).count() == 2


def test_sudoku_with_search(spark):
    rows = ["53..7....", "6..195...", ".98....6.", "8...6...3", "4..8.3..1", "7...2...6", ".6....28.", "...419..5", "....8..79"]
    givens = {r * 9 + c: int(x) for r, row in enumerate(rows) for c, x in enumerate(row) if x != "."}
    for g in (givens, {k: v for k, v in givens.items() if k % 4}):
        found = {r["id"]: r["value"] for r in solve_sudoku(spark, g).collect()}
        assert all(found[k] == v for k, v in g.items())
        assert all({found[r * 9 + c] for c in range(9)} == {found[c * 9 + r] for c in range(9)} == set(range(1, 10)) for r in range(9))
    assert solve_sudoku(spark, {0: 1, 1: 1}) is None


def test_text_and_binary_sources(spark, tmp_path):
    f = tmp_path / "adjacency"
    f.write_text("# comment\n1 0\n4 1 5\n2 3 1 5 4 # more\n5 0")
    want = [(1, []), (2, [1, 5, 4]), (4, [5]), (5, [])]
    for lines in (True, False):
        assert sorted((r["id"], r["targets"]) for r in text.read_adjacency(spark, str(f), lines).collect()) == want
    f.write_text("1\n2 7\n8 2 0")
    assert sorted((r["id"], r["targets"]) for r in text.read_adjacency(spark, str(f), False).collect()) == [(1, [7, 8]), (2, [])]
    f.write_text("1 3 4")
    with pytest.raises(Exception):
        text.read_adjacency(spark, str(f)).collect()
    f.write_text("1 2 3 0")
    assert sorted(r["value"] for r in text.read_ints(spark, str(f)).collect()) == [0, 1, 2, 3]
    f.write_text("1 -2")
    with pytest.raises(Exception):
        text.read_ints(spark, str(f)).collect()
    f.write_text("<http://a/x>\t<http://p>\t<http://a/y> .\n<http://a/x>\t<http://p>\t<http://b/z> .\n")
    assert [tuple(r) for r in text.read_triples(spark, str(f), "http://a/").collect()] == [("http://a/x", "http://p", "http://a/y")]
    numbers = [5, 2, 300, 70000, 1, 0]
    assert list(binary.decode_varints(binary.encode_varints(numbers))) == numbers
    (tmp_path / "split-0").write_bytes(binary.encode_varints(numbers))
    assert sorted((r["id"], r["targets"]) for r in binary.read_varint_splits(spark, str(tmp_path / "split-*")).collect()) == [(1, []), (5, [300, 70000])]
    pages = spark.createDataFrame([(1, '<a href="/x">X</a><a class=y href=\'/z\'>'), (2, None)], "page_id bigint, html string")
    assert sorted(r["dst"] for r in text.page_links(pages).collect()) == ["/x", "/z"]


def test_consecutive_keys_join_over_blocks(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (2, 25), (3, 26), (1, 47)], "k bigint, t bigint")
    assert sorted(tuple(r) for r in text.consecutive(rows, "k", ["t"], "t div 10").collect()) == [(1, 2), (2, 3), (3, 1)]


def test_snapshot(spark, tmp_path):
    g = PropertyGraph.of(spark.createDataFrame([(0, 1), (1, 0)], "src bigint, dst bigint"))
    c = Computation(g, pagerank_program())
    path = f"file://{tmp_path}/snap"
    snapshot.save(c.graph, path)
    c.execute()
    back = snapshot.restore(spark, path)
    assert set(back.vertices.columns) == {"id", "state"} and {round(r["state"], 9) for r in back.vertices.collect()} == {0.15}
    assert pagerank(back)[0].count() == 2
    snapshot.remove(spark, path)
    assert not (tmp_path / "snap").exists()


def test_functions(spark):
    df = spark.createDataFrame([([1, 4, 9], [4, 5], {"a": 1}, {"a": 2, "b": 3}, float("nan"))], "x array<bigint>, y array<bigint>, m map<string,int>, n map<string,int>, z double")
    r = df.select(
        W.set_insert(F.col("x"), F.lit(5)).alias("insert"), W.set_union(F.col("x"), F.col("y")).alias("union"), W.set_difference(F.col("x"), F.col("y")).alias("minus"),
        W.set_intersection(F.col("x"), F.col("y")).alias("both"), W.split_at(F.col("x"), F.lit(4)).alias("split"), W.delta_decoded(W.delta_encoded(F.col("x"))).alias("coded"),
        W.merge_maps(F.col("m"), F.col("n"), lambda a, b: a + b).alias("maps"), W.as_json("z").alias("json"), W.set_contains(F.col("x"), F.lit(9)).alias("there"), W.partition_of(F.lit(5), 7).alias("p"),
    ).first()
    assert r["insert"] == [1, 4, 5, 9] and r["union"] == [1, 4, 5, 9] and r["minus"] == [1, 9] and r["both"] == [4]
    assert (r["split"]["below"], r["split"]["rest"]) == ([1], [4, 9]) and r["coded"] == [1, 4, 9] and r["maps"] == {"a": 3, "b": 3}
    assert r["json"] == "{}" and r["there"] and 0 <= r["p"] < 7
