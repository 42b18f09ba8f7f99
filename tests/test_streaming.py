from pyspark.sql import functions as F

from weftgraph.algorithms.paths import sssp_program
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ExecutionConfig
from weftgraph.streaming import Continuous, work_list


def test_edges_that_come_in_shorten_distances(spark, tmp_path):
    g = PropertyGraph.of(spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0)], "src bigint, dst bigint, weight double"))
    g = PropertyGraph(g.vertices.withColumn("state", F.when(F.col("id") == 0, 0).cast("int")), g.edges)
    c = Continuous(g, sssp_program(), ExecutionConfig())
    folder = str(tmp_path / "edges")
    spark.createDataFrame([(0, 2, 1.0), (2, 3, 1.0)], "src bigint, dst bigint, weight double").write.parquet(folder)
    stream = spark.readStream.schema("src bigint, dst bigint, weight double").parquet(folder)
    c.add_edges_from(stream)
    c.await_idle()
    assert {r["id"]: r["state"] for r in c.vertices.collect()} == {0: 0, 1: 5, 2: 1, 3: 2}
    signals = str(tmp_path / "signals")
    spark.createDataFrame([(1, 2)], "dst bigint, signal int").write.parquet(signals)
    c.signals_from(spark.readStream.schema("dst bigint, signal int").parquet(signals))
    c.await_idle()
    assert {r["id"]: r["state"] for r in c.vertices.collect()} == {0: 0, 1: 2, 2: 1, 3: 2}
    c.stop()


def test_work_list_is_drained_and_counted(spark, tmp_path):
    folder = str(tmp_path / "items")
    spark.createDataFrame([(1, 5), (1, -2), (2, 7)], "k bigint, item bigint").write.parquet(folder)
    stream = spark.readStream.schema("k bigint, item bigint").parquet(folder)
    out = work_list(stream, "k", lambda x: x > 0, lambda x: f"did {x}")
    q = out.writeStream.format("memory").queryName("drained").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r["key"], r["item"], r["result"]) for r in spark.sql("select * from drained").collect()) == [(1, 5, "did 5"), (2, 7, "did 7")]
