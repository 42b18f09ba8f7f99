"""Exact deduplication as a stateful stream.

Every document arrives in a stream as (digest, stable identifier, content locator). Keyed state in RocksDB on the shared
folder keeps, for each digest and without expiry, the best identifier with its locator, the locator of the first arrival, and a
count. A run is cut into several micro-batches, so state written by one batch is met by the next at every size.

A state folder holds `arrivals` (digest, id, locator of every row that came), `files` (the path of every file that a locator
names), `stream` (the state) and `hits` (the state of every digest that came more than once). A later run over the same folder
goes on from there: what arrived before isn't counted again, and a hit on a text of an earlier run has that text fetched
through its locator. The bytes behind every digest that was hit are compared before its rows count as equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import LOCATOR, exists, located, new_dir, store, text_or_empty, without

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves megabytes ahead
    "spark.sql.streaming.metricsEnabled": "false",
    # on a local file system the default manager starts a process for each link it looks at, and checksum files double what is written
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
KEY = ["digest", "n_bytes"]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _through_state(spark: SparkSession, schema, state: str, new_files: int, batches: int) -> None:
    """Run what arrived through the keyed state; digests seen more than once go to the hits, batch by batch."""
    session = spark.newSession()
    for k, v in STATE_CONF.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batch: DataFrame, number: int) -> None:
        batch.where("n > 1").write.mode("overwrite").parquet(f"{state}/hits/batch={number}")

    arrived = F.struct("id", *LOCATOR)
    query = (
        session.readStream.schema(schema)
        .option("maxFilesPerTrigger", max(1, -(-new_files // batches)))
        .parquet(f"{state}/arrivals")
        .groupBy(*KEY)
        .agg(F.max(arrived).alias("best"), F.min(F.struct("run", *LOCATOR)).alias("origin"), F.max("run").alias("latest"), F.count(F.lit(1)).alias("n"))
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{state}/stream")
        .trigger(availableNow=True)
        .foreachBatch(emit)
        .start()
    )
    query.awaitTermination()


def _fetched(spark: SparkSession, state: str, wanted: DataFrame, text_col: str) -> DataFrame | None:
    """wanted (with locators) and the text that each locator leads to; None if wanted is empty. Files that none is in aren't opened."""
    files = spark.read.parquet(f"{state}/files").distinct().join(wanted.select(LOCATOR[0]).distinct(), LOCATOR[0])
    paths = [r["path"] for r in files.select("path").distinct().collect()]  # names of files, of which a table has few
    if not paths:
        return None
    texts = located(spark.read.parquet(*paths)).select(*LOCATOR, text_or_empty(text_col).alias("text"))
    return wanted.join(texts, list(LOCATOR))


def dedup_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    state_dir: str | None = None,
    batches: int = 3,
    hot_rows: int = 100_000,
    small_hits: int = 250_000,
) -> DataFrame:
    """One row per row of docs: id, locator, digest, keep_id, group_size, kept.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row with the largest
    id stays (a null id loses to any other; of rows with the same id and text exactly one stays, the one with the
    largest locator). Equal digests of different bytes are told apart. Extra columns are not read. An empty table
    gives an empty result.

    state_dir: where the state is kept for later runs; they count and compare with all rows that ever arrived there (a row at the same
    place with the same digest arrives once). One run at a time; files of earlier runs must still be there, with the same text
    column. batches: micro-batches of a run. A digest of hot_rows rows or more is joined by broadcast (there are at most rows /
    hot_rows of them), so no task gets all of its rows; up to small_hits digests are broadcast as a whole to pick the texts to compare.
    """
    spark, state = docs.sparkSession, state_dir or new_dir(docs.sparkSession, "state")
    placed = located(docs)
    rows = placed.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *LOCATOR)
    rows = rows.select("*", digest(F.col("text")).alias("digest"), F.octet_length("text").alias("n_bytes"))
    places = placed.select(F.col(LOCATOR[0]), F.col("_metadata.file_path").alias("path")).distinct()
    arrivals, run = f"{state}/arrivals", 0
    if exists(spark, arrivals):
        current, _ = store(rows.drop("text"), "arrivals")
        schema = current.withColumn("run", F.lit(0)).schema
        before = spark.read.schema(schema).parquet(arrivals)
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        new = current.join(before.select(*LOCATOR, "digest"), [*LOCATOR, "digest"], "left_anti").select(*current.columns)
        had = set(before.inputFiles())
        new.withColumn("run", F.lit(run)).write.mode("append").parquet(arrivals)
        new_files = len(set(spark.read.schema(schema).parquet(arrivals).inputFiles()) - had)
    else:
        schema = rows.drop("text").withColumn("run", F.lit(0)).schema
        rows.drop("text").withColumn("run", F.lit(0)).write.parquet(arrivals)
        current = spark.read.schema(schema).parquet(arrivals)
        new_files = len(current.inputFiles())
        current = current.drop("run")
    places.write.mode("append").parquet(f"{state}/files")
    _through_state(spark, schema, state, new_files, batches)
    types = dict(current.dtypes)
    place = f"{LOCATOR[0]}:bigint,{LOCATOR[1]}:bigint"
    hit_schema = f"digest {types['digest']}, n_bytes int, best struct<id:{types['id']},{place}>, origin struct<run:int,{place}>, latest int, n bigint"
    if not exists(spark, f"{state}/hits"):
        spark.createDataFrame([], hit_schema).write.parquet(f"{state}/hits/batch=-1")
    hits = spark.read.schema(hit_schema).parquet(f"{state}/hits").groupBy(*KEY)
    hits, _ = store(hits.agg(F.max("best").alias("best"), F.min("origin").alias("origin"), F.max("latest").alias("latest"), F.max("n").alias("n")), "hits")
    hot, cold = F.broadcast(hits.where(F.col("n") >= hot_rows)), hits.where(F.col("n") < hot_rows)
    any_hot, few = not hits.where(F.col("n") >= hot_rows).isEmpty(), hits.count() <= small_hits

    # bytes behind every hit: least and greatest text of each task first, so that a copy in many tasks moves once for each
    keys = lambda h: h.select(*KEY)
    if few:
        parts = [rows.join(F.broadcast(keys(hits)), KEY, "left_semi")]
    else:
        parts = [rows.join(F.broadcast(keys(hot)), KEY, "left_semi"), rows.join(F.broadcast(keys(hot)), KEY, "left_anti").join(keys(cold), KEY, "left_semi")]
    ends = [p.groupBy(*KEY).agg(F.min("text").alias("low"), F.max("text").alias("high")) for p in parts]
    earlier = hits.where((F.col("origin.run") < run) & (F.col("latest") == run)).select(*KEY, *[F.col(f"origin.{c}").alias(c) for c in LOCATOR])
    earlier = _fetched(spark, state, earlier, text_col) if run else None
    if earlier is not None:
        ends.append(earlier.select(*KEY, F.col("text").alias("low"), F.col("text").alias("high")))
    compared = ends[0]
    for e in ends[1:]:
        compared = compared.unionByName(e)
    unequal = compared.groupBy(*KEY).agg((F.min("low") == F.max("high")).alias("same")).where("NOT same")
    clashes, _ = store(unequal.select(*KEY), "clashes")

    def with_hits(h: DataFrame) -> DataFrame:
        return h.select(*KEY, "best", "n")

    if any_hot:
        out = current.join(F.broadcast(with_hits(hot)), KEY).unionByName(current.join(F.broadcast(keys(hot)), KEY, "left_anti").join(with_hits(cold), KEY, "left"))
    else:
        out = current.join(with_hits(hits), KEY, "left")
    out = out.select("id", *LOCATOR, *KEY, F.coalesce("best", F.struct("id", *LOCATOR)).alias("best"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    if not clashes.isEmpty():
        now = rows.join(clashes, KEY, "left_semi").select("id", *LOCATOR, *KEY, "text")
        every = now
        before = spark.read.schema(schema).parquet(arrivals).join(clashes, KEY, "left_semi").join(current.select(*LOCATOR), list(LOCATOR), "left_anti")
        before = _fetched(spark, state, before.select("id", *LOCATOR, *KEY), text_col) if run else None
        if before is not None:
            every = now.unionByName(before.select(*now.columns))
        groups = every.groupBy(*KEY, "text").agg(F.max(F.struct("id", *LOCATOR)).alias("best"), F.count(F.lit(1)).alias("n"))
        exact = now.join(groups, [*KEY, "text"]).select("id", *LOCATOR, *KEY, "best", "n")
        out = out.join(clashes, KEY, "left_anti").unionByName(exact)
    return out.select(
        "id",
        *LOCATOR,
        "digest",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.struct("id", *LOCATOR).eqNullSafe(F.col("best"))).alias("kept"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that repeat another's text; columns and extra columns as they were."""
    rows = located(docs)
    return without(rows, dedup_table(rows, id_col, text_col, **options).where("NOT kept")).select(*docs.columns)
