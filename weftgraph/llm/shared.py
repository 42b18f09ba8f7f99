"""Tables, shared folders and row locators used by every corpus operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is made and set, but only under a local master, where one machine does everything.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


_folders: ContextVar[set[str] | None] = ContextVar("folders", default=None)


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors. Inside scratch() the folder goes at its end."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    if _folders.get() is not None:
        _folders.get().add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Folders that are stored inside go at the end, but those taken out of the set; frames that read the others must be done by then."""
    folders: set[str] = set()
    token = _folders.set(folders)
    try:
        yield folders
    finally:
        _folders.reset(token)
        for path in folders:
            remove_dir(spark, path)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step go when the step ends, so that those of several steps do not add up on disk. Results are the same."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut where a column of texts reaches `most` bytes, so that what is made of a slice stays small; a longer text stands alone."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield b.slice(at, end - at)
            at, done = end, int(ends[end - 1])
    pa.default_memory_pool().release_unused()


LOCATOR = ("__weft_file", "__weft_row")


def located(docs: DataFrame) -> DataFrame:
    """docs with two columns that address a row: a hash of its file and its row number there.

    A frame that isn't a plain Parquet scan is written to the shared folder first. A located frame stays as it is.
    """
    if LOCATOR[0] in docs.columns:
        return docs
    try:
        return docs.select(
            "*",
            F.xxhash64("_metadata.file_path").alias(LOCATOR[0]),
            F.col("_metadata.row_index").alias(LOCATOR[1]),
        )
    except Exception as e:  # the frame has no file metadata
        if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        return located(store(docs, "located")[0])


def text_or_empty(text_col: str = "text"):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _marked(rows: DataFrame, marked: DataFrame, how: str, most: int) -> DataFrame:
    """Located rows with __weft_hit: whether their locators are in marked. Locators are kept as a bit each in words of 64 rows of a file, so there are at most as many words as marked rows, and
    no more than a 64th of all rows. Up to `most` words are broadcast, and no row moves; beyond that both sides are shuffled."""
    word, bit = F.shiftright(LOCATOR[1], 6), F.expr(f"cast({LOCATOR[1]} & 63 as int)")
    words = marked.select(LOCATOR[0], word.alias("__weft_word"), F.expr(f"shiftleft(1L, cast({LOCATOR[1]} & 63 as int))").alias("bit"))
    words, _ = store(words.groupBy(LOCATOR[0], "__weft_word").agg(F.bit_or("bit").alias("__weft_bits")), "marks")
    joined = rows.withColumn("__weft_word", word).join(F.broadcast(words) if words.count() <= most else words.hint("merge"), [LOCATOR[0], "__weft_word"], how)
    hit = F.coalesce(F.call_function("getbit", F.col("__weft_bits"), bit) == 1, F.lit(False))
    return joined.select(*rows.columns, hit.alias("__weft_hit"))


def within(rows: DataFrame, wanted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Located rows whose locators are in wanted; rows don't move unless wanted is in more than `most` words of 64 rows."""
    return _marked(rows, wanted, "inner", most).where("__weft_hit").drop("__weft_hit")


def without(rows: DataFrame, gone: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Located rows but those whose locators are in gone; rows don't move unless gone is in more than `most` words of 64 rows."""
    return _marked(rows, gone, "left", most).where("NOT __weft_hit").drop("__weft_hit")
