"""Tables in the folder that driver and executors share, used to cut lineage between supersteps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder is set, under a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_buckets(df: DataFrame, label: str, key: str, n: int) -> tuple[DataFrame, str, str]:
    """df as a table in n buckets of key, its path and its name: joins and groups by key then read it as it lies, without an exchange."""
    spark, path, name = df.sparkSession, new_path(df.sparkSession, label), f"weftgraph_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({df._jdf.schema().toDDL()}) USING parquet CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    df.write.insertInto(name)
    return spark.table(name), path, name


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
