"""Adjacency lists as varints: id, number of targets, targets; seven bits a byte, the least first, the top bit set on all but the last."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def encode_varints(numbers: Iterable[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("varints are unsigned")
        while n > 0x7F:
            out.append(0x80 | n & 0x7F)
            n >>= 7
        out.append(n)
    return bytes(out)


def decode_varints(data: bytes) -> Iterable[int]:
    n = shift = 0
    for b in data:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            yield n
            n = shift = 0
    if shift:
        raise ValueError("the data ends inside a number")


def read_varint_splits(spark: SparkSession, path: str) -> DataFrame:
    """id, targets from binary files, each a task."""

    def records(batches):
        import pandas as pd

        for b in batches:
            for data in b["content"]:
                numbers = iter(decode_varints(data))
                rows = [(i, [next(numbers) for _ in range(next(numbers))]) for i in numbers]
                yield pd.DataFrame({"id": [r[0] for r in rows], "targets": [r[1] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, "id bigint, targets array<bigint>")


def decode_backwards(data: bytes) -> Iterable[int]:
    """The numbers from the last to the first: a number ends where the next byte, or none, has its top bit clear before it."""
    end = len(data)
    while end:
        begin = end - 1
        while begin and data[begin - 1] > 0x7F:
            begin -= 1
        yield next(iter(decode_varints(data[begin:end])))
        end = begin


def write_varint_split(spark: SparkSession, path: str, records: Iterable[tuple[int, list[int]]]) -> None:
    """One split of (id, targets) records as a file, on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    try:
        for vertex_id, targets in records:
            out.write(bytearray(encode_varints([vertex_id, len(targets), *targets])))
    finally:
        out.close()
