"""Sorted-string-table shards: documents keyed by identifier, as token identifiers.

A shard is one file, a run of sections that each end with the byte 0x0A:

- data blocks of about block_bytes. An entry is: varint shared (bytes of its key that the entry before has too),
  varint unshared, varint value length, the unshared key bytes, the value. Every restart_every-th entry shares nothing;
  the block ends with the offsets of those entries (uint32 each) and their number (uint32).
- the index: for each block varint key length, its last key, varint offset, varint length.
- a Bloom filter: its bits, then the number of hashes (one byte).
- the footer, FOOTER: index offset and length, filter offset and length, entries, identifiers, shard number, first key, last key, MAGIC.

Beside the shards lies `_index`, a Parquet table with a row for each: its file and what its footer says. Readers need no footers then, and a
look-up opens only the shards whose keys can hold what is looked for.

A key is one flag byte and the identifier as big-endian uint64 with the sign bit turned, so bytes sort as numbers do,
null (flag 0) first. A value is one width byte (2 or 4) and the identifiers in so many little-endian bytes.

Spark's own text writer writes the sections as raw bytes, which gives atomic commits, survives lost executors and
works on every file system that Spark knows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.shared import slices, text_or_empty
from weftgraph.llm.tokens import default_vocabulary, encode

MAGIC = b"WEFTSST2"
FOOTER = struct.Struct("<7Q9s9s8s")
#: Bytes of identifiers that a reader holds before it passes them on.
HELD = 4 << 20


def read_footer(data: bytes) -> tuple:
    return FOOTER.unpack(data)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def decode_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def encode_value(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def decode_value(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _bits(key_hash: int, hashes: int, bits: int) -> list[int]:
    low, high = key_hash & 0xFFFFFFFF, key_hash >> 32 | 1
    return [(low + i * high) % bits for i in range(hashes)]


class Writer:
    """Sections of one shard, from entries in ascending order of keys. Holds one block and 8 bytes for each key."""

    def __init__(self, shard: int, block_bytes: int = 64 << 10, restart_every: int = 16, bits_per_key: int = 10, hashes: int = 7):
        self.shard, self.block_bytes, self.restart_every, self.bits_per_key, self.hashes = shard, block_bytes, restart_every, bits_per_key, hashes
        self.at = self.entries = self.ids = 0
        self.index, self.key_hashes, self.first = bytearray(), [], bytes(9)
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0

    def _section(self, body: bytes) -> bytes:
        self.at += len(body) + 1
        return body

    def _close_block(self) -> Iterator[bytes]:
        if self.n:
            body = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            self.index += varint(len(self.last)) + self.last + varint(self.at) + varint(len(body))
            yield self._section(body)
            self.final = self.last
            self._new_block()

    def add(self, key: bytes, value: bytes, n_ids: int) -> Iterator[bytes]:
        shared = 0
        if self.n % self.restart_every:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.key_hashes.append(xxhash.xxh64_intdigest(key))
        if not self.entries:
            self.first = key
        self.last, self.n = key, self.n + 1
        self.entries, self.ids = self.entries + 1, self.ids + n_ids
        if len(self.block) >= self.block_bytes:
            yield from self._close_block()

    def close(self) -> Iterator[bytes]:
        last = self.last
        yield from self._close_block()
        last = last or (self.final if self.entries else bytes(9))
        index_at, index = self.at, bytes(self.index)
        yield self._section(index)
        bits = max(64, -(-len(self.key_hashes) * self.bits_per_key // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        h = np.array(self.key_hashes, np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        for i in range(self.hashes):
            bloom[((low + np.uint64(i) * high) % np.uint64(bits)).astype(np.int64)] = 1
        body = np.packbits(bloom, bitorder="little").tobytes() + bytes([self.hashes])
        filter_at = self.at
        yield self._section(body)
        yield FOOTER.pack(index_at, len(index), filter_at, len(body), self.entries, self.ids, self.shard, self.first, last, MAGIC)


class Shard:
    """Reads a shard's bytes, which may be a view."""

    def __init__(self, data: bytes | memoryview):
        self.data = data
        index_at, index_len, filter_at, filter_len, self.entries, self.ids, self.number, self.first, self.last, magic = FOOTER.unpack(data[-FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.filter = data[filter_at : filter_at + filter_len]
        self.last_keys, self.blocks = [], []
        at = index_at
        while at < index_at + index_len:
            n, at = read_varint(data, at)
            self.last_keys.append(bytes(data[at : at + n]))
            offset, at = read_varint(data, at + n)
            length, at = read_varint(data, at)
            self.blocks.append((offset, length))

    def _entry(self, at: int, before: bytes) -> tuple[bytes, bytes | memoryview, int]:
        shared, at = read_varint(self.data, at)
        unshared, at = read_varint(self.data, at)
        size, at = read_varint(self.data, at)
        key = before[:shared] + self.data[at : at + unshared]
        at += unshared
        return key, self.data[at : at + size], at + size

    def _restarts(self, block: int) -> tuple[int, int, np.ndarray]:
        offset, length = self.blocks[block]
        n = int.from_bytes(self.data[offset + length - 4 : offset + length], "little")
        end = offset + length - 4 * (n + 1)
        return offset, end, np.frombuffer(self.data, "<u4", n, end)

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            at, end, _ = self._restarts(block)
            key = b""
            while at < end:
                key, value, at = self._entry(at, key)
                yield key, value

    def may_hold(self, key: bytes) -> bool:
        bits = (len(self.filter) - 1) * 8
        return all(self.filter[b >> 3] >> (b & 7) & 1 for b in _bits(xxhash.xxh64_intdigest(key), self.filter[-1], bits))

    def get(self, key: bytes) -> list[bytes]:
        """Values of all entries with this key: filter, then binary search over index and restarts."""
        out: list[bytes] = []
        if not self.may_hold(key):
            return out
        block = bisect_left(self.last_keys, key)
        while block < len(self.blocks):
            offset, end, restarts = self._restarts(block)
            low = max(0, bisect_left(restarts, key, key=lambda r: self._entry(offset + int(r), b"")[0]) - 1)
            at, now = offset + int(restarts[low]), b""
            while at < end:
                now, value, at = self._entry(at, now)
                if now == key:
                    out.append(bytes(value))
                elif now > key:
                    return out
            block += 1
        return out


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    vocabulary: str | None = None,
    shard_bytes: int = 32 << 20,
    most_shards: int = 1_000_000,
) -> None:
    """Write docs as shards to path, in ascending order of id over all shards (part files in order of their names).

    A null or empty text is end_id alone. A null id sorts first; rows with the same id stand beside each other, by a hash of their
    text; many of them are spread over several shards, as ranges are cut by both. An empty table gives shards without entries. Extra columns are not read. The number
    of shards grows with the text, a shard for shard_bytes of it, up to most_shards, which then hold more each; a shard is written as a stream, so a very long text holds one block in memory. Ids are integers.
    """
    vocab = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        writer = Writer(TaskContext.get().partitionId())

        def rows_of(sections: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sections, pa.binary())], ["section"])

        for b in slices(batches):
            ready: list[bytes] = []
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(encode(text, vocab), np.uint32(end_id))
                ready += writer.add(encode_key(doc_id), encode_value(ids), len(ids))
                if len(ready) >= 64:
                    yield rows_of(ready)
                    ready = []
            if ready:
                yield rows_of(ready)
        yield rows_of(list(writer.close()))

    # ordered before encoding: the sampling for the ranges then costs a scan, not a second encoding
    order = [F.col("id").asc_nulls_first(), "spread"]
    ordered = rows.select("*", F.xxhash64("text").alias("spread")).repartitionByRange(max(1, min(most_shards, -(-total // shard_bytes))), *order)
    ordered = ordered.sortWithinPartitions(*order, "text").select("id", "text")
    ordered.mapInArrow(run, "section binary").select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    _write_index(docs.sparkSession, path)


def _shards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(path)


def _write_index(spark: SparkSession, path: str) -> None:
    """A row for each shard in _index, from the footers; only those leave the JVM."""

    def footers(batches):
        for b in batches:
            rows = [(f, *read_footer(d)[4:9]) for f, d in zip(b.column("file").to_pylist(), b.column("footer").to_pylist()) if d]
            kinds = [("file", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("shard", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    found = _shards(spark, path).select(F.col("path").alias("file"), F.substring("content", -FOOTER.size - 1, FOOTER.size).alias("footer"))
    found.mapInArrow(footers, INDEX).write.parquet(f"{path}/_index")


INDEX = "file string, entries bigint, ids bigint, shard bigint, first binary, last binary"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard: file, entries, ids, shard, first and last key, start (identifiers in the shards before it)."""
    shards = spark.read.schema(INDEX).parquet(f"{path}/_index")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as files
    return shards.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))


def lookup(spark: SparkSession, path: str, ids: list[int | None]) -> DataFrame:
    """Rows (doc_id, ids) of the documents with these identifiers: index, then filter and binary search in the shards that can hold them.

    ids are a request's, so they go out with the tasks. An identifier that isn't there gives no row, one that is there twice gives two.
    """
    keys = sorted({encode_key(i) for i in ids})
    near = [r["file"] for r in read_index(spark, path).where("entries > 0").select("file", "first", "last").toLocalIterator() if (at := bisect_left(keys, bytes(r["first"]))) < len(keys) and keys[at] <= bytes(r["last"])]
    schema = "doc_id bigint, ids binary"
    if not near:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                shard = Shard(memoryview(content.as_buffer()).cast("B"))
                found = [(k, v) for k in keys if shard.first <= k <= shard.last for v in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([decode_key(k) for k, _ in found], pa.int64()), pa.array([decode_value(v).tobytes() for _, v in found], pa.binary())], ["doc_id", "ids"])

    return _shards(spark, near).select("content").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the shards at path: doc_id, shard, start (identifiers before it in all shards), n_tokens, ids (binary, little-endian uint32)."""

    def entries(batches):
        for b in batches:
            for content in b.column("content"):
                data = memoryview(content.as_buffer()).cast("B")
                if not len(data):
                    continue
                shard, start, rows, size = Shard(data), 0, [], 0
                for key, value in shard.scan():
                    ids = decode_value(value)
                    rows.append((decode_key(key), shard.number, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += ids.nbytes
                    if size >= HELD or len(rows) >= 4000:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    kinds = [("doc_id", pa.int64()), ("shard", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    found = _shards(spark, path).select("content").mapInArrow(entries, "doc_id bigint, shard bigint, start bigint, n_tokens bigint, ids binary")
    starts = read_index(spark, path).select("shard", F.col("start").alias("base"))  # most_shards rows at most
    return found.join(F.broadcast(starts), "shard").select("doc_id", "shard", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
