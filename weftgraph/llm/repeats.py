"""Removal of repeated passages by prefix-free parsing.

Rolling-hash triggers cut every text into phrases. A trigger is a place whose rolling hash is the least of a stretch that
a window of `length` bytes holds, the leftmost of equal ones; so every window holds a trigger that depends on nothing
but the window, and equal windows hold it at the same place. A phrase is the run of windows with the same trigger; with
the `length` - 1 bytes that follow it is the shortest text that says all about its windows. The dictionary holds
distinct phrases, the parse is the corpus as phrases, each with its place.

Equal phrases decide most windows at once: all but the first place that the parse has for a phrase are repeated as a whole, whatever
they hold. Only first places of different phrases around the same trigger can share some windows and not others.
Those are parsed again with wider triggers, that is into shorter phrases (TRIGGERS); of what is still open the suffix array of the
dictionary is built, by prefix doubling to the depth of `length` bytes, and its equal suffixes are put in the order of their places in
the parse: the corpus order of the windows, as far as removal needs it. As phrases carry the bytes that follow them, no window runs
into the next phrase, so the parse needs no suffix array of its own. Nothing is paired up: each step keeps the least place of a class.

Each step first merges what a batch of documents holds, so a text that a third of the corpus repeats sends one record
for each batch, not for each document; where records meet they are merged as a stream, so the record of a phrase that every batch
has costs no memory. Rows are named by both columns of their locator.

Records meet as hashes: 112 bits of a phrase (48 of its trigger, 64 of its bytes), 128 bits of a window. At 100 TB, with some 3e12
phrases, the expected number of unequal phrases that look equal is 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import LOCATOR, located, new_dir, short_lived_shuffles, text_or_empty

#: Bytes of a trigger in the first parse and in the one of what that leaves open.
TRIGGERS = (32, 88)
CHUNK = 1 << 20
#: Bytes of records that are gathered before they are merged into those of a bucket.
MERGE = 4 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
#: What a row of the working tables holds.
MARKS, WANTED, SUFFIXES, PHRASES = 0, 1, 2, 3  # phrases of the second parse: PHRASES + 1
WORK = "key bigint, row bigint, payload binary, kind int"
PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("file", "<i8"), ("row", "<i8"), ("start", "<u4"), ("n", "<u2"), ("sorted", "?")])
SUFFIX = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("file", "<i8"), ("row", "<i8"), ("start", "<u4")])
RUN = np.dtype([("start", "<u4"), ("n", "<u4")])
LEAST = -(1 << 63)


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest ones first: high ones are mostly zero then, side by side, and compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, at: int, n: int, dtype: str) -> tuple[np.ndarray, int]:
    size = n * np.dtype(dtype).itemsize
    part = np.frombuffer(data, np.uint8, size, at).reshape(-1, n)
    return np.ascontiguousarray(part.T).view(dtype).reshape(-1), at + size


def write_phrases(r: np.ndarray) -> bytes:
    """Phrase records as columns. A document's numbers are written once; of a trigger's hash six bytes, as phrases that only seem to share one do no harm."""
    r = r[np.lexsort((r["start"], r["row"], r["file"], r["doc"]))]
    at = np.flatnonzero(_starts(r["doc"], r["file"], r["row"]))
    counts = np.diff(np.append(at, len(r))).astype("<u4")
    trigger = np.ascontiguousarray(r["trigger"]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    columns = [planes(x) for x in (r["doc"][at], r["file"][at], r["row"][at], counts)] + [trigger] + [planes(r[c]) for c in ("phrase", "start", "n", "sorted")]
    return np.array([len(at), len(r)], "<u4").tobytes() + b"".join(columns)


def read_phrases(data: bytes) -> np.ndarray:
    docs, n = np.frombuffer(data, "<u4", 2).tolist()
    r, at = np.zeros(n, PHRASE), 8
    doc, at = from_planes(data, at, docs, "<i8")
    file, at = from_planes(data, at, docs, "<i8")
    row, at = from_planes(data, at, docs, "<i8")
    counts, at = from_planes(data, at, docs, "<u4")
    r["doc"], r["file"], r["row"] = np.repeat(doc, counts), np.repeat(file, counts), np.repeat(row, counts)
    trigger = np.zeros((n, 8), np.uint8)
    trigger[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    r["trigger"], at = trigger.view("<u8").reshape(-1), at + 6 * n
    for c, kind in (("phrase", "<u8"), ("start", "<u4"), ("n", "<u2"), ("sorted", "?")):
        r[c], at = from_planes(data, at, n, kind)
    return r


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each stretch of width bytes, mixed."""
    n = len(data) - width + 1
    with np.errstate(over="ignore"):
        power, factor, have = data.astype(np.uint64) + np.uint64(1), np.uint64(MULTIPLIER), 1
        h, done = np.zeros(n, np.uint64), 0
        while have <= width:
            if width & have:  # these bytes come next in the stretch
                h = h * factor + power[done : done + n]
                done += have
            if 2 * have <= width:
                power = power[:-have] * factor + power[have:]
            factor, have = factor * factor, have * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def phrases(items: list[tuple[int, int, int, bytes, list[tuple[int, int]]]], length: int, trigger: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records of the phrases in items (doc, file, row, data, runs of windows), and the item of each. Many runs are parsed at a time."""
    low, digest = np.uint64((1 << 24) - 1), xxhash.xxh3_64_intdigest
    todo = [(i, s + at, min(CHUNK, n - at)) for i, (*_, runs) in enumerate(items) for s, n in runs for at in range(0, n, CHUNK)]
    while todo:
        size = taken = 0
        while taken < len(todo) and (not size or size + todo[taken][2] + length <= 2 * CHUNK):
            size += todo[taken][2] + length - 1
            taken += 1
        part, todo = todo[:taken], todo[taken:]
        buffer = b"".join([items[i][3][s : s + n + length - 1] for i, s, n in part])
        n = np.array([x[2] for x in part])
        offset = np.cumsum(n + length - 1) - (n + length - 1)
        # windows that lie in one run, by their place in the buffer
        which = np.repeat(np.arange(len(part)), n)
        window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + offset[which]
        h = rolling_hashes(np.frombuffer(buffer, np.uint8), trigger)
        least = (sliding_min(h & ~low | np.arange(len(h), dtype=np.uint64), length - trigger + 1) & low)[window]
        first = np.flatnonzero(_starts(least, which))
        count, whose = np.diff(np.append(first, len(least))), which[first]
        r = np.zeros(len(first), PHRASE)
        item = np.array([x[0] for x in part])[whose]
        r["trigger"], r["n"] = h[least[first].astype(np.int64)], count
        r["start"] = window[first] - offset[whose] + np.array([x[1] for x in part])[whose]
        for place, name in enumerate(("doc", "file", "row")):
            r[name] = np.array([x[place] for x in items], np.int64)[item]
        begin = window[first]
        r["phrase"] = [digest(buffer[a:z]) for a, z in zip(begin.tolist(), (begin + count + length - 1).tolist())]
        yield r, item


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any key."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Out:
    """Gathers rows of a working table."""

    def __init__(self, buckets: int):
        self.buckets, self.rows = buckets, []

    def marks(self, r: np.ndarray, n: np.ndarray | int = 1) -> None:
        """Windows from the start of each record on, n of them, are repeated."""
        self._by(MARKS, r, n)

    def wanted(self, r: np.ndarray) -> None:
        self._by(WANTED, r, r["n"])

    def _by(self, kind: int, r: np.ndarray, n: np.ndarray | int) -> None:
        if not len(r):
            return
        order = np.lexsort((r["start"], r["row"], r["file"]))
        runs = np.empty(len(r), RUN)
        runs["start"], runs["n"] = r["start"], n
        runs, file, row = runs[order], r["file"][order], r["row"][order]
        at = np.flatnonzero(_starts(file, row))
        for a, z in zip(at.tolist(), [*at[1:].tolist(), len(r)]):
            self.rows.append((kind, int(file[a]), int(row[a]), runs[a:z].tobytes()))

    def dealt(self, kind: int, records: np.ndarray, hashes: np.ndarray) -> None:
        bucket = (hashes >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, records = bucket[order], records[order]
        at = np.flatnonzero(_starts(bucket)) if len(bucket) else np.zeros(0, np.int64)
        for a, z in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
            part = records[a:z]
            self.rows.append((kind, int(bucket[a]), 0, write_phrases(part) if kind >= PHRASES else part.tobytes()))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["key", "row", "payload", "kind"])


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix of data at starts among them, to the depth of length bytes, by prefix doubling; equal ones share a rank.

    Ranks of eight bytes are numbers; pairs of ranks are ranked until two of them cover length bytes. length is 8 or more.
    """
    n, have = len(data), 8
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    rank = np.zeros(n + length, np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | padded[i : i + n + length].astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].reshape(-1).astype(np.int64)
    while 2 * have <= length:
        rank = np.unique(rank[: len(rank) - have] * np.int64(len(rank)) + rank[have:], return_inverse=True)[1].reshape(-1).astype(np.int64)
        have *= 2
    pairs = rank[starts] * np.int64(len(rank)) + rank[starts + (length - have)]
    return np.unique(pairs, return_inverse=True)[1].reshape(-1)


def sort_suffixes(items: list[tuple[int, int, int, bytes, list[tuple[int, int]]]], length: int, out: Out) -> None:
    """The windows of items' runs in the order of a suffix array: mark all but the earliest of equal ones, send on the earliest.

    CHUNK bytes of runs are sorted at a time; what is equal across chunks meets like what is equal across batches.
    """
    todo = [(i, s + at, min(CHUNK, n - at)) for i, (*_, runs) in enumerate(items) for s, n in runs for at in range(0, n, CHUNK)]
    while todo:
        size = taken = 0
        while taken < len(todo) and (not size or size + todo[taken][2] + length <= CHUNK):
            size += todo[taken][2] + length - 1
            taken += 1
        part, todo = todo[:taken], todo[taken:]
        buffer = b"".join([items[i][3][s : s + n + length - 1] for i, s, n in part])
        n = np.array([x[2] for x in part])
        offset = np.cumsum(n + length - 1) - (n + length - 1)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r, window = np.empty(len(inside), SUFFIX), inside + np.repeat(offset, n)
        for place, name in enumerate(("doc", "file", "row")):
            r[name] = np.repeat(np.array([items[i][place] for i, _, _ in part], np.int64), n)
        r["start"] = inside + np.repeat(np.array([x[1] for x in part]), n)
        rank = suffix_ranks(np.frombuffer(buffer, np.uint8), window, length)
        order = np.lexsort((r["start"], r["row"], r["file"], r["doc"], rank))
        first = _starts(rank[order])
        out.marks(r[order[~first]])
        lead = order[first]
        records = r[lead]
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(buffer[w : w + length]) for w in window[lead].tolist()]), "<u8").reshape(-1, 2)
        records["h1"], records["h2"] = digests[:, 0], digests[:, 1]
        out.dealt(SUFFIXES, records, records["h1"])


def parse(items: list[tuple[int, int, int, bytes, list[tuple[int, int]]]], length: int, out: Out, level: int = 0) -> None:
    """Phrases of the runs of a batch: mark repeats, look closer at those that meet here, send on the rest."""
    if level == len(TRIGGERS):
        return sort_suffixes(items, length, out)
    found = list(phrases(items, length, TRIGGERS[level]))
    if not found:
        return None
    r, at = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    del found
    order = _in_order(r, "trigger", "phrase")
    r, at = r[order], at[order]
    first = _starts(r["trigger"], r["phrase"])
    out.marks(r[~first], r["n"][~first])
    r, at = r[first], at[first]
    lead = _starts(r["trigger"])
    group = np.cumsum(lead) - 1
    several = np.bincount(group)[group] > 1
    r["sorted"] = several
    keep = r[lead | ~several]
    out.dealt(PHRASES + level, keep, keep["trigger"])
    open_ = sorted(zip(at[several].tolist(), r["start"][several].tolist(), r["n"][several].tolist()))
    del r, at, keep, order, group
    parse([(*items[i][:4], joined([x[1:] for x in runs])) for i, runs in groupby(open_, key=lambda x: x[0])], length, out, level + 1)
    return None


def _in_order(r: np.ndarray, *keys: str) -> np.ndarray:
    """The order of records by keys, then by their places."""
    return np.lexsort((r["start"], r["row"], r["file"], r["doc"], *[r[k] for k in reversed(keys)]))


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that touch as one."""
    out: list[list[int]] = []
    for s, n in runs:
        if out and out[-1][0] + out[-1][1] == s:
            out[-1][1] += n
        else:
            out.append([s, n])
    return [(s, n) for s, n in out]


class PhraseMeeting:
    """Phrases of one bucket from all batches, merged as they come."""

    read = staticmethod(read_phrases)

    def __init__(self, out: Out):
        self.out, self.held = out, np.empty(0, PHRASE)

    def merge(self, r: np.ndarray) -> None:
        """Mark what isn't the first of its phrase; hold the first, and one that was sorted, which says that its trigger has more phrases."""
        r = np.concatenate([self.held, r])
        r = r[_in_order(r, "trigger", "phrase")]
        first = _starts(r["trigger"], r["phrase"])
        again = r[~first & ~r["sorted"]]
        self.out.marks(again, again["n"])
        more = np.zeros(len(r), bool)
        at = np.flatnonzero(r["sorted"] & ~first)
        more[at[_starts(r["trigger"][at], r["phrase"][at])]] = True
        self.held = r[first | more]

    def close(self) -> None:
        r = self.held
        lead, first = _starts(r["trigger"]), _starts(r["trigger"], r["phrase"])
        group = np.cumsum(lead) - 1
        mixed = np.bincount(group, weights=first | r["sorted"])[group] > 1
        self.out.wanted(r[first & mixed & ~r["sorted"]])


class SuffixMeeting:
    """Windows of one bucket, merged as they come."""

    read = staticmethod(lambda data: np.frombuffer(data, SUFFIX))

    def __init__(self, out: Out):
        self.out, self.held = out, np.empty(0, SUFFIX)

    def merge(self, r: np.ndarray) -> None:
        r = np.concatenate([self.held, r])
        r = r[_in_order(r, "h1", "h2")]
        first = _starts(r["h1"], r["h2"])
        self.out.marks(r[~first])
        self.held = r[first]

    def close(self) -> None:
        pass


def met_in_turn(rows: Iterator[tuple[int, bytes]], meeting: type, out: Out) -> Iterator[None]:
    """Let rows (bucket, payload), in order of their buckets, meet; yields from time to time, when out has something."""
    now, current, waiting, size = None, None, [], 0

    def merge() -> None:
        nonlocal waiting, size
        if waiting:
            current.merge(np.concatenate(waiting))
        waiting, size = [], 0

    for bucket, payload in rows:
        if bucket != now:
            if current:
                merge()
                current.close()
                yield
            now, current = bucket, meeting(out)
        waiting.append(current.read(payload))
        size += waiting[-1].nbytes
        if size >= max(MERGE, current.held.nbytes):
            merge()
            yield
    if current:
        merge()
        current.close()
        yield


def covered(runs: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes under the windows of the runs."""
    r = np.concatenate([np.frombuffer(x, RUN) for x in runs])
    r = r[np.argsort(r["start"], kind="stable")]
    start = r["start"].astype(np.int64)
    end = np.maximum.accumulate(start + r["n"] - 1 + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist()))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, batch_bytes: int = 16 << 20, bucket_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): the rows of docs as id, file, row, text; and for each (file, row) with any, its runs of repeated windows.

    A window (length bytes, more than the triggers have) is repeated if an equal one starts earlier: in a row with a smaller id
    (null the smallest; rows of the same id in a fixed order of their places), or in the same row. Bytes are those of UTF-8. bucket_bytes of text
    go to one bucket, so the buckets grow with the corpus. Ids are integers.
    """
    spark = docs.sparkSession
    rows = located(docs).select(F.col(id_col).cast("long").alias("id"), F.col(LOCATOR[0]).alias("file"), F.col(LOCATOR[1]).alias("row"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 8))

    def batches_of(batches, columns):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                held.append((LEAST if row[0] is None else row[0], *row[1:3], row[3].encode("utf-8", "surrogatepass"), *row[4:]))
                size += len(held[-1][3])
                if size >= batch_bytes:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def first_pass(batches):
        out = Out(buckets)
        for held in batches_of(batches, ("id", "file", "row", "text")):
            parse([(*x, [(0, len(x[3]) - length + 1)]) for x in held if len(x[3]) >= length], length, out)
            yield out.batch()

    def closer(level):
        def run(batches):
            out = Out(buckets)
            for held in batches_of(batches, ("id", "file", "row", "text", "runs")):
                parse([(*x[:4], joined(sorted(tuple(y) for p in x[4] for y in np.frombuffer(p, RUN).tolist()))) for x in held], length, out, level)
                yield out.batch()

        return run

    def meeting(batches):
        """Buckets one after another; rows of other kinds, whose places are below 0, go through."""
        out = Out(buckets)
        through = []

        def dealt():
            nonlocal kind
            for b in batches:
                aside = int(np.count_nonzero(b.column("place").to_numpy() < 0))  # in order, so they come first
                if aside:
                    through.append(b.slice(0, aside).select(["key", "row", "payload", "kind"]))
                    yield None
                b = b.slice(aside)
                if len(b) and kind is None:
                    kind = b.column("kind")[0].as_py()
                for place, payload in zip(b.column("place").to_pylist(), b.column("payload")):
                    yield place, payload.as_buffer()

        kind, source = None, dealt()
        for item in source:
            while through:
                yield through.pop()
            if item is not None:
                every = (x for x in chain([item], source) if x is not None)
                for _ in met_in_turn(every, SuffixMeeting if kind == SUFFIXES else PhraseMeeting, out):
                    while through:
                        yield through.pop()
                    yield out.batch()
        while through:
            yield through.pop()

    def kept(work: DataFrame, label: str) -> DataFrame:
        """Written by kind, so that a reader of one kind opens no other."""
        path = new_dir(spark, label)
        with short_lived_shuffles(spark):
            work.write.partitionBy("kind").parquet(path)
        return spark.read.schema(WORK).parquet(path)

    def met(work: DataFrame, kind: int, label: str) -> DataFrame:
        """Rows of the kind meet by bucket; all others go through the same exchange, spread."""
        aside = F.lit(-1) - F.pmod(F.xxhash64("kind", "key", "row"), F.lit(buckets))
        place = F.when(F.col("kind") == kind, F.col("key")).otherwise(aside)
        dealt = work.select("*", place.alias("place")).repartition(tasks, "place").sortWithinPartitions("place")
        return kept(dealt.mapInArrow(meeting, WORK), label)

    def wanted(work: DataFrame, level: int) -> DataFrame:
        """A closer look at the runs that a meeting left open."""
        runs = work.where(F.col("kind") == WANTED).groupBy(F.col("key").alias("file"), "row").agg(F.collect_list("payload").alias("runs"))
        return kept(rows.join(runs, ["file", "row"]).select("id", "file", "row", "text", "runs").mapInArrow(closer(level), WORK), f"parsed-{level}")

    done = [met(rows.mapInArrow(first_pass, WORK), PHRASES, "met-0")]
    for level in range(1, len(TRIGGERS) + 1):
        done.append(wanted(done[-1], level))
        kind = PHRASES + level if level < len(TRIGGERS) else SUFFIXES
        gathered = done[0].where(F.col("kind") == kind)
        for frame in done[1:]:
            gathered = gathered.union(frame.where(F.col("kind") == kind))
        done.append(met(gathered, kind, f"met-{level}"))
    marks = done[0].where(F.col("kind") == MARKS)
    for frame in done[1:]:
        marks = marks.union(frame.where(F.col("kind") == MARKS))
    return rows, marks.groupBy(F.col("key").alias("file"), "row").agg(F.collect_list("payload").alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, **options) -> DataFrame:
    """One row per row of docs: the id column, n_bytes, n_removed, spans (array of struct start, end in bytes), kept (binary).

    A byte goes if a repeated window covers it (see repeated_spans). Texts shorter than length bytes, empty and null ones stay as they are. Repeated rows: the
    first in the fixed order stays whole, the others go. Extra columns are not read; an empty table gives an empty result.
    """
    rows, runs = repeated_spans(docs, id_col, text_col, length, **options)
    id_type = dict(docs.dtypes)[id_col]

    def cut(batches):
        for b in batches:
            spans, kept, size = [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                gone = covered(runs, length) if runs else []
                at, left = 0, []
                for a, z in gone:
                    left.append(data[at:a])
                    at = z
                left.append(data[at:])
                spans.append([{"start": a, "end": z} for a, z in gone]), kept.append(b"".join(left)), size.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            removed = [n - len(k) for n, k in zip(size, kept)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    joined = rows.join(runs, ["file", "row"], "left").select("id", "text", "runs")
    out = joined.mapInArrow(cut, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_bytes", "n_removed", "spans", "kept")
