"""Packing of token sequences: first-fit decreasing on a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import LOCATOR, located, slices, text_or_empty
from weftgraph.llm.tokens import default_vocabulary, encode


class Tournament:
    """Free space of bins 0, 1, 2, ... as the leaves of a tree whose inner nodes hold the largest free space below.

    A bin that was never used has the full capacity, so the leftmost leaf that fits is first fit's choice.
    """

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.node = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        node, i = self.node, 1
        while i < self.size:
            i *= 2
            if node[i] < length:
                i += 1
        bin_, node[i] = i - self.size, node[i] - length
        while i > 1:
            i //= 2
            node[i] = max(node[2 * i], node[2 * i + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length; ties keep their order."""
    tree, out = Tournament(len(lengths), capacity), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.place(lengths[i])
    return out


def plan(lengths: list[int], capacity: int, min_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length).

    Documents are cut into full pieces and a rest. The rests are packed first-fit decreasing. Bins that are left with
    min_cut or more free places are then filled up from the emptiest ones, by cutting; at most one bin stays so empty.
    """
    full = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rests = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for rest, b in zip(rests, first_fit_decreasing([r[2] for r in rests], capacity)):
        bins.setdefault(b, []).append(rest)
    filled = sorted(bins.values(), key=lambda x: -sum(p[2] for p in x))
    free = [capacity - sum(p[2] for p in x) for x in filled]
    give = len(filled) - 1
    for take in range(len(filled)):
        while take < give and free[take] >= min_cut:
            d, s, n = filled[give].pop()
            part = min(n, free[take])
            filled[take].append((d, s, part))
            free[take] -= part
            free[give] += part
            if part < n:
                filled[give].append((d, s + part, n - part))
            if not filled[give]:
                give -= 1
    return full + [x for x in filled if x]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    vocabulary: str | None = None,
    group_bytes: int = 8 << 20,
    min_cut: int = 32,
    seed: int = 17,
    task_groups: int = 16,
) -> DataFrame:
    """One row per piece: the id column, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Each document is its identifiers and then end_id, so an empty or null text is one token; every identifier lies in
    exactly one piece and no sequence is longer than capacity. Documents fall at random (by id and row number, so that
    repeated rows and a hot id spread, and a table packs alike wherever it lies) into groups of about group_bytes of text; the number of groups grows with the
    input, and each is packed alone; a task takes about task_groups of them, one at a time. Rows with the same id are documents of their own. An empty table gives no rows.
    Extra columns are not read.
    """
    path = vocabulary or default_vocabulary()
    id_type = dict(docs.dtypes)[id_col]
    rows = located(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *LOCATOR)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // task_groups))
    chance = F.xxhash64(F.lit(seed), "id", LOCATOR[1])
    dealt = rows.select("id", F.pmod(chance, F.lit(groups)).alias("grp"), chance.alias("uid"), "text")

    def tokenise(batches):
        for b in slices(batches):
            ids = [np.append(encode(t, path), np.uint32(end_id)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grp"), b.column("uid"), pa.array(ids, pa.binary())], ["id", "grp", "uid", "ids"])

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("uid", "ascending"), ("id", "ascending")]).combine_chunks()
        ids = table.column("ids").to_pylist()
        taken, start, length, doc_tokens, seq, offset, cut = [], [], [], [], [], [], []
        for number, pieces in enumerate(plan([len(x) // 4 for x in ids], capacity, min_cut)):
            at = 0
            for d, s, n in pieces:
                taken.append(d), start.append(s), length.append(n), doc_tokens.append(len(ids[d]) // 4)
                seq.append(number), offset.append(at), cut.append(ids[d][4 * s : 4 * (s + n)])
                at += n
        base = (table.column("grp")[0].as_py() << 32) if len(table) else 0
        whole = [pa.array(x, pa.int64()) for x in (start, length, doc_tokens, [base + x for x in seq], offset)]
        columns = [table.column("id").take(pa.array(taken, pa.int64())), *whole[:2], pa.array(cut, pa.binary()), *whole[2:]]
        return pa.table(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    tokens = dealt.mapInArrow(tokenise, f"id {id_type}, grp bigint, uid bigint, ids binary")
    out = tokens.repartition(tasks, "grp").groupBy("grp").applyInArrow(group, f"id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
