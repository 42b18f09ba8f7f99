"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of their 8 bytes, so they share at least
8 - d positional bytes: the guaranteed minimum of matches. Any two fingerprints with that many matches share
`probe` of them within the first d + probe positions; so the index is kept by sets of `probe` positions out of those, and a
posting list holds the fingerprints with the same bytes there. Pairs from the lists have their shared
positional bytes tallied; pairs that reach the minimum are verified by their differing bits.

A list longer than `long_list` isn't paired up: its members meet at midpoints instead. Each emits the fingerprints
within d // 2 and d - d // 2 bits of it; two fingerprints are d or fewer bits apart exactly if they share
such a point, and members of a point link to its smallest. That is exact too, and linear in the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.components import components
from weftgraph.llm.shared import LOCATOR, located, slices, store, text_or_empty

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, width: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """SimHash of the shingles of width words (bytes without ASCII white space, A-Z lower-cased), repeats included.

    Fewer words: the whole sequence is the one shingle. No word: 0. A bit is set if it is in over half the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    ones = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        part = words[at : at + chunk + width - 1]
        hashes = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(width))))], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(octets[:, k], minlength=256) @ BYTE_BITS
    return int.from_bytes(np.packbits((2 * ones > n).reshape(-1), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows of docs: id, locator, fp (the fingerprint as a signed long)."""
    rows = located(docs).select(F.col(id_col).alias("id"), *LOCATOR, text_or_empty(text_col).alias("text"))

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column(LOCATOR[0]), b.column(LOCATOR[1]), pa.array(fp)], ["id", *LOCATOR, "fp"])

    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, {LOCATOR[0]} bigint, {LOCATOR[1]} bigint, fp bigint")


def octet(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def links(fps: DataFrame, bits: int = 2, probe: int = 4, long_list: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column fp: their components are those of all pairs within bits.

    Pairs from posting lists of up to long_list members are all there; in longer ones members are linked
    through their midpoints, which connects the same fingerprints.
    """
    sets = list(combinations(range(bits + probe), probe))

    def mask(s: tuple[int, ...]) -> int:
        m = sum(0xFF << 8 * p for p in s)
        return m - (1 << 64) if m >= 1 << 63 else m

    keys = F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(mask(s)).cast("long")).alias("octets")) for i, s in enumerate(sets)])
    postings = fps.select("fp", F.explode(keys).alias("key"))
    # lists of one are most, and go before any list is gathered
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes, _ = store(sizes, "posting-sizes")
    short = postings.join(sizes.where(F.col("n") <= long_list), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("members"))
    pairs = short.select(F.posexplode("members").alias("i", "a"), "members").select("a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("b"))
    tally = sum((octet(F.col("a"), p) == octet(F.col("b"), p)).cast("int") for p in range(8))
    near = pairs.where(tally >= 8 - bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).distinct()

    crowded = postings.join(sizes.where(F.col("n") > long_list), "key", "left_semi").select("fp").distinct()

    def flips(k: int) -> list[int]:
        out = [sum(1 << b for b in s) for s in combinations(range(64), k)]
        return [x - (1 << 64) if x >= 1 << 63 else x for x in out]

    half = bits - bits // 2
    around = F.array(*[F.lit(x).cast("long") for k in range(half + 1) for x in flips(k)])
    met = crowded.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = met.select("fp", "point", F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))).alias("off"))
    if bits % 2 == 0:
        first = met.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        through = met.join(first, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    else:  # an odd distance is met by one side at half - 1 and the other at half: the nearer side is the hub
        first = met.where(F.col("off") < half).groupBy("point").agg(F.min("fp").alias("a"))
        through = met.join(first, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.union(through.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, probe: int = 4, long_list: int = 64) -> DataFrame:
    """One row per row of docs: id, locator, fp, component_id.

    component_id is the smallest id that can be reached over links of bits or fewer differing bits, the row's own included. A
    null or empty text has fingerprint 0 and links like any other. A null id is never the smallest unless all of its component
    are null. Repeated rows share a fingerprint and so a component; extra columns are not read; an empty table gives an empty result.
    """
    rows, _ = store(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct, _ = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    linked, _ = store(links(distinct.select("fp"), bits, probe, long_list), "links")
    member = components(linked).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "component_id"), "fp", "left").select("id", *LOCATOR, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (then the smallest locator); a null id only if all are null."""
    rows = located(docs)
    found, _ = store(near_duplicates(rows, id_col, text_col, **options), "components")
    order = F.struct(F.col("id").isNull(), "id", *LOCATOR)
    # pre-aggregated by a fingerprint's component; an all-null component is told apart by its fingerprint's root
    key = [F.col("component_id")]
    best = found.where("component_id IS NOT NULL").groupBy(*key).agg(F.min(order).alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in LOCATOR])
    nameless = found.where("component_id IS NULL").groupBy("fp").agg(F.min(order).alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in LOCATOR])
    return rows.join(best.union(nameless), list(LOCATOR), "left_semi").select(*docs.columns)
