"""Column functions for sets, maps, hashes and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_of(vertex_id: Column, n: int) -> Column:
    """The partition, of n, that a vertex hashes to."""
    return F.pmod(F.xxhash64(vertex_id), F.lit(n)).cast("int")


def seeded(n: int, *parts: Column, seed: int = 0) -> Column:
    """A number from 0 to n - 1 that looks random but depends only on the parts and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(n)).cast("int")


def set_insert(items: Column, item: Column) -> Column:
    """A sorted array of distinct items with one more."""
    return F.array_sort(F.array_union(items, F.array(item)))


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def set_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def split_at(items: Column, value: Column) -> Column:
    """A sorted set as a struct of its items below the value and the others."""
    return F.struct(F.filter(items, lambda x: x < value).alias("below"), F.filter(items, lambda x: x >= value).alias("rest"))


def set_contains(items: Column, item: Column) -> Column:
    return F.array_contains(items, item)


def delta_encoded(items: Column) -> Column:
    """A sorted set as its first item and the steps to the next, which compress well."""
    return F.transform(items, lambda x, i: F.when(i == 0, x).otherwise(x - items[i - 1]))


def delta_decoded(steps: Column, item_type: str = "bigint") -> Column:
    start = F.array().cast(f"array<{item_type}>")
    return F.aggregate(steps, start, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)).cast(item_type))))


def merge_maps(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Two maps as one; a key that both have gets combine of both values."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(combine(x, y)))


def as_json(*columns: str) -> Column:
    """The columns as a JSON object; NaN becomes null."""
    return F.to_json(F.struct(*[F.when(F.col(c).cast("string") == "NaN", None).otherwise(F.col(c)).alias(c) for c in columns]))


def log_time(at: Column) -> Column:
    """A time as console logs show it."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def bits_of(numbers: Column) -> Column:
    """An array of numbers from 0 to 63 as a set of bits."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))))


def has_bit(bits: Column, number: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, number.cast("int")).bitwiseAND(F.lit(1)) == 1


def numbers_of(bits: Column) -> Column:
    """The numbers in a set of bits, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda x: has_bit(bits, x))
