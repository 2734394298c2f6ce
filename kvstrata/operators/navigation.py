"""Scans in key order, neighbours and counts over a resolved (key, value) frame."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from kvstrata.functions.keys import decode_parts, decode_strings, has_prefix, literal_key, successor

RANGE_ROWS = 1_000_000
SAMPLED = 20


def prefix_scan(kv: DataFrame, prefix: bytes = b"") -> DataFrame:
    """Rows under a prefix in key order."""
    return kv.where(has_prefix("key", prefix)).orderBy("key")


def range_scan(kv: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Rows with low <= key < high in key order."""
    kv = kv if low is None else kv.where(F.col("key") >= F.lit(bytearray(low)))
    return (kv if high is None else kv.where(F.col("key") < F.lit(bytearray(high)))).orderBy("key")


def peek(log: DataFrame, prefix: bytes = b"", at: bytes = b"") -> DataFrame:
    """The key a cursor under a prefix stands on at `at` or after: the least ever written, whether or not it is visible."""
    found = log.where(has_prefix("key", prefix))
    return (found.where(F.col("key") >= F.lit(bytearray(at))) if at else found).agg(F.min("key").alias("key"))


def skip_prefix(kv: DataFrame, prefix: bytes) -> DataFrame:
    """The first row after all that start with the prefix."""
    after = successor(prefix) if prefix else None
    return (kv.where(F.lit(False)) if after is None else kv.where(F.col("key") >= F.lit(bytearray(after)))).orderBy("key").limit(1)


def query(kv: DataFrame, first_part: str) -> DataFrame:
    """Rows whose first part is `first_part`, their keys as dotted strings."""
    return kv.where(has_prefix("key", literal_key(first_part))).select(F.array_join(decode_strings("key"), ".").alias("path"), "value")


def query_raw(kv: DataFrame, prefix: bytes) -> DataFrame:
    return kv.where(has_prefix("key", prefix)).select("key")


def first_key(kv: DataFrame) -> DataFrame:
    return kv.agg(F.min("key").alias("key"))


def last_key(kv: DataFrame) -> DataFrame:
    return kv.agg(F.max("key").alias("key"))


def next_key(kv: DataFrame, after: bytes) -> DataFrame:
    """The least key above `after`, which needn't exist; null for an empty one."""
    return kv.where((F.col("key") > F.lit(bytearray(after))) & F.lit(bool(after))).agg(F.min("key").alias("key"))


def prev_key(kv: DataFrame, before: bytes) -> DataFrame:
    return kv.where((F.col("key") < F.lit(bytearray(before))) & F.lit(bool(before))).agg(F.max("key").alias("key"))


def _ordered(df: DataFrame, fill: dict[str, tuple[Callable[[str], Column], str, bool]], range_rows: int) -> tuple[DataFrame, WindowSpec]:
    """Adds columns that look along the whole key order without a single-task window. Keys fall into ranges of about
    `range_rows` rows, cut at quantiles of a bounded sample (SAMPLED keys a range, the least hashes of keys, so the cuts are
    the same whenever they are made); each range is one window, and one summary row a range carries values across."""
    ranges = max(1, math.ceil(df.count() / range_rows))
    spread = df.withColumn("__p", F.lit(0))
    if ranges > 1:
        sample = sorted(bytes(r[0]) for r in df.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLED * ranges).collect())
        bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)})

        @F.pandas_udf("int")
        def range_of(keys: pd.Series) -> pd.Series:
            return keys.map(lambda k: bisect_right(bounds, bytes(k)))

        spread = df.withColumn("__p", range_of("key"))
    ends = spread.groupBy("__p").agg(*(f(c).alias(f"__{name}") for name, (f, c, _) in fill.items()))
    carry = []
    for name, (_, _, forward) in fill.items():
        w = Window.orderBy(F.col("__p") if forward else F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
        carry.append(F.last(f"__{name}", ignorenulls=True).over(w).alias(f"__{name}"))
    return spread.join(ends.select("__p", *carry), "__p"), Window.partitionBy("__p").orderBy("key")


def neighbours(kv: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every key with the keys before and after it."""
    placed, inside = _ordered(kv.select("key"), {"prev": (F.max, "key", True), "next": (F.min, "key", False)}, range_rows)
    return placed.select("key", F.coalesce(F.lag("key").over(inside), "__prev").alias("prev_key"), F.coalesce(F.lead("key").over(inside), "__next").alias("next_key"))


def neighbours_of(kv: DataFrame, probes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For every probe key, present or not, the nearest keys strictly before and after it: an as-of lookup by one ordered pass."""
    both = kv.select("key", F.lit(True).alias("own")).unionByName(probes.select("key", F.lit(False).alias("own")))
    both = both.groupBy("key").agg(F.max("own").alias("own"), F.max(~F.col("own")).alias("asked")).withColumn("real", F.when(F.col("own"), F.col("key")))
    placed, inside = _ordered(both, {"prev": (F.max, "real", True), "next": (F.min, "real", False)}, range_rows)
    # both frames grow from the start of an order; one that shrinks towards the end is read anew for every row
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (inside, Window.partitionBy("__p").orderBy(F.desc("key"))))
    found = (F.coalesce(F.last("real", ignorenulls=True).over(w), f"__{name}").alias(f"{name}_key") for name, w in (("prev", before), ("next", after)))
    out = placed.select("key", "asked", *found)
    return out.where("asked").drop("asked")


def count_visible(kv: DataFrame) -> DataFrame:
    return kv.agg(F.count("*").alias("n"))


def count_indexed(log: DataFrame) -> DataFrame:
    """Keys ever written, deleted ones included."""
    return log.agg(F.countDistinct("key").alias("n"))


def count_by_prefix(kv: DataFrame, prefix: bytes) -> DataFrame:
    return kv.where(has_prefix("key", prefix)).agg(F.count("*").alias("n"))


def count_by_part(kv: DataFrame, n: int = 1) -> DataFrame:
    """Keys under each value of the first n parts."""
    group = F.array_join(F.slice(decode_strings("key"), 1, n), ".").alias("group")
    return kv.groupBy(group).agg(F.count("*").alias("n"))


def for_each(kv: DataFrame, visit: Callable[[bytes, bytes], bool | None], prefix: bytes = b"") -> int:
    """Calls visit(key, value) on the driver in key order until it returns False, a partition at a time; gives the calls made."""
    n = 0
    for row in prefix_scan(kv, prefix).toLocalIterator(prefetchPartitions=True):
        n += 1
        if visit(bytes(row["key"]), bytes(row["value"])) is False:
            break
    return n


def subscript_counts(kv: DataFrame) -> DataFrame:
    return kv.select("key", F.size(decode_parts("key")).alias("n_parts"))
