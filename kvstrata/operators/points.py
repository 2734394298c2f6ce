"""Lookups of many keys at once, existence and the shape of nodes. `kv` is a resolved (key, value) frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.functions.keys import part_spans


def get(kv: DataFrame, key: bytes) -> DataFrame:
    return kv.where(F.col("key") == F.lit(bytearray(key))).select("key", "value")


def multi_get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Found keys with their values; Spark picks the join by the size of `keys`."""
    return keys.select("key").distinct().join(kv.select("key", "value"), "key")


def get_default(kv: DataFrame, keys: DataFrame, default: bytes) -> DataFrame:
    """Every asked key with its value, or the default where it is absent. An empty value is present."""
    found = kv.select("key", "value", F.lit(True).alias("__found"))
    value = F.when(F.col("__found"), F.col("value")).otherwise(F.lit(bytearray(default)))
    return keys.select("key").distinct().join(found, "key", "left").select("key", value.alias("value"))


def exists(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Every asked key and whether it has a value; values aren't read."""
    found = kv.select("key", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def value_sizes(kv: DataFrame) -> DataFrame:
    return kv.select("key", F.octet_length("value").cast("bigint").alias("size"))


def nodes(kv: DataFrame) -> DataFrame:
    """Every key and every ancestor of one, with its shape: 10 value, 1 children, 11 both. One pass: a key stands for itself
    and for all its proper prefixes, and each distinct node is aggregated once."""
    ends = F.transform(part_spans("key"), lambda s: s["at"] + s["size"] - 1)
    spread = kv.select("key", F.explode(ends).alias("end")).select(F.substring("key", F.lit(1), F.col("end")).alias("key"), (F.col("end") == F.octet_length("key")).cast("int").alias("own"))
    return spread.groupBy("key").agg((10 * F.max("own") + F.max(1 - F.col("own"))).alias("shape"))


def shape(kv: DataFrame, keys: DataFrame, faithful: bool = False) -> DataFrame:
    """Shape of each asked key, 0 if there is no such node. `faithful`: children aren't told, so 0 or 10. Of the stored keys
    only the prefixes as long as an asked key are looked at, one row for each prefix that is asked for."""
    if faithful:
        return exists(kv, keys).select("key", F.when(F.col("found"), 10).otherwise(0).alias("shape"))
    asked = keys.select("key").distinct()
    lengths = asked.agg(F.array_sort(F.collect_set(F.octet_length("key"))).alias("lengths"))  # MAX_KEY of them at most
    spread = kv.select("key").crossJoin(F.broadcast(lengths)).select(F.col("key").alias("stored"), F.explode(F.filter("lengths", lambda n: n <= F.octet_length("key"))).alias("n"))
    spread = spread.select(F.substring("stored", F.lit(1), F.col("n")).alias("key"), (F.col("n") == F.octet_length("stored")).cast("int").alias("own"))
    found = spread.groupBy("key").agg((10 * F.max("own") + F.max(1 - F.col("own"))).alias("shape"))
    return asked.join(found, "key", "left").select("key", F.coalesce("shape", F.lit(0)).alias("shape"))


def key_only(kv: DataFrame) -> DataFrame:
    return kv.select("key")
