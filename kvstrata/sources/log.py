"""Tables of a store, and other tables as version logs.

kv_log   key BINARY, seq BIGINT, txid BIGINT, is_tombstone BOOLEAN, value BINARY: every write, in order of seq
txn_log  txid BIGINT, state STRING: ACTIVE, COMMITTED or ROLLED_BACK
kv       key BINARY, value BINARY: a resolved snapshot
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions.keys import make_key

LOG = "key BINARY, seq BIGINT, txid BIGINT, is_tombstone BOOLEAN, value BINARY"
TXN = "txid BIGINT, state STRING"
KV = "key BINARY, value BINARY"
ACTIVE, COMMITTED, ROLLED_BACK = "ACTIVE", "COMMITTED", "ROLLED_BACK"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def append_log(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    """Appends rows of LOG, each file sorted by key so that row groups can be skipped by key range."""
    rows.select("key", "seq", "txid", "is_tombstone", "value").sortWithinPartitions("key", "seq").write.mode("append").option("compression", compression).parquet(path)


def write_sorted(rows: DataFrame, path: str, *order: str, compression: str = "zstd") -> None:
    """Writes files of disjoint key ranges, sorted inside, for scans by key range."""
    rows.repartitionByRange("key").sortWithinPartitions(*(order or ("key",))).write.mode("overwrite").option("compression", compression).parquet(path)


def as_log(table: DataFrame, key: Column, seq: Column, txid: Column, value: Column, deleted: Column | None = None) -> DataFrame:
    deleted = F.lit(False) if deleted is None else deleted
    return table.select(key.alias("key"), seq.cast("bigint").alias("seq"), txid.cast("bigint").alias("txid"), deleted.alias("is_tombstone"), F.when(~deleted, value.cast("binary")).alias("value"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to one key per user, ten to a transaction; errors are deletes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.concat_ws(":", "event_type", "event_id")
    return as_log(e, make_key(F.lit("user"), F.col("user_id").cast("string")), F.col("event_id"), F.expr("event_id div 10 + 1"), value, F.col("event_type") == "error")


def orders_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(make_key(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("order"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").cast("binary").alias("value"))


def nations_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return both.select(make_key(F.lit("region"), F.col("r_name"), F.lit("nation"), F.col("n_name")).alias("key"), F.col("n_nationkey").cast("string").cast("binary").alias("value"))


def documents_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, language and id. A null text is no value, so such a document has no key."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return d.select(make_key(F.lit("doc"), F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("key"), F.col("text").cast("binary").alias("value"))
