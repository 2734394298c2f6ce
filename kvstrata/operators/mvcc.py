"""Versions: visibility, history, pruning, conflicts and replay over a log.

The newest visible write of a key is the one with the greatest seq, not the greatest txid. Tombstones and values are
looked at only after the newest write is chosen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many transaction ids are a literal list in the plan; more are an anti-join.
LITERAL_IDS = 1000


def without_transactions(log: DataFrame, hidden: Iterable[int] | DataFrame | None, own: int | None = None) -> DataFrame:
    """Rows whose transaction isn't hidden; those of `own` stay. `hidden`: ids, or a frame of txid of any size."""
    if hidden is None:
        return log
    if isinstance(hidden, DataFrame):
        ids = hidden.select("txid") if own is None else hidden.select("txid").where(F.col("txid") != own)
        return log.join(ids, "txid", "left_anti").select(*log.columns)
    ids = sorted(set(hidden) - {own})
    if len(ids) > LITERAL_IDS:
        return without_transactions(log, log.sparkSession.createDataFrame([(i,) for i in ids], "txid bigint"))
    return log.where(~F.col("txid").isin(ids)) if ids else log


def newest(log: DataFrame, wide: bool = False) -> DataFrame:
    """The row of greatest seq of each key. Top-1 ranking is limited before the shuffle, so each task sends one row a key;
    `wide`: only (key, seq) is shuffled to find it, and rows are joined back, which pays where values are long."""
    if wide:
        top = log.groupBy("key").agg(F.max("seq").alias("seq"))
        return log.join(top, ["key", "seq"], "left_semi")
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def visible(log: DataFrame, as_of: int, active: Iterable[int] | DataFrame | None = None, wide: bool = False) -> DataFrame:
    """(key, value) as transaction `as_of` sees them: of each key the newest write with txid <= as_of that isn't of another
    transaction in `active` (running or rolled back), unless that is a delete. Own writes are visible."""
    seen = without_transactions(log.where(F.col("txid") <= as_of), active, own=as_of)
    return newest(seen, wide).where(~F.col("is_tombstone")).select("key", "value")


def snapshot(log: DataFrame, transactions: DataFrame, as_of: int | None = None) -> DataFrame:
    """(key, value) of committed work only; rollbacks stay hidden for good."""
    log = log if as_of is None else log.where(F.col("txid") <= as_of)
    done = transactions.where("state = 'COMMITTED'").select("txid")
    return newest(log.join(done, "txid", "left_semi")).where(~F.col("is_tombstone")).select("key", "value")


def versions(log: DataFrame) -> DataFrame:
    """All versions of every key, numbered from the newest, whoever wrote them: key, n, txid, is_tombstone, value."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.select("key", F.row_number().over(order).alias("n"), "txid", "is_tombstone", "value")


def version_lists(log: DataFrame) -> DataFrame:
    """key and its versions as an array, newest first. One row per key: meant for keys of bounded history."""
    version = F.struct((-F.col("seq")).alias("order"), "txid", "is_tombstone", "value")
    return log.groupBy("key").agg(F.array_sort(F.collect_list(version)).alias("versions")).select("key", F.transform("versions", lambda v: v.dropFields("order")).alias("versions"))


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("n_versions"), F.count_if("is_tombstone").alias("n_deletes"))


def written_by(log: DataFrame, txid: int) -> DataFrame:
    """Keys with a version created by the transaction."""
    return log.where(F.col("txid") == txid).select("key").distinct()


def prune(log: DataFrame, active: Iterable[int] | None = None) -> DataFrame:
    """Versions to keep: the newest of each key, and those that a running transaction may read (not newer than the newest
    running one, of a writer that isn't running)."""
    ids = sorted(set(active or ()))
    newest_of = log.groupBy("key").agg(F.max("seq").alias("seq"))
    if not ids:
        return log.join(newest_of, ["key", "seq"], "left_semi")
    readable = ~F.col("txid").isin(ids) & (F.col("txid") <= ids[-1])
    return log.where(readable).unionByName(log.where(~readable).join(newest_of, ["key", "seq"], "left_semi"))


def conflicts(log: DataFrame, keys: DataFrame, txid: int, active: Iterable[int] | DataFrame) -> DataFrame:
    """(key, holder) of the keys to be written that another running transaction has written."""
    if not isinstance(active, DataFrame):
        active = log.sparkSession.createDataFrame([(i,) for i in active], "txid bigint")
    held = log.join(active.where(F.col("txid") != txid).select("txid"), "txid", "left_semi").select("key", F.col("txid").alias("holder")).distinct()
    return keys.select("key").distinct().join(held, "key")


def lock(held: DataFrame, keys: DataFrame, txid: int, exclusive: bool = True) -> DataFrame:
    """(key, granted) of the locks a transaction asks for, without waiting. `held`: (txid, key, exclusive) of all locks. One
    that the transaction holds already, in whatever mode, is granted; else none is that meets another transaction's lock on
    the key, unless both are shared."""
    on = held.groupBy("key").agg(F.bool_or(F.col("txid") == txid).alias("own"), F.bool_or((F.col("txid") != txid) & (F.col("exclusive") | F.lit(exclusive))).alias("met"))
    return keys.select("key").distinct().join(on, "key", "left").select("key", F.coalesce(F.col("own") | ~F.col("met"), F.lit(True)).alias("granted"))


def locked(held: DataFrame, keys: DataFrame, txid: int, exclusive: bool = True) -> DataFrame:
    """All locks after lock(): those granted that the transaction didn't hold are new, in the mode asked for."""
    new = lock(held, keys, txid, exclusive).where("granted").select(F.lit(txid).cast("bigint").alias("txid"), "key", F.lit(exclusive).alias("exclusive"))
    return held.select("txid", "key", "exclusive").unionByName(new.join(held.where(F.col("txid") == txid).select("key"), "key", "left_anti").select("txid", "key", "exclusive"))


def unlocked(held: DataFrame, txid: int) -> DataFrame:
    """All locks after a transaction has let go of its own."""
    return held.where(F.col("txid") != txid)


def replay(records: DataFrame) -> DataFrame:
    """State after recovery from (kind, txid, key, value, lsn): of each key the last UPDATE or DELETE of a committed transaction."""
    committed = records.where("kind = 'COMMIT'").select("txid").distinct()
    work = records.where("kind IN ('UPDATE', 'DELETE')").join(committed, "txid", "left_semi")
    log = work.select("key", F.col("lsn").alias("seq"), "txid", (F.col("kind") == "DELETE").alias("is_tombstone"), "value")
    return newest(log).where(~F.col("is_tombstone")).select("key", "value")


def next_txid(records: DataFrame) -> DataFrame:
    return records.where("kind = 'COMMIT'").agg((F.coalesce(F.max("txid"), F.lit(0)) + 1).alias("next_txid"))
