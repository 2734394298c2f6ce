"""A transactional key-value store as two append-only Parquet tables.

Writes append rows to the log; a transaction's fate is one small file appended to txn_log, which is the only thing a commit
writes. Reads are lazy frames over both. Numbers of writes and transactions are given out by drivers, one at a time: who
gives one out holds a lock file, which a file system creates for one only. The log's folder is named in a small file that
compaction replaces in one step, so a crash leaves either the old log or the new one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.functions.codec import decode_object, encode_object
from kvstrata.functions.keys import MAX_KEY
from kvstrata.operators import documents, mvcc, navigation, points
from kvstrata.sources.log import ACTIVE, COMMITTED, LOG, ROLLED_BACK, TXN, append_log, read_log, write_sorted
from kvstrata.sources.shipping import hadoop_path

LOCK_SECONDS = 60.0


class ConflictError(Exception):
    """Another running transaction has written one of the keys."""


class NotFoundError(KeyError):
    """The key was never written."""


@dataclass(frozen=True)
class Config:
    """Options of a store, written when it is created and read when it is opened. The compression of files, the longest key
    and the number of running transactions (0: any) hold; the others describe a paged store, and are kept and not enforced."""

    compression: str = "zstd"
    max_key_size: int = MAX_KEY
    max_transactions: int = 0
    max_versions: int = 64
    max_subscripts: int = 16
    max_record_size: int = 16384
    page_size: int = 4096
    buffer_pages: int = 256
    flags: int = 0


@dataclass
class Transaction:
    store: Store
    txid: int
    active: frozenset[int]
    state: str = ACTIVE

    def commit(self) -> None:
        self.store.end(self, COMMITTED)

    def rollback(self) -> None:
        self.store.end(self, ROLLED_BACK)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None) -> Store:
        """An empty store; what was at the path is overwritten."""
        store = cls(spark, path, config or Config())
        at, files = hadoop_path(spark, store.path)
        files.delete(at, True)
        files.mkdirs(at)
        store._put("config", json.dumps(asdict(store.config)))
        store._put("current", "kv_log")
        for name, schema in (("kv_log", LOG), ("txn_log", TXN)):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store.path}/{name}")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> Store:
        """An existing store, with the options it was created with unless others are given. Transactions that were running
        when it was left are rolled back for good, and a lock that was left behind goes."""
        store = cls(spark, path, config or Config())
        store.config = config or Config(**json.loads(store._text("config")))
        at, files = hadoop_path(spark, f"{store.path}/lock")
        files.delete(at, False)
        running = store.active()
        if running:
            store._note([(t, ROLLED_BACK) for t in running])
        return store

    def _text(self, name: str) -> str:
        at, files = hadoop_path(self.spark, f"{self.path}/{name}")
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Writes a small file whole: under another name, which then replaces it in one step."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        new, files = hadoop_path(self.spark, f"{self.path}/{name}.new")
        out = files.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(new, hadoop_path(self.spark, f"{self.path}/{name}")[0], options)

    @contextmanager
    def _alone(self):
        """Holds the lock file while numbers are given out and used."""
        at, files = hadoop_path(self.spark, f"{self.path}/lock")
        until = time.monotonic() + LOCK_SECONDS
        while True:
            with suppress(Py4JJavaError):  # another has just created it
                if files.createNewFile(at):
                    break
            if time.monotonic() > until:
                raise ConflictError("another writer holds the store's lock")
            time.sleep(0.05)
        try:
            yield
        finally:
            files.delete(at, False)

    @property
    def _log_path(self) -> str:
        return f"{self.path}/{self._text('current')}"

    @property
    def log(self) -> DataFrame:
        return read_log(self.spark, self._log_path)

    @property
    def transactions(self) -> DataFrame:
        """txid and state of every transaction; an end outweighs its begin."""
        told = self.spark.read.schema(TXN).parquet(f"{self.path}/txn_log")
        return told.groupBy("txid").agg(F.when(F.bool_or(F.col("state") == COMMITTED), COMMITTED).when(F.bool_or(F.col("state") == ROLLED_BACK), ROLLED_BACK).otherwise(ACTIVE).alias("state"))

    def _note(self, rows: list[tuple[int, str]]) -> None:
        self.spark.createDataFrame(rows, TXN).coalesce(1).write.mode("append").parquet(f"{self.path}/txn_log")

    def active(self) -> list[int]:
        return [r[0] for r in self.transactions.where(F.col("state") == ACTIVE).select("txid").collect()]

    def begin(self) -> Transaction:
        with self._alone():
            last = self.spark.read.schema(TXN).parquet(f"{self.path}/txn_log").agg(F.max("txid")).first()[0] or 0
            running = self.active()
            if 0 < self.config.max_transactions <= len(running):
                raise ConflictError(f"{len(running)} transactions are running, as many as may")
            self._note([(last + 1, ACTIVE)])
        return Transaction(self, last + 1, frozenset(running))

    @contextmanager
    def transaction(self):
        """A transaction that commits at the end of the block, or is rolled back by an error."""
        txn = self.begin()
        try:
            yield txn
        except BaseException:
            txn.rollback()
            raise
        if txn.state == ACTIVE:
            txn.commit()

    def auto_get(self, key: bytes) -> bytes | None:
        """get() in a transaction of its own, as the following."""
        with self.transaction() as txn:
            return self.get(txn, key)

    def auto_set(self, key: bytes, value: bytes) -> None:
        with self.transaction() as txn:
            self.set(txn, [(key, value)])

    def auto_delete(self, key: bytes) -> bool:
        """Whether the key had ever been written."""
        try:
            with self.transaction() as txn:
                self.delete(txn, [key])
        except NotFoundError:
            return False
        return True

    def auto_exists(self, key: bytes) -> bool:
        with self.transaction() as txn:
            return self.exists(txn, key)

    def auto_count(self) -> int:
        with self.transaction() as txn:
            return self.count(txn)

    def end(self, txn: Transaction, state: str) -> None:
        self._open(txn)
        self._note([(txn.txid, state)])
        txn.state = state

    @staticmethod
    def _open(txn: Transaction) -> None:
        if txn.state != ACTIVE:
            raise ValueError(f"transaction {txn.txid} has ended")

    def _write(self, txn: Transaction, rows: DataFrame) -> None:
        """Appends (key, is_tombstone, value) rows under the transaction."""
        self._open(txn)
        wrong = rows.where(F.col("key").isNull() | ~F.octet_length("key").between(1, self.config.max_key_size))
        if wrong.head(1):
            raise ValueError(f"keys have 1 to {self.config.max_key_size} bytes")
        with self._alone():
            if (running := self.active()) != [txn.txid] and mvcc.conflicts(self.log, rows, txn.txid, running).head(1):
                raise ConflictError("another running transaction has written one of the keys")
            base = (self.log.agg(F.max("seq")).first()[0] or 0) + 1
            append_log(rows.withColumns({"seq": F.lit(base) + F.monotonically_increasing_id(), "txid": F.lit(txn.txid).cast("bigint")}), self._log_path, self.config.compression)

    def set(self, txn: Transaction, rows: DataFrame | Iterable[tuple[bytes, bytes]]) -> None:
        """Writes (key, value) rows. Of rows with one key in a call, the last in the frame's order counts."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary")
        self._write(txn, rows.select("key", F.lit(False).alias("is_tombstone"), "value"))

    def set_str(self, txn: Transaction, key: str, value: str) -> None:
        self.set(txn, [(key.encode(), value.encode())])

    def delete(self, txn: Transaction, keys: DataFrame | Iterable[bytes]) -> None:
        """Deletes keys; one that was never written is an error, one already deleted is not."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
        if keys.join(self.log.select("key"), "key", "left_anti").head(1):
            raise NotFoundError("a key was never written")
        self._write(txn, keys.select("key", F.lit(True).alias("is_tombstone"), F.lit(None).cast("binary").alias("value")))

    def view(self, txn: Transaction, strict: bool = True) -> DataFrame:
        """(key, value) as the transaction sees them. Strict: transactions running at its begin stay hidden; else a lower one shows once it commits. Rollbacks are always hidden."""
        self._open(txn)
        ended = self.transactions.where(F.col("state") != COMMITTED).select("txid")
        if strict and txn.active:
            ended = ended.unionByName(self.spark.createDataFrame([(t,) for t in txn.active], "txid bigint")).distinct()
        return mvcc.visible(self.log, txn.txid, ended)

    def snapshot(self, as_of: int | None = None) -> DataFrame:
        return mvcc.snapshot(self.log, self.transactions, as_of)

    def get(self, txn: Transaction, key: bytes) -> bytes | None:
        found = points.get(self.view(txn), key).head(1)
        return bytes(found[0]["value"]) if found else None

    def get_str(self, txn: Transaction, key: str) -> str | None:
        value = self.get(txn, key.encode())
        return None if value is None else value.decode()

    def get_default(self, txn: Transaction, key: bytes, default: bytes) -> bytes:
        value = self.get(txn, key)
        return default if value is None else value

    def exists(self, txn: Transaction, key: bytes) -> bool:
        return bool(points.get(self.view(txn), key).select("key").head(1))

    def shape(self, txn: Transaction, key: bytes) -> int:
        asked = self.spark.createDataFrame([(bytearray(key),)], "key binary")
        return points.shape(self.view(txn), asked).first()["shape"]

    def scan(self, txn: Transaction, prefix: bytes = b"") -> DataFrame:
        return navigation.prefix_scan(self.view(txn), prefix)

    def count(self, txn: Transaction) -> int:
        return self.view(txn).count()

    def first(self, txn: Transaction) -> bytes | None:
        return self._key(navigation.first_key(self.view(txn)))

    def last(self, txn: Transaction) -> bytes | None:
        return self._key(navigation.last_key(self.view(txn)))

    def next(self, txn: Transaction, after: bytes) -> bytes | None:
        return self._key(navigation.next_key(self.view(txn), after))

    def prev(self, txn: Transaction, before: bytes) -> bytes | None:
        return self._key(navigation.prev_key(self.view(txn), before))

    @staticmethod
    def _key(one: DataFrame) -> bytes | None:
        key = one.first()["key"]
        return None if key is None else bytes(key)

    def versions(self, key: bytes) -> DataFrame:
        """All versions of a key, newest first, whatever became of their transactions."""
        return mvcc.versions(self.log.where(F.col("key") == F.lit(bytearray(key)))).orderBy("n")

    def set_objects(self, txn: Transaction, df: DataFrame, root, **options) -> None:
        """Flattens each row under its root key and writes the pairs. Fields that are gone aren't deleted."""
        self.set(txn, documents.flatten(df, root, **options).select("key", "value"))

    def get_objects(self, txn: Transaction, roots: DataFrame, schema: T.StructType, **options) -> DataFrame:
        """Objects under the root keys, by one range join of roots and keys cut to the roots' lengths."""
        sizes = [r[0] for r in roots.select(F.octet_length("root")).distinct().collect()]
        view = self.view(txn)
        cut = view.select(F.explode(F.array(*(F.substring("key", 1, n) for n in sizes))).alias("root"), "key", "value") if sizes else view.select(F.col("key").alias("root"), "key", "value")
        pairs = cut.join(roots.select("root").distinct(), "root")
        return documents.unflatten(pairs, schema, **options)

    def set_whole(self, txn: Transaction, df: DataFrame, key: Column, columns: list[str] | None = None) -> None:
        """Writes each row as one value under its key."""
        names = columns or df.columns
        value = encode_object(F.struct(*names), df.select(*names).schema)
        self.set(txn, df.select(key.alias("key"), value.alias("value")))

    def get_whole(self, txn: Transaction, keys: DataFrame, schema: T.StructType) -> DataFrame:
        """key and the fields of rows that set_whole() wrote."""
        found = points.multi_get(self.view(txn), keys)
        return found.select("key", decode_object(F.col("value"), schema).alias("row")).select("key", "row.*")

    def compact(self) -> None:
        """Keeps only versions that someone may still read, drops rolled-back work, and writes them as a new log sorted by
        key. The log before the last one goes, so that readers who have begun can end."""
        with self._alone():
            states = self.transactions
            gone = states.where(F.col("state") == ROLLED_BACK).select("txid")
            kept = mvcc.prune(self.log.join(gone, "txid", "left_anti").select(*self.log.columns), self.active())
            old, new = self._text("current"), f"kv_log-{uuid.uuid4().hex[:12]}"
            write_sorted(kept, f"{self.path}/{new}", "key", "seq", compression=self.config.compression)
            self._put("current", new)
        at, files = hadoop_path(self.spark, self.path)
        for entry in files.listStatus(at):
            name = entry.getPath().getName()
            if name.startswith("kv_log") and name not in (old, new):
                files.delete(entry.getPath(), True)
