from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.functions.codec import decode_object, encode_object
from kvstrata.functions.keys import literal_key, make_key
from kvstrata.plans.store import Config, ConflictError, NotFoundError, Store
from kvstrata.sources.log import append_log, as_log
from kvstrata.streaming.latest import latest, stream_log


def test_life_of_a_store(spark, out):
    s = Store.create(spark, f"{out}/db")
    t1 = s.begin()
    s.set(t1, [(b"aaa", b"1"), (b"bbb", b"2"), (b"ccc", b"")])
    assert s.get(t1, b"aaa") == b"1" and s.count(t1) == 3
    t2 = s.begin()
    assert s.get(t2, b"aaa") is None
    with pytest.raises(ConflictError):
        s.set(t2, [(b"aaa", b"x")])
    t1.commit()
    assert s.get(t2, b"aaa") is None, "running at the begin of t2"
    t3 = s.begin()
    assert (s.first(t3), s.last(t3), s.next(t3, b"aaa"), s.prev(t3, b"aaa")) == (b"aaa", b"ccc", b"bbb", None)
    assert s.get(t3, b"ccc") == b"" and s.get_default(t3, b"zzz", b"d") == b"d" and s.exists(t3, b"ccc")
    s.delete(t3, [b"ccc"])
    assert s.last(t3) == b"bbb" and not s.exists(t3, b"ccc")
    with pytest.raises(NotFoundError):
        s.delete(t3, [b"never"])
    t3.rollback()
    with pytest.raises(ValueError):
        s.set(t3, [(b"k", b"v")])
    t4 = s.begin()
    s.set(t4, [(b"left", b"open")])
    again = Store.open(spark, f"{out}/db")
    t5 = again.begin()
    assert {bytes(r.key) for r in again.scan(t5).collect()} == {b"aaa", b"bbb", b"ccc"}, "rollbacks stay hidden after reopening"
    for key in (b"", b"x" * 257):
        with pytest.raises(ValueError):
            again.set(t5, [(key, b"v")])
    again.set_str(t5, "greeting", "hello world")
    t5.commit()
    assert again.versions(b"ccc").count() == 2
    again.compact()
    assert {bytes(r.key): bytes(r.value) for r in again.snapshot().collect()} == {b"aaa": b"1", b"bbb": b"2", b"ccc": b"", b"greeting": b"hello world"}
    assert again.versions(b"ccc").count() == 1


def test_calls_with_their_own_transaction(spark, out):
    s = Store.create(spark, f"{out}/db", Config(compression="snappy", max_key_size=64, max_transactions=2, page_size=8192))
    s.auto_set(b"k", b"v")
    assert s.auto_get(b"k") == b"v" and s.auto_get(b"none") is None and s.auto_exists(b"k") and s.auto_count() == 1
    assert s.auto_delete(b"k") and not s.auto_delete(b"never") and not s.auto_exists(b"k")
    with pytest.raises(RuntimeError), s.transaction() as txn:
        s.set(txn, [(b"x", b"1")])
        raise RuntimeError
    assert s.active() == [] and s.auto_get(b"x") is None
    again = Store.open(spark, f"{out}/db")
    assert again.config == s.config and again.config.page_size == 8192
    again.begin(), again.begin()
    with pytest.raises(ConflictError, match="as many as may"):
        again.begin()


def test_one_writer_at_a_time(spark, out, monkeypatch):
    s = Store.create(spark, f"{out}/db")
    monkeypatch.setattr("kvstrata.plans.store.LOCK_SECONDS", 0.2)
    with s._alone(), pytest.raises(ConflictError, match="lock"):
        s.begin()
    t = s.begin()
    s.set(t, [(b"a", b"1"), (b"b", b"2")])
    s.set(t, [(b"a", b"3")])
    t.commit()
    seqs = [r.seq for r in s.log.collect()]
    assert len(set(seqs)) == len(seqs) == 3 and s.auto_get(b"a") == b"3"


def test_compaction_leaves_the_old_log_until_the_next(spark, out):
    s = Store.create(spark, f"{out}/db")
    s.auto_set(b"a", b"1")
    before = s.log
    s.compact()
    assert before.count() == s.log.count() == 1 and s.auto_get(b"a") == b"1"
    s.auto_set(b"b", b"2")
    s.compact()
    assert s.auto_count() == 2 and len(list((Path(out) / "db").glob("kv_log*"))) == 2


def test_whole_objects(spark, out):
    s = Store.create(spark, f"{out}/db")
    df = spark.createDataFrame([("a", [1.5, None], (1, "x"), bytearray(b"\x00\xff"), True), ("b", None, None, None, None), ("é", [], (None, ""), bytearray(), False)], "k string, f array<double>, s struct<n:bigint,t:string>, b binary, o boolean")
    with s.transaction() as t:
        s.set_whole(t, df, F.col("k").cast("binary"))
    with s.transaction() as t:
        got = {bytes(r.key).decode(): r.asDict(True) for r in s.get_whole(t, df.select(F.col("k").cast("binary").alias("key")), df.schema).collect()}
    assert {k: {n: v for n, v in r.items() if n != "key"} for k, r in got.items()} == {r.k: r.asDict(True) for r in df.collect()}
    some = T.StructType([T.StructField("o", T.BooleanType()), T.StructField("k", T.StringType()), T.StructField("new", T.IntegerType())])
    stored = spark.createDataFrame(df.select(encode_object(F.struct(*df.columns), df.schema).alias("b")).collect(), "b binary")
    values = stored.select(decode_object(F.col("b"), some).alias("x")).collect()
    assert {(r.x.o, r.x.k, r.x.new) for r in values} == {(True, "a", None), (None, "b", None), (False, "é", None)}
    with pytest.raises(Exception, match="truncated object"):
        spark.range(1).select(decode_object(F.unhex(F.lit("0F0200000001")), some)).collect()


def test_objects(spark, out):
    s = Store.create(spark, f"{out}/db")
    t = s.begin()
    df = spark.createDataFrame([("Alice", 30, ["a", "b"]), ("Bob", 20, [])], "name string, age int, tags array<string>")
    s.set_objects(t, df, make_key(F.lit("person"), F.col("name")))
    roots = spark.createDataFrame([(bytearray(literal_key("person", "Alice")),)], "root binary")
    assert s.get_objects(t, roots, df.schema).drop("root").collect() == [("Alice", 30, ["a", "b"])]
    assert s.shape(t, literal_key("person")) == 1 and s.shape(t, literal_key("person", "Bob")) == 11


def test_stream_of_latest(spark, out):
    def rows(*r):
        df = spark.createDataFrame(r, "k string, s bigint, v string")
        append_log(as_log(df, F.col("k").cast("binary"), F.col("s"), F.lit(1), F.col("v"), F.col("v").isNull()), f"{out}/log")

    rows(("a", 1, "x"), ("b", 2, "y"), ("a", 5, "z"))
    q = latest(stream_log(spark, f"{out}/log")).writeStream.outputMode("update").format("memory").queryName("latest_keys").option("checkpointLocation", f"{out}/cp").start()
    try:
        q.processAllAvailable()
        rows(("a", 3, "late"), ("b", 6, None))
        q.processAllAvailable()
        got = spark.table("latest_keys").orderBy("seq").collect()
        assert [(bytes(r.key), r.seq, r.value and bytes(r.value)) for r in got] == [(b"b", 2, b"y"), (b"a", 5, b"z"), (b"b", 6, None)]
    finally:
        q.stop()
