import random

import pytest

from kvstrata.functions.keys import literal_key
from kvstrata.operators import navigation as N
from kvstrata.operators import points as P
from kvstrata.sources.log import KV


def kv(spark, keys):
    return spark.createDataFrame([(bytearray(k), bytearray(b"v" + k)) for k in keys], KV)


def keys(df, c="key"):
    return [None if r[c] is None else bytes(r[c]) for r in df.collect()]


def test_neighbours_of_one(spark):
    df = kv(spark, [b"bbb", b"aaa", b"ccc"])
    assert keys(N.first_key(df)) == [b"aaa"] and keys(N.last_key(df)) == [b"ccc"]
    assert [keys(N.next_key(df, k))[0] for k in (b"aaa", b"ccc", b"ab", b"")] == [b"bbb", None, b"bbb", None]
    assert [keys(N.prev_key(df, k))[0] for k in (b"ccc", b"aaa", b"ab", b"")] == [b"bbb", None, b"aaa", None]
    assert keys(N.first_key(df.limit(0))) == [None]


def test_scans(spark):
    df = kv(spark, [b"item/1", b"item/2", b"item/3", b"other/1"])
    assert keys(N.prefix_scan(df, b"item/")) == [b"item/1", b"item/2", b"item/3"] and len(keys(N.prefix_scan(df))) == 4
    assert keys(N.range_scan(df, b"item/2", b"other")) == [b"item/2", b"item/3"]
    assert keys(N.skip_prefix(df, b"item/")) == [b"other/1"] and keys(N.skip_prefix(df, b"other")) == []
    seen = []
    assert N.for_each(df, lambda k, v: seen.append(k), b"item/") == 3 and seen == [b"item/1", b"item/2", b"item/3"]
    assert N.for_each(df, lambda k, v: False) == 1
    assert N.count_by_prefix(df, b"item/").first()[0] == 3


def test_prefix_is_pushed_to_the_scan(spark, out):
    kv(spark, [b"a", b"b"]).write.parquet(f"{out}/kv")
    plan = N.prefix_scan(spark.read.parquet(f"{out}/kv"), b"a")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_neighbours_of_all(spark, range_rows):
    rng = random.Random(3)
    have = sorted({bytes(rng.choices(range(256), k=rng.randrange(1, 4))) for _ in range(60)})
    got = {bytes(r.key): (r.prev_key and bytes(r.prev_key), r.next_key and bytes(r.next_key)) for r in N.neighbours(kv(spark, have), range_rows).collect()}
    assert got == {k: (have[i - 1] if i else None, have[i + 1] if i + 1 < len(have) else None) for i, k in enumerate(have)}
    asked = sorted({bytes(rng.choices(range(256), k=rng.randrange(1, 4))) for _ in range(30)} | set(have[:10]))
    got = {bytes(r.key): (r.prev_key and bytes(r.prev_key), r.next_key and bytes(r.next_key)) for r in N.neighbours_of(kv(spark, have), kv(spark, asked), range_rows).collect()}
    assert got == {k: (max((x for x in have if x < k), default=None), min((x for x in have if x > k), default=None)) for k in asked}


def test_neighbours_of_probes_read_a_range_once(spark):
    """A frame that shrinks towards the end of its range is read anew for every row, so that time grows with the square."""
    df = kv(spark, [b"a", b"b"])
    plan = N.neighbours_of(df, df)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_points_and_shape(spark):
    df = kv(spark, [literal_key("a"), literal_key("a", "b"), literal_key("c", "d", "e")])
    asked = kv(spark, [literal_key("a"), literal_key("a", "b"), literal_key("c"), literal_key("c", "d"), literal_key("x")])
    assert {bytes(r.key): r["shape"] for r in P.shape(df, asked).collect()} == {literal_key("a"): 11, literal_key("a", "b"): 10, literal_key("c"): 1, literal_key("c", "d"): 1, literal_key("x"): 0}
    assert {bytes(r.key): r["shape"] for r in P.shape(df, asked, faithful=True).collect()} == {literal_key("a"): 10, literal_key("a", "b"): 10, literal_key("c"): 0, literal_key("c", "d"): 0, literal_key("x"): 0}
    empty = spark.createDataFrame([(bytearray(b"e"), bytearray(b""))], KV)
    wanted = kv(spark, [b"e", b"m"])
    assert {bytes(r.key): bytes(r.value) for r in P.get_default(empty, wanted, b"d").collect()} == {b"e": b"", b"m": b"d"}
    assert {bytes(r.key): r.found for r in P.exists(empty, wanted).collect()} == {b"e": True, b"m": False}
    assert P.value_sizes(empty).first()["size"] == 0 and P.multi_get(empty, wanted).count() == 1


def test_query_by_first_part(spark):
    df = kv(spark, [literal_key("users", "a"), literal_key("users", "b", "c"), literal_key("user", "z")])
    assert sorted(r.path for r in N.query(df, "users").collect()) == ["users.a", "users.b.c"]
    assert len(keys(N.query_raw(df, b"\x05use"))) == 2
    assert {r["group"]: r.n for r in N.count_by_part(df).collect()} == {"users": 2, "user": 1}
