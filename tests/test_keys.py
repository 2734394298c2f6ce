import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvstrata.functions import keys as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def binary(b):
    return F.lit(bytearray(b))


@pytest.mark.parametrize(
    "path, delimiter, expected, back, n",
    [
        ("users/matthew/articles", "/", "057573657273076D6174746865770861727469636C6573", "users/matthew/articles", 3),
        ("a/b/c/d/e/f/g/h", "/", "01610162016301640165016601670168", "a/b/c/d/e/f/g/h", 8),
        ("com.example.method", ".", "03636F6D076578616D706C65066D6574686F64", "com.example.method", 3),
        ("a//b", "/", "0161000162", "a//b", 3),
        ("/a", "/", "000161", "a", 2),
        ("a/", "/", "0161", "a", 1),
        ("", "/", "", "", 0),
        ("é|x", "|", "02C3A90178", "é|x", 2),
    ],
)
def test_split_and_unsplit(spark, path, delimiter, expected, back, n):
    key = K.key_split(F.lit(path), delimiter)
    assert one(spark, F.hex(key)) == expected
    u = one(spark, K.key_unsplit(key, delimiter))
    assert (u["path"], u["n_parts"]) == (back, n)


def test_split_limits(spark):
    assert one(spark, F.transform(K.split_parts(F.lit("x" * 150 + "/" + "y" * 150), "/"), F.octet_length)) == [150]  # the second part would pass 256 bytes
    assert one(spark, F.transform(K.split_parts(F.lit("x" * 300), "/"), F.octet_length)) == [255]
    assert one(spark, F.size(K.split_parts(F.lit("/".join("abcdefghijklmnopqrst")), "/"))) == 16


def test_tuple_lengths_and_subscripts(spark):
    assert one(spark, K.length_prefix_size(F.lit(8))) == 1 and one(spark, K.length_prefix_size(F.lit(200))) == 3
    for n in (0, 1, 127, 128, 255, 256, 300):
        assert one(spark, K.decode_length_prefix(K.length_prefix(F.lit(n)))) == n
        assert bytes(one(spark, K.decode_parts(K.encode_tuple(F.lit("x" * n), F.lit("b")), tuple_format=True))[0]) == b"x" * n
    assert one(spark, F.hex(K.integer_subscript(F.lit(300)))) == "022C01000000000000"
    for n in (0, 300, -1, 2**63 - 1, -(2**63) + 1):
        assert one(spark, K.decode_integer_subscript(K.integer_subscript(F.lit(n)))) == n
    key = K.make_key(F.lit("accounts"), F.lit("user1"), F.lit("txns"), F.lit("1"))
    assert one(spark, K.subscript_count(key)) == 4
    assert [one(spark, K.subscript_offset(key, i)) for i in (0, 1, 2, 4, -1)] == [0, 9, 15, -1, -1]
    assert one(spark, K.subscript_equal(key, 1, "user1")) and not one(spark, K.subscript_equal(key, 9, "user1"))
    assert one(spark, F.hex(K.child(K.make_key(F.lit("users")), F.lit("aaa")))) == "05757365727303616161"
    assert one(spark, K.ancestor(key, 1)) == K.literal_key("accounts")


def test_truncated_and_long_parts_raise(spark):
    for column in (K.decode_parts(F.unhex(F.lit("0561"))), K.make_key(F.lit("x" * 256), strict=True)):
        with pytest.raises(Exception, match="truncated|255"):
            one(spark, column)
    with pytest.raises(ValueError):
        K.literal_key("x" * 256)


def test_successor_and_prefix(spark):
    assert K.successor(b"a\xff\xff") == b"b" and K.successor(b"\xff") is None
    df = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"a\xff", b"b", b"\xff", b"\xffz")], "key binary")
    assert {bytes(r[0]) for r in df.where(K.has_prefix("key", b"a")).collect()} == {b"a", b"a\xff"}
    assert df.where(K.has_prefix("key", b"")).count() == 5 and df.where(K.has_prefix("key", b"\xff")).count() == 2


def test_order_is_length_first(spark):
    names = ["9", "10", "b", "aa", "", "zz", "100"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", K.make_key("n").alias("key"))
    assert [r["n"] for r in df.orderBy("key").collect()] == sorted(names, key=lambda n: (len(n), n))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=12), st.binary(max_size=12), st.binary(max_size=12))
def test_round_trips(spark, parts, a, b):
    key = F.lit(bytearray(K.literal_key(*parts)))
    assert [bytes(p) for p in one(spark, K.decode_parts(key))] == parts
    assert one(spark, K.encode_parts(K.decode_parts(key))) == K.literal_key(*parts)
    n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert one(spark, K.common_prefix_length(binary(a), binary(b))) == n
    assert bytes(one(spark, K.front_decode(K.front_code(binary(a), binary(b)), binary(b)))) == a
    low, high = min(a, b), max(a, b)
    if low < high:
        s = bytes(one(spark, K.minimum_separator(binary(low), binary(high))))
        assert low < s <= high and high.startswith(s)
    assert one(spark, K.compare(binary(a), binary(b))) == (a > b) - (a < b)
