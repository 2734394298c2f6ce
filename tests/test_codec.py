import datetime
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kvstrata.functions.codec import decode_as, decode_value, encode_value


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x, kind):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    "value, spark_type, kind, expected",
    [
        (True, "boolean", "bool", "0101"),
        (False, "boolean", "bool", "0100"),
        (42, "int", "i32", "062A000000"),
        (-1, "bigint", "i64", "08FFFFFFFFFFFFFFFF"),
        (4294967295, "bigint", "u32", "07FFFFFFFF"),
        (-2, "int", "i16", "04FEFF"),
        (255, "int", "u8", "02FF"),
        (-128, "int", "i8", "0380"),
        (65535, "int", "u16", "05FFFF"),
        (1.5, "float", "f32", "0A0000C03F"),
        (3.14, "double", "f64", "0B1F85EB51B81E0940"),
        ("", "string", "string", "0C"),
        ("é", "string", "string", "0CC3A9"),
        ("", "binary", "bytes", "0D00000000"),
        (None, "string", "string", "00"),
        (None, "int", "null", "00"),
    ],
)
def test_bytes(spark, value, spark_type, kind, expected):
    assert one(spark, F.hex(encode_value(lit(value, spark_type), kind))) == expected


def test_integers_come_back(spark):
    limits = {"i8": (-128, 127), "u8": (0, 255), "i16": (-32768, 32767), "u16": (0, 65535), "i32": (-(2**31), 2**31 - 1), "u32": (0, 2**32 - 1), "i64": (-(2**63), 2**63 - 1), "u64": (0, 2**64 - 1)}
    asked = [(kind, n) for kind, ends in limits.items() for n in (*ends, 0)]
    rows = spark.createDataFrame([(k, kind, Decimal(n)) for k, (kind, n) in enumerate(asked)], "k int, kind string, n decimal(20,0)")
    coded = F.coalesce(*(F.when(F.col("kind") == kind, encode_value(F.col("n"), kind)) for kind in limits))
    found = rows.select("k", decode_value(coded)["int"].alias("n")).collect()
    assert [r.n for r in sorted(found)] == [n for _, n in asked]


def test_floats_come_back(spark):
    df = spark.createDataFrame([(0.1,), (-0.0,), (1e308,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(decode_value(encode_value(F.col("x"), "f64"))["float"]).collect()]
    assert got[:4] == [0.1, -0.0, 1e308, math.inf] and math.copysign(1, got[1]) < 0 and math.isnan(got[4]) and got[5] is None


@pytest.mark.parametrize("kind, number, code", [("f64", "double", "d"), ("f32", "float", "f")])
def test_float_bits(spark, kind, number, code):
    """Every exponent, the ends of every format, and random patterns, against the machine's own."""
    rng = random.Random(1)
    width, fraction = struct.calcsize(code), {"d": 52, "f": 23}[code]
    patterns = [e << fraction | f for e in range(1 << (8 * width - 1 - fraction)) for f in (0, 1, (1 << fraction) - 1, rng.getrandbits(fraction))]
    patterns = [p | s << (8 * width - 1) for p in patterns for s in (0, 1)]
    values = [struct.unpack(f"<{code}", p.to_bytes(width, "little"))[0] for p in patterns]
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {number}")
    coded = df.select("i", "x", encode_value(F.col("x"), kind).alias("b"))
    for r in coded.select("i", "b", decode_as(F.col("b"), kind).alias("back")).collect():
        x = values[r.i]
        if math.isnan(x):
            assert math.isnan(r.back)
        else:
            assert bytes(r.b)[1:] == struct.pack(f"<{code}", x) and r.back == x and math.copysign(1, r.back) == math.copysign(1, x)


def test_decode_as_takes_any_number(spark):
    b = lambda v, k: encode_value(F.lit(v), k)
    assert one(spark, decode_as(b(-3, "i16"), "i64")) == -3 and one(spark, decode_as(b(2**63 - 1, "u64"), "u64")) == 2**63 - 1
    assert one(spark, decode_as(b(1.5, "f32"), "f64")) == 1.5 and one(spark, decode_as(b("x", "string"), "i64")) is None
    assert one(spark, decode_as(F.unhex(F.lit("00")), "string")) is None and one(spark, decode_as(F.unhex(F.lit("")), "f64")) is None
    assert one(spark, F.transform(F.array(F.lit(0.1), F.lit(-2.5)), lambda x: decode_as(encode_value(x, "f64"), "f64"))) == [0.1, -2.5]


def test_dialects(spark):
    t = F.timestamp_micros(F.lit(1705314600000000))
    assert one(spark, F.hex(encode_value(t, "datetime", "csharp"))) == "0E008457EDB415DC08"
    assert one(spark, F.hex(encode_value(t, "datetime", "go"))) == "0E009049F3977EAA17"
    for d in ("go", "csharp"):
        assert one(spark, decode_value(encode_value(t, "datetime", d), d)["time"]) == datetime.datetime(2024, 1, 15, 10, 30)
    guid = F.lit(bytearray(range(16)))
    assert one(spark, F.hex(encode_value(guid, "guid", "csharp"))) == "0F" + bytes(range(15, -1, -1)).hex().upper()
    assert bytes(one(spark, decode_value(encode_value(guid, "guid", "csharp"), "csharp")["guid"])) == bytes(range(16))
    assert one(spark, F.hex(encode_value(F.lit("ab"), "string", "rust"))) == "0C020000006162"
    assert one(spark, decode_value(encode_value(F.lit("ab"), "string", "rust"), "rust")["string"]) == "ab"
    with pytest.raises(ValueError):
        encode_value(guid, "guid", "rust")


def test_wrong_input(spark):
    with pytest.raises(Exception, match="unknown value tag"):
        one(spark, decode_value(F.unhex(F.lit("7F00"))))
    assert one(spark, decode_value(F.unhex(F.lit("")))) is None
    with pytest.raises(Exception, match="empty value"):
        one(spark, decode_value(F.unhex(F.lit("")), "csharp"))
