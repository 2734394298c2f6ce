import datetime
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from kvstrata.functions.keys import literal_key, make_key
from kvstrata.operators import documents as D

PERSON = "name string, age int, scores array<int>, address struct<city:string,zip:string>, height double"


def people(spark):
    return spark.createDataFrame([("Alice", 30, [100, 95, 87], Row("NYC", "10001"), 1.5), ("Bob", 25, [], None, None), (None, None, None, Row("X", None), 2.0)], PERSON)


def root():
    return make_key(F.lit("p"), F.coalesce("name", F.lit("none")))


def test_round_trip(spark):
    df = people(spark)
    for dialect in ("go", "csharp"):
        pairs = D.flatten(df, root(), dialect=dialect)
        back = {r.root: r.asDict(True) for r in D.unflatten(pairs, df.schema, dialect).collect()}
        expected = {literal_key("p", r.name or "none"): r.asDict(True) for r in df.collect()}
        assert {bytes(k): {n: v for n, v in r.items() if n != "root"} for k, r in back.items()} == expected


def test_pair_counts_and_markers(spark):
    df = spark.createDataFrame([("Alice", 25, None)], "Name string, Age int, Address struct<City:string,Zip:string>")
    pairs = D.flatten(df, make_key(F.lit("p")), dialect="csharp")
    assert pairs.count() == 3 and bytes(pairs.where("key = root").first()["value"]) == b""
    with_address = spark.createDataFrame([("Alice", 25, Row("NYC", "10001"))], df.schema)
    assert D.flatten(with_address, make_key(F.lit("p"))).count() == 6
    assert D.flatten(with_address, make_key(F.lit("p")), ignore=("Age", "Address")).count() == 2
    renamed = D.flatten(with_address, make_key(F.lit("p")), rename={"Name": "person_name"})
    assert literal_key("p", "person_name") in {bytes(r.key) for r in renamed.collect()}
    assert D.unflatten(renamed, with_address.schema, rename={"Name": "person_name"}).first()["Name"] == "Alice"
    assert D.flatten(df, make_key(F.lit("p")), dialect="rust").count() == 3, "without markers, and every null is a leaf, that of the container too"


def test_nested_arrays(spark):
    df = spark.createDataFrame([([[1, 2], [], [3]], [Row("a", 1), Row("b", 2)])], "m array<array<int>>, s array<struct<k:string,n:int>>")
    back = D.unflatten(D.flatten(df, make_key(F.lit("r"))), df.schema).first()
    assert back["m"] == [[1, 2], [], [3]] and [(x.k, x.n) for x in back["s"]] == [("a", 1), ("b", 2)]


NESTED = "f array<double>, g struct<x:double,y:float,z:struct<w:array<float>>>, n array<int>, m array<array<bigint>>, s array<struct<k:string,d:double>>, t timestamp, e array<string>, o struct<a:int>"


def nested(spark):
    moment = datetime.datetime(2024, 1, 15, 10, 30)
    rows = [
        ([1.5, -0.25, 1e300], Row(2.5, 0.5, Row([1.0, 2.0])), [1, None, 3], [[1], [2**40, -3]], [Row("a", 0.1), Row(None, -1.0)], moment, ["", "é"], Row(1)),
        ([None, 2.0], Row(None, -1.5, None), [None, 7], [None, [5]], [None, Row("b", None)], None, [None, "x"], None),
        (None, None, None, None, None, None, None, Row(None)),
    ]
    return spark.createDataFrame(rows, NESTED).withColumn("i", F.monotonically_increasing_id())


def rebuilt(spark, dialect):
    df = nested(spark)
    key = make_key(F.lit("r"), F.col("i").cast("string"))
    columns = [c for c in df.columns if c != "i"]
    back = D.unflatten(D.flatten(df, key, columns, dialect), df.select(*columns).schema, dialect)
    assert back.drop("root").schema.simpleString() == df.select(*columns).schema.simpleString()
    return [r.asDict(True) for r in back.orderBy("root").drop("root").collect()], [r.asDict(True) for r in df.orderBy("i").drop("i").collect()]


def test_floats_and_nulls_anywhere(spark):
    for dialect in ("go", "csharp"):
        got, expected = rebuilt(spark, dialect)
        assert got == expected


def test_trees_without_markers(spark):
    df = nested(spark).drop("t").withColumn("t", F.lit(None).cast("int"))
    columns = [c for c in df.columns if c not in ("i", "t")]
    back = D.unflatten(D.flatten(df, make_key(F.lit("r"), F.col("i").cast("string")), columns, "rust"), df.select(*columns).schema, "rust")
    assert [r.asDict(True) for r in back.orderBy("root").drop("root").collect()] == [r.asDict(True) for r in df.select(*columns, "i").orderBy("i").drop("i").collect()]
    empty = spark.createDataFrame([([], Row([]), 1)], "a array<int>, b struct<c:array<string>>, d int")
    assert D.unflatten(D.flatten(empty, make_key(F.lit("x")), dialect="rust"), empty.schema, "rust").drop("root").first() == Row(a=None, b=None, d=1)
    pairs = D.flatten(spark.createDataFrame([(None, Row(None))], "a array<int>, b struct<c:string>"), make_key(F.lit("x")), dialect="rust")
    assert sorted((bytes(r.key), bytes(r.value)) for r in pairs.collect()) == [(literal_key("x", "a"), b"\0"), (literal_key("x", "b", "c"), b"\0")]


def test_json_trees(spark):
    docs = ['{"a": 1, "b": {"c": [true, null, "x"], "d": {}}, "e": "s"}', "[1, [2, 3]]", '"scalar"']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    pairs = D.flatten_json(df, make_key(F.col("i").cast("string")), "j")
    got = {bytes(r.root): json.loads(r.json) for r in D.unflatten_json(pairs).collect()}
    assert got == {literal_key(0): {"a": 1, "b": {"c": [True, "x"]}, "e": "s"}, literal_key(1): [1, [2, 3]], literal_key(2): "scalar"}
    maps = D.unflatten_json(D.flatten_json(df.where("i = 1"), make_key(F.lit("x")), "j", markers=False), infer_arrays=False).first()
    assert json.loads(maps["json"]) == {"0": 1, "1": {"0": 2, "1": 3}}


def test_objects_by_prefix(spark):
    kv = spark.createDataFrame([(bytearray(literal_key("u", "1", "n")), bytearray(b"x")), (bytearray(literal_key("u", "2", "n")), bytearray(b"y"))], "key binary, value binary")
    one = D.objects(kv, "u").first()
    assert one["group"] == "u" and {k: bytes(v) for k, v in one["fields"].items()} == {"1.n": b"x", "2.n": b"y"}
    assert {r["group"]: r.n_fields for r in D.objects_by(kv, 2).collect()} == {"u.1": 1, "u.2": 1}
