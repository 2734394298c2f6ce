"""Nested rows as key trees and back.

flatten() turns each row into (root, key, value) pairs: a marker for the root, for every struct and for every array, and a
pair for every scalar, its key the root's followed by field names and array indexes. With a known schema the pairs are a
plan-time expression; JSON of any shape goes through an Arrow function.

What trees can't say doesn't come back: null elements at the end of an array (those before others do), and in the rust
dialect, which has no markers, empty containers, which come back as null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.functions.codec import OF_TYPE, decode_as, encode_value
from kvstrata.functions.keys import decode_strings, has_prefix, let, literal_key, part, unsigned

PAIRS = "array<struct<key:binary,value:binary>>"


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _pairs(x: Column, kind: T.DataType, key: Column, dialect: str, rename: dict[str, str], ignore: frozenset[str], at: str = "") -> Column:
    nothing = F.array().cast(PAIRS)
    absent = F.array(_pair(key, F.unhex(F.lit("00")))) if dialect == "rust" else nothing
    if isinstance(kind, (T.StructType, T.ArrayType)):
        marker = nothing if dialect == "rust" else F.array(_pair(key, F.unhex(F.lit("00" if dialect == "go" else ""))))
        if isinstance(kind, T.StructType):
            fields = [(f"{at}.{f.name}".lstrip("."), f) for f in kind.fields]
            inner = [_pairs(x[f.name], f.dataType, F.concat(key, part(F.lit(rename.get(p, f.name)))), dialect, rename, ignore, p) for p, f in fields if p not in ignore]
        else:
            each = F.transform(x, lambda v, i: _pairs(v, kind.elementType, F.concat(key, part(i.cast("string"))), dialect, rename, ignore, at))
            inner = [F.flatten(each)]
        return F.when(x.isNull(), absent).otherwise(F.concat(marker, *inner))
    return F.when(x.isNull(), absent).otherwise(F.array(_pair(key, encode_value(x, OF_TYPE[kind.simpleString()], dialect))))


def flatten(df: DataFrame, root: Column, columns: list[str] | None = None, dialect: str = "go", rename: dict[str, str] | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(root, key, value) pairs of each row. `rename` and `ignore` go by dotted field path. Null scalars are left out, but
    the rust dialect keeps them and writes no markers."""
    names = columns or df.columns
    row = F.struct(*names)
    kind = df.select(*names).schema
    pairs = _pairs(row, kind, F.col("__root"), dialect, rename or {}, frozenset(ignore))
    return df.withColumn("__root", root).select(F.col("__root").alias("root"), F.explode(pairs).alias("pair")).select("root", "pair.key", "pair.value")


def _below(tree: Column, key: Column) -> Column:
    """Keys under another."""
    return F.filter(F.map_keys(tree), lambda k: (F.octet_length(k) > F.octet_length(key)) & (F.substring(k, F.lit(1), F.octet_length(key)) == key))


def _rebuild(tree: Column, kind: T.DataType, key: Column, dialect: str, rename: dict[str, str], at: str = "") -> Column:
    if isinstance(kind, T.StructType):
        fields = [(f"{at}.{f.name}".lstrip("."), f) for f in kind.fields]
        made = F.struct(*(_rebuild(tree, f.dataType, F.concat(key, part(F.lit(rename.get(p, f.name)))), dialect, rename, p).alias(f.name) for p, f in fields))
        return F.when(F.size(_below(tree, key)) > 0 if dialect == "rust" else F.map_contains_key(tree, key), made)
    if isinstance(kind, T.ArrayType):
        first = F.octet_length(key) + 1
        indexes = F.transform(_below(tree, key), lambda k: F.substring(k, first + 1, unsigned(k, first)).cast("string").cast("int"))
        n = F.coalesce(F.array_max(indexes) + 1, F.lit(0))
        items = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: _rebuild(tree, kind.elementType, F.concat(key, part(i.cast("string"))), dialect, rename, at))
        return F.when(n > 0 if dialect == "rust" else F.map_contains_key(tree, key), items)
    return decode_as(F.try_element_at(tree, key), OF_TYPE[kind.simpleString()], dialect).cast(kind)


def unflatten(pairs: DataFrame, schema: T.StructType, dialect: str = "go", rename: dict[str, str] | None = None) -> DataFrame:
    """(root, fields of schema) from (root, key, value) pairs: one row a root, arrays by their indexes. A root's pairs are one
    row, which is a document's unit."""
    trees = pairs.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tree"))
    rename = rename or {}
    made = [_rebuild(F.col("tree"), f.dataType, F.concat(F.col("root"), part(F.lit(rename.get(f.name, f.name)))), dialect, rename, f.name) for f in schema.fields]
    return trees.select("root", *(c.alias(f.name) for c, f in zip(made, schema.fields, strict=True)))


def paths_by(kv: DataFrame, depth: int) -> DataFrame:
    """(group, path, value) of rows with more than `depth` parts: the first ones as a dotted path, and the others."""

    def cut(parts: Column) -> Column:
        return F.struct(F.array_join(F.slice(parts, 1, depth), ".").alias("group"), F.array_join(F.slice(parts, F.lit(depth + 1), F.size(parts)), ".").alias("path"), F.size(parts).alias("n"))

    one = kv.select(F.explode(F.filter(F.array(let(decode_strings("key"), cut)), lambda c: c["n"] > depth)).alias("at"), "value")
    return one.select("at.group", "at.path", "value")


def objects_by(kv: DataFrame, depth: int) -> DataFrame:
    """Rows grouped by their first `depth` parts: the group's key as a dotted path, its field count and fields. An object is
    one row; for groups that may be too large for that, aggregate paths_by()."""
    entry = F.struct("path", "value")
    return paths_by(kv, depth).groupBy("group").agg(F.count("*").alias("n_fields"), F.map_from_entries(F.collect_list(entry)).alias("fields"))


def objects(kv: DataFrame, first_part: str) -> DataFrame:
    """Rows under a first part grouped by it: the group and a map from the rest of the path to the value."""
    return objects_by(kv.where(has_prefix("key", literal_key(first_part))), 1).select("group", "fields")


def to_paths(value: object, path: tuple[str, ...] = (), markers: bool = True) -> Iterator[tuple[tuple[str, ...], object]]:
    """(path, scalar) of a parsed JSON value; containers give (path, Ellipsis) if `markers`."""
    if isinstance(value, (dict, list)):
        if markers:
            yield path, ...
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from to_paths(v, (*path, str(k)), markers)
    elif value is not None or not markers:
        yield path, value


def flatten_json(df: DataFrame, root: Column, json_col: str, markers: bool = True) -> DataFrame:
    """(root, path, scalar) of JSON of any shape: scalars as JSON text, null for a container's marker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, list(p), None if v is ... else json.dumps(v)) for r, t in zip(batch.column("root").to_pylist(), batch.column("json").to_pylist(), strict=True) if t is not None for p, v in to_paths(json.loads(t), (), markers)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.string())], names=["root", "path", "scalar"])

    return df.select(root.alias("root"), F.col(json_col).alias("json")).mapInArrow(run, "root binary, path array<string>, scalar string")


def from_paths(pairs: list[tuple[list[str], object]], infer_arrays: bool) -> object:
    """Nested maps of (path, scalar) pairs; with `infer_arrays`, maps whose keys are all whole numbers become lists."""
    if any(not p for p, _ in pairs) and not any(p for p, _ in pairs):
        return pairs[0][1]
    tree: dict = {}
    for path, value in pairs:
        at = tree
        for k in path[:-1]:
            at = at.setdefault(k, {})
        if path:
            at[path[-1]] = value

    def lists(x: object) -> object:
        if not isinstance(x, dict):
            return x
        x = {k: lists(v) for k, v in x.items()}
        return [x[k] for k in sorted(x, key=int)] if x and all(k.isdecimal() for k in x) else x

    return lists(tree) if infer_arrays else tree


def unflatten_json(pairs: DataFrame, infer_arrays: bool = True) -> DataFrame:
    """(root, json) from flatten_json's rows; a root is one document and is rebuilt in one place."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = [(p, json.loads(s)) for p, s in zip(table["path"].to_pylist(), table["scalar"].to_pylist(), strict=True) if s is not None]
        return pa.table({"root": pa.array([key[0].as_py()], pa.binary()), "json": [json.dumps(from_paths(rows, infer_arrays), sort_keys=True)]})

    return pairs.groupBy("root").applyInArrow(run, "root binary, json string")
