"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand together. The driver proposes boundaries, one
aggregation counts the exact bytes and rows below all of them, and the probes are refined between the nearest two until
each shard's splitter is within the tolerance of its target, for all splitters in the same rounds. Splitters fall between
groups of equal texts; only a group that keeps a splitter from its tolerance is itself split. The driver holds no more
than MOST_PROBES new boundaries a round, or seven a shard.

Inside a shard the ranges that tasks sort are equal parts of its hash values, RANGE_BYTES on average. A range that a large
group of equal texts makes much longer is dealt to more ranges by id. Exact row counts of the ranges, added up in each
shard, give their first slots, and the rows are exchanged once, to their range, where they are numbered in order.

Defined cases: a null text counts as empty and groups with nulls; a null id is an id like others; rows equal in text and id
stay together; an empty table gives no rows; a text longer than a shard makes that shard as long as it is; other columns
stay whatever their names, but for those of the result, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.llm.storage import Scratch, unused

ROW_BYTES = 16
RANGE_BYTES = 64 << 20
TOLERANCE = 0.001
MOST_PROBES = 20_000
HALF = 1 << 63
TOP = 1 << 128
#: A boundary between two text hashes: its id part is zero.
GROUP = 1 << 64


def halves(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries as signed text and id hashes, in whose order they rise."""
    return np.array([(b >> 64) - HALF for b in bounds], np.int64), np.array([(b & (GROUP - 1)) - HALF for b in bounds], np.int64)


def below(bounds: tuple[np.ndarray, np.ndarray], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many of the rising boundaries are at or below each (h, g)."""
    first, last = np.searchsorted(bounds[0], h, "left"), np.searchsorted(bounds[0], h, "right")
    tied = np.flatnonzero(last > first)
    if len(tied):
        order = tied[np.argsort(first[tied], kind="stable")]
        cuts = [0, *(np.flatnonzero(np.diff(first[order])) + 1).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some, k = order[a:b], first[order[a]]
            last[some] = k + np.searchsorted(bounds[1][k : last[some[0]]], g[some], "right")
    return last


class Known:
    """Boundaries, rising, with the exact bytes and rows below each."""

    def __init__(self, total: int, count: int):
        self.keys, self.bytes, self.rows = [0, TOP], np.array([0, total]), np.array([0, count])

    def around(self, targets: np.ndarray) -> np.ndarray:
        """The boundary at or before each target, of which the next one is past it."""
        return np.clip(np.searchsorted(self.bytes, targets, "right") - 1, 0, len(self.keys) - 2)

    def nearest(self, targets: np.ndarray) -> np.ndarray:
        k = self.around(targets)
        return k + (self.bytes[k + 1] - targets < targets - self.bytes[k])

    def open(self, targets: np.ndarray, tolerance: float) -> np.ndarray:
        """Targets from which the nearest boundary is too far, with several rows up to the next."""
        k = self.around(targets)
        far = np.abs(self.bytes[self.nearest(targets)] - targets) > tolerance
        return targets[far & (self.rows[k + 1] - self.rows[k] > 1)]

    def probes(self, targets: np.ndarray, step: int) -> list[int]:
        """New boundaries, multiples of `step`, that part the intervals of the targets evenly."""
        where = np.unique(self.around(targets)).tolist()
        each = max(7, min(4095, MOST_PROBES // max(1, len(where))))
        found = []
        for k in where:
            lo, hi = self.keys[k] // step, -(-self.keys[k + 1] // step)
            found += sorted({lo + (hi - lo) * j // (each + 1) for j in range(1, each + 1)} - {lo, hi})
        return [p * step for p in found]

    def add(self, keys: list[int], total: np.ndarray, rows: np.ndarray) -> None:
        joined = sorted(zip([*self.keys, *keys], [*self.bytes.tolist(), *total.tolist()], [*self.rows.tolist(), *rows.tolist()], strict=True))
        self.keys = [k for k, _, _ in joined]
        self.bytes, self.rows = np.array([b for _, b, _ in joined]), np.array([n for _, _, n in joined])


def histogram(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of (h, g, size) rows below each probe."""
    bounds = halves(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            h, g, size = (b.column(c).to_numpy() for c in ("h", "g", "size"))
            place = below(bounds, h, g)
            rows += np.bincount(place, minlength=len(rows))
            np.add.at(total, place, size)
        k = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k]), pa.array(rows[k])], names=["bin", "bytes", "rows"])

    found = keys.select("h", "g", "size").mapInArrow(run, "bin bigint, bytes bigint, rows bigint").groupBy("bin").agg(F.sum("bytes"), F.sum("rows")).toArrow()
    total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    k = found[0].to_numpy()
    total[k], rows[k] = found[1].to_numpy(), found[2].to_numpy()
    return np.cumsum(total)[:-1], np.cumsum(rows)[:-1]


def splitters(count_below, shards: int, total: int, count: int) -> list[int]:
    """The shards - 1 boundaries, rising. `count_below` gives bytes and rows below each of a list of rising boundaries."""
    tolerance = total / shards * TOLERANCE
    targets = total * np.arange(1, shards) / shards
    known = Known(total, count)
    for step in (GROUP, 1):
        while new := known.probes(known.open(targets, tolerance), step):
            known.add(new, *count_below(new))
    return [known.keys[k] for k in known.nearest(targets)]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The frame's rows with size (bytes of the text plus ROW_BYTES), shard and slot; columns of these names are replaced."""
    scratch = Scratch(docs.sparkSession, "sharding")
    docs = docs.drop("size", "shard", "slot")
    own = docs.columns
    h, g, bin_, part, at = unused(own, "h", "g", "bin", "part", "at")
    docs = docs.withColumns({"size": F.coalesce(F.octet_length(text_col).cast("bigint"), F.lit(0)) + ROW_BYTES, h: F.xxhash64(text_col), g: F.xxhash64(F.col(id_col).cast("bigint"))})
    keys = scratch.keep(docs.select(F.col(h).alias("h"), F.col(g).alias("g"), "size"))
    count, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    found = splitters(lambda probes: histogram(keys, probes), shards, total, count) if count else []
    per_shard = max(1, math.ceil(total / shards / RANGE_BYTES))
    known = docs.sparkSession.sparkContext.broadcast((halves(found), halves([0, *found])[0].astype(float), halves([*(f for f in found), TOP - 1])[0].astype(float)))

    @F.pandas_udf("shard int, bin int")
    def place(h: pd.Series, g: pd.Series) -> pd.DataFrame:
        bounds, low, high = known.value
        k = below(bounds, h.to_numpy(), g.to_numpy())
        share = (h.to_numpy().astype(float) - low[k]) / np.maximum(high[k] - low[k], 1)
        return pd.DataFrame({"shard": k.astype(np.int32), "bin": np.clip((share * per_shard).astype(np.int32), 0, per_shard - 1)})

    def ranged(df: DataFrame, h: str, g: str, parts: DataFrame) -> DataFrame:
        df = df.withColumn(at, place(h, g)).withColumns({"shard": F.col(f"{at}.shard"), bin_: F.col(f"{at}.bin")}).drop(at)
        many = F.coalesce(F.col("__parts"), F.lit(1)) if "__parts" in parts.columns else F.lit(1)
        return df.join(parts, ["shard", bin_], "left").withColumn(part, F.pmod(F.xxhash64(g), many).cast("int")).drop("__parts")

    binned = keys.withColumn(at, place("h", "g"))
    sizes = binned.groupBy(F.col(f"{at}.shard").alias("shard"), F.col(f"{at}.bin").alias(bin_)).agg(F.ceil(F.sum("size") / RANGE_BYTES).cast("int").alias("__parts"))
    parts = scratch.keep(sizes.where(F.col("__parts") > 2))
    ranges = ranged(keys.select("h", "g"), "h", "g", parts).groupBy("shard", bin_, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy(bin_, part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = scratch.keep(ranges.select("shard", bin_, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")))
    scratch.drop(keys)
    inside = Window.partitionBy("shard", bin_, part).orderBy(h, g, F.col(id_col))
    placed = ranged(docs, h, g, parts).repartition(max(1, ranges.count()), "shard", bin_, part).join(ranges, ["shard", bin_, part])
    slot = F.col("__first") + F.row_number().over(inside) - 1
    return placed.withColumn("slot", slot).select(*own, "size", "shard", "slot")
