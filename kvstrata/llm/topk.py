"""Exact top-k inner products with KD-trees per shard.

Vectors become integers floor(256 * x). The row space is cut into at most CELLS cells by median splits fitted on a bounded
sample of SAMPLE rows (the smallest hashes of ids), and every row goes to its cell; a cell of more than SHARD_ROWS rows is
dealt to several shards by hash, so a vector that a large part of all rows repeat fills shards and not one task. In each
shard, median splits on the widest dimension make a balanced tree, and every node has the tight box of what it holds. Trees
are laid out once and stored.

A query goes to its cells in rounds: the one whose box allows the highest score, then a few more, then all others, and only
where the cell's box can still beat the kth score that the rounds before have found. In a shard it goes down the tree best
first: of the nodes it has met it opens the one with the highest bound, until no bound reaches its kth score, which scored
leaves keep raising. A task holds one shard's tree and lets the queries stream by, so neither side is copied for the other.

Exact for every k: a node is left out only if its bound is below the kth score already found, or equals it and all ids below
it are larger than the kth. Products that may pass 2**53 are done in whole numbers of any size.

Defined cases: vectors that are null, or hold null or non-finite components, take no part as query or candidate, nor do
rows with a null id; the candidates of a query are all rows with another id; repeated rows are candidates each. Query rows
of one id are one query: equal ones are asked once, and among different ones a candidate has its best score. Vectors of
other lengths than the query's score with it over the components both have; an empty table gives no rows; other columns are
ignored. A score among the best that doesn't fit a bigint raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.llm.memo import runs
from kvstrata.llm.storage import Scratch

SAMPLE = 8192
CELLS = 1024
SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 128
SCALE = 256
#: How many cells a query has met after each round; the last round takes what is left.
MET = (1, 8)
#: Whole numbers up to here are exact in double precision.
EXACT = float(1 << 53)
#: Components are held within this for bounds; where it matters, products are done in whole numbers.
CLIP = 1e150
ABSENT = -(1 << 63)
LEAST, MOST = ABSENT + 1, (1 << 63) - 1


def fine(vector: str):
    """Whether a vector takes part. NaN and infinities fail the comparison."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf))), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column of finite numbers, cut or padded with zeros to one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(column))
    if (lengths == width).all():
        return flat.reshape(len(column), width).astype(np.float64)
    out = np.zeros((len(column), max(width, lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[:, :width]


def scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -CLIP, CLIP)


def whole(x: float) -> int:
    return int(x) * SCALE if abs(x) >= EXACT else math.floor(x * SCALE)


def laid_out(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Places of the rows of each leaf of a balanced tree; rows of equal values stay in order."""
    leaves = [np.arange(len(x))]
    while leaves and max(map(len, leaves)) > leaf:
        halves = []
        for rows in leaves:
            rows = rows[np.argsort(x[rows, np.ptp(x[rows], axis=0).argmax()], kind="stable")] if x.shape[1] else rows
            halves += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        leaves = halves
    return leaves


class Splits:
    """Median splits of a sample: where each row of the whole table belongs."""

    def __init__(self, x: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.dim, self.at = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        parts = [x]
        for level in range(self.depth):
            halves = []
            for k, part in enumerate(parts):
                node = (1 << level) - 1 + k
                if len(part) and part.shape[1]:
                    self.dim[node] = np.ptp(part, axis=0).argmax()
                    self.at[node] = np.median(part[:, self.dim[node]])
                right = part[:, self.dim[node]] >= self.at[node] if part.shape[1] else np.zeros(len(part), bool)
                halves += [part[~right], part[right]]
            parts = halves

    def cell(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)


class Boxes:
    """Bounds of inner products with what lies in boxes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least_id: np.ndarray):
        self.low, self.high, self.least_id = low, high, least_id
        self.reach = np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0)

    def bounds(self, q: np.ndarray, sums: np.ndarray, at) -> np.ndarray:
        """Highest score of each query in each of the boxes `at`, infinite where doubles may not hold it."""
        found = np.maximum(q, 0) @ self.high[at].T + np.minimum(q, 0) @ self.low[at].T
        return np.where(sums[:, None] * self.reach[at] < EXACT, found, np.inf)


class Tree:
    """A shard: its rows leaf by leaf, and the boxes of all nodes; node n has the children 2n + 1 and 2n + 2."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: np.ndarray):
        self.raw, self.x, self.ids, self.rows = raw, scaled(raw), ids, rows
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        self.starts = np.array([*starts, len(ids)])
        levels = [(np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts), np.minimum.reduceat(ids, starts))]
        while len(levels[0][2]) > 1:
            low, high, least = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), np.minimum(least[::2], least[1::2])))
        self.boxes = Boxes(*(np.concatenate(parts) for parts in zip(*levels, strict=True)))
        self.first_leaf = len(starts) - 1

    def scores(self, raw_q: np.ndarray, q: np.ndarray, sums: np.ndarray, leaf: int) -> np.ndarray:
        a, b = self.starts[leaf], self.starts[leaf + 1]
        safe = sums * self.boxes.reach[self.first_leaf + leaf] < EXACT
        out = np.zeros((len(q), b - a), np.int64)
        out[safe] = (q[safe] @ self.x[a:b].T).astype(np.int64)
        if not safe.all():
            rows = [[whole(v) for v in r] for r in self.raw[a:b].tolist()]
            for k in np.flatnonzero(~safe):
                mine = [whole(v) for v in raw_q[k].tolist()]
                out[k] = [min(max(sum(u * v for u, v in zip(mine, r, strict=True)), LEAST), MOST) for r in rows]
        return out

    def search(self, raw_q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query up to k (scores, ids, rows), best first, ties to the smaller id; ABSENT scores fill up. What is
        worse than (kth, kth_id) isn't wanted."""
        q, m = scaled(raw_q), len(raw_q)
        sums = np.abs(q).sum(1)
        front = np.full((m, len(self.boxes.least_id)), -np.inf)
        front[:, 0] = self.boxes.bounds(q, sums, [0])[:, 0]
        best = np.full((m, k), ABSENT), np.full((m, k), MOST), np.full((m, k), MOST)
        kth, kth_id, active = kth.copy(), kth_id.copy(), np.arange(m)
        while len(active):
            node = front[active].argmax(1)
            bound = front[active, node]
            keep = (bound > -np.inf) & (bound >= kth[active])
            active, node, bound = active[keep], node[keep], bound[keep]
            front[active, node] = -np.inf
            opened = ~((bound == kth[active]) & (self.boxes.least_id[node] > kth_id[active]))
            for one in np.unique(node[opened]):
                some = active[opened & (node == one)]
                if one < self.first_leaf:
                    below = [2 * one + 1, 2 * one + 2]
                    front[np.ix_(some, below)] = self.boxes.bounds(q[some], sums[some], below)
                    continue
                leaf = one - self.first_leaf
                at = slice(self.starts[leaf], self.starts[leaf + 1])
                score = self.scores(raw_q[some], q[some], sums[some], leaf)
                score[own[some][:, None] == self.ids[None, at]] = ABSENT
                wanted = (score > kth[some][:, None]) | (score == kth[some][:, None]) & (self.ids[at] < kth_id[some][:, None]) & (score > ABSENT)
                some, score = some[wanted.any(1)], score[wanted.any(1)]
                if not len(some):
                    continue
                here = score, np.broadcast_to(self.ids[at], score.shape), np.broadcast_to(self.rows[at], score.shape)
                s, i, r = (np.concatenate([old[some], new], axis=1) for old, new in zip(best, here, strict=True))
                line = np.lexsort((r, i, -1 - s), axis=1)[:, :k]
                for old, new in zip(best, (s, i, r), strict=True):
                    old[some] = np.take_along_axis(new, line, 1)
                s, i = best[0][some, -1], best[1][some, -1]
                up = (s > kth[some]) | (s == kth[some]) & (i < kth_id[some])
                kth[some[up]], kth_id[some[up]] = s[up], i[up]
        return best


def cell_boxes(placed: DataFrame, width: int) -> tuple[np.ndarray, Boxes, np.ndarray]:
    """The cells that (id, v, cell) rows are in, their boxes and how many rows each has: CELLS of them at most."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for b in batches:
            x, cell, ids = scaled(matrix(b.column("v"), width)), b.column("cell").to_numpy(), b.column("id").to_numpy()
            for c in np.unique(cell).tolist():
                low, high, least, n = found.get(c, (np.inf, -np.inf, MOST, 0))
                at = cell == c
                found[c] = np.minimum(low, x[at].min(0)), np.maximum(high, x[at].max(0)), min(least, int(ids[at].min())), n + int(at.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([f[i].tobytes() for f in found.values()], pa.binary()) for i in (0, 1)), *(pa.array([f[i] for f in found.values()], pa.int64()) for i in (2, 3))], names=["cell", "low", "high", "least_id", "n"])

    def ends(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(t[c].to_pylist())).reshape(t.num_rows, width) for c in ("low", "high"))

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        low, high = ends(t)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "low": pa.array([low.min(0).tobytes()], pa.binary()), "high": pa.array([high.max(0).tobytes()], pa.binary()), "least_id": [pc.min(t["least_id"]).as_py()], "n": [pc.sum(t["n"]).as_py()]})

    kinds = "cell int, low binary, high binary, least_id bigint, n bigint"
    met = placed.mapInArrow(part, kinds).groupBy("cell").applyInArrow(merge, kinds).toArrow().sort_by("cell")
    return met["cell"].to_numpy(), Boxes(*ends(met), met["least_id"].to_numpy()), met["n"].to_numpy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best rows of `vectors` for each id of `queries`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    kind = vectors.schema[vector_col].dataType.elementType
    kind = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & fine("v")).select("id", F.col("v").cast(kind).alias("v"))

    rows = ready(vectors)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    if n <= SHARD_ROWS:
        known, shards_of = None, spark.createDataFrame([(0, 0, 1)], "cell int, first int, shards int")
        sharded = numbered.select(F.lit(0).alias("cell"), F.lit(0).alias("shard"), "id", "row", "v")
    else:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        splits = spark.sparkContext.broadcast(Splits(scaled(matrix(sample["v"], width)), min(CELLS, n / SHARD_ROWS)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.value.cell(scaled(matrix(b.column("v"), width))).astype(np.int32))], names=["id", "row", "v", "cell"])

        placed = scratch.keep(numbered.select("id", "row", "v").mapInArrow(place, f"id bigint, row bigint, v {kind}, cell int"))
        cells, boxes, sizes = cell_boxes(placed, width)
        known = spark.sparkContext.broadcast((cells, boxes))
        shards = np.ceil(sizes / SHARD_ROWS).astype(int).tolist()
        shards_of = spark.createDataFrame(list(zip(cells.tolist(), [0, *np.cumsum(shards).tolist()], shards, strict=False)), "cell int, first int, shards int")  # CELLS rows at most
        sharded = placed.join(shards_of, "cell").select("cell", (F.col("first") + F.pmod(F.xxhash64("row"), "shards")).cast("int").alias("shard"), "id", "row", "v")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def laid(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            leaves = laid_out(scaled(matrix(t["v"], width)), LEAF_ROWS)
            t = t.take(np.concatenate(leaves)).append_column("leaf", pa.array(np.repeat(np.arange(len(leaves), dtype=np.int32), [len(x) for x in leaves])))
            return t.combine_chunks().to_batches()[0]

        now, parts = None, []
        for (shard,), part in runs(batches, "shard"):
            if shard != now and parts:
                yield laid(parts)
                parts = []
            now = shard
            parts.append(part)
        if parts:
            yield laid(parts)

    planted = scratch.keep(sharded.repartition("shard").sortWithinPartitions("shard", "id", "row").mapInArrow(plant, f"cell int, shard int, id bigint, row bigint, v {kind}, leaf int"))
    asked = scratch.keep(ready(queries).distinct().withColumn("q", F.monotonically_increasing_id()))
    best = None
    for after, until in zip((0, *MET), (*MET, CELLS), strict=True):
        if after and (known is None or after >= len(cells)):
            break

        def route(batches: Iterator[pa.RecordBatch], after: int = after, until: int = until) -> Iterator[pa.RecordBatch]:
            cell, box = known.value
            for b in batches:
                for k_ in range(0, b.num_rows, QUERY_ROWS):
                    part = b.slice(k_, QUERY_ROWS)
                    x = scaled(matrix(part.column("v"), width))
                    bound = box.bounds(x, np.abs(x).sum(1), slice(None))
                    kth, kth_id = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("kth", "kth_id"))
                    line = np.argsort(-bound, axis=1, kind="stable")[:, after:until]
                    bound = np.take_along_axis(bound, line, 1)
                    go = (bound > kth) | (bound == kth) & (box.least_id[line] <= kth_id)
                    at, column = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(cell[line[at, column]].astype(np.int32))], names=[*part.schema.names, "cell"])

        if best is None:
            ready_to_go = asked.withColumns({"kth": F.lit(ABSENT), "kth_id": F.lit(MOST)})
        else:
            kth = best.where(F.col("at") == k).select("q", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
            ready_to_go = asked.join(kth, "q", "left").select("id", "v", "q", F.coalesce("kth", F.lit(ABSENT)).alias("kth"), F.coalesce("kth_id", F.lit(MOST)).alias("kth_id"))
        ready_to_go = ready_to_go.select("id", "v", "q", "kth", "kth_id")
        stay = planted
        if known is None:
            routed = ready_to_go.withColumn("cell", F.lit(0))
        else:
            routed = scratch.keep(ready_to_go.mapInArrow(route, f"id bigint, v {kind}, q bigint, kth bigint, kth_id bigint, cell int"))
            stay = planted.where(F.col("cell").isin([r[0] for r in routed.select("cell").distinct().collect()]))  # CELLS rows at most
        comers = routed.join(shards_of, "cell").withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)))
        comers = comers.select("shard", F.lit(None).cast("int").alias("leaf"), "id", F.col("q").alias("row"), "v", "kth", "kth_id")
        stay = stay.select("shard", "leaf", "id", "row", "v", F.lit(None).cast("bigint").alias("kth"), F.lit(None).cast("bigint").alias("kth_id"))
        # rows of a shard come first, leaf by leaf, then its queries
        both = stay.unionByName(comers).repartition("shard").sortWithinPartitions("shard", F.col("leaf").asc_nulls_last())

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, of, parts = None, None, []
            for (shard, asking), part in runs(batches, "shard", "asking"):
                if shard != of:
                    tree, of, parts = None, shard, []
                if not asking:
                    parts.append(part)
                    continue
                if tree is None:
                    if not parts:
                        continue
                    t = pa.Table.from_batches(parts).combine_chunks()
                    tree, parts = Tree(matrix(t["v"], width), *(t[c].to_numpy() for c in ("id", "row", "leaf"))), []
                for k_ in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(k_, QUERY_ROWS)
                    own, q, kth, kth_id = (some.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row", "kth", "kth_id"))
                    s, i, r = tree.search(matrix(some.column("v"), width), own, k, kth, kth_id)
                    at, column = np.nonzero(s > ABSENT)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[at], q[at], i[at, column], r[at, column], s[at, column])], names=["query_id", "q", "vec_id", "row", "score"])

        found = both.withColumn("asking", F.col("leaf").isNull()).mapInArrow(meet, "query_id bigint, q bigint, vec_id bigint, row bigint, score bigint")
        found = found if best is None else best.drop("at").unionByName(found)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
        was, best = best, scratch.keep(found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k))
        scratch.drop(*(t for t in (routed, was) if hasattr(t, "kept_at")))
    scratch.drop(planted, asked, *([placed] if known else []))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    one = best.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    fits = F.when((F.col("score") == LEAST) | (F.col("score") == MOST), F.raise_error(F.lit("a score doesn't fit a bigint")).cast("bigint")).otherwise(F.col("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))
