"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products inside cells.

Centroids are fitted on a bounded sample, EACH rows for every cell and SAMPLE at least (those with the smallest hashes of
ids); dense spots among SAMPLE of them become centroids of their own. There are as many cells as give CELL_ROWS rows of a
label to each, CELLS at most, so the sample and the centroids that tasks get are bounded too. Every row is then assigned: to the cell of its nearest centroid, its home, and as a guest to each cell whose
border is nearer than half the distance of two vectors at the limit's angle. Blocks of bounded size of a cell's rows are multiplied with blocks of its home rows. Rows within half the limit's
angle of the centroid are all linked with each other, so they are counted without being multiplied, less those of their own id; that keeps a cell
with a large share of all rows linear. Counts are summed by id, blocks give spanning links, and groups are their components.

A pair is linked only if its own cosine in double precision reaches the limit, and no linked pair is missed: for ends x, y
with homes i, j the gaps x.(ci - cj) and y.(cj - ci) add up to at most |x - y| |ci - cj|, so one of them is within half of
it and that end is a guest of the other's home (tests hold the links against brute force).

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link
with nothing (a null id is kept); rows of one id aren't linked with each other and their links add up; vectors of different
lengths aren't linked; an empty table gives no rows; columns other than id, vector and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.llm.components import connected_components, forest
from kvstrata.llm.storage import Scratch

SAMPLE = 4096
CELLS, EACH = 4096, 16
CELL_ROWS = 4096
BLOCK_ROWS = 2048
LIMIT = 0.93


def units(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors in double precision of a list column whose rows all have `width` finite components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(x: np.ndarray, cells: int, limit: float, rounds: int = 8) -> np.ndarray:
    """Centroids by spherical k-means. Spots with many rows within half the limit's angle are centroids that only those rows move."""
    if not len(x):
        return np.zeros((1, 1))
    near = math.cos(math.acos(limit) / 2)
    few = x[:SAMPLE]
    close = few @ few.T >= near
    fixed, free = [], np.ones(len(few), bool)
    while (n := (close & free).sum(1) * free).max() >= max(16, len(few) // 200):
        members = close[n.argmax()] & free
        fixed.append(few[members].mean(0))
        free &= ~members
    rest = x[np.random.default_rng(7).permutation(len(x))[: max(1, cells - len(fixed))]]
    c = np.concatenate([np.array(fixed).reshape(-1, x.shape[1]), rest])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for _ in range(rounds):
        home = np.concatenate([(x[k : k + SAMPLE] @ c.T).argmax(1) for k in range(0, len(x), SAMPLE)])
        order = np.argsort(home, kind="stable")
        found, first = np.unique(home[order], return_index=True)
        total = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(total, axis=1)
        moved = (found >= len(fixed)) & (size > 1e-9)
        c[found[moved]] = total[moved] / size[moved, None]
    return c


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row; equal labels only are compared."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumns({"width": F.size("v"), "label": F.concat_ws(":", F.size("v"), "label")})
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()
    centres = {}
    for width, n, labels in sizes:
        cells = min(CELLS, max(1, math.ceil(n / max(1, labels) / CELL_ROWS)))
        sample = rows.where(F.col("width") == width).orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, EACH * cells)).select("v").toArrow()
        centres[width] = fit(units(sample["v"], width), cells, limit)
    shared = spark.sparkContext.broadcast(centres)
    near = math.cos(math.acos(limit) / 2) + 1e-9

    def margins(c: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """How much nearer than each other centroid a row of these homes must be to have no link across."""
        apart = np.sqrt(np.maximum(0, 2 - 2 * c[homes] @ c.T))
        return apart * (0.5 * math.sqrt(2 - 2 * limit)) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                c = shared.value[int(width)]
                for k in range(0, part.num_rows, step := max(1, (1 << 20) // len(c))):
                    some = part.slice(k, step)
                    x = units(some.column("v"), int(width))
                    s = x @ c.T
                    home = s.argmax(1)
                    core = s.max(1) >= near
                    there = s.max(1, keepdims=True) - s <= margins(c, home)
                    there[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(there)
                    took = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), pa.array(core[row])], names=[*took.schema.names, "cell", "home", "core"])

    placed = scratch.keep(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("home", T.IntegerType()), T.StructField("core", T.BooleanType())])))
    at_home, probes = F.col("cell") == F.col("home"), (F.col("cell") != F.col("home")) | ~F.col("core")
    cells = placed.groupBy("label", "cell").agg(F.ceil(F.count_if(at_home) / BLOCK_ROWS).cast("int").alias("rights"), F.ceil(F.count_if(probes) / BLOCK_ROWS).cast("int").alias("lefts"), F.count_if(at_home & F.col("core")).alias("cores"), F.min(F.when(at_home & F.col("core"), F.col("id"))).alias("core_id"))
    cells = scratch.keep(cells)
    blocks = placed.join(cells.where("rights > 0 AND lefts > 0"), ["label", "cell"])
    spot = F.xxhash64("id", F.lit(1))
    left = blocks.where(probes).withColumns({"l": F.pmod(spot, "lefts").cast("int"), "r": F.explode(F.sequence(F.lit(0), F.col("rights") - 1))})
    right = blocks.where(at_home).withColumns({"r": F.pmod(spot, "rights").cast("int"), "l": F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))})
    left, right = (d.select("label", "cell", "l", "r", "id", "v", "width", "home", "core") for d in (left, right))
    right = right.toDF(*right.columns)  # columns of its own, as both sides are of one table

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
        if left.num_rows and right.num_rows:
            width, cell = left["width"][0].as_py(), right["cell"][0].as_py()
            c = shared.value[width]
            x, y = units(left["v"], width), units(right["v"], width)
            x_id, y_id = left["id"].to_numpy(), right["id"].to_numpy()
            x_home, y_core = left["home"].to_numpy(), right["core"].to_numpy(zero_copy_only=False)
            linked = (x @ y.T >= limit) & (x_id[:, None] != y_id[None, :])
            guest = x_home != cell
            if guest.any():  # a pair of two cells counts in the lower one, or in the one where it meets at all
                s = y @ c.T
                met = s[:, [cell]] - s <= margins(c, np.array([cell]))
                linked &= ~guest[:, None] | (cell < x_home)[:, None] | ~met[:, x_home].T
            a, b = np.nonzero(linked)
            both = guest[a] | y_core[b]  # other pairs come again with their ends exchanged
            n = np.bincount(a, minlength=len(x))
            m = np.bincount(b[both], minlength=len(y))
            u, root = forest(np.concatenate([x_id, y_id]), a, b + len(x))
            ids = np.concatenate([x_id[n > 0], y_id[m > 0], u])
            out = {"id": ids, "n": np.concatenate([n[n > 0], m[m > 0], np.zeros(len(u), np.int64)]), "root": np.concatenate([ids[: len(ids) - len(u)], root])}
        return pa.table(out)

    keys = ["label", "cell", "l", "r"]
    found = scratch.keep(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "id bigint, n bigint, root bigint"))
    cores = placed.where(at_home & F.col("core")).join(cells.select("label", "cell", "cores", "core_id"), ["label", "cell"])
    cores = cores.groupBy("label", "cell", "id").agg(F.count("*").alias("own"), F.min("cores").alias("cores"), F.min("core_id").alias("root"))
    cores = cores.select("id", (F.col("own") * (F.col("cores") - F.col("own"))).alias("n"), "root")
    found = found.unionByName(cores)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)
    ids = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"))
    out = ids.join(counts, ids["vec_id"] == counts["id"], "left").drop("id").join(groups, ids["vec_id"] == groups["id"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
