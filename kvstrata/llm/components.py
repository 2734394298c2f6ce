"""Connected components of a distributed graph by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.storage import Scratch


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id reached) that span what the pairs of places (a, b) connect."""
    used, inverse = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(used))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(used))
    return used[other], used[root[other]]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of `edges` (u, v); a component is its smallest node. Loops and null ends don't count.

    A large-star step hangs each node's larger neighbours on the smallest node around it, a small-star step does so for the
    smaller ones; every step keeps the components, and the graph becomes a star on each component's smallest node. Both
    steps are a minimum by key joined back, so a hub is only a large key of a join, which adaptive execution can split.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    seen = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_of == seen or not print_of[0]:
            break
        seen = print_of
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, large)
        now = new
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
