"""MinHash near-duplicates of documents with SetSketch registers.

A document's set is its distinct 5-word shingles. Register i keeps the least of exponentially distributed values h_i over
the set, truncated and spaced exponentially with base BASE; registers of a union are the maxima of registers. BANDS bands
of ROWS registers each are hashed, and documents that share a band are candidates: at similarity 0.75 a pair shares none
with probability (1 - 0.75**ROWS)**BANDS, under 3e-7. Documents with equal sets are one node from the start.

In a band's bucket every node is paired with the smallest one, its centre, so a bucket of any size gives as many pairs as
nodes. A pair's similarity is estimated jointly from both sketches and both set sizes by maximum likelihood; pairs whose
estimate is more than SLACK under the limit (six deviations) go, and all others are confirmed on the full sets, which are made
where the texts are read; no text is shuffled. A centre's
sketch and set go once to each task that holds some of its partners, PARTNERS at most, not once a pair.

After these links, only nodes of one centre that are still in different groups can matter. The largest group of a centre's
nodes isn't compared with itself, so where most copies are linked already, the work grows with the few that aren't. All
others are compared on their full sets in blocks of at most about BLOCK nodes and BLOCK_SHINGLES shingles, by products of
incidence matrices inside a task; a block pair gives back only links that span what it connects. So no pairs of a family
are ever rows, and what is sent is arrays of hashes, once for each block that a node's own block meets. Copies none of
which are linked, most of whose pairs are just under the limit, cost products with the square of their number and are
sent (their number / BLOCK) times: exact components need each of those pairs excluded.

Sets are compared as sets of 64-bit hashes of shingles, so two shingles of one pair of documents with equal hashes would
count as one: less than one pair in 10**9, even of documents with 20,000 shingles each.

Defined cases: null texts and texts without words have the empty set and link with nothing; with fewer words than a shingle
has, all of them are one; a row with a null id is kept and links with nothing; rows of one id are one document with the
links of all of them; very long texts are one row and are handled whole; an empty table gives no rows; columns other than
id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.components import connected_components, forest
from kvstrata.llm.langid import text_bytes
from kvstrata.llm.memo import slices, tidy
from kvstrata.llm.shingles import LOWER, inside, mix, windows, word_hashes, words
from kvstrata.llm.storage import Scratch

SHINGLE = 5
LIMIT = (75, 100)
BANDS, ROWS = 56, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
SLACK = 0.17
PARTNERS = 4096
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
COLUMNS = 1024
#: Bytes of texts, sketches or sets (or of one longer one) that a task works on at a time.
SLICE = 1 << 19
#: Bits of a bitmap for each id it holds, and the power of two that it has at most (16 MB).
ID_BITS, MAP_BITS = 32, 27
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sets(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one set after another and rising in each, and the sets' sizes."""
    data, offsets = text_bytes(text.fill_null(""))
    data = LOWER[data]
    begin, end, counts = words(data, offsets)
    hashes = word_hashes(data, begin, end)
    at = inside(counts, shingle)
    n = np.diff(counts)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - shingle + 1, 0))
    value = windows(hashes, shingle)[at]
    few = np.flatnonzero((n > 0) & (n < shingle))
    if len(few):
        short = np.array([windows(hashes[counts[k] : counts[k + 1]], int(n[k]))[0] for k in few], np.uint64)
        doc, value = np.concatenate([doc, few]), np.concatenate([value, short])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(n))


def registers(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set: an element's values are a Poisson process whose points fall on random registers, so
    only the points up to a time at which all registers are filled almost surely are drawn, again with more time if not."""
    least = np.full(len(sizes) * REGISTERS, np.inf)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    time = (np.log(REGISTERS) + 8) / np.maximum(sizes, 1)
    open_ = sizes > 0
    while open_.any():
        mine = open_[doc]
        state, d = values[mine], doc[mine]
        x, most = np.zeros(len(d)), time[d]
        while len(d):
            state = mix(state + _GOLD)
            x = x - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / REGISTERS
            keep = np.flatnonzero(x <= most)
            state, d, x, most = state[keep], d[keep], x[keep], most[keep]
            place = ((mix(state ^ _GOLD) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, d * REGISTERS + place, x)
        open_ &= np.isinf(least.reshape(-1, REGISTERS)).any(1)
        time[open_] *= 2
    level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, level), 0, 65535).astype("<u2").reshape(-1, REGISTERS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    bands = sketch.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * _GOLD + bands[:, :, k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs by the likelihood of how many registers are greater, less and equal, given the set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = [np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12) for x in (u - v * j, v - u * j)]
    like = more * np.log(p[0]) + less * np.log(p[1]) + equal * np.log(np.maximum(1 - p[0] - p[1], 1e-12))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def sums(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, whatever the order of its elements."""
    ends = np.cumsum(sizes)
    out = []
    for k in np.array([[1], [2]], np.uint64):  # arrays, as scalars warn of overflow
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + k * _GOLD))])
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            values, sizes = sets(part.column("text"))
            sketch = registers(values, sizes)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes.astype(np.int64)), *map(pa.array, sums(values, sizes)), pa.array([r.tobytes() for r in sketch], pa.binary())], names=["id", "n", "h1", "h2", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
        keys = band_keys(sketch)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "keys"])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sorted shingle hashes of the wanted nodes (id, node, h1, h2) as (node, hashes), from documents (id, text).

    Texts aren't shuffled: every task drops the documents whose id isn't in a bitmap of hashed ids, makes the sets of the
    rest, and only these meet the wanted rows. A bit that several ids share lets a document through that the join drops."""
    spark = docs.sparkSession
    size = 1 << min(MAP_BITS, max(6, math.ceil(math.log2(max(1, wanted.count() * ID_BITS)))))
    bit = F.pmod(F.xxhash64("id"), F.lit(size))
    found = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    found = found.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array(((bitmap[at >> 6] >> (at & 63)) & 1).astype(bool)))
            for part in slices(batch, "text", SLICE):
                values, sizes = sets(part.column("text"))
                ends = np.cumsum(sizes)
                hashes = pa.array([values[b - n : b].tobytes() for b, n in zip(ends, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, sums(values, sizes)), hashes], names=["id", "h1", "h2", "hashes"])

    made = docs.where("id IS NOT NULL").select("id", "text", bit.alias("bit")).mapInArrow(tidy(run), "id bigint, h1 bigint, h2 bigint, hashes binary")
    return made.join(wanted, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2", "node"]).select("node", "hashes")


def _by_centre(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of beside() with the places of partners and of the centre of each, which may have come batches before."""
    centre = None
    for batch in (part for whole in batches for part in slices(whole, column, SLICE)):
        t = pa.Table.from_batches([batch] if centre is None else [centre, batch]).combine_chunks()
        is_centre = t["b"].is_null().to_numpy()
        a, at = t["a"].to_numpy(), np.maximum.accumulate(np.where(is_centre, np.arange(t.num_rows), 0))
        partner = np.flatnonzero(~is_centre & (a == a[at]))
        yield t, partner, at[partner]
        centre = t.slice(int(at[-1]), 1).combine_chunks().to_batches()[0] if t.num_rows else centre


def beside(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """The payload (by node) of every pair's b after that of its a, whose b is null, in tasks of PARTNERS pairs of one a."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")).where("parts > 1")
    pairs = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    of = [c for c in payload.columns if c != "node"]
    centres = pairs.select("a", "part").distinct().join(payload.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), *of)
    partners = pairs.join(payload.withColumnRenamed("node", "b"), "b").select("a", "part", "b", *of)
    return centres.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def _pairs(t: pa.Table, places: np.ndarray) -> pa.RecordBatch:
    return t.select(["a", "b"]).take(pa.array(places, pa.int64())).combine_chunks().to_batches(max_chunksize=None)[0] if len(places) else pa.RecordBatch.from_pylist([], pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = LIMIT[0] / LIMIT[1] - SLACK
    for t, partner, centre in _by_centre(batches, "sketch"):
        n, sketch = t["n"].to_numpy(), np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u2").reshape(-1, REGISTERS)
        yield _pairs(t, partner[estimate(sketch[centre], sketch[partner], n[centre], n[partner]) >= least])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, partner, centre in _by_centre(batches, "hashes"):
        hashes, keep = t["hashes"], []
        of, x = -1, None
        for p, c in zip(partner.tolist(), centre.tolist(), strict=True):
            if c != of:
                of, x = c, np.frombuffer(hashes[c].as_py(), np.uint64)
            y = np.frombuffer(hashes[p].as_py(), np.uint64)
            few = LIMIT[1] * min(len(x), len(y)) < LIMIT[0] * max(len(x), len(y))
            if not few and linked(len(x) + len(y) - len(np.unique(np.concatenate([x, y]))), len(x), len(y)):
                keep.append(p)
        yield _pairs(t, np.array(keep, np.int64))


def linked(both, n_a, n_b):
    return LIMIT[1] * both >= LIMIT[0] * (n_a + n_b - both)


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the nodes of two blocks (or of one) that are in different groups, as (id, smallest id reached)."""
    blobs = table["hashes"].to_pylist()
    values, sizes = np.frombuffer(b"".join(blobs), np.uint64), np.array([len(b) // 8 for b in blobs], np.int64)
    block, ids, group = (table[c].to_numpy() for c in ("block", "node", "group"))
    left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
    node = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    node, column = node[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    node, column = node[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        holds = np.zeros((len(sizes), COLUMNS), np.float32)
        holds[node[a:b], column[a:b] - start] = 1
        both += holds[left] @ holds[right].T
    found = linked(both.astype(np.int64), sizes[left][:, None], sizes[right][None, :]) & (both > 0) & (group[left][:, None] != group[right][None, :])
    i, j = np.nonzero(found)
    u, v = forest(ids, left[i], right[j]) if len(i) else (np.zeros(0, np.int64),) * 2
    return pa.table({"a": u, "b": v})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id its links reach) and kept (doc_id = component_id) of every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.keep(docs.mapInArrow(tidy(_sign), "id bigint, n bigint, h1 bigint, h2 bigint, sketch binary"))
    nodes = signed.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    rows = scratch.keep(signed.select("id", "n", "h1", "h2").join(nodes.select("h1", "h2", "n", "rep", "node"), ["h1", "h2", "n"], "left").select("id", "n", "node", "rep"))
    several = rows.where("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u < most").select("id", "u")
    same = scratch.keep(rows.join(several, "id").select("u", F.col("node").alias("v")).where("u < v").distinct())
    scratch.drop(signed)
    bands = nodes.select("node", "sketch").mapInArrow(tidy(_bands), "node bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "node")
    shared = bands.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    # one plan at every size: there are BANDS keys for every repeated node, too many to broadcast but from small inputs
    buckets = bands.join(shared.hint("merge"), "key").where("node <> first")
    tried = scratch.keep(buckets.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    likely = scratch.keep(beside(tried, nodes.select("node", "n", "sketch")).mapInArrow(tidy(_likely), "a bigint, b bigint"))
    used = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.keep(nodes.join(used, "node", "left_semi").select(F.col("rep").alias("id"), "node", "h1", "h2"))
    full = scratch.keep(full_sets(docs, wanted))
    scratch.drop(wanted)
    links = scratch.keep(beside(likely, full).mapInArrow(tidy(_confirm), "a bigint, b bigint"))
    scratch.drop(likely)

    def groups_of(pairs: DataFrame) -> DataFrame:
        return scratch.keep(connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same), scratch))

    groups = groups_of(links)
    placed = tried.join(groups.select(F.col("id").alias("b"), "component"), "b", "left").join(nodes.select(F.col("node").alias("b"), "n"), "b")
    placed = scratch.keep(placed.select("a", F.col("b").alias("node"), F.coalesce("component", "b").alias("group"), "n"))
    scratch.drop(tried)
    sizes = placed.groupBy("a", "group").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("a").agg(F.count("*").alias("k"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "group")).alias("main")).where("k > 1")

    def blocks(c, s):
        return F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")

    sizes = sizes.select("a", F.col("main.group").alias("main"), blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("others"), blocks(F.col("main.c"), F.col("main.s")).alias("mains"))
    spot, other = F.xxhash64("node", F.lit(2)), F.col("group") != F.col("main")
    family = placed.join(sizes, "a").withColumn("block", F.when(other, F.pmod(spot, "others")).otherwise(F.col("others") + F.pmod(spot, "mains")).cast("int"))
    family = family.withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(other, F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1)))
    family = family.select("a", F.least("block", "meets").alias("l"), F.greatest("block", "meets").alias("r"), "block", "node", "group")
    late = scratch.keep(family.join(full, "node").groupBy("a", "l", "r").applyInArrow(_compare, "a bigint, b bigint"))
    scratch.drop(full, placed)
    if late.head(1):
        groups = groups_of(links.unionByName(late))
    reps = groups.withColumnRenamed("id", "node").join(nodes.select("node", "rep"), "node")
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    out = rows.join(reps.select("node", "component"), "node", "left").join(least, "component", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "rep", "id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
