"""Removal of word sequences that a document with a smaller id has too, by fixed-block anchors.

Documents are dealt to batches of about BATCH_BYTES of text, row by row and whatever their ids, and written once as a
table bucketed by batch, which all steps read without moving it again. Each document's words are cut into non-overlapping
blocks of BLOCK words, its reference blocks, and probed with every rolling window of BLOCK words; as 2 * BLOCK - 1 is
WINDOW, any repeated window holds a whole reference block of the earlier document. The distinct window hashes of a batch
meet those of all others in groups by hash, five bytes each, and a group answers with one bit each: whether it is a block
somewhere and occurs in two documents. Hits are extended: windows of WINDOW words around a hit go on, with the smallest id
of their batch, and their groups answer with the smallest id of all. Adjoining repeated windows make up the maximal
repeats, whose words are removed. A batch sends a sequence once however often it holds it, so a passage that many
documents share costs one entry a batch.

Sequences are told apart by two independent 64-bit hashes of their words, taken from the words' bytes. Windows are judged
on the input, not on what is left.

Defined cases: a null text has no words; documents with fewer than WINDOW words lose none; rows with equal ids don't take
from each other; a row with a null id neither takes nor loses words; very long texts are one row and are handled whole; an
empty table gives no rows; other columns stay whatever their names, but for those of the result, which are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.llm.langid import text_bytes
from kvstrata.llm.memo import tidily
from kvstrata.llm.shingles import inside, windows, word_hashes, words
from kvstrata.llm.storage import Scratch, unused

WINDOW, BLOCK = 13, 7
BATCH_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
#: Batches and groups hold up to so many times more in large inputs, so that a batch's entries for a group stay many.
MOST_TIMES, TIMES_FROM = 4, 64 << 30
TASK_BYTES = 32 << 20
_BITS = 38
_IS_BLOCK, _IN_TWO = 1 << _BITS, 1 << (_BITS + 1)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, int)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def run_lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def least_of(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each place the smallest of the ids at places with the same keys."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    first = starts(*(k[order] for k in keys))
    out = np.empty(len(ids), np.int64)
    if len(ids):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], first), run_lengths(first, len(ids)))
    return out


class Batch:
    """Words of a batch's documents that can take part, as arrays."""

    def __init__(self, ids: pa.ChunkedArray, text: pa.ChunkedArray):
        if ids.null_count:
            text = pa.chunked_array([pa.array((t if i is not None else None for i, t in zip(ids.to_pylist(), text.to_pylist(), strict=True)), pa.string())])
        self.data, offsets = text_bytes(text.combine_chunks().cast(pa.large_string()).fill_null(""))
        self.begin, self.end, self.counts = words(self.data, offsets)
        self.ids = ids.fill_null(0).to_numpy()
        self.hashes = word_hashes(self.data, self.begin, self.end)
        self.long = np.diff(self.counts) >= WINDOW

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, document and hash of each window of `size` words of documents with at least WINDOW words."""
        at = inside(self.counts, size)
        doc = np.repeat(np.arange(len(self.ids)), np.maximum(np.diff(self.counts) - size + 1, 0))
        keep = self.long[doc]
        at, doc = at[keep], doc[keep]
        return at, doc, windows(self.hashes, size)[at]

    def second(self, at: np.ndarray) -> np.ndarray:
        """The other hash of the windows of WINDOW words at these places."""
        return windows(word_hashes(self.data, self.begin, self.end, 1), WINDOW, 1)[at] if len(at) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of BLOCK-word windows in order of hash, the first of each run of one hash, the distinct hashes, and whether each is a reference block and in two documents."""
        at, doc, h = self.places(BLOCK)
        order = np.argsort(h)
        at, doc, h = at[order], doc[order], h[order]
        first = starts(h)
        if not len(h):
            return at, first, h, np.zeros(0, bool), np.zeros(0, bool)
        block = np.logical_or.reduceat((at - self.counts[doc]) % BLOCK == 0, first)
        ids = self.ids[doc]
        return at, first, h[first], block, np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)


def _pack(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5])


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array of the rows of `data` between the cuts."""
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The frame's rows with n_words, n_removed, kept_text, the kept words joined by one space, and repeats, the maximal
    runs of removed words as (begin, end) word numbers; columns of these names are replaced."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    docs = docs.drop("n_words", "n_removed", "kept_text", "repeats")
    names, (own_id, batch_col) = docs.columns, unused(docs.columns, "id", "batch")
    total = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    times = min(MOST_TIMES, max(1.0, math.sqrt(total / TIMES_FROM)))
    batches = max(1, math.ceil(total / (BATCH_BYTES * times)))
    bits = max(0, math.ceil(math.log2(max(1, total / (GROUP_BYTES * times)))))
    tasks = min(batches, max(math.ceil(total / TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = docs.withColumns({own_id: F.col(id_col).cast("bigint"), batch_col: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int")})
    dealt = scratch.keep_bucketed(dealt, tasks, batch_col)
    narrow = dealt.select(F.col(batch_col).alias("batch"), F.col(own_id).alias("id"), F.col(text_col).alias("text"))

    def cuts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups that sorted hashes are in, and where each begins; the end follows."""
        group = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        first = starts(group)
        return group[first].astype(np.int32), np.append(first, len(h))

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, _, h, block, two = Batch(table["id"], table["text"]).anchors()
        low = (h >> np.uint64(64 - bits - _BITS)) & np.uint64(_IS_BLOCK - 1)
        entry = low | np.where(block, np.uint64(_IS_BLOCK), np.uint64(0)) | np.where(two, np.uint64(_IN_TWO), np.uint64(0))
        group, at = cuts(h)
        return pa.table({"group": group, "batch": pa.array([key[0].as_py()] * len(group), pa.int32()), "entries": _blobs(_pack(entry), at)})

    def answer_anchors(table: pa.Table) -> pa.Table:
        blobs = table["entries"].to_pylist()
        entry = _unpack(b"".join(blobs))
        low = entry & np.uint64(_IS_BLOCK - 1)
        order = np.argsort(low)
        first = starts(low[order])
        flags = np.bitwise_or.reduceat(entry[order], first)
        n = run_lengths(first, len(low))
        shared = ((flags & np.uint64(_IS_BLOCK)) > 0) & ((n > 1) | ((flags & np.uint64(_IN_TWO)) > 0))
        bit = np.zeros(len(entry), bool)
        bit[order] = np.repeat(shared, n)
        at = np.cumsum([0, *(len(b) // 5 for b in blobs)])
        return pa.table({"batch": table["batch"], "group": table["group"], "hits": pa.array([np.packbits(bit[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    sent = narrow.groupBy("batch").applyInArrow(lambda key, table: tidily(send_anchors, key, table), "group int, batch int, entries binary")
    hits = scratch.keep(sent.groupBy("group").applyInArrow(lambda table: tidily(answer_anchors, table), "batch int, group int, hits binary"))

    def send_windows(key: tuple, table: pa.Table, hits: pa.Table) -> pa.Table:
        group, at, h1, h2, least = np.zeros(0, np.int32), np.zeros(1, int), *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64)
        if table.num_rows and hits.num_rows:
            batch = Batch(table["id"], table["text"])
            place, first, h, _, _ = batch.anchors()
            got = dict(zip(hits["group"].to_pylist(), hits["hits"].to_pylist(), strict=True))
            groups, cut = cuts(h)
            shared = np.concatenate([np.unpackbits(np.frombuffer(got[k], np.uint8), count=n) for k, n in zip(groups.tolist(), np.diff(cut).tolist(), strict=True)])
            hit = np.zeros(len(batch.hashes) + 1, np.int64)
            hit[place] = np.repeat(shared, run_lengths(first, len(place)))
            hit = np.concatenate([[0], np.cumsum(hit)])
            place, doc, h1 = batch.places(WINDOW)
            near = hit[place + WINDOW - BLOCK + 1] > hit[place]
            ids, h1, h2 = batch.ids[doc[near]], h1[near], batch.second(place[near])
            order = np.lexsort((h2, h1))
            ids, h1, h2 = ids[order], h1[order], h2[order]
            first = starts(h1, h2)
            least = np.minimum.reduceat(ids, first) if len(ids) else least
            h1, h2 = h1[first], h2[first]
            group, at = cuts(h1)
        return pa.table({"group": group, "batch": pa.array([key[0].as_py()] * len(group), pa.int32()), "h1": _blobs(h1, at), "h2": _blobs(h2, at), "ids": _blobs(least, at)})

    def answer_windows(table: pa.Table) -> pa.Table:
        n = [len(b) // 8 for b in table["ids"].to_pylist()]
        h1, h2, own = _joined(table["h1"], np.uint64), _joined(table["h2"], np.uint64), _joined(table["ids"], np.int64)
        least = least_of(own, h1, h2)
        news = least < own
        at = np.concatenate([[0], np.cumsum(news)])[np.cumsum([0, *n])]
        return pa.table({"batch": table["batch"], "h1": _blobs(h1[news], at), "h2": _blobs(h2[news], at), "ids": _blobs(least[news], at)})

    kinds = "batch int, h1 binary, h2 binary, ids binary"
    sent = narrow.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(lambda key, table, hits: tidily(send_windows, key, table, hits), f"group int, {kinds}")
    earlier = scratch.keep(sent.groupBy("group").applyInArrow(lambda table: tidily(answer_windows, table), kinds))
    scratch.drop(hits)

    def cut_out(key: tuple, table: pa.Table, earlier: pa.Table) -> pa.Table:
        batch = Batch(table[own_id], table[text_col])
        place, doc, h = batch.places(WINDOW)
        known1, known2, at = (_joined(earlier[c], k) for c, k in (("h1", np.uint64), ("h2", np.uint64), ("ids", np.int64)))
        _, back, times_ = np.unique(np.concatenate([h, known1]), return_inverse=True, return_counts=True)
        some = np.flatnonzero(times_[back[: len(h)]] > 1)
        place, ids, h = place[some], batch.ids[doc[some]], h[some]
        least = least_of(np.concatenate([ids, at]), np.concatenate([h, known1]), np.concatenate([batch.second(place), known2]))[: len(h)]
        repeated = place[least < ids]
        cover = np.zeros(len(batch.hashes) + 1, np.int64)
        cover[repeated] += 1
        np.add.at(cover, repeated + WINDOW, -1)
        gone = np.cumsum(cover)[:-1] > 0
        count = np.concatenate([[0], np.cumsum(gone)])
        removed = count[batch.counts[1:]] - count[batch.counts[:-1]]
        kept, n_words, repeats = [], [], []
        for k, t in enumerate(table[text_col].to_pylist()):
            own = (t or "").encode().split()
            n_words.append(len(own))
            runs = []
            if removed[k]:
                mine = gone[batch.counts[k] : batch.counts[k + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]))).tolist()
                runs = [{"begin": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                own = [w for w, g in zip(own, mine.tolist(), strict=True) if not g]
            repeats.append(runs)
            kept.append(b" ".join(own))
        spans = pa.array(repeats, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        return pa.table([*(table[c] for c in names), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=[*names, "n_words", "n_removed", "kept_text", "repeats"])

    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", span)])
    return dealt.groupBy(batch_col).cogroup(earlier.groupBy("batch")).applyInArrow(lambda key, table, earlier: tidily(cut_out, key, table, earlier), schema)
