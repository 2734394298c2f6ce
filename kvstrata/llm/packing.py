"""Hierarchical multi-length packing of tokenised documents into training windows.

Each task tokenises its documents and packs them as they come; nothing is shuffled and no state leaves a task.
Whole 2048-token windows are cut off long documents; what remains of a document goes to the tier of the smallest
context size that holds it. Windows of each tier are opened by that tier's pieces, and their gaps are filled with the
largest pieces of shorter tiers that fit; a gap that none fits is filled by cutting a piece, the rest of which goes back
to its tier. Full windows have a power-of-two length and no padding; only what is left at the end of a task can leave one
padded window. Windows of one tier are dealt to step groups inside each task: all hold
step_tokens tokens but the last of each tier of a task, which holds what is left, one window or more.

Defined cases: a null or empty text has one token, the end id; a row with a null id is packed like any other (its id
stays null); repeated rows are packed each; an empty table gives no pieces; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.memo import Memo, kept, slices
from kvstrata.sources.shipping import ship_package

TIERS = (2048, 1024, 512, 256, 128)
END_ID = 1
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, context int, step_group bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int32()), ("step_group", pa.int64())])


#: The pre-tokeniser's pattern of byte-level files with use_regex: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(path: str):
    """A tiktoken encoder of a `tokenizers` file, if that is byte-level BPE whose ids rise with its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """Ids of whole texts by a `tokenizers` file without special tokens.

    The pre-tokeniser never joins across a single space between two characters that aren't white space, so a text is
    encoded as the chunks between such spaces and equal chunks are encoded once: by the library, or, for chunks of Latin
    letters, by an encoder with the same ranks that has less to do for each call. Texts that may hold an added token's
    string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ranked = Tokenizer.from_file(path), ranked(path)
        self.memo = Memo(lambda chunk: self.one(" " + chunk))
        self.whole = re.compile("|".join(re.escape(str(t.content)) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.doubt = re.compile(r"\s | \s|^ | $")
        self.split = re.compile(r"(?<=\S) (?=\S)").split

    def one(self, text: str) -> list[int]:
        if self.ranked is not None and (text.isascii() or max(text) < "\u0250"):
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = self.split(text) if self.doubt.search(text) else text.split(" ")
        return np.array(self.one(first), "<u4").tobytes() + b"".join(map(self.memo.__getitem__, rest))


@kept
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens), ids as little-endian 32-bit bytes, of one task."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536):
        self.tiers, self.sizes, self.step_tokens = tiers, tiers[::-1], step_tokens
        self.pool: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.base, self.sequences, self.dealt = task << 33, 0, dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        total, long = len(ids) // 4, self.tiers[0]
        whole = total // long * long
        for at in range(0, whole, long):
            self.emit([(long, doc, at, ids[4 * at : 4 * (at + long)], total)], long)
        if whole < total:
            self.put((total - whole, doc, whole, ids[4 * whole :], total))

    def put(self, piece: tuple) -> None:
        tier = next(t for t in self.sizes if piece[0] <= t)
        insort(self.pool[tier], piece, key=lambda p: p[0])

    def emit(self, pieces: list[tuple], context: int) -> None:
        at, sequence = 0, self.base + self.sequences
        group = self.base + (self.tiers.index(context) << 28) + self.dealt[context] // (self.step_tokens // context)
        self.sequences += 1
        self.dealt[context] += 1
        for n, doc, start, ids, total in pieces:
            self.rows.append((doc, start, n, ids, total, sequence, at, context, group))
            at += n

    def fitting(self, most: int) -> tuple | None:
        """Takes the largest waiting piece of at most `most` tokens."""
        for t in self.tiers:
            if t // 2 < most and (waiting := self.pool[t]) and (k := bisect_right(waiting, most, key=lambda p: p[0])):
                return waiting.pop(k - 1)
        return None

    def pack(self) -> None:
        """Fills windows of each tier, longest first, until what waits is less than a window of its tier."""
        for context in self.tiers:
            while waiting := self.pool[context]:
                piece = waiting.pop()
                window, gap = [piece], context - piece[0]
                while gap and (piece := self.fitting(gap)):
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    longer = next((self.pool[t] for t in self.sizes if self.pool[t]), None)
                    if longer is None or longer[-1][0] <= gap:
                        for p in window:
                            self.put(p)
                        break
                    n, doc, start, ids, total = longer.pop()
                    window.append((gap, doc, start, ids[: 4 * gap], total))
                    self.put((n - gap, doc, start + gap, ids[4 * gap :], total))
                self.emit(window, context)

    def finish(self) -> None:
        """Cuts what is left into windows as long as it fills, from the longest tier down; a rest under the shortest is padded."""
        self.pack()
        left = [p for t in self.tiers for p in self.pool[t]]
        self.pool = {t: [] for t in self.tiers}
        tokens = sum(p[0] for p in left)
        while left:
            context = next((t for t in self.tiers if t <= tokens), self.tiers[0])
            window, gap = [], context
            while left and gap:
                n, doc, start, ids, total = left.pop()
                k = min(n, gap)
                window.append((k, doc, start, ids[: 4 * k], total))
                if k < n:
                    left.append((n - k, doc, start + k, ids[4 * k :], total))
                gap -= k
            tokens -= context - gap
            self.emit(window, context)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """Rows of SCHEMA, one per piece: `ids` are the piece's token ids as little-endian unsigned 32-bit bytes, `offset` its
    place in sequence `sequence_id`, `context` the window length of that sequence's tier, `step_group` windows of one tier
    and task with together step_tokens tokens, or fewer in the task's last group of the tier. Sequence ids follow the input's partitions, so the same files give the same ids."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end = byte_bpe(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.add(doc, bpe.encode(text) + end)
                packer.pack()
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
