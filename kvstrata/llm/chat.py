r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, tokenised once with offsets, and the sorted spans of its assistant texts are intersected
with the token spans by binary search. The control strings are tokens of their own, added to the tokeniser's, so no token
crosses the border of a text: the ids under the mask decode to exactly the assistant texts, which read_back() gets from
them and from nothing else. For the same reason long conversations give the same tokens when they are handed to the
tokeniser some turns at a time, as is done to hold the offsets of PIECE characters or one turn at once.

Template: each turn is BEGIN role TEXT text END. Control strings start with "<", and inside roles and texts a backslash is
written as two and "<" as backslash-l, so no control string (of this template or of a tokeniser's "<|...|>" kind) can occur
there, and the writing is undone exactly.

Defined cases: a null text or role is empty; turns go by turn (null first), then role, then text; repeated rows are turns
each; rows with a null conv_id are one conversation with that id; very long texts and conversations are formatted whole, as
one row is a conversation's unit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.memo import slices
from kvstrata.sources.shipping import ship_package

BEGIN, TEXT, END = "<turn>", "<text>", "</turn>\n"
LEARNED_ROLE = "assistant"
PIECE = 100_000
SCHEMA = "conv_id bigint, formatted string, ids array<int>, mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "<" if m[1] == "l" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The formatted conversation, the spans of its learned texts, and where pieces of some turns begin, in code points."""
    parts, spans, cuts, at = [], [], [0], 0
    for role, text in turns:
        if at - cuts[-1] >= PIECE:
            cuts.append(at)
        head, body = f"{BEGIN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans, cuts


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, as they were."""
    turns = [t.split(TEXT) for t in formatted.split(END)[:-1]]
    return [(unescape(role.removeprefix(BEGIN)), unescape(text)) for role, text in turns]


def intersect(tokens: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the sorted token spans meet one of the sorted, disjoint spans. Pieces of one character share its span."""
    edge = np.zeros(len(tokens) + 1, np.int64)
    some = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
    np.add.at(edge, np.searchsorted(tokens[:, 1], some[:, 0], "right"), 1)
    np.add.at(edge, np.searchsorted(tokens[:, 0], some[:, 1], "left"), -1)
    return np.cumsum(edge)[:-1] > 0


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    bpe = Tokenizer.from_file(path)
    bpe.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in (BEGIN, TEXT, END)])
    return bpe


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows of SCHEMA, one per conversation of (conv_id, turn, role, text): the formatted text, its token ids (control strings
    have the ids after the tokeniser's own, in the order BEGIN, TEXT, END) and the loss mask over them."""
    ship_package(turns.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: t.role).alias("roles"), F.transform("turns", lambda t: t.text).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                text, spans, cuts = render(list(zip(*(batch.column(c)[k].as_py() for c in ("roles", "texts")), strict=True)))
                ids, tokens = [], []
                for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
                    e = bpe.encode(text[a:b], add_special_tokens=False)
                    ids.append(np.array(e.ids, np.int32))
                    tokens.append(np.array(e.offsets, np.int64).reshape(-1, 2) + a)
                rows.append((batch.column("conv_id")[k].as_py(), text, np.concatenate(ids), intersect(np.concatenate(tokens), spans)))
                held += len(text)
                if held >= PIECE or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())), strict=True)], names=["conv_id", "formatted", "ids", "mask"])
                    rows, held = [], 0

    return whole.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """From format_conversations' rows alone: conv_id, n_turns, turns (role, newline, text, newline for each turn, joined),
    loss_text (what the ids under the loss mask decode to, as it was before escaping) and formatted_chars."""
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "formatted"):
                texts = part.column("formatted").to_pylist()
                turns = [parse(t) for t in texts]
                masked = [ids.values.to_numpy()[m.values.to_numpy(zero_copy_only=False)].tolist() for ids, m in zip(part.column("ids"), part.column("mask"), strict=True)]
                loss = map(unescape, bpe.decode_batch(masked, skip_special_tokens=False))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([len(t) for t in turns], pa.int64()), pa.array(["".join(f"{r}\n{x}\n" for r, x in t) for t in turns], pa.string()), pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["conv_id", "n_turns", "turns", "loss_text", "formatted_chars"],
                )

    return formatted.select("conv_id", "formatted", "ids", "mask").mapInArrow(run, "conv_id bigint, n_turns bigint, turns string, loss_text string, formatted_chars bigint")
