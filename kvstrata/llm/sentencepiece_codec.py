"""Offset-preserving SentencePiece encoding and decoding.

A model file is read with a small protobuf reader. Texts are normalised by longest-prefix matches in its compiled
character map (a double-array trie followed by replacement strings), and every byte of the normalised text remembers the
byte of the original it came from; every piece is projected to its span of original bytes through that alignment.
The library merges pieces inside a segment; in a model none of whose pieces holds a space mark after another character,
segments (space marks and what follows them) are independent, so each distinct segment is encoded once.

Defined cases: a null text is an empty one, which has only the end id; null ids and repeated rows are encoded each; a very
long text is encoded whole; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import contextlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.memo import Memo, slices
from kvstrata.sources.shipping import ship_package

SPACE = "▁"
#: Piece types of the model format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown piece decodes to unless the model says otherwise: a fixed value.
UNK_SURFACE = " ⁇ "
SCHEMA = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, decoded string"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints for varints, bytes for the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: lambda: 8, 5: lambda: 4, 2: varint}[key & 7]()
            yield key >> 3, data[at : at + n]
            at += n


class CharMap:
    """The compiled character map: a double-array trie from byte sequences to offsets of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at`, and its replacement."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.blob = f.read()
        pieces, spec, trainer = [], {3: 1, 4: 1, 5: 1, 2: b""}, {}
        for number, value in fields(self.blob):
            if number == 1:
                p = dict(fields(value))
                pieces.append((p[1], p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec |= dict(fields(value))
        self.char_map, self.dummy, self.squeeze, self.escape = CharMap(spec[2]), bool(spec[3]), bool(spec[4]), bool(spec[5])
        self.end = next(i for i, (p, t) in enumerate(pieces) if t == CONTROL and p == bytes(trainer.get(47, b"</s>")))
        self.mark = SPACE.encode() if self.escape else b" "
        unk = bytes(trainer.get(44, UNK_SURFACE.encode()))
        self.is_byte = np.array([t == BYTE for _, t in pieces])
        self.norm_len = np.array([1 if t == BYTE else 0 if t == CONTROL else len(p) for p, t in pieces], np.int64)
        surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else unk if t == UNKNOWN else p.replace(SPACE.encode(), b" ") for p, t in pieces]
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.surfaces = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([t != CONTROL and p.startswith(SPACE.encode()) for p, t in pieces])
        self.loose = np.array([t in (BYTE, UNKNOWN) for _, t in pieces])
        inner = any(SPACE in p.decode("utf-8", "replace").lstrip(SPACE) for p, t in pieces if t in (NORMAL, USER_DEFINED))
        #: Segments can be encoded apart and offsets counted without the map.
        self.plain = not inner and not self.char_map.units and self.dummy and self.escape and not self.squeeze and any(t == BYTE for _, t in pieces)
        self.lone = next((i for i, (p, _) in enumerate(pieces) if p == SPACE.encode()), None)
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.blob)
        #: By the segment without its first space, which the library puts before a text itself.
        self.memo = Memo(lambda rest: self.library.encode(rest) if rest else [self.lone])

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for the end the byte of the original it came from."""
        data, out, align = text.encode(), bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        at, end = 0, len(data)
        pending: list[tuple[bytes, int]] = []
        while at < end:
            if hit := self.char_map.longest(data, at):
                n, new = hit
            else:
                b = data[at]
                n = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                new = data[at : at + n]
            pending.append((new, at))
            at += n
        if self.squeeze:
            while pending and pending[0][0] == b" ":
                pending.pop(0)
        if not pending:
            return b"", np.zeros(1, np.int64)
        if self.dummy:
            put(self.mark, pending[0][1])
        after_space = self.squeeze
        for new, came in pending:
            if after_space:
                new = new.lstrip(b" ")
            for k in range(len(new)):
                put(self.mark if new[k : k + 1] == b" " else new[k : k + 1], came)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
        stop = end
        if self.squeeze:
            while out.endswith(self.mark):
                stop = align[-1]
                del out[-len(self.mark) :], align[-len(self.mark) :]
        return bytes(out), np.array([*align, stop], np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the original's UTF-8 bytes."""
        _, align = self.normalise(text)
        ends = np.minimum(np.cumsum(self.norm_len[ids]), len(align) - 1)
        begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return align[begins], align[ends]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of each text with the end id, and the begins and ends of all pieces, one after another."""
        cut: list[list[str] | None] = []
        for t in texts:
            if not self.plain or SPACE in t or not t:
                cut.append(None)
            elif "  " in t or t[0] == " ":
                cut.append([s[1:] for s in re.findall(r" +[^ ]*", " " + t)])
            else:
                cut.append(t.split(" "))
        get, end = self.memo.__getitem__, np.array([self.end], "<u4").tobytes()
        ids = [np.frombuffer(b"".join([*map(get, c), end]) if c else np.array([*self.library.encode(t), self.end], "<u4").tobytes(), "<i4") for t, c in zip(texts, cut, strict=True)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        first = np.cumsum([0, *map(len, ids)])[:-1]
        width = np.where(self.is_byte[flat], 1, self.surface_len[flat])
        started = first[[c is not None for c in cut]]
        width[started] -= self.marked[flat[started]]
        ends = np.cumsum(width)
        base = np.repeat((ends - width)[first], [len(x) for x in ids]) if ids else ends
        begins, ends = ends - width - base, ends - base
        for i, c in enumerate(cut):
            if c is None:
                s = slice(first[i], first[i] + len(ids[i]))
                begins[s], ends[s] = self.spans(texts[i], ids[i])
        return ids, begins, ends

    def decode(self, ids: list[np.ndarray]) -> list[str | None]:
        """Texts of id lists. Surfaces are laid end to end, without the first space mark; bytes that aren't UTF-8 become U+FFFD one by one."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        counts = np.array([len(x) for x in ids], np.int64)
        n, at = self.surface_len[flat].copy(), self.surface_at[flat].copy()
        first = np.cumsum(counts) - counts
        if self.dummy or self.squeeze:
            for k, (f, c) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
                while f < first[k] + c and n[f] == 0:  # control ids stand for nothing
                    f += 1
                if f < first[k] + c and self.marked[flat[f]]:
                    n[f] -= 1
                    at[f] += 1
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        data = self.surfaces[np.repeat(at - (ends - n), n) + np.arange(total)].tobytes()
        bound = [0, *np.concatenate([[0], ends])[np.cumsum(counts)].tolist()]
        parted = self.surface_len[flat] == 0  # a control id between two byte pieces parts them
        parted[(first + counts - 1)[counts > 0]] = False
        parted = np.concatenate([[0], np.cumsum(parted)])
        parted = (parted[first + counts] > parted[first]).tolist()
        out = []
        for k, x in enumerate(ids):
            raw = data[bound[k] : bound[k + 1]]
            whole = None
            if not parted[k]:
                with contextlib.suppress(UnicodeDecodeError):
                    whole = raw.decode()
            out.append(self._by_runs(x, n[first[k] : first[k] + len(x)], at[first[k] : first[k] + len(x)]) if whole is None else whole)
        return out

    def _by_runs(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for w in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + w]).decode())
                        k += w
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    k += 1
            run.clear()

        for i, size, start in zip(ids.tolist(), n.tolist(), at.tolist(), strict=True):
            piece = self.surfaces[start : start + size].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                flush()
                out.append(piece.decode("utf-8", "replace"))
        flush()
        return "".join(out)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA: `ids` with the end id, `begins` and `ends` of each piece in the original's UTF-8 bytes (of the end id
    both are the text's length), and `decoded`, the text of exactly those ids."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                ids, begins, ends = model.encode([t or "" for t in part.column("text").to_pylist()])
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (np.concatenate(ids), begins, ends)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists, pa.array(model.decode(ids), pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
