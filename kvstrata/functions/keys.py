"""Hierarchical keys as Column expressions, all on the JVM side.

A key is a sequence of parts, each a length byte and that many bytes, so keys order by (length, bytes) of each part in turn.
Keys are binary columns; Spark compares them as unsigned bytes, the shorter first on a tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and markers of the key formats: fixed values.
MAX_PARTS, MAX_PART, MAX_KEY = 16, 255, 256
INLINE_MAX, LONG_MARKER = 128, 255
SUBSCRIPT_TAG = "02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound to a variable: evaluated once and written once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bytes(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("binary")


def empty_key() -> Column:
    return F.unhex(F.lit(""))


def whole(n: int) -> Column:
    """A literal of up to 20 digits."""
    return F.lit(str(n)).cast("decimal(20,0)")


def byte(n: Column | int, width: int = 1) -> Column:
    """An unsigned big-endian number of `width` bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def unsigned(b: Column, at: Column | int, width: int = 1) -> Column:
    """The number in `width` bytes of a binary column from the 1-based place `at`."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(b, at, F.lit(width))), 16, 10).cast("int")


def part(p: Column | str, strict: bool = False) -> Column:
    """One encoded part. Longer ones than 255 bytes have no encoding: an error if strict, else cut there."""
    b = _bytes(p)
    if strict:
        return F.when(F.octet_length(b) <= MAX_PART, F.concat(byte(F.octet_length(b)), b)).otherwise(F.raise_error(F.lit("key part over 255 bytes")).cast("binary"))
    b = F.substring(b, F.lit(1), F.lit(MAX_PART))
    return F.concat(byte(F.octet_length(b)), b)


def make_key(*parts: Column | str, strict: bool = False) -> Column:
    """The key of a fixed list of parts."""
    return F.concat(*(part(p, strict) for p in parts))


def encode_parts(parts: Column | str, strict: bool = False) -> Column:
    """The key of an array of parts."""
    return F.aggregate(parts, empty_key(), lambda key, p: F.concat(key, part(p, strict)))


def split_parts(path: Column | str, delimiter: str) -> Column:
    """Parts of a path as binaries: none after a trailing delimiter, long ones in chunks of 255 bytes, at most 16, and none from the first that would make the key longer than 256 bytes."""
    path = F.col(path) if isinstance(path, str) else path
    raw = F.split(path, f"\\Q{delimiter}\\E", -1)
    raw = F.when(F.element_at(raw, -1) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)

    def chunks(p: Column) -> Column:
        b = p.cast("binary")
        last = F.greatest(F.ceil(F.octet_length(b) / MAX_PART) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(b, k * MAX_PART + 1, F.lit(MAX_PART)))

    parts = F.slice(F.flatten(F.transform(raw, chunks)), 1, MAX_PARTS)
    room = F.lit(MAX_KEY)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def fits(s: Column, p: Column) -> Column:
        full = s["full"] | (s["used"] + F.octet_length(p) + 1 > room)
        return F.struct(F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), F.when(full, s["used"]).otherwise(s["used"] + F.octet_length(p) + 1).alias("used"), full.alias("full"))

    return F.slice(parts, F.lit(1), F.aggregate(parts, start, fits, lambda s: s["n"]))


def key_split(path: Column | str, delimiter: str) -> Column:
    """The key of a delimited path."""
    return encode_parts(split_parts(path, delimiter))


def part_spans(key: Column | str, tuple_format: bool = False) -> Column:
    """1-based place and size of each part of a key; a key that ends inside a part is an error. `tuple_format`: lengths as
    encode_tuple writes them."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("spans"))

    def spans(key: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def after(head: Column) -> Column:
                size, skip = head, F.lit(1)
                if tuple_format:
                    long = head == LONG_MARKER
                    size, skip = F.when(long, unsigned(key, s["at"] + 1, 2)).otherwise(head), F.when(long, 3).otherwise(1)
                span = F.struct((s["at"] + skip).alias("at"), size.alias("size"))
                fits = s["at"] + skip + size <= F.octet_length(key) + 1
                span = F.when(fits, span).otherwise(F.raise_error(F.lit("truncated key")).cast("struct<at:int,size:int>"))
                return F.struct((s["at"] + skip + size).alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

            return F.when(s["at"] > F.octet_length(key), s).otherwise(let(unsigned(key, s["at"]), after))

        return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_PARTS)), start, step, lambda s: s["spans"])

    return let(_bytes(key), spans)


def decode_parts(key: Column | str, tuple_format: bool = False) -> Column:
    """Parts of a key as binaries; a key that ends inside a part is an error. `tuple_format`: lengths as encode_tuple writes them."""
    return F.transform(part_spans(key, tuple_format), lambda s: F.substring(_bytes(key), s["at"], s["size"]))


def decode_strings(key: Column | str) -> Column:
    return F.transform(decode_parts(key), lambda p: p.cast("string"))


def key_unsplit(key: Column | str, delimiter: str) -> Column:
    """struct(path, n_parts). A delimiter goes only after something, so leading empty parts are lost."""
    parts = decode_strings(key)
    path = F.aggregate(parts, F.lit(""), lambda s, p: F.concat(s, F.when(s == "", F.lit("")).otherwise(F.lit(delimiter)), p))
    return F.struct(path.alias("path"), F.size(parts).alias("n_parts"))


def length_prefix(n: Column) -> Column:
    """One byte under 128; else the marker and two bytes, high first."""
    return F.when(n < INLINE_MAX, byte(n)).otherwise(F.concat(byte(LONG_MARKER), byte(n, 2)))


def decode_length_prefix(key: Column, at: Column | int = 1) -> Column:
    head = unsigned(key, at)
    return F.when(head == LONG_MARKER, unsigned(key, at + 1, 2)).otherwise(head)


def length_prefix_size(n: Column) -> Column:
    return F.when(n < INLINE_MAX, 1).otherwise(3)


def encode_tuple(*parts: Column | str) -> Column:
    """The tuple format: lengths by length_prefix. Equal to make_key while all parts are under 128 bytes."""
    bodies = [_bytes(p) for p in parts]
    return F.concat(*(x for b in bodies for x in (length_prefix(F.octet_length(b)), b)))


def integer_subscript(n: Column) -> Column:
    """Tag byte and eight bytes, low first (so these don't sort by number)."""
    h = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(F.lit(SUBSCRIPT_TAG), *(F.substring(h, k, 2) for k in range(15, 0, -2))))


def decode_integer_subscript(b: Column) -> Column:
    h = F.hex(b)
    value = F.conv(F.concat(*(F.substring(h, k, 2) for k in range(17, 1, -2))), 16, 10).cast("decimal(20,0)")
    return F.when(value >= whole(2**63), value - whole(2**64)).otherwise(value).cast("bigint")


def subscript_count(key: Column | str) -> Column:
    return F.size(decode_parts(key))


def extract_subscript(key: Column | str, i: int) -> Column:
    """The 0-based part, null out of range."""
    return F.get(decode_parts(key), F.lit(i)) if i >= 0 else F.lit(None).cast("binary")


def subscript_equal(key: Column | str, i: int, value: str) -> Column:
    return F.coalesce(extract_subscript(key, i) == F.lit(value).cast("binary"), F.lit(False))


def subscript_offset(key: Column | str, i: int) -> Column:
    """Where the 0-based part begins in the key, its length byte included; -1 out of range."""
    parts = decode_parts(key)
    sizes = F.aggregate(F.slice(parts, F.lit(1), F.lit(max(i, 0))), F.lit(0), lambda n, p: n + F.octet_length(p) + 1)
    return F.when((F.lit(i) >= 0) & (F.lit(i) < F.size(parts)), sizes).otherwise(-1)


def ancestor(key: Column | str, n: int) -> Column:
    """The key of the first n parts."""
    return encode_parts(F.slice(decode_parts(key), F.lit(1), F.lit(n)))


def child(parent: Column | str, name: Column | str) -> Column:
    return F.concat(_bytes(parent), part(name))


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many bytes two binaries share from the start."""
    most = F.least(F.octet_length(a), F.octet_length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k > most) | (F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))))
    return F.when(most == 0, 0).otherwise(F.coalesce(F.get(places, F.lit(0)) - 1, most))


def minimum_separator(left: Column, right: Column) -> Column:
    """The shortest prefix of `right` that is greater than `left`; `left` itself if none is."""
    prefix = F.substring(right, F.lit(1), common_prefix_length(left, right) + 1)
    return F.when(prefix > left, prefix).otherwise(left)


def front_code(key: Column, previous: Column) -> Column:
    """Two length bytes, shared with the previous key and own, and the own bytes."""
    n = common_prefix_length(key, previous)
    return F.concat(byte(n), byte(F.octet_length(key) - n), F.substring(key, n + 1, F.lit(MAX_KEY)))


def front_decode(coded: Column, previous: Column) -> Column:
    return F.concat(F.substring(previous, F.lit(1), unsigned(coded, 1)), F.substring(coded, F.lit(3), unsigned(coded, 2)))


def literal_key(*parts: str | bytes | int) -> bytes:
    """The key of literal parts, in Python."""
    raw = [p if isinstance(p, bytes) else str(p).encode() for p in parts]
    if any(len(p) > MAX_PART for p in raw):
        raise ValueError("key part over 255 bytes")
    return b"".join(bytes([len(p)]) + p for p in raw)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys that start with `prefix`; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column | str, prefix: bytes) -> Column:
    """Starts with `prefix`, as a range of keys, which Parquet scans prune by; the empty prefix matches all."""
    key = F.col(key) if isinstance(key, str) else key
    if not prefix:
        return F.lit(True)
    end = successor(prefix)
    return key >= F.lit(bytearray(prefix)) if end is None else (key >= F.lit(bytearray(prefix))) & (key < F.lit(bytearray(end)))
