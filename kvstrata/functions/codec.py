"""The tagged value codec: a tag byte and a payload, low byte first.

All of it is built-in expressions: the bit patterns of floats are put together from sign, exponent and fraction, which
powers of two scale without rounding. So values can be coded inside higher-order functions, at any depth of a row. Only
the places of values inside a whole object that was written as one value are found by an Arrow function.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.functions.keys import let, whole

#: Tags of the value format: fixed values.
TAGS = {"null": 0x00, "bool": 0x01, "u8": 0x02, "i8": 0x03, "i16": 0x04, "u16": 0x05, "i32": 0x06, "u32": 0x07, "i64": 0x08, "u64": 0x09, "f32": 0x0A, "f64": 0x0B, "string": 0x0C, "bytes": 0x0D, "datetime": 0x0E, "guid": 0x0F}
#: Containers, in the rust dialect only, where they stand for other kinds' tags: fixed values.
OBJECT_TAGS = {"array": 0x0E, "map": 0x0F}
WIDTHS = {"bool": 1, "u8": 1, "i8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "i64": 8, "u64": 8, "f32": 4, "f64": 8, "datetime": 8, "guid": 16}
#: 100 ns ticks from year 1 to 1970: a fixed value of the csharp dialect.
EPOCH_TICKS = 621355968000000000
DIALECTS = ("go", "csharp", "rust")
#: Spark types to the tags that hold them.
OF_TYPE = {"boolean": "bool", "tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64", "float": "f32", "double": "f64", "string": "string", "binary": "bytes", "timestamp": "datetime", "date": "datetime"}
DECODED = "tag tinyint, bool boolean, int decimal(20,0), float double, string string, bytes binary, time timestamp, guid binary"


INTEGERS = ("u8", "i8", "i16", "u16", "i32", "u32", "i64", "u64")
#: Fraction bits, least exponent of a normal number, and exponent bias of the float formats: fixed values.
FLOATS = {"f32": (23, -126, 127), "f64": (52, -1022, 1023)}


def _swap(h: Column) -> Column:
    """Hex with its bytes in the other order."""
    return F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1")


def little(n: Column, width: int) -> Column:
    """Hex of the low `width` bytes of a whole number, low byte first."""
    return _swap(F.right(F.lpad(F.hex(n.cast("bigint")), F.lit(16), F.lit("0")), F.lit(2 * width)))


def _wide(n: Column) -> Column:
    """An unsigned 64-bit number as the signed one of the same bits."""
    n = n.cast("decimal(20,0)")
    return F.when(n >= whole(2**63), n - whole(2**64)).otherwise(n).cast("bigint")


def _raw(b: Column, at: Column | int, width: Column | int) -> Column:
    """The bits in up to 8 bytes from the 1-based place `at`, as a bigint."""
    at, width = (F.lit(x) if isinstance(x, int) else x for x in (at, width))
    return F.conv(_swap(F.hex(F.substring(b, at, width))), 16, -10).cast("bigint")


def _signed(raw: Column, width: Column | int) -> Column:
    shift = 64 - 8 * width
    return F.call_function("shiftright", F.call_function("shiftleft", raw, F.lit(shift) if isinstance(shift, int) else shift), F.lit(shift) if isinstance(shift, int) else shift)


def from_little(b: Column, at: int, width: int, signed: bool) -> Column:
    """The number in `width` bytes from the 1-based place `at`, as decimal(20,0)."""
    raw = _raw(b, at, width)
    if signed:
        return _signed(raw, width).cast("decimal(20,0)")
    value = raw.cast("decimal(20,0)")
    return F.when(raw < 0, value + whole(2**64)).otherwise(value).cast("decimal(20,0)") if width == 8 else value


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def float_bits(x: Column, kind: str) -> Column:
    """The bit pattern of a float as a bigint; every NaN has one."""
    fraction, least, bias = FLOATS[kind]
    infinite = (2 * bias + 1) << fraction
    sign = -(1 << 63) if kind == "f64" else 1 << 31

    def exponent(size: Column) -> Column:
        """Of the greatest power of two that isn't more. The logarithm may be one off at a power of two."""
        guess = F.greatest(F.floor(F.log2(size)), F.lit(least)).cast("int")
        right = let(guess, lambda g: F.when(_power(g) > size, g - 1).when(_power(g) * 2 <= size, g + 1).otherwise(g))
        return F.greatest(right, F.lit(least))

    def normal(size: Column) -> Column:
        return let(exponent(size), lambda e: F.call_function("shiftleft", (e + bias).cast("bigint"), F.lit(fraction)) + ((size / _power(e) - 1) * float(1 << fraction)).cast("bigint"))

    def bits(x: Column) -> Column:
        size = F.abs(x)
        # subnormal numbers have no leading one; two steps, as the whole power can be infinite
        tiny = (size * 2.0 ** ((fraction - least) // 2) * 2.0 ** (fraction - least - (fraction - least) // 2)).cast("bigint")
        found = F.when(size == F.lit(float("inf")), F.lit(infinite)).when(size < F.lit(2.0**least), tiny).otherwise(normal(size)).cast("bigint")
        negative = (x < 0) | (x.cast("string") == "-0.0")
        return F.when(F.isnan(x), F.lit(infinite + (1 << (fraction - 1)))).when(negative, found.bitwiseOR(F.lit(sign))).otherwise(found)

    return let(x.cast("double"), bits)


def from_bits(bits: Column, kind: str) -> Column:
    """The float of a bit pattern, as a double."""
    fraction, least, bias = FLOATS[kind]

    def value(bits: Column) -> Column:
        wide = F.call_function("shiftright", bits, F.lit(fraction)).bitwiseAND(F.lit(2 * bias + 1)).cast("int")
        part = bits.bitwiseAND(F.lit((1 << fraction) - 1)).cast("double")
        negative = bits.bitwiseAND(F.lit(-(1 << 63) if kind == "f64" else 1 << 31)) != 0
        size = F.when(wide == 2 * bias + 1, F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(wide == 0, part * 2.0 ** (least - fraction)).otherwise((part / float(1 << fraction) + 1) * _power(wide - bias))
        return size * F.when(negative, -1.0).otherwise(1.0)

    return let(bits, value)


def encode_value(x: Column, kind: str, dialect: str = "go") -> Column:
    """Tag and payload of a column by kind, a key of TAGS; a null encodes as the null tag. Of a whole number outside a kind of
    up to 4 bytes only the low bytes are kept, so another number comes back."""
    if dialect not in DIALECTS or kind not in TAGS:
        raise ValueError(f"no {kind} in dialect {dialect}")
    if dialect == "rust" and kind in ("datetime", "guid"):
        raise ValueError(f"no {kind} in dialect {dialect}")
    tag = f"{TAGS[kind]:02X}"
    if kind == "null":
        return F.unhex(F.lit("00"))
    if kind == "bool":
        body = F.when(x, "01").otherwise("00")
    elif kind in FLOATS:
        body = little(float_bits(x.cast("double" if kind == "f64" else "float"), kind), WIDTHS[kind])
    elif kind == "string":
        raw = x.cast("binary")
        body = F.concat(little(F.octet_length(raw), 4), F.hex(raw)) if dialect == "rust" else F.hex(raw)
    elif kind == "bytes":
        body = F.concat(little(F.octet_length(x), 4), F.hex(x))
    elif kind == "datetime":
        micros = F.unix_micros(x.cast("timestamp"))
        body = little(micros * 10 + F.lit(EPOCH_TICKS), 8) if dialect == "csharp" else little(micros * 1000, 8)
    elif kind == "guid":
        body = _swap(F.hex(x)) if dialect == "csharp" else F.hex(x)
    else:
        body = little(_wide(x) if kind == "u64" else x, WIDTHS[kind])
    return F.when(x.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.concat(F.lit(tag), body)))


def encode_object(x: Column, kind: T.DataType) -> Column:
    """A whole row, array or scalar as one value of the rust dialect: maps of fields by name, arrays with their length."""
    def size(n: Column) -> Column:
        return F.unhex(little(n, 4))

    if isinstance(kind, T.StructType):
        fields = [F.concat(size(F.octet_length(F.lit(f.name))), F.lit(f.name).cast("binary"), encode_object(x[f.name], f.dataType)) for f in kind.fields]
        body = F.concat(F.unhex(F.lit(f"{OBJECT_TAGS['map']:02X}")), size(F.lit(len(fields))), *fields)
    elif isinstance(kind, T.ArrayType):
        items = F.aggregate(F.transform(x, lambda v: encode_object(v, kind.elementType)), F.unhex(F.lit("")), lambda all_, v: F.concat(all_, v))
        body = F.concat(F.unhex(F.lit(f"{OBJECT_TAGS['array']:02X}")), size(F.size(x)), items)
    else:
        return encode_value(x, OF_TYPE[kind.simpleString()], "rust")
    return F.when(x.isNull(), F.unhex(F.lit("00"))).otherwise(body)


def decode_object(b: Column, kind: T.DataType) -> Column:
    """What encode_object() wrote, as a column of a type. Fields may come in any order, and those that the type doesn't have
    are passed over; bytes that aren't such a value are an error. Values inside have no fixed places, so an Arrow function
    finds them; scalars are decoded as others are."""

    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else json.dumps(_found(memoryview(v), 0, kind)[0]))

    def shaped(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, shaped(f.dataType)) for f in kind.fields])
        return T.ArrayType(shaped(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()

    def decoded(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*(decoded(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda v: decoded(v, kind.elementType))
        return decode_as(F.unhex(x), OF_TYPE[kind.simpleString()], "rust").cast(kind)

    whole_ = T.StructType([T.StructField("v", shaped(kind))])
    return let(F.from_json(F.pandas_udf(find, "string")(b), whole_, {"mode": "FAILFAST"})["v"], lambda x: decoded(x, kind))


def _found(v: memoryview, at: int, kind: T.DataType | None, top: bool = True) -> tuple[object, int]:
    """The scalars of a value as hex in the shape of a type (nothing of what the type hasn't), and where the value ends."""
    def number(k: int) -> int:
        if k + 4 > len(v):
            raise ValueError("truncated object")
        return int.from_bytes(v[k : k + 4], "little", signed=True)

    tag, start = v[at], at
    if tag == OBJECT_TAGS["map"]:
        out, end = {}, at + 5
        inside = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        for _ in range(number(at + 1)):
            n = number(end)
            name = bytes(v[end + 4 : end + 4 + n]).decode()
            value, end = _found(v, end + 4 + n, inside.get(name), False)
            if name in inside:
                out[name] = value
    elif tag == OBJECT_TAGS["array"]:
        out, end = [], at + 5
        for _ in range(number(at + 1)):
            value, end = _found(v, end, kind.elementType if isinstance(kind, T.ArrayType) else None, False)
            out.append(value)
        out = out if isinstance(kind, T.ArrayType) else None
    else:
        names = {t: k for k, t in TAGS.items()}
        if tag not in names:
            raise ValueError(f"unknown value tag {tag:02X}")
        end = at + 1 + (4 + number(at + 1) if names[tag] in ("string", "bytes") else WIDTHS.get(names[tag], 0))
        out = None if tag == 0 or isinstance(kind, (T.StructType, T.ArrayType)) else bytes(v[start:end]).hex()
    if end > len(v):
        raise ValueError("truncated object")
    return ({"v": out} if top else out), end


def _by_tag(tag: Column, values: dict[str, Column]) -> Column:
    out = None
    for kind, value in values.items():
        out = F.when(tag == TAGS[kind], value) if out is None else out.when(tag == TAGS[kind], value)
    return out


def _tag(b: Column) -> Column:
    return F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")


def _whole(b: Column, tag: Column) -> Column:
    """Any whole number, as a bigint; those over 2**63 - 1 as the negative number of the same bits."""
    width = _by_tag(tag, {k: F.lit(WIDTHS[k]) for k in INTEGERS})
    signed = tag.isin([TAGS[k] for k in INTEGERS if k[0] == "i"])
    return let(width, lambda w: let(_raw(b, 2, w), lambda raw: F.when(signed, _signed(raw, w)).otherwise(raw)))


def _text(b: Column, dialect: str) -> Column:
    body = F.substring(b, F.lit(6), _raw(b, 2, 4).cast("int")) if dialect == "rust" else F.substring(b, F.lit(2), F.greatest(F.octet_length(b) - 1, F.lit(0)))
    return body.cast("string")


def _time(b: Column, dialect: str) -> Column:
    number = _raw(b, 2, 8)
    unit, since = (10, number - EPOCH_TICKS) if dialect == "csharp" else (1000, number)
    return F.timestamp_micros(F.call_function("div", since - F.pmod(since, F.lit(unit)), F.lit(unit)))


def _guid(b: Column, dialect: str) -> Column:
    body = F.substring(b, F.lit(2), F.lit(16))
    return F.unhex(_swap(F.hex(body))) if dialect == "csharp" else body


def _as(b: Column, tag: Column, kind: str, dialect: str) -> Column:
    if kind in INTEGERS:
        number = _whole(b, tag)
        if kind == "u64":
            number = let(number, lambda raw: F.when((raw < 0) & (tag == TAGS["u64"]), raw.cast("decimal(20,0)") + whole(2**64)).otherwise(raw.cast("decimal(20,0)")).cast("decimal(20,0)"))
        return F.when(tag.isin([TAGS[k] for k in INTEGERS]), number)
    if kind in FLOATS:
        return _by_tag(tag, {k: from_bits(_raw(b, 2, WIDTHS[k]), k) for k in FLOATS})
    made = {"bool": lambda: F.substring(b, 2, 1) != F.unhex(F.lit("00")), "string": lambda: _text(b, dialect), "bytes": lambda: F.substring(b, F.lit(6), _raw(b, 2, 4).cast("int")), "datetime": lambda: _time(b, dialect), "guid": lambda: _guid(b, dialect), "null": lambda: F.lit(None)}
    return F.when(tag == TAGS[kind], made[kind]())


def decode_as(b: Column, kind: str, dialect: str = "go") -> Column:
    """The value of a kind that the reader knows, a key of TAGS, without what decode_value needs to tell kinds apart: any
    whole number for one of them, any float for one of them, and null for a null value or one of another kind."""
    return let(b, lambda b: let(_tag(b), lambda tag: _as(b, tag, kind, dialect)))


def decode_value(b: Column, dialect: str = "go") -> Column:
    """A struct of DECODED, with the field of the value's type set. An unknown tag is an error, and so is an empty value in
    the csharp dialect; in others that is null."""
    return let(b, lambda b: let(_tag(b), lambda tag: _decoded(b, tag, dialect)))


def _decoded(b: Column, tag: Column, dialect: str) -> Column:
    known = [t for k, t in TAGS.items() if dialect != "rust" or k not in ("datetime", "guid")]
    kinds = {"bool": "bool", "int": "u64", "float": "f64", "string": "string", "bytes": "bytes", "time": "datetime", "guid": "guid"}
    fields = F.struct(tag.cast("tinyint").alias("tag"), *(_as(b, tag, kind, dialect).alias(name) for name, kind in kinds.items()))
    kind = f"struct<{DECODED.replace(', ', ',').replace(' ', ':')}>"
    wrong = F.raise_error(F.concat(F.lit("unknown value tag "), F.hex(F.substring(b, 1, 1)))).cast(kind)
    empty = F.raise_error(F.lit("empty value")).cast(kind) if dialect == "csharp" else F.lit(None).cast(kind)
    return F.when(b.isNull(), F.lit(None)).when(F.octet_length(b) == 0, empty).when(~tag.isin(known), wrong).otherwise(fields)
