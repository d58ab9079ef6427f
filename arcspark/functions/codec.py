"""Escapes, Base64 variants, gzip, Rice codes, bit streams, variable-length numbers, dumps."""

from __future__ import annotations

import base64
import gzip
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arcspark import schemas

# -------------------------------------------------------------------- escapes


def escape(text: str, chars: str = ",", mark: str = "\\") -> str:
    return "".join(mark + c if c in chars or c == mark else c for c in text)


def unescape(text: str, chars: str = ",", mark: str = "\\") -> str:
    """The text without escapes; an unknown, unfinished or missing one is an error."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == mark:
            if i + 1 == len(text):
                raise ValueError("an escape is not finished")
            if text[i + 1] not in chars and text[i + 1] != mark:
                raise ValueError(f"{text[i + 1]!r} is escaped needlessly")
            c, i = text[i + 1], i + 1
        elif c in chars:
            raise ValueError(f"{c!r} is not escaped")
        out.append(c)
        i += 1
    return "".join(out)


def join_escaped(parts: list[str], separator: str = ",") -> str:
    return separator.join(escape(p, separator) for p in parts)


def split_escaped(text: str, separator: str = ",", mark: str = "\\") -> list[str]:
    out, now, i = [], [], 0
    while i < len(text):
        if text[i] == mark and i + 1 < len(text):
            now.append(text[i : i + 2])
            i += 2
            continue
        if text[i] == separator:
            out.append("".join(now))
            now = []
        else:
            now.append(text[i])
        i += 1
    return [unescape(p, separator, mark) for p in [*out, "".join(now)]]


def escaped(text: Column, chars: str = ",") -> Column:
    kinds = "".join(f"\\{c}" for c in chars)
    return F.regexp_replace(text, f"([\\\\{kinds}])", r"\\\\$1".replace("\\\\\\\\", "\\\\"))


def concat_escaped(parts: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(parts, lambda p: escaped(p, separator)), separator)


# --------------------------------------------------------------------- base64

# The standard alphabet, and one whose order is that of the bytes it encodes.
_STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ORDERED = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"


def base64_encode(data: bytes, url_safe: bool = False, ordered: bool = False, compress: bool = False, lines: bool = False) -> str:
    data = gzip.compress(data, mtime=0) if compress else data
    text = base64.b64encode(data).decode("ascii")
    if ordered:
        text = text.translate(str.maketrans(_STANDARD, _ORDERED))
    elif url_safe:
        text = text.translate(str.maketrans("+/", "-_"))
    return "\n".join(text[i : i + 76] for i in range(0, len(text), 76)) if lines else text


def base64_decode(text: str, ordered: bool = False) -> bytes:
    text = "".join(text.split())
    text = text.translate(str.maketrans(_ORDERED, _STANDARD)) if ordered else text.translate(str.maketrans("-_", "+/"))
    data = base64.b64decode(text + "=" * (-len(text) % 4))
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def base64_url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


# ----------------------------------------------------------------------- gzip


def gunzip_best_effort(data: bytes, limit: int | None = None) -> tuple[bytes | None, bool]:
    """(what could be read, whether the limit cut it); None if nothing could."""
    inflater, out = zlib.decompressobj(31), bytearray()
    try:
        out += inflater.decompress(data, (limit + 1) if limit is not None else 0)
    except zlib.error:
        for i in range(0, len(data), 512):  # again, up to where it breaks
            if i == 0:
                inflater, out = zlib.decompressobj(31), bytearray()
            try:
                out += inflater.decompress(data[i : i + 512])
            except zlib.error:
                break
    cut = limit is not None and len(out) > limit
    return (bytes(out[:limit] if cut else out) or (b"" if inflater.eof else None)), cut


@F.pandas_udf(schemas.B)
def gzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda x: gzip.compress(bytes(x), mtime=0), na_action="ignore")


@F.pandas_udf(schemas.GUNZIPPED)
def gunzipped(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gunzip_best_effort(bytes(x)) if x is not None else (None, None) for x in data], columns=["data", "was_truncated"])


# ----------------------------------------------------------------- bit streams


class Bits:
    """Bits in order, the lowest of each byte first."""

    def __init__(self, data: bytes = b"", size: int = 0):
        self.data, self.size = bytearray(data), size

    def append(self, bit: int) -> None:
        if self.size == 8 * len(self.data):
            self.data.append(0)
        self.data[self.size >> 3] |= bit << (self.size & 7)
        self.size += 1

    def get(self, i: int) -> int:
        return self.data[i >> 3] >> (i & 7) & 1


def rice_encode(values: list[int], m: int, signed: bool = True) -> tuple[bytes, int, int]:
    """(bits, number of bits, number of values): sign, quotient in ones ended by a zero, m bits of rest, high ones first."""
    shown = []
    for v in values:
        x = abs(v) if signed and v != -(1 << 63) else v
        rest = f"{x & ((1 << m) - 1):0{m}b}" if m else ""
        shown.append(f"{'1' if signed and v < 0 else '0' if signed else ''}{'1' * abs(x >> m)}0{rest}")
    bits = np.frombuffer("".join(shown).encode("ascii"), np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes(), len(bits), len(values)


def rice_decode(data: bytes, count: int, m: int, signed: bool = True) -> list[int]:
    shown = (np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little") | 48).tobytes().decode("ascii")
    at, out = 0, []
    for _ in range(count):
        negative = signed and shown[at] == "1"
        at += signed
        end = shown.index("0", at)  # the quotient's end
        x = (end - at) << m | (int(shown[end + 1 : end + 1 + m], 2) if m else 0)
        at = end + 1 + m
        out.append(-x if negative else x)
    return out


@F.pandas_udf(schemas.B)
def rice_encoded(values: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([rice_encode(list(map(int, v)), int(k))[0] if v is not None else None for v, k in zip(values, m, strict=True)])


@F.pandas_udf(schemas.LONGS)
def rice_decoded(data: pd.Series, count: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([rice_decode(bytes(d), int(n), int(k)) if d is not None else None for d, n, k in zip(data, count, m, strict=True)])


# --------------------------------------------------------------- small numbers


def vlong_encode(value: int) -> bytes:
    """-112 to 127 in a byte; else a byte that tells sign and length, and the bytes, high ones first."""
    if -112 <= value <= 127:
        return bytes([value & 0xFF])
    base, x = (-112, value) if value >= 0 else (-120, ~value)
    size = (x.bit_length() + 7) // 8
    return bytes([(base - size) & 0xFF]) + x.to_bytes(size, "big")


def vlong_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position behind it)."""
    first = data[at] - 256 if data[at] > 127 else data[at]
    if first >= -112:
        return first, at + 1
    negative = first < -120
    size = -120 - first if negative else -112 - first
    x = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    return (~x if negative else x), at + 1 + size


def parse_long(data: bytes, radix: int = 10) -> int:
    """A signed number in ``radix``; a ValueError beyond 64 bits or for any other character."""
    text = data.decode("ascii")
    if not text or text != text.strip() or "_" in text or not 2 <= radix <= 36:
        raise ValueError(text)
    value = int(text, radix)
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError("out of range")
    return value


def hex_dump(data: bytes, offset: int = 0) -> str:
    rows = []
    for i in range(0, len(data), 16):
        part = data[i : i + 16]
        shown = "".join(chr(b) if 0x20 <= b < 0x7F else "." for b in part)
        rows.append(f"{offset + i:08X} {' '.join(f'{b:02X}' for b in part):<48}{shown}")
    return "\n".join(rows)


# --------------------------------------------------------------- column forms


def _column(kind, of, *, per_row: int = 1):
    """A pandas UDF of ``of``; what it can't read is null, as with Spark's try functions."""

    def one(*values):
        if any(v is None for v in values):
            return None
        try:
            return of(*values)
        except (ValueError, IndexError):
            return None

    if per_row == 1:

        @F.pandas_udf(kind)
        def mapped(a: pd.Series) -> pd.Series:
            return pd.Series([one(None if v is None else v) for v in a], dtype="object")

        return mapped

    @F.pandas_udf(kind)
    def mapped_two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return mapped_two


def unescaped(text: Column, chars: str = ",") -> Column:
    """The text without escapes; null where one is wrong."""
    return _column(schemas.S, lambda t: unescape(t, chars))(text)


def split_escaped_of(text: Column, separator: str = ",") -> Column:
    """The parts of an escaped list; null where an escape is wrong."""
    return _column(schemas.STRINGS, lambda t: split_escaped(t, separator))(text)


def parsed_long(data: Column, radix: Column) -> Column:
    """A signed number in ``radix``; null beyond 64 bits or for any other character."""
    return _column(schemas.L, lambda d, r: parse_long(bytes(d), int(r)), per_row=2)(data.cast("binary"), radix)


def vlong_bytes(value: Column) -> Column:
    return _column(schemas.B, lambda v: vlong_encode(int(v)))(value)


def vlong_value(data: Column) -> Column:
    """The number that the data begin with."""
    return _column(schemas.L, lambda d: vlong_decode(bytes(d))[0])(data)


def bit_at(data: Column, i: Column) -> Column:
    """Bit ``i`` of a bit stream, as built-in functions have it."""
    byte = F.conv(F.hex(F.substring(data, F.shiftright(i, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, i.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))


def gunzipped_to(limit: int):
    """``gunzipped`` that stops after ``limit`` bytes."""

    @F.pandas_udf(schemas.GUNZIPPED)
    def unpack(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([gunzip_best_effort(bytes(x), limit) if x is not None else (None, None) for x in data], columns=["data", "was_truncated"])

    return unpack
