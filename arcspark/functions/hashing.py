"""Rabin fingerprints, Murmur2, CRC-16, MD5 signatures and the hash of a byte string."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arcspark import schemas

# An irreducible polynomial for each degree, highest bit first.
POLYNOMIALS = {64: 0xD74307D3FD3382DB, 40: 0x8643FFF621800000, 32: 0x9B6C9A2F80000000, 24: 0x8E375B8000000000}
_MASK, _TOP = (1 << 64) - 1, 1 << 63


@cache
def _overflow(degree: int) -> int:
    """x to the 64th modulo the polynomial; the top bit of a number is the constant term."""
    f, poly = _TOP, POLYNOMIALS[degree]
    for _ in range(64):
        out = f & 1 if degree == 64 else f >> (64 - degree) & 1
        f = (f >> 1) ^ (poly if out else 0)
    return f


def _reduced(f: int, degree: int) -> int:
    for k in range(63, degree - 1, -1):
        if f >> (63 - k) & 1:
            f ^= POLYNOMIALS[degree] >> (k - degree)
    return f


@cache
def _tables(poly: int) -> np.ndarray:
    """Row k: what a byte adds when 8 - k bytes follow its place; row 7 is a byte step."""

    def shifted(value: int, bits: int) -> int:
        for _ in range(bits):
            value = (value >> 1) ^ (poly if value & 1 else 0)
        return value

    # a byte's bits leave at the low end, one after the other, each folding the polynomial in
    step = np.asarray([shifted(b, 8) for b in range(256)], np.uint64)
    rows = [step]
    for _ in range(7):
        before = rows[0]
        rows.insert(0, (before >> np.uint64(8)) ^ step[(before & np.uint64(0xFF)).astype(np.int64)])
    return np.stack(rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x & _TOP else x


def start_of(degree: int) -> int:
    """What a fingerprint of no bytes begins with; bytes are folded in by the same number."""
    return _overflow(degree)


def rabin_bytes(data: bytes, degree: int = 64) -> int:
    """Fingerprint of a byte string as a signed long; that of no bytes is the polynomial."""
    f = _overflow(degree)
    table = [int(x) for x in _tables(f)[7]]
    for b in data:
        f ^= b
        f = (f >> 8) ^ table[f & 0xFF]
    return _signed(_reduced(f, degree))


def rabin_text(text: str, degree: int = 64) -> int:
    """Two bytes for each UTF-16 unit, the low one first."""
    return rabin_bytes(text.encode("utf-16-le", "surrogatepass"), degree)


def rabin_longs(values: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of 8-byte strings packed little-endian, all at once."""
    table = _tables(POLYNOMIALS[64])
    f = values ^ np.uint64(POLYNOMIALS[64])
    out = np.zeros(len(f), np.uint64)
    for k in range(8):
        out ^= table[k][((f >> np.uint64(8 * k)) & np.uint64(0xFF)).astype(np.int64)]
    return out


@F.pandas_udf(schemas.L)
def rabin64(texts: pd.Series) -> pd.Series:
    known = texts.notna().to_numpy()
    out = pd.Series(pd.NA, index=texts.index, dtype="Int64")
    if known.any():
        out[known] = rabin_many([t.encode("utf-16-le", "surrogatepass") for t in texts[known]])
    return out


def _int32(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def murmur2(data: bytes, seed: int = 0) -> int:
    """32-bit Murmur2; the bytes after the last whole four are signed, the first of them the highest."""
    m, h = 0x5BD1E995, (seed ^ len(data)) & 0xFFFFFFFF
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
        k = (k ^ k >> 24) * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ k
    rest = [b - 256 if b > 127 else b for b in data[whole:]]
    if rest:
        for i, b in enumerate(reversed(rest)):
            h ^= b << 8 * i & 0xFFFFFFFF
        h = h * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return _int32(h ^ h >> 15)


def murmur2_many(data: list[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """``murmur2`` of many byte strings, four bytes of all of them at a time; as unsigned numbers."""
    n = np.fromiter(map(len, data), np.int64, len(data))
    out = np.zeros(len(data), np.uint32)
    seeds = np.broadcast_to(np.asarray(seeds, np.uint32), len(data))
    m = np.uint32(0x5BD1E995)
    for size in np.unique(n):
        which = np.flatnonzero(n == size)
        rows = np.frombuffer(b"".join(data[i] for i in which), np.uint8).reshape(len(which), size)
        h = seeds[which] ^ np.uint32(size)
        whole = size // 4 * 4
        words = np.ascontiguousarray(rows[:, :whole]).view("<u4")
        with np.errstate(over="ignore"):
            for j in range(whole // 4):
                k = words[:, j] * m
                h = h * m ^ (k ^ k >> np.uint32(24)) * m
            for i in range(size - whole):
                h = h ^ rows[:, size - 1 - i].view(np.int8).astype(np.int32).view(np.uint32) << np.uint32(8 * i)
            if size > whole:
                h = h * m
            h = (h ^ h >> np.uint32(13)) * m
        out[which] = h ^ h >> np.uint32(15)
    return out


def _to_bytes(value) -> bytes:
    """Text as UTF-8, whole numbers as 4 or 8 bytes by their type, floats as their bits, booleans as one byte; high bytes first."""
    if isinstance(value, str):
        return value.encode("utf-8", "surrogatepass")
    if isinstance(value, (bool, np.bool_)):
        return b"\1" if value else b"\0"
    if isinstance(value, (np.int32, np.float32)):
        return value.astype(value.dtype.newbyteorder(">")).tobytes()
    if isinstance(value, (int, np.integer)):
        return int(value).to_bytes(8, "big", signed=True)
    if isinstance(value, (float, np.floating)):
        return np.asarray(value, ">f8").tobytes()
    return bytes(value)


def _mapped(values: pd.Series, of) -> pd.Series:
    """``of`` (a list of byte strings -> numbers) for all that isn't null."""
    known = values.notna().to_numpy()
    out = pd.Series(pd.NA, index=values.index, dtype="Int32")
    if known.any():
        out[known] = of([_to_bytes(v) for v in values[known]])
    return out


@F.pandas_udf(schemas.I)
def murmur2_of(values: pd.Series) -> pd.Series:
    """Murmur2 of text, bytes, numbers or booleans."""
    return _mapped(values, lambda data: murmur2_many(data).view(np.int32))


@F.pandas_udf(schemas.I)
def murmur2_text(texts: pd.Series) -> pd.Series:
    return _mapped(texts, lambda data: murmur2_many(data).view(np.int32))


@cache
def _crc16() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xA001 if b & 1 else 0)
        out.append(b)
    return out


def crc16(data: bytes, start: int = 0) -> int:
    """CRC-16/ARC."""
    table = _crc16()
    for b in data:
        start = start >> 8 ^ table[(start ^ b) & 0xFF]
    return start


def _folded(data: list[bytes], start, table: np.ndarray) -> np.ndarray:
    """f = (f >> 8) ^ table[low byte of f ^ byte] over the bytes of many strings, a byte of all of them at a time."""
    n = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-n, kind="stable")
    flat, starts, longest = np.frombuffer(b"".join(data), np.uint8), (np.cumsum(n) - n)[order], n[order]
    out, kind = np.full(len(data), start, table.dtype), table.dtype.type
    live = len(data)
    for j in range(int(n.max(initial=0))):
        while live and longest[live - 1] <= j:
            live -= 1
        f = out[:live]
        out[:live] = f >> kind(8) ^ table[((f ^ flat[starts[:live] + j]) & kind(0xFF)).astype(np.int64)]
    back = np.empty(len(data), table.dtype)
    back[order] = out
    return back


def crc16_many(data: list[bytes]) -> np.ndarray:
    """``crc16`` of many byte strings."""
    return _folded(data, 0, np.asarray(_crc16(), np.int32))


def rabin_many(data: list[bytes]) -> np.ndarray:
    """``rabin_bytes`` of many byte strings, in 64 bits, as signed numbers."""
    start = start_of(64)
    return _folded(data, start, _tables(start)[7]).view(np.int64)


@F.pandas_udf(schemas.I)
def crc16_of(data: pd.Series) -> pd.Series:
    return _mapped(data, crc16_many)


def md5_signature(data: Column) -> Column:
    """MD5 digest as binary; empty for empty input."""
    return F.when(F.octet_length(data) == 0, F.lit(b"")).otherwise(F.unhex(F.md5(data.cast("binary"))))


def _polynomial(units: np.ndarray) -> int:
    """The sum of units by powers of 31, the last unit by one, in 32 bits."""
    powers = np.full(len(units), 31, np.uint32)
    powers[:1] = 1
    with np.errstate(over="ignore"):
        return _int32(int((units[::-1].astype(np.uint32) * np.cumprod(powers, dtype=np.uint32)).sum(dtype=np.uint32)))


def bytes_hash(data: bytes) -> int:
    """31 h + byte, bytes signed, in 32 bits."""
    return _polynomial(np.frombuffer(data, np.int8).astype(np.int32))


def string_hash(text: str) -> int:
    """31 h + unit over UTF-16 units, in 32 bits."""
    return _polynomial(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2"))


@F.pandas_udf(schemas.I)
def string_hash_of(texts: pd.Series) -> pd.Series:
    return texts.map(string_hash, na_action="ignore").astype("Int32")
