"""Shingles, Jaccard similarity, SimHash, string and byte helpers, matchers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from arcspark import schemas

from arcspark.functions.hashing import rabin_longs


def char_shingles(text: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` characters; none for shorter texts."""
    n = F.char_length(text)
    # the characters and the same shifted, side by side: one pass, where substrings would be looked for from the start
    chars = F.split(text, "")
    side = F.arrays_zip(*(F.slice(chars, i + 1, F.greatest(n, F.lit(1))).alias(f"c{i}") for i in range(width)))
    runs = F.transform(F.slice(side, 1, F.greatest(n - width + 1, F.lit(1))), lambda x: F.concat(*(x[f"c{i}"] for i in range(width))))
    return F.when(n < width, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as FLOAT; NaN if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float("nan"))).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).cast("float")


def shingle_numbers(text: str) -> np.ndarray:
    """Distinct runs of three characters, in order, each a number of 21 bits a character; none for shorter texts."""
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(chars) < 3:
        return chars[:0]
    runs = np.sort(chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


@F.arrow_udf(schemas.I)
def shingle_count(texts: pa.Array) -> pa.Array:
    """Size of ``char_shingles`` of width three; 0 where there is no text."""
    return pa.array((len(shingle_numbers(x.as_py() or "")) for x in texts), pa.int32())


def shingle_similarity(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    x, y = shingle_numbers(a), shingle_numbers(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else float("nan")


@F.arrow_udf(FloatType())
def shingle_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """``jaccard`` of the ``char_shingles`` of two texts; only the texts need to travel."""
    return pa.array((shingle_similarity(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)), pa.float32())


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rotate_left_1(h: Column) -> Column:
    return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))


def _vote(hashes: np.ndarray) -> int:
    """Bit i is set if more hashes have it than not."""
    if not len(hashes):
        return 0
    # bits are added up byte by byte, in slices: 64 counts, whatever the number of hashes
    counts, half = np.zeros(64, np.int64), len(hashes)
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for i in range(0, half, 1 << 16):
        counts += np.unpackbits(rows[i : i + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > half, bitorder="little").tobytes(), "little", signed=True)


def simhash_text(text: str | None) -> int:
    """64-bit SimHash of a text's distinct runs of four UTF-16 units; 0 for shorter ones."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    if len(units) < 4:
        return 0
    grams = units[:-3] << np.uint64(48) | units[1:-2] << np.uint64(32) | units[2:-1] << np.uint64(16) | units[3:]
    return _vote(rabin_longs(np.unique(grams).byteswap()))


def simhash_bytes(data: bytes, offset: int = 0) -> int:
    """SimHash of the runs of eight bytes; a byte over 127 sets all bits above its own, as signed bytes do."""
    signed = np.frombuffer(data, np.int8)[offset:].astype(np.int64)
    if len(signed) < 8:
        return 0
    grams = np.zeros(len(signed) - 7, np.int64)
    for i in range(8):
        grams = (grams << 8) | signed[i : len(signed) - 7 + i]
    return _vote(rabin_longs(grams.view(np.uint64).byteswap()))


def simhash_strings(items: set[str]) -> int:
    from arcspark.functions.hashing import rabin_text

    return _vote(np.asarray([rabin_text(s) & 0xFFFFFFFFFFFFFFFF for s in items], np.uint64))


@F.pandas_udf(schemas.L)
def simhash(texts: pd.Series) -> pd.Series:
    return texts.map(simhash_text, na_action="ignore").astype("Int64")


def shortest_prefix(text: Column, patterns: list[str]) -> Column:
    found = F.filter(F.array(*map(F.lit, sorted(patterns, key=lambda p: (len(p), p)))), lambda p: F.startswith(text, p))
    return F.get(found, F.lit(0))


def longest_prefix(text: Column, patterns: list[str]) -> Column:
    found = F.filter(F.array(*map(F.lit, sorted(patterns, key=lambda p: (-len(p), p)))), lambda p: F.startswith(text, p))
    return F.get(found, F.lit(0))


def longest_suffix(text: Column, patterns: list[str]) -> Column:
    found = F.filter(F.array(*map(F.lit, sorted(patterns, key=lambda p: (-len(p), p)))), lambda p: F.endswith(text, p))
    return F.get(found, F.lit(0))


def shortest_suffix(text: Column, patterns: list[str]) -> Column:
    found = F.filter(F.array(*map(F.lit, sorted(patterns, key=lambda p: (len(p), p)))), lambda p: F.endswith(text, p))
    return F.get(found, F.lit(0))


def has_prefix(text: Column, patterns: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.startswith(text, p))


def byte_index_of(data: Column, pattern: bytes) -> Column:
    """Byte position, from 0, of ``pattern``; -1 if it is absent."""
    return F.locate(pattern.decode("latin-1"), F.decode(data, "ISO-8859-1")) - 1


def escaped_text(value: Column) -> Column:
    """One line of text: CR becomes a blank, the ends are trimmed of blanks and control characters, LF and TAB are escaped."""
    bare = F.regexp_replace(F.replace(value, F.lit("\r"), F.lit(" ")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.replace(F.replace(bare, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def utf8_find(text: Column, what: str) -> Column:
    """Byte offset of ``what`` in the text's UTF-8; -1 if it is absent."""
    at = F.instr(text, what)
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substring(text, F.lit(1), at - 1)))


def meta_charset(content: Column) -> Column:
    """The charset that an http-equiv content-type tag names in the first 2000 bytes, else null."""
    head = F.decode(F.call_function("substring", content.cast("binary"), F.lit(1), F.lit(2000)), "ISO-8859-1")
    tag = F.regexp_extract(head, META_TAG, 1)
    found = F.regexp_extract(tag, META_CHARSET, 1)
    return F.when(found == "", None).otherwise(found)


# What a content-type meta tag and its charset look like.
META_TAG = r"(?i)<meta\s+([^>]*http-equiv\s*=\s*[\"']?content-type[\"']?[^>]*)>"
META_CHARSET = r"(?i)charset\s*=\s*([a-z][_\-0-9a-z]*)"
