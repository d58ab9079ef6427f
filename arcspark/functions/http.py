"""Content types, HTTP dates, charset names, sniffing, detection and decoding."""

from __future__ import annotations

import codecs
import re
from calendar import timegm
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from arcspark import schemas
from arcspark.functions import charsets
from arcspark.functions.text import META_CHARSET, META_TAG

# ------------------------------------------------------------- content type

_TYPE = re.compile(r"[ \t]*([^ \t;(]*)")
_PARAM = re.compile(r";[ \t]*charset=[ \t]*(?:([\"'])(.*?)(?:\1|$)|([^ \t;(]*))", re.I | re.S)


def parse_content_type(value: str | None) -> tuple[str | None, str | None]:
    """(type, charset), lower case; neither for an empty value, ``*/*`` or one without a slash."""
    if not value or value == "*/*" or "/" not in value:
        return None, None
    m = _TYPE.match(value)
    kind, charset = m[1].lower(), None
    for p in _PARAM.finditer(value, m.end()):
        charset = (p[2] if p[1] else p[3]).lower() or None
    return kind, charset


@F.pandas_udf(schemas.CONTENT_TYPE)
def content_type(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_content_type(v) for v in values], columns=["content_type", "charset"])


# --------------------------------------------------------------------- dates

# The months' prefixes and the characters between fields.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_BETWEEN = re.compile(r"[\t !\"#$%&'()*+,\-./;<=>?@\[\\\]^_`{|}~]+")
_CLOCK = re.compile(r"(\d{1,4}):(\d{1,4}):(\d{1,4}).*", re.S)


def parse_http_date(text: str | None) -> int:
    """Epoch milliseconds, or -1. Month names may be longer; two-digit years mean 1969 to 2068."""
    day = month = year = None
    clock: tuple[int, ...] | None = None
    for word in _BETWEEN.split(text or ""):
        if not word:
            continue
        if not "0" <= word[0] <= "9":
            if month is None:
                month = next((i for i, m in enumerate(MONTHS, 1) if word.lower().startswith(m)), None)
        elif ":" in word:
            if clock is None and (m := _CLOCK.fullmatch(word)):
                clock = tuple(map(int, m.groups()))
        elif word.isascii() and word.isdigit():
            if day is None and len(word) <= 2:
                day = int(word)
            elif year is None and len(word) <= 5:
                year = int(word)
    if None in (day, month, year, clock):
        return -1
    if year <= 99:
        year += 1900 if year >= 69 else 2000
    if not (1 <= day <= 31 and 1601 <= year <= 30827 and clock[0] <= 23 and clock[1] <= 59 and clock[2] <= 59):
        return -1
    return timegm((year, month, day, *clock)) * 1000


@F.pandas_udf(schemas.L)
def http_date(values: pd.Series) -> pd.Series:
    return pd.Series([parse_http_date(v) for v in values], dtype="int64")


def ts14_millis(text: Column) -> Column:
    """yyyyMMddHHmmss in UTC -> epoch milliseconds; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


#: Short names of the default zone's two offsets from UTC, in hours.
ZONE_NAMES = {-8: "PST", -7: "PDT"}


def format_millis(millis: Column, zone: str = "America/Los_Angeles", names: dict[int, str] | None = None) -> Column:
    """``yyyy.MM.dd at hh:mm:ss`` and the zone's short name (its offset if it has none), empty for -1."""
    utc = F.timestamp_millis(millis)
    there = F.from_utc_timestamp(utc, zone)
    seconds = F.unix_timestamp(there) - F.unix_timestamp(utc)
    name = F.concat(F.lit("GMT"), F.when(seconds < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(seconds) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(F.abs(seconds) / 60) % 60).cast("string"), 2, "0"))
    for hours, short in (ZONE_NAMES if names is None else names).items():
        name = F.when(seconds == hours * 3600, short).otherwise(name)
    return F.when(millis == -1, "").otherwise(F.concat(F.date_format(there, "yyyy.MM.dd 'at' hh:mm:ss "), name))


# ------------------------------------------------------------------ charsets

#: Names that Python spells otherwise or doesn't know; every other alias is Python's own.
ALIASES = {
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "ms_kanji": "cp932",
    "euc-jp": "euc_jp", "x-euc-jp": "euc_jp", "ks_c_5601-1987": "cp949", "ks_c_5601": "cp949", "x-windows-949": "cp949",
    "gb_2312-80": "gb2312", "x-gbk": "gbk", "gb2312": "gbk", "big5": "big5hkscs", "iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "ascii",
    "x-mac-roman": "mac_roman", "macintosh": "mac_roman", "unicode": "utf_16", "x-utf-8": "utf_8",
}


#: Families of names that differ in their prefix alone -> the codec's name.
FAMILIES = [
    (re.compile(r"(?:x-|cs)?(?:windows|win|cp|ms|ibm|dos|pc)[-_ ]?0*(\d{2,5})"), "cp{}"),
    (re.compile(r"(?:x-|cs)?iso[-_ ]?8859[-_ ]?(\d{1,2})(?:[-_](?:e|i)|:\d{4})?"), "iso8859_{}"),
    (re.compile(r"(?:csiso)?latin[-_ ]?(\d{1,2})|l(\d{1,2})"), "latin{}"),
    (re.compile(r"(?:x-|cs|unicode-\d-\d-)?utf[-_ ]?(8|16|32|7)(?:[-_ ]?n|[-_ ]?mac)?"), "utf_{}"),
    (re.compile(r"(?:x-)?(?:unicode-|utf[-_ ]?16[-_ ]?|x-utf-16)(le|be)(?:-bom)?"), "utf_16_{}"),
    (re.compile(r"(?:x-)?mac-?(roman|greek|cyrillic|turkish|iceland|croatian|romania)"), "mac_{}"),
    (re.compile(r"(?:x-|cs)?euc[-_ ]?(jp|kr|cn)"), "euc_{}"),
    (re.compile(r"(?:x-|cs)?koi8[-_ ]?(r|u|t)"), "koi8_{}"),
    (re.compile(r"(?:cs)?iso[-_ ]?2022[-_ ]?(jp(?:-[123]|-2004|-ext)?|kr)"), "iso2022_{}"),
]
#: Latin alphabets by number where a codec has another: ISO names part 9 the fifth, and so on.
LATIN = {"5": "iso8859_9", "6": "iso8859_10", "7": "iso8859_13", "8": "iso8859_14", "9": "iso8859_15", "10": "iso8859_16"}


def _family(key: str) -> str | None:
    for pattern, shape in FAMILIES:
        if m := pattern.fullmatch(key):
            part = next(g for g in m.groups() if g is not None)
            if shape == "latin{}":
                return "cp1252" if part == "1" else LATIN.get(part, f"iso8859_{part}")
            # browsers read part 1 as the wider Windows page, which has it whole
            return "cp1252" if shape == "iso8859_{}" and part == "1" or shape == "cp{}" and part == "819" else shape.format(part.replace("-", "_"))
    return None


def charset_codec(name: str | None) -> str | None:
    """The codec for a charset's name, or None."""
    key = (name or "").strip().strip("\"'").lower()
    for candidate in (ALIASES.get(key), _family(key), key):
        if candidate:
            try:
                return codecs.lookup(candidate).name
            except (LookupError, ValueError):
                continue
    return None


_META, _META_CHARSET = re.compile(META_TAG.encode()), re.compile(META_CHARSET.encode())


def sniff_meta(content: bytes) -> str | None:
    m = _META.search(content[:2000])
    found = _META_CHARSET.search(m[1]) if m else None
    return found[1].decode("ascii") if found else None


def _escapes(data: bytes) -> str | None:
    if b"\x1b$)A" in data or b"\x1b$)G" in data or b"\x1b$*H" in data:
        return "ISO-2022-CN"
    if b"\x1b$)C" in data:
        return "ISO-2022-KR"
    if b"\x1b$B" in data or b"\x1b$@" in data or b"\x1b(J" in data:
        return "ISO-2022-JP"
    if b"~{" in data and b"~}" in data:
        return "HZ-GB-2312"
    return None


def _by_marks(data: bytes) -> str | None:
    """What marks, escape sequences, valid UTF-8 or zeros say; None if only the double-byte charsets are left, or none."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE")):
        if data.startswith(mark):
            return name
    if data.isascii():
        return _escapes(data) or "ASCII"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    if data.count(0) > len(data) // 4:
        return "UTF-16BE" if data[0::2].count(0) > data[1::2].count(0) else "UTF-16LE"
    return None


def detect_charsets(contents: Iterable[bytes | None], most: int | None = None) -> list[str | None]:
    """The likeliest charset of each content, or of its first ``most`` bytes; ASCII for plain text, None for none.

    Marks and escape sequences decide first, then valid UTF-8, then the
    automata of the double-byte charsets, all contents that are left at once;
    windows-1252 is what no automaton takes. Approximate where several fit.
    """
    data = [None if c is None else bytes(c if most is None else c[:most]) for c in contents]
    found = [_by_marks(d) if d else None for d in data]
    left = [i for i, d in enumerate(data) if d and found[i] is None]
    for i, name in zip(left, charsets.double_byte([data[i] for i in left]), strict=True):
        found[i] = name or "windows-1252"
    return found


def detect_charset(content: bytes, most: int | None = None) -> str | None:
    return detect_charsets([content], most)[0]


@F.pandas_udf(schemas.S)
def detected_charset(contents: pd.Series) -> pd.Series:
    return pd.Series(detect_charsets(contents), index=contents.index, dtype=object)


@F.pandas_udf(schemas.B)
def encoded(texts: pd.Series, charset_names: pd.Series) -> pd.Series:
    """Text in the charset of a name, with question marks for what it lacks; null for a name that is none."""
    return pd.Series([t.encode(c, "replace") if t is not None and (c := charset_codec(n)) else None for t, n in zip(texts, charset_names, strict=True)], index=texts.index, dtype=object)


def decode_all(contents: Iterable[bytes | None], header_charsets: Iterable[str | None], text: bool = True, html: bool = True) -> list[tuple[str | None, str | None]]:
    """(text, charset) of each content: by the header's charset, then the meta tag's, then the detected one."""
    data = [None if c is None else bytes(c) for c in contents]
    found = [None if d is None else html and charset_codec(sniff_meta(d)) or charset_codec(said) for d, said in zip(data, header_charsets, strict=True)]
    unknown = [i for i, d in enumerate(data) if text and d is not None and found[i] is None]
    for i, name in zip(unknown, detect_charsets([data[i] for i in unknown]), strict=True):
        found[i] = charset_codec(name)
    return [(None, None) if d is None or c is None else (d.decode(c, "replace"), c) for d, c in zip(data, found, strict=True)]


def decode_best_effort(content: bytes, header_charset: str | None, text: bool = True, html: bool = True) -> tuple[str | None, str | None]:
    return decode_all([content], [header_charset], text, html)[0]


#: Contents of a batch that are decoded at once.
DECODED_AT_ONCE = 128


def decode_arrays(contents: pa.Array, said: pa.Array) -> pa.Array:
    """``decode_all`` over a batch, of which few contents at a time are Python's."""
    kind, parts = pa.struct([("text", pa.string()), ("charset", pa.string())]), []
    for a in range(0, len(contents), DECODED_AT_ONCE):
        rows = decode_all(contents[a : a + DECODED_AT_ONCE].to_pylist(), said[a : a + DECODED_AT_ONCE].to_pylist())
        parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], fields=list(kind)))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(schemas.DECODED)
def decoded(contents: pa.Array, charsets: pa.Array) -> pa.Array:
    return decode_arrays(contents, charsets)
