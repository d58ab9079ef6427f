"""HTTP header arrays: ARRAY<STRUCT<item_key, item_value>>, in order, keys nullable and repeatable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KIND = "array<struct<item_key:string,item_value:string>>"


def header(key: Column | str | None, value: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(key).cast("string").alias("item_key"), lit(value).cast("string").alias("item_value"))


def _is(x: Column, key: str | None) -> Column:
    return x["item_key"].isNull() if key is None else F.coalesce(F.lower(x["item_key"]) == key.lower(), F.lit(False))


def find(headers: Column, key: str | None) -> Column:
    """The last value of ``key``, without regard to case; the status line for None."""
    return F.try_element_at(F.filter(headers, lambda x: _is(x, key)), F.lit(-1))["item_value"]


def find_all(headers: Column, key: str | None) -> Column:
    return F.transform(F.filter(headers, lambda x: _is(x, key)), lambda x: x["item_value"])


def grouped(headers: Column, exclude: list[str] | None = None) -> Column:
    """key -> values, the last one first, without the excluded keys."""
    wanted = F.filter(headers, lambda x: x["item_key"].isNotNull() & ~F.lower(x["item_key"]).isin([e.lower() for e in exclude or []]))
    keys = F.array_distinct(F.transform(wanted, lambda x: F.lower(x["item_key"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.reverse(F.transform(F.filter(wanted, lambda x: F.lower(x["item_key"]) == k), lambda x: x["item_value"]))))


def add(headers: Column, key: str | None, value: Column | str) -> Column:
    return F.concat(headers, F.array(header(key, value)).cast(_KIND))


def prepend(headers: Column, key: str | None, value: Column | str) -> Column:
    return F.concat(F.array(header(key, value)).cast(_KIND), headers)


def set_at(headers: Column, index: int, key: str | None, value: Column | str) -> Column:
    return F.transform(headers, lambda x, i: F.when(i == index, header(key, value)).otherwise(x))


def remove(headers: Column, key: str | None) -> Column:
    return F.filter(headers, lambda x: ~_is(x, key))


def set_value(headers: Column, key: str | None, value: Column | str) -> Column:
    """Replaces every ``key``, or adds it."""
    changed = F.transform(headers, lambda x: F.when(_is(x, key), header(key, value)).otherwise(x))
    return F.when(F.exists(headers, lambda x: _is(x, key)), changed).otherwise(add(headers, key, value))


def set_if_absent(headers: Column, key: str | None, value: Column | str) -> Column:
    return F.when(F.exists(headers, lambda x: _is(x, key)), headers).otherwise(add(headers, key, value))


def parse(text: Column) -> Column:
    """Header lines -> array: folded lines join the one before, tabs become blanks, a line without a key has a null one."""
    unfolded = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]+", " ")
    lines = F.filter(F.split(F.replace(unfolded, F.lit("\t"), F.lit(" ")), "\n"), lambda x: F.trim(x) != "")
    key = lambda x: F.regexp_extract(x, r"^([^\s:]+)\s*:", 1)
    return F.transform(lines, lambda x: F.when(key(x) != "", F.struct(key(x).alias("item_key"), F.trim(F.regexp_replace(x, r"^[^\s:]+\s*:", "")).alias("item_value"))).otherwise(F.struct(F.lit(None).cast("string").alias("item_key"), F.trim(x).alias("item_value"))))


def parse_plain(text: Column) -> Column:
    """Lines split at CR or LF; those whose value is empty go."""
    lines = F.filter(F.split(text, "[\r\n]+"), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.when(F.instr(x, ":") > 0, header(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))).otherwise(header(None, F.trim(x))))
    return F.filter(pairs, lambda x: x["item_value"] != "")


def render(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda x: F.concat(F.when(x["item_key"].isNull() | (x["item_key"] == ""), F.lit("")).otherwise(F.concat(x["item_key"], F.lit(":"))), F.coalesce(x["item_value"], F.lit("")), F.lit("\r\n"))), "")


def split_value(value: Column) -> Column:
    """(header_length, content_length) of a raw record's value; no blank line counts as at -1."""
    at = F.locate("\r\n\r\n", F.decode(value, "ISO-8859-1")) - 1
    head = F.when(at < 0, 3).otherwise(at + 4)
    return F.struct(head.alias("header_length"), (F.octet_length(value) - head).alias("content_length"))


def content_of(value: Column) -> Column:
    return F.call_function("substring", value, split_value(value)["header_length"] + 1)


def item_of(value: Column, url: Column, prefix: str | None = None) -> Column:
    """A raw record's value -> the item's columns, with built-in functions alone; ``prefix`` is that of the own headers' names."""
    from arcspark.sources.members import HOST_IP, MIME_TYPE, PREFIX, TIMESTAMP

    prefix = PREFIX if prefix is None else prefix

    head = F.decode(F.call_function("substring", value, F.lit(1), split_value(value)["header_length"]), "UTF-8")
    lines = F.filter(F.split(head, "\r\n"), lambda x: x != "")
    usable = lambda x: (F.instr(x, ":") > 0) & ~x.endswith(":")
    headers = F.transform(lines, lambda x: F.when(usable(x), header(F.substring_index(x, ":", 1), F.regexp_replace(x, "^[^:]*:", ""))).otherwise(header(None, x)))
    return F.struct(
        url.alias("uri"), find(headers, prefix + HOST_IP).alias("host_ip"), F.unix_millis(F.try_to_timestamp(find(headers, prefix + TIMESTAMP), F.lit("yyyyMMddHHmmss"))).alias("timestamp"),
        find(headers, prefix + MIME_TYPE).alias("mime_type"), F.octet_length(value).alias("record_length"), headers.alias("header_items"), content_of(value).alias("content"),
    )


def http_status(line: Column) -> Column:
    """The status code; 200 for lines that are missing, short or not HTTP, 0 if it is too large."""
    digits = F.regexp_extract(F.coalesce(line, F.lit("")), r"(?i)^\s*http/?[^ ]* +([0-9]+)", 1)
    return F.when(digits == "", 200).otherwise(F.coalesce(digits.try_cast("int"), F.lit(0)))


def response_code(line: Column) -> Column:
    """The code after the first blank, or -1."""
    return F.coalesce(F.regexp_extract(F.coalesce(line, F.lit("")), r"(?i)^http/[0-9.]+\s+([0-9]{1,9})", 1).try_cast("int"), F.lit(-1))
