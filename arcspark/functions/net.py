"""IPv4 addresses, socket addresses and the folder of a numeric id."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4_int(text: Column) -> Column:
    """Dotted form -> signed 32-bit number, big-endian; null if it isn't an address.

    One to four parts; the last fills what is left.
    """
    parts = F.split(text, r"\.")
    n = F.size(parts)
    value = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    last = F.element_at(parts, -1).try_cast("bigint")
    high = F.lit(0).cast("bigint")
    for i in range(3):
        high = high + F.when(n > i + 1, F.shiftleft(value(i), 24 - 8 * i)).otherwise(0)
    fine = F.forall(parts, lambda p: p.rlike("^[0-9]{1,10}$")) & (n <= 4) & F.forall(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda p: p.try_cast("bigint") <= 255)
    room = F.pow(F.lit(2.0), (5 - n) * 8).cast("bigint")
    whole = high + last
    return F.when(fine & (last < room), F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole)).cast("int")


def ipv4_text(number: Column) -> Column:
    byte = lambda s: F.shiftrightunsigned(number.cast("int"), s).bitwiseAND(255).cast("string")
    return F.concat_ws(".", *(byte(s) for s in (24, 16, 8, 0)))


def ipv4_bytes(text: str) -> bytes | None:
    parts = text.split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch("[0-9]+", p) for p in parts):
        return None
    *head, last = map(int, parts)
    if any(h > 255 for h in head) or last >= 256 ** (4 - len(head)):
        return None
    return bytes(head) + last.to_bytes(4 - len(head), "big")


def socket_address(text: Column) -> Column:
    """host:port at the first colon."""
    return F.struct(F.substring_index(text, ":", 1).alias("host"), F.regexp_extract(text, "^[^:]*:([0-9]+)$", 1).try_cast("int").alias("port"))


# Ids that the folders tell apart, and names in a folder.
IDS, FAN_OUT = 100_000_000, 100


def path_for_id(number: int, ids: int = IDS, fan_out: int = FAN_OUT) -> str:
    """Folders of an id: decimal digits in base ``fan_out`` of its remainder by ``ids``, high ones first, and the id itself as the last name."""
    rest, unit, parts = abs(number) % ids, ids // fan_out, []
    while unit > 1:
        part, rest = divmod(rest, unit)
        parts.append(str(part))
        unit //= fan_out
    return "/".join([*parts, str(number)])


def path_for_id_of(number: Column, ids: int = IDS, fan_out: int = FAN_OUT) -> Column:
    """``path_for_id`` with built-in functions alone."""
    rest, unit, parts = F.abs(number) % ids, ids // fan_out, []
    while unit > 1:
        parts.append(F.floor(rest / unit).cast("string"))
        rest = rest % unit
        unit //= fan_out
    return F.concat_ws("/", *parts, number.cast("string"))
