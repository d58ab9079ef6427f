"""Gzip members and archive records, streamed: no file is ever held whole."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import BinaryIO

BLOCK, LONGEST_FILE_HEADER = 32 << 10, 4096

#: What every member begins with.
MAGIC = b"\x1f\x8b\x08"
# The metadata line, the names of a record's own headers after their prefix, the file header.
METADATA = re.compile(r"^(.*)\s([0-9.]+)\s([0-9]+)\s([^\s]+)\s([0-9]+)$", re.S)
HOST_IP, TIMESTAMP, MIME_TYPE, PAYLOAD_LENGTH = "HostIP", "ArcTimestamp", "ArcMimeType", "ArcPayloadLen"
FILE_HEADER = "filedesc://{name} 0.0.0.0 {ts} text/plain {length}\n1 0 {origin}\nURL IP-address Archive-date Content-type Archive-length\n\n"
EXTRA_FIELD = bytes([8, 0, 0x4C, 0x58, 4, 0, 0, 0, 0, 0])
CUT_IN_DOWNLOAD = re.compile(r"x-[a-z]+-contenttruncated", re.I)

#: What the own headers' names begin with, and the origin in a file header, unless a caller says otherwise.
PREFIX, ORIGIN = "x-arc-", "arcspark"
#: Bits of a record's flags: the payload is shorter than declared, or than the reader's bound allows.
CUT_SHORT, CUT_BY_BOUND = 1, 2


class ArcError(ValueError):
    """A damaged archive."""


class TruncatedHeader(ArcError):
    """The file ends inside a member's header."""


@dataclass
class Record:
    url: str
    host_ip: str
    ts14: str
    mime_type: str
    headers: list[tuple[str | None, str]]
    content: bytes
    declared: int
    flags: int = 0
    pos: int = 0
    size: int = 0
    raw_header_bytes: int = 0
    extra: dict = field(default_factory=dict)

    def all_headers(self, prefix: str = PREFIX) -> list[tuple[str | None, str]]:
        """The record's own headers, those of the capture, and the payload's length."""
        own = [(prefix + HOST_IP, self.host_ip), (prefix + TIMESTAMP, self.ts14), (prefix + MIME_TYPE, self.mime_type)]
        return [*own, *self.headers, (prefix + PAYLOAD_LENGTH, str(len(self.content)))]

    def value(self, prefix: str = PREFIX) -> bytes:
        """The record as headers, a blank line and the payload."""
        return render_headers(self.all_headers(prefix)) + b"\r\n" + self.content


def render_headers(headers: list[tuple[str | None, str]]) -> bytes:
    return "".join(f"{k}:{v}\r\n" if k else f"{v}\r\n" for k, v in headers).encode("utf-8", "replace")


def _check_header(head: bytes) -> None:
    if len(head) < 10:
        raise TruncatedHeader("the file ends in a member's header")
    if head[:2] != b"\x1f\x8b":
        raise ArcError("Not in GZIP format")
    if head[2] != 8:
        raise ArcError("Unsupported compression method")


def members(stream: BinaryIO, block: int = BLOCK, most: int | None = None, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed size, data) of each gzip member; CRC and length are checked.

    Of a member of more than ``most`` bytes those are kept and the rest is read past.
    A stream that stands at the member at ``start`` gives those that begin before ``end``.
    """
    pending, offset = b"", start
    while end is None or offset < end:
        while len(pending) < 10 and (more := stream.read(block)):
            pending += more
        if not pending:
            return
        _check_header(pending)
        inflater, parts, used, held = zlib.decompressobj(31), [], 0, 0
        while not inflater.eof:
            if not pending:
                pending = stream.read(block)
                if not pending:
                    if not parts:
                        raise TruncatedHeader("the file ends in a member's header")
                    raise ArcError("Corrupt GZIP trailer: the file ends in a member")
            try:
                part = inflater.decompress(pending)
                parts.append(part if most is None else part[: max(0, most - held)])
                held += len(part)
            except zlib.error as e:
                raise ArcError(f"Corrupt GZIP {'header' if 'header' in str(e) else 'trailer'}: {e}") from e
            used += len(pending) - len(inflater.unused_data)
            pending = inflater.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def parse_metadata(line: str, legacy: bool = False) -> tuple[str, str, str, str, int]:
    """url, ip, timestamp, mime type, length. A url may hold spaces, but not for ``legacy``."""
    if legacy:
        parts = line.split(" ")
        if len(parts) != 5:
            raise ArcError("Invalid ARC Metadata Line")
    elif m := METADATA.match(line):
        parts = list(m.groups())
    else:
        parts = line.rsplit(" ", 4)
    if len(parts) != 5 or not parts[4].strip().isdigit():
        raise ArcError("Invalid ARC Metadata Line")
    return parts[0], parts[1], parts[2], parts[3], int(parts[4])


_HEADER_END = re.compile(rb"\n\r?\n")


def header_end(data: bytes, start: int = 0) -> int:
    """Where the body begins: after LF LF, LF CR LF or CR LF CR LF; -1 if nowhere."""
    m = _HEADER_END.search(data, start)
    return m.end() if m else -1


def split_header(line: str) -> tuple[str | None, str]:
    """The status line and lines without a usable colon have no key."""
    colon = line.find(":")
    return (None, line) if colon in (-1, len(line) - 1) else (line[:colon], line[colon + 1 :])


def parse_record(data: bytes, pos: int = 0, size: int = 0, legacy: bool = False) -> Record:
    end = data.find(b"\n")
    if end < 0:
        raise ArcError("Invalid ARC Metadata Line")
    url, ip, ts14, mime, declared = parse_metadata(data[:end].decode("utf-8", "replace").rstrip("\r"), legacy)
    at = header_end(data, end + 1)
    if data[end + 1 : end + 2] == b"\n":  # no header at all
        at = end + 2
    if at < 0:
        at = len(data)
    head = data[end + 1 : at]
    headers = [split_header(x) for x in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n") if x]
    wanted = max(0, declared - len(head))
    body = data[at : at + wanted]
    cut = len(body) < wanted or any(k and CUT_IN_DOWNLOAD.fullmatch(k) for k, _ in headers)
    flags = CUT_SHORT if cut else 0
    return Record(url, ip, ts14, mime, headers, body, declared, flags, pos, size, len(head))


def records(
    stream: BinaryIO, mode: str = "PERMISSIVE", legacy: bool = False, block: int = BLOCK, most: int | None = None,
    start: int = 0, end: int | None = None, after: Callable[[int], tuple[int, BinaryIO] | None] | None = None,
) -> Iterator[Record]:
    """The records of one archive; its first member is the file header.

    A header cut short ends the scan, unless ``mode`` is FAILFAST. Other damage
    raises. With DROPMALFORMED bad records are left out; where a member is
    damaged, ``after`` finds the next sound one from a position on, and without
    it the scan ends there. Members of more than ``most`` bytes come cut there
    and flagged. ``start`` and ``end`` are those of ``members``.
    """
    found, at = members(stream, block, most, start, end), start
    while True:
        try:
            pos, size, data = next(found)
        except StopIteration:
            return
        except TruncatedHeader:
            if mode == "FAILFAST":
                raise
            return
        except ArcError:
            if mode != "DROPMALFORMED":
                raise
            sound = after(at + 1) if after else None
            if sound is None or end is not None and sound[0] >= end:
                return
            at = sound[0]
            found = members(sound[1], block, most, at, end)
            continue
        at = pos + size
        if pos == 0:
            if not data or len(data) >= LONGEST_FILE_HEADER:
                raise ArcError("Invalid ARC File Header")
            continue
        try:
            record = parse_record(data, pos, size, legacy)
            if most is not None and len(data) >= most:
                record.flags |= CUT_BY_BOUND
            yield record
        except ArcError:
            if mode != "DROPMALFORMED":
                raise


def _sound(file: BinaryIO, at: int, legacy: bool) -> bool:
    """Whether a whole record's member stands there: its checksum holds and it begins with a metadata line."""
    file.seek(at)
    inflater, head = zlib.decompressobj(31), b""
    try:
        while not inflater.eof:
            data = file.read(BLOCK)
            if not data:
                return False
            while data and not inflater.eof:  # a little at a time: what stands here may be no member at all
                part = inflater.decompress(data, BLOCK)
                data = inflater.unconsumed_tail
                head = head or part
        parse_metadata(head.partition(b"\n")[0].decode("utf-8", "replace").rstrip("\r"), legacy)
    except (zlib.error, ArcError):
        return False
    return True


def next_member(file: BinaryIO, start: int, end: int, legacy: bool = False) -> int | None:
    """Where the first record's member begins in [start, end) of a file that can seek.

    The three bytes that begin a member can also stand inside one, so whatever
    follows is inflated to its checksum and its first line read. Only an
    archive that a record holds, stored as it is, could pass for one.
    """
    at, held = start, b""
    file.seek(at)
    while at < end:
        data = held + file.read(BLOCK)
        if len(data) < len(MAGIC):
            return None
        found = data.find(MAGIC)
        while found >= 0 and at + found < end:
            if _sound(file, at + found, legacy):
                return at + found
            found = data.find(MAGIC, found + 1)
        held = data[-(len(MAGIC) - 1) :]
        at += len(data) - len(held)
        file.seek(at + len(held))
    return None


def epoch_millis(ts14: str) -> int | None:
    try:
        return int(datetime.strptime(ts14, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).timestamp() * 1000)
    except ValueError:
        return None


def gzip_member(data: bytes, extra: bytes = b"") -> bytes:
    """One member; the file header's carries an extra field."""
    deflater = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflater.compress(data) + deflater.flush()
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\0") + bytes(4) + b"\0\x03" + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def file_header(name: str, ts14: str, origin: str = ORIGIN) -> bytes:
    tail = FILE_HEADER.split("{length}")[1].format(origin=origin)
    return gzip_member(FILE_HEADER.format(name=name, ts=ts14, length=len(tail), origin=origin).encode("latin-1", "replace"), EXTRA_FIELD)


def record_member(url: str, ip: str, ts14: str, mime: str, headers: list[tuple[str | None, str]], content: bytes) -> bytes:
    head = render_headers(headers) + b"\r\n"
    line = f"{url} {ip} {ts14} {mime} {len(head) + len(content)}\n".encode("utf-8", "replace")
    return gzip_member(line + head + content + b"\n")


def pack_splits(sizes: list[int], files_per_split: int = 1, bytes_per_split: int | None = None) -> list[list[int]]:
    """Indices by split: a split closes when it has its number of files or of bytes."""
    out: list[list[int]] = []
    now: list[int] = []
    total = 0
    for i, size in enumerate(sizes):
        now.append(i)
        total += size
        if len(now) >= files_per_split or bytes_per_split is not None and total >= bytes_per_split:
            out.append(now)
            now, total = [], 0
    return [*out, now] if now else out
