"""``format("sequence")``: key/value sequence files of text, read and written in Arrow batches.

A file is read in ranges of ``splitMB``: a stretch between two sync marks
belongs to the range in which its mark begins. Plain files, compressed values
and compressed blocks are read, with the codecs Default, Gzip and BZip2.
Files are written with compressed blocks (``codec`` default, gzip or bzip2)
or plain (``codec`` none). Both columns are text; nulls are written as empty.
"""

from __future__ import annotations

import bz2
import hashlib
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from arcspark.sources.arc import _option, _place, open_resuming

SCHEMA = "key string, value string"
_ARROW = pa.schema([("key", pa.string()), ("value", pa.string())])
# Fixed values of the format: its beginning, the classes of text and of codecs, the mark before a sync.
MAGIC, VERSION, ESCAPE, SYNC = b"SEQ", 6, b"\xff\xff\xff\xff", 16
TEXT = "org.apache.hadoop.io.Text"
CODECS = {"default": "org.apache.hadoop.io.compress.DefaultCodec", "gzip": "org.apache.hadoop.io.compress.GzipCodec", "bzip2": "org.apache.hadoop.io.compress.BZip2Codec"}
#: Rows of an Arrow batch, and bytes of a block or between two sync marks of a plain file.
BATCH_ROWS, BLOCK_BYTES, MARK_BYTES = 4096, 1 << 20, 64 << 10
#: Ranges that ``range_mb`` aims at, and their least and most megabytes.
RANGES, LEAST_MB, MOST_MB = 48, 0.05, 64.0


class SequenceError(ValueError):
    """A damaged sequence file, or one of another kind."""


def vint(n: int) -> bytes:
    """A number as the format writes lengths: small ones in a byte, others after a byte that tells how many follow."""
    if -112 <= n <= 127:
        return struct.pack("b", n)
    below = n < 0
    n = ~n if below else n
    size = (n.bit_length() + 7) // 8
    return struct.pack("b", (-120 if below else -112) - size) + n.to_bytes(size, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """(number, where it ends)."""
    first = data[at] - 256 if data[at] > 127 else data[at]
    if first >= -112:
        return first, at + 1
    below = first < -120
    size = -120 - first if below else -112 - first
    n = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    return ~n if below else n, at + 1 + size


def _inflated(data: bytes, codec: str) -> bytes:
    return zlib.decompress(data) if codec == CODECS["default"] else zlib.decompress(data, 31) if codec == CODECS["gzip"] else bz2.decompress(data)


def _deflated(data: bytes, codec: str) -> bytes:
    if codec == CODECS["bzip2"]:
        return bz2.compress(data)
    out = zlib.compressobj(6, zlib.DEFLATED, 31 if codec == CODECS["gzip"] else 15)
    return out.compress(data) + out.flush()


def _text(data: bytes) -> str:
    """A text with its length before it."""
    n, at = read_vint(data, 0)
    return data[at : at + n].decode("utf-8", "replace")


def _texts(lengths: bytes, data: bytes) -> list[str]:
    out, at, where = [], 0, 0
    while at < len(lengths):
        n, at = read_vint(lengths, at)
        out.append(_text(data[where : where + n]))
        where += n
    return out


@dataclass
class Header:
    values: bool
    blocks: bool
    codec: str | None
    sync: bytes
    end: int


class _Bytes:
    """Reads of a file from a position on."""

    def __init__(self, file: io.BufferedReader, at: int):
        self.file, self.at = file, at
        file.seek(at)

    def take(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise SequenceError(f"the file ends within {n} bytes at {self.at}")
        self.at += n
        return data

    def number(self) -> int:
        first = self.take(1)
        if first[0] < 128 or first[0] - 256 >= -112:
            return read_vint(first, 0)[0]
        size = (-120 if first[0] - 256 < -120 else -112) - (first[0] - 256)
        return read_vint(first + self.take(size), 0)[0]

    def text(self) -> str:
        return self.take(self.number()).decode("utf-8", "replace")


def read_header(file: io.BufferedReader) -> Header:
    data = _Bytes(file, 0)
    if data.take(3) != MAGIC or data.take(1)[0] != VERSION:
        raise SequenceError("not a sequence file of version 6")
    kinds = data.text(), data.text()
    if kinds != (TEXT, TEXT):
        raise SequenceError(f"keys and values are {kinds}, not text")
    values, blocks = data.take(2)
    codec = data.text() if values or blocks else None
    if codec is not None and codec not in CODECS.values():
        raise SequenceError(f"no codec for {codec}")
    for _ in range(2 * struct.unpack(">i", data.take(4))[0]):
        data.text()
    return Header(bool(values), bool(blocks), codec, data.take(SYNC), data.at)


def next_mark(file: io.BufferedReader, mark: bytes, start: int, end: int) -> int | None:
    """Where a sync mark begins in [start, end)."""
    at, held = start, b""
    file.seek(start)
    while at < end:
        data = held + file.read(1 << 16)
        if len(data) < len(mark):
            return None
        found = data.find(mark)
        if found >= 0:
            return at + found if at + found < end else None
        held = data[-(len(mark) - 1) :]
        at += len(data) - len(held)
    return None


def pairs(file: io.BufferedReader, start: int, end: int | None, size: int) -> Iterator[tuple[list[str], list[str]]]:
    """Keys and values of the stretches whose marks begin in [start, end); what stands before the first mark belongs to 0."""
    head = read_header(file)
    mark = ESCAPE + head.sync
    at = head.end if start == 0 else next_mark(file, mark, max(start, head.end), end or size)
    if at is None:
        return
    data, keys, values = _Bytes(file, at), [], []
    while data.at < size:
        before = data.at
        length = data.take(4)
        if length == ESCAPE:
            if data.take(SYNC) != head.sync:
                raise SequenceError(f"a sync mark is damaged at {before}")
            if end is not None and before >= end:
                break
            if head.blocks:
                n = data.number()
                parts = [_inflated(data.take(data.number()), head.codec) for _ in range(4)]
                keys, values = _texts(parts[0], parts[1]), _texts(parts[2], parts[3])
                if len(keys) != n or len(values) != n:
                    raise SequenceError(f"a block of {n} has {len(keys)} keys and {len(values)} values")
                yield keys, values
                keys, values = [], []
            continue
        whole, key = struct.unpack(">i", length)[0], struct.unpack(">i", data.take(4))[0]
        if head.blocks or not 0 <= key <= whole:
            raise SequenceError(f"no record at {before}")
        keys.append(_text(data.take(key)))
        value = data.take(whole - key)
        values.append(_text(_inflated(value, head.codec) if head.values else value))
        if len(keys) >= BATCH_ROWS:
            yield keys, values
            keys, values = [], []
    if keys:
        yield keys, values


def _files(path: str) -> list[fs.FileInfo]:
    """The files at or below ``path``, by name."""
    where, base = _place(path)
    info = where.get_file_info(base)
    found = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(found, key=lambda f: f.path)


def range_mb(path: str) -> float:
    """Megabytes of a range by which all files make some RANGES of them: least for small files, most for large ones."""
    return min(MOST_MB, max(LEAST_MB, sum(f.size for f in _files(path)) / (RANGES << 20)))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None
    size: int


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path, each = _option(self.options, "path"), max(1, int(float(_option(self.options, "splitMB", 64)) * (1 << 20)))
        out = [Range(f.path, a, a + each if a + each < f.size else None, f.size) for f in _files(path) if f.size for a in range(0, f.size, each)]
        return out or [Range("", 0, None, 0)]

    def read(self, partition):
        if not partition.path:
            return
        where, _ = _place(_option(self.options, "path"))
        with open_resuming(where, partition.path) as file:
            for keys, values in pairs(file, partition.start, partition.end, partition.size):
                for a in range(0, len(keys), BATCH_ROWS):
                    yield pa.record_batch([pa.array(keys[a : a + BATCH_ROWS], pa.string()), pa.array(values[a : a + BATCH_ROWS], pa.string())], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class SequenceWriter(DataSourceArrowWriter):
    """One file for each task; files are hidden until the job commits."""

    def __init__(self, options: dict):
        self.options, self.job = options, uuid.uuid4().hex

    def _hidden(self, base: str, name: str) -> str:
        return f"{base}/.{self.job}-{name}.tmp"

    def write(self, iterator):
        where, base = _place(_option(self.options, "path"))
        where.create_dir(base, recursive=True)
        codec = str(_option(self.options, "codec", "default")).lower()
        if codec != "none" and codec not in CODECS:
            raise ValueError(f"codec {codec}: none, {', '.join(CODECS)}")
        name = f"part-{uuid.uuid4().hex}.seq"
        sync = hashlib.md5(name.encode()).digest()
        say = lambda x: vint(len(x)) + x
        plain = codec == "none"
        with where.open_output_stream(self._hidden(base, name), compression=None) as out:
            out.write(MAGIC + bytes([VERSION]) + say(TEXT.encode()) * 2 + (b"\0\0" if plain else b"\1\1" + say(CODECS[codec].encode())) + struct.pack(">i", 0) + sync)
            keys, values, held, since, plain_rows = [], [], 0, 0, []

            def block() -> None:
                nonlocal held
                parts = [b"".join(vint(len(x)) for x in keys), b"".join(keys), b"".join(vint(len(x)) for x in values), b"".join(values)]
                out.write(ESCAPE + sync + vint(len(keys)) + b"".join(say(_deflated(p, CODECS[codec])) for p in parts))
                keys.clear()
                values.clear()
                held = 0

            for batch in iterator:
                for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    key, value = say((k or "").encode()), say((v or "").encode())
                    if plain:
                        if since >= MARK_BYTES:
                            out.write(b"".join(plain_rows) + ESCAPE + sync)
                            plain_rows, since = [], 0
                        plain_rows += struct.pack(">ii", len(key) + len(value), len(key)), key, value
                        since += 8 + len(key) + len(value)
                        continue
                    keys.append(key)
                    values.append(value)
                    held += len(key) + len(value)
                    if held >= BLOCK_BYTES:
                        block()
            if keys:
                block()
            out.write(b"".join(plain_rows))
        return Written(name)

    def _clear(self, where: fs.FileSystem, base: str) -> None:
        for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                where.delete_file(f.path)

    def commit(self, messages):
        where, base = _place(_option(self.options, "path"))
        for m in messages:
            if m is not None and m.name:
                where.move(self._hidden(base, m.name), posixpath.join(base, m.name))
        self._clear(where, base)

    def abort(self, messages):
        where, base = _place(_option(self.options, "path"))
        self._clear(where, base)


class SequenceDataSource(DataSource):
    @classmethod
    def name(cls):
        return "sequence"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SequenceReader(dict(self.options))

    def writer(self, schema, overwrite):
        return SequenceWriter(dict(self.options))


def read_sequence_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(key, value) of the text sequence files at or below ``path``."""
    spark.dataSource.register(SequenceDataSource)
    return spark.read.format("sequence").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_sequence_files(rows: DataFrame, path: str, key: str = "key", value: str = "value", codec: str = "default") -> None:
    rows.sparkSession.dataSource.register(SequenceDataSource)
    rows.selectExpr(f"CAST(`{key}` AS string) AS key", f"CAST(`{value}` AS string) AS value").write.format("sequence").mode("append").option("codec", codec).save(path)
