"""Media columns over content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, padded, taken as the 8-bit grey samples of
an image 576 samples wide and stored as a lossless PNG. Each task streams the
images it meets into tar shards of its own, each digest once; a row carries
digest, shard, offset and length. Over all tasks a digest gets one address,
the first. Range reads of the header alone fill the metadata columns.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import id_and_text, materialize, scratch

WIDTH, PAD = 576, b"\xff"
#: Bytes of a shard before the next is begun; digests that a task remembers.
SHARD_BYTES, REMEMBERED = 256 << 20, 200_000
#: Fixed values of the PNG format: signature; bytes up to the end of the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + PAD * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # filter 0 before each row
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES of an image."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode_png(data: bytes) -> bytes:
    width, height, _ = read_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends members to tar shards under ``uri``; names are new at each attempt."""

    def __init__(self, uri: str, limit: int = SHARD_BYTES):
        self._fs, self._base = open_store(uri)
        self._limit, self._out, self._at, self.shard = limit, None, 0, ""

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self._out is None:
            self._fs.create_dir(self._base, recursive=True)
            self.shard, self._at = f"shard-{uuid.uuid4().hex}.tar", 0
            self._out = self._fs.open_output_stream(f"{self._base}/{self.shard}", compression=None)
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self._out.write(head + data + bytes(-len(data) % 512))
        place = self.shard, self._at + len(head), len(data)
        self._at += len(head) + len(data) + -len(data) % 512
        if self._at >= self._limit:
            self.close()
        return place

    def close(self) -> None:
        if self._out is not None:
            self._out.write(bytes(1024))
            self._out.close()
            self._out = None


def store(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads; per row doc_id, n_bytes, digest, shard, offset, length."""

    def write(batches):
        out, known = ShardWriter(uri), {}
        try:
            for batch in batches:
                got = []
                for text in batch.column(1).to_pylist():
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[digest] = out.add(f"{digest}.png", encode_png(payload))
                    got.append((len(text.encode("utf-8", "surrogatepass")), digest, *known[digest]))
                n, digest, shard, offset, length = zip(*got, strict=True) if got else ((),) * 5
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:  # a shard that a failed task leaves has no row that points to it
            out.close()

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(write, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, digest string, shard string, offset long, length long")


def addresses(rows: DataFrame) -> DataFrame:
    """One address for each digest: digest, shard, offset, length."""
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.shard", "at.offset", "at.length")


def _each(uri: str, batches, work, names, kinds):
    """The rows and ``work(file, row)`` beside them; one shard is open at a time."""
    where, base = open_store(uri)
    name, file = "", None
    try:
        for batch in batches:
            got = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["shard"], where.open_input_file(f"{base}/{row['shard']}")
                got.append(work(file, row))
            columns = zip(*got, strict=True) if got else ((),) * len(names)
            yield pa.record_batch([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])
    finally:
        if file is not None:
            file.close()


INDEX = "digest string, shard string, offset long, length long"
HEADER = "width long, height long, bits int"


def metadata(index: DataFrame, uri: str) -> DataFrame:
    """The index with width, height, bits: reads HEADER_BYTES of each image and no more. Rows come by shard."""
    by_shard = index.select("digest", "shard", "offset", "length").repartition(F.col("shard"), F.pmod(F.xxhash64("digest"), F.lit(8))).sortWithinPartitions("shard", "offset")

    def head(file, row):
        return read_header(file.read_at(HEADER_BYTES, row["offset"]))

    return by_shard.mapInArrow(lambda b: _each(uri, b, head, ["width", "height", "bits"], [pa.int64(), pa.int64(), pa.int32()]), f"{INDEX}, {HEADER}")


def features(described: DataFrame, uri: str) -> DataFrame:
    """``metadata``'s rows with digests and features of what is stored, read back by address."""

    def read(file, row):
        stored = file.read_at(row["length"], row["offset"])
        payload = decode_png(stored)
        samples = np.frombuffer(payload, np.uint8)
        feature = f"grey{row['bits']} {row['width']}x{row['height']} sum={int(samples.sum(dtype=np.int64))} " + ",".join(map(str, np.bincount(samples >> 5, minlength=8)))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return described.mapInArrow(lambda b: _each(uri, b, read, names, kinds), f"{INDEX}, {HEADER}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """Store, describe and read back: one row for each row of ``docs``, with its payload's address under ``uri``.

    Metadata columns come from header-only reads, features from the stored
    bytes. Null and empty texts are one row of padding. Repeated texts share
    one address and equal values; rows that repeat an id, and rows without
    one, come each; an empty table writes no shard; other columns are not
    looked at. A payload is held whole, with its image some three times its
    size, one at a time.
    """
    uri = uri or scratch(docs.sparkSession, "media", scope)
    rows = materialize(store(docs, uri, id_col, text_col), "media-rows", scope)
    known = features(metadata(addresses(rows), uri), uri)
    return rows.select("doc_id", "n_bytes", "digest").join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "digest", "shard", "offset", "length"
    )
