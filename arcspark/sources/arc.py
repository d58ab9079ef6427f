"""``spark.read.format("arc")``: web archives as rows, and the writer of such files.

Options, in any case: ``mode`` (PERMISSIVE, FAILFAST, DROPMALFORMED), ``records``
(raw or item), ``strictSuffix`` (leave out ``.warc.gz``), ``pathGlobFilter``,
``filesPerPartition``, ``mbPerPartition``, ``withContent``, ``urlPrefix``,
``legacyMetadata``, ``headerPrefix`` (of the names of a record's own headers),
``maxRecordMB`` (longer records are cut there and flagged), ``fullNames``
(paths below the folder in place of file names), ``splitMB`` (files are read in
ranges, each from the first member that begins in it), ``memberIndex`` (the
folder of ``arcspark.sources.positions``: ranges that begin where it says),
``readRetries`` (a read that fails is tried again from where it stood).
Streams take ``lookbackHours``. The writer takes ``timestamp`` and ``origin``.
With ``pushdown`` (set by ``read_arc`` where
``spark.sql.python.filterPushdown.enabled`` is on) the scan takes filters on
``url``/``uri`` (equality, prefix).
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from arcspark import schemas
from arcspark.sources.members import ORIGIN, PREFIX, Record, epoch_millis, file_header, next_member, pack_splits, record_member, records

BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def is_archive(name: str, strict: bool = True) -> bool:
    return name.endswith("arc.gz") and not (strict and name.endswith(".warc.gz"))


def raw_row(r: Record, name: str, content: bool = True, prefix: str = PREFIX) -> dict:
    return {"url": r.url, "value": r.value(prefix) if content else None, "arc_file_name": name, "arc_file_pos": r.pos, "arc_file_size": r.size}


def item_row(r: Record, name: str, content: bool = True, prefix: str = PREFIX) -> dict:
    return {
        "uri": r.url, "host_ip": r.host_ip, "timestamp": epoch_millis(r.ts14), "mime_type": r.mime_type, "record_length": len(r.value(prefix)),
        "header_items": [{"item_key": k, "item_value": v} for k, v in r.all_headers(prefix)], "content": r.content if content else None,
        "arc_file_name": name, "arc_file_pos": r.pos, "flags": r.flags, "arc_file_size": r.size,
    }


_ARROW_ITEM = pa.schema([
    ("uri", pa.string()), ("host_ip", pa.string()), ("timestamp", pa.int64()), ("mime_type", pa.string()), ("record_length", pa.int32()),
    ("header_items", pa.list_(pa.struct([("item_key", pa.string()), ("item_value", pa.string())]))), ("content", pa.binary()),
    ("arc_file_name", pa.string()), ("arc_file_pos", pa.int64()), ("flags", pa.int32()), ("arc_file_size", pa.int64()),
])
_ARROW_RAW = pa.schema([("url", pa.string()), ("value", pa.binary()), ("arc_file_name", pa.string()), ("arc_file_pos", pa.int64()), ("arc_file_size", pa.int64())])


def batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("value") or row.get("content") or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@dataclass
class Files(InputPartition):
    """What one task reads: files with where it begins, where it ends (None: the file's end), and whether a member is known to begin there."""

    ranges: tuple[tuple[str, int, int | None, bool], ...]

    @classmethod
    def whole(cls, *paths: str) -> Files:
        return cls(tuple((p, 0, None, True) for p in paths))

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(r[0] for r in self.ranges)


#: Bytes that one read of a range asks the store for; reads that are tried again, and the first wait in seconds.
READ_AHEAD, RETRIES, WAIT_S = 1 << 20, 5, 0.5


class Resuming(io.RawIOBase):
    """A file that is opened again, where it stood, when a read fails."""

    def __init__(self, where: fs.FileSystem, path: str, retries: int = RETRIES):
        super().__init__()
        self._where, self._path, self._left, self._at, self._file = where, path, retries, 0, None
        self.bytes_read = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence != 0:
            raise OSError("positions are counted from the beginning")
        self._at = offset
        return offset

    def readinto(self, buffer) -> int:
        wait = WAIT_S
        while True:
            try:
                if self._file is None:
                    self._file = self._where.open_input_file(self._path)
                self._file.seek(self._at)
                data = self._file.read(len(buffer))
                break
            except OSError:
                self._left -= 1
                self._file = None
                if self._left < 0:
                    raise
                time.sleep(wait)
                wait *= 2
        buffer[: len(data)] = data
        self._at += len(data)
        self.bytes_read += len(data)
        return len(data)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None
        super().close()


def open_resuming(where: fs.FileSystem, path: str, retries: int = RETRIES) -> io.BufferedReader:
    return io.BufferedReader(Resuming(where, path, retries), READ_AHEAD)


#: Schemes of Hadoop's clients for stores that have another name here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; stores that only Spark opens need ``read_arc_binary``."""
    scheme, mark, rest = path.partition("://")
    if mark:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith(("/", "file:")) else posixpath.abspath(path))


def _option(options: dict, name: str, default=None):
    """Spark hands options over in lower case; a dictionary of our own may not be."""
    return next((v for k, v in options.items() if k.lower() == name.lower()), default)


@dataclass(frozen=True, order=True)
class Found:
    """An archive file; in order of arrival."""

    mtime: int
    path: str
    size: int


def find_archives(path: str, strict: bool = True, glob: str | None = None) -> list[Found]:
    where, base = _place(path)
    info = where.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    kept = [f for f in found if f.type == fs.FileType.File and f.size and is_archive(f.base_name, strict) and (not glob or fnmatch.fnmatch(f.base_name, glob))]
    return sorted(Found(f.mtime_ns or 0, f.path, f.size) for f in kept)


def list_archives(path: str, strict: bool = True, glob: str | None = None) -> list[tuple[str, int]]:
    """(path, size) in order of paths."""
    return sorted((f.path, f.size) for f in find_archives(path, strict, glob))


def index_splits(index: str) -> list[tuple[str, int]]:
    """(file, position) of the places where a member index says that ranges may begin: one for each of its ``splitMB``."""
    where, base = _place(f"{index.rstrip('/')}/splits")
    found = dataset.dataset(base, filesystem=where, format="parquet").to_table(columns=["path", "pos"])
    return list(zip(found.column("path").to_pylist(), found.column("pos").to_pylist(), strict=True))


class ArcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.equal: str | None = None
        self.prefix = self.option("urlPrefix", "")

    def option(self, name: str, default=None):
        return _option(self.options, name, default)

    def _flag(self, name: str, default: str) -> bool:
        return str(self.option(name, default)).lower() == "true"

    def found(self) -> list[Found]:
        return find_archives(self.option("path"), self._flag("strictSuffix", "true"), self.option("pathGlobFilter"))

    def partitions(self):
        files = sorted((f.path, f.size) for f in self.found())
        if (ranges := self._ranges(files)) is not None:
            return ranges or [Files(())]
        mb, each = self.option("mbPerPartition"), self.option("filesPerPartition")
        splits = pack_splits([size for _, size in files], int(each) if each else 1 << 30 if mb else 1, int(mb) << 20 if mb else None)
        return [Files.whole(*(files[i][0] for i in split)) for split in splits] or [Files(())]

    def _ranges(self, files: list[tuple[str, int]]) -> list[Files] | None:
        """Partitions of parts of files, where that is asked for."""
        index, mb = self.option("memberIndex"), self.option("splitMB")
        if index:
            starts: dict[str, list[int]] = {}
            for path, pos in index_splits(index):
                starts.setdefault(path, []).append(pos)
            base = _place(self.option("path"))[1].rstrip("/")
            out = []
            for path, _ in files:
                # what the index doesn't know is read whole
                known = sorted({0, *starts.get(posixpath.relpath(path, base) if path != base else posixpath.basename(path), ())})
                out += [Files(((path, a, b, True),)) for a, b in zip(known, [*known[1:], None], strict=True)]
            return out
        if mb:
            each = max(1, int(float(mb) * (1 << 20)))
            return [Files(((path, a, a + each if a + each < size else None, a == 0),)) for path, size in files for a in range(0, max(size, 1), each)]
        return None

    def read(self, partition):
        where, base = _place(self.option("path"))
        yield from self.read_from(where, base, partition)

    def read_from(self, where: fs.FileSystem, base: str, partition: Files):
        item = self.option("records", "raw") == "item"
        content, make = self._flag("withContent", "true"), item_row if item else raw_row
        prefix, most = self.option("headerPrefix", PREFIX), self.option("maxRecordMB")
        mode, legacy = self.option("mode", "PERMISSIVE").upper(), self._flag("legacyMetadata", "false")
        name = (lambda p: posixpath.relpath(p, base) if p != base else posixpath.basename(p)) if self._flag("fullNames", "false") else posixpath.basename

        def rows():
            for path, start, end, exact in partition.ranges:
                with open_resuming(where, path, int(self.option("readRetries", RETRIES))) as file:
                    size = where.get_file_info(path).size

                    def after(at: int):
                        sound = next_member(file, at, size, legacy)
                        return None if sound is None else (file.seek(sound), file)

                    if not exact:
                        start = next_member(file, start, end or size, legacy)
                        if start is None:
                            continue
                    file.seek(start)
                    for r in records(file, mode, legacy, most=int(most) << 20 if most else None, start=start, end=end, after=after):
                        if r.url.startswith(self.prefix) and (self.equal is None or r.url == self.equal):
                            yield make(r, name(path), content, prefix)

        yield from batches(rows(), _ARROW_ITEM if item else _ARROW_RAW)


class PushdownReader(ArcReader):
    """Takes filters on the url; Spark refuses such a reader where pushdown is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("url",), ("uri",)):
                self.equal = f.value
            elif isinstance(f, StringStartsWith) and f.attribute in (("url",), ("uri",)) and f.value.startswith(self.prefix):
                self.prefix = f.value
            else:
                yield f


class ArcStream(DataSourceStreamReader):
    """New archive files as they come, each once.

    The offset is the latest time a file was changed, and the names of the
    files changed within ``lookbackHours`` (a week if not given) before that:
    a file that shows up late, or is moved in with an older time, is new as
    long as its time lies within. Older ones count as read.
    """

    def __init__(self, options: dict):
        self.reader = ArcReader(options)
        self.lookback = int(float(self.reader.option("lookbackHours", 168)) * 3600e9)

    def initialOffset(self):
        return {"time": -1, "names": []}

    def latestOffset(self):
        files = self.reader.found()
        if not files:
            return self.initialOffset()
        latest = files[-1].mtime
        return {"time": latest, "names": sorted(f.path for f in files if f.mtime > latest - self.lookback)}

    def partitions(self, start, end):
        def read_by(offset: dict):
            names, old = set(offset["names"]), offset["time"] - self.lookback
            return lambda f: f.path in names or offset["time"] >= 0 and f.mtime <= old

        before, now = read_by(start), read_by(end)
        return [Files.whole(f.path) for f in self.reader.found() if now(f) and not before(f)]

    def read(self, partition):
        return self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class ArcWriter(DataSourceWriter):
    """Writes rows of url, host_ip, ts14, mime_type, headers, content; one file for each task.

    Files carry the job's name and end in ``.tmp`` until the job commits; what
    failed attempts left behind goes then, or when the job is given up.
    """

    def __init__(self, options: dict):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, rows):
        where, base = _place(_option(self.options, "path"))
        where.create_dir(base, recursive=True)
        stamp = _option(self.options, "timestamp", "20240101000000")
        name, n = f"part-{uuid.uuid4().hex}.arc.gz", 0
        with where.open_output_stream(self._hidden(base, name), compression=None) as out:
            out.write(file_header(name, stamp, _option(self.options, "origin", ORIGIN)))
            for r in rows:
                headers = [(h["item_key"], h["item_value"]) for h in r["headers"] or []]
                out.write(record_member(r["url"] or "", r["host_ip"] or "0.0.0.0", r["ts14"] or stamp, r["mime_type"] or "no-type", headers, bytes(r["content"] or b"")))
                n += 1
        return Written(name, n)

    def _hidden(self, base: str, name: str) -> str:
        return f"{base}/.{self.job}-{name}.tmp"

    def _clear(self, where: fs.FileSystem, base: str) -> None:
        for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                where.delete_file(f.path)

    def commit(self, messages):
        where, base = _place(_option(self.options, "path"))
        for m in messages:
            if m is not None:
                where.move(self._hidden(base, m.name), f"{base}/{m.name}")
        self._clear(where, base)

    def abort(self, messages):
        where, base = _place(_option(self.options, "path"))
        self._clear(where, base)


WRITE_SCHEMA = "url string, host_ip string, ts14 string, mime_type string, headers array<struct<item_key:string,item_value:string>>, content binary"


class ArcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "arc"

    def schema(self) -> StructType:
        return schemas.ITEM if _option(self.options, "records", "raw") == "item" else schemas.RAW_RECORD

    def reader(self, schema):
        options = dict(self.options)
        return (PushdownReader if _option(options, "pushdown") == "true" else ArcReader)(options)

    def streamReader(self, schema):
        return ArcStream(dict(self.options))

    def writer(self, schema, overwrite):
        return ArcWriter(dict(self.options))


def read_arc(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArcDataSource)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options}
    return spark.read.format("arc").options(**{k: str(v) for k, v in options.items()}).load(path)


def read_arc_binary(spark: SparkSession, path: str, item: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """The same rows where only Spark can open the store: each file is read whole by ``binaryFile``."""
    import io

    make, arrow, schema = (item_row, _ARROW_ITEM, schemas.ITEM) if item else (raw_row, _ARROW_RAW, schemas.RAW_RECORD)

    def work(found):
        def rows():
            for batch in found:
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for r in records(io.BytesIO(data.as_py()), mode):
                        yield make(r, posixpath.basename(path))

        yield from batches(rows(), arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*arc.gz").option("recursiveFileLookup", "true").load(path)
    return files.where("path NOT LIKE '%.warc.gz'").select("path", "content").mapInArrow(work, schema)


def read_named(files: DataFrame, item: bool = False, **options: object) -> DataFrame:
    """The rows of the archives that the first column of ``files`` names, by URI or path; others are left out."""
    reader = ArcReader({**options, "records": "item" if item else "raw"})

    def work(found):
        for batch in found:
            for path in batch.column(0).to_pylist():
                if path and is_archive(posixpath.basename(path), reader._flag("strictSuffix", "true")):
                    where, place = _place(unquote(path))
                    yield from reader.read_from(where, posixpath.dirname(place), Files.whole(place))

    return files.mapInArrow(work, schemas.ITEM if item else schemas.RAW_RECORD)


def write_arc(rows: DataFrame, path: str, **options: object) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(ArcDataSource)
    rows.select("url", "host_ip", "ts14", "mime_type", "headers", "content").write.format("arc").mode("append").options(**{k: str(v) for k, v in options.items()}).save(path)
