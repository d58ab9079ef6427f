"""Member indexes of archives: where each record lies, ranges for scans, and reads of single records.

``write_member_index`` keeps two tables in a folder: ``members`` (url, its
hash, file, position, size, by hash, so that a look-up prunes row groups) and
``splits`` (one position for each so many megabytes of a file). A scan with
``memberIndex`` reads one file in as many tasks as it has splits. A look-up
joins urls with ``members`` and reads those members' bytes alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark import schemas
from arcspark.sources.arc import _ARROW_ITEM, _ARROW_RAW, RETRIES, Resuming, _place, batches, item_row, raw_row, read_arc
from arcspark.sources.members import PREFIX, ArcError, parse_record

#: Bytes between two members that are read rather than skipped; bytes of one read at most, unless a member is longer.
GAP, READ_BYTES = 64 << 10, 8 << 20
#: Urls that a look-up broadcasts.
BROADCAST_URLS = 100_000

_WHERE = ["path", "pos", "size"]


def member_index(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(url, url_hash, path, pos, size) of every record below ``path``; ``path`` is relative to it."""
    rows = read_arc(spark, path, **{**options, "records": "raw", "withContent": "false", "fullNames": "true"})
    return rows.select("url", F.xxhash64("url").alias("url_hash"), F.col("arc_file_name").alias("path"), F.col("arc_file_pos").alias("pos"), F.col("arc_file_size").alias("size"))


def write_member_index(spark: SparkSession, path: str, index: str, split_mb: float = 64, **options: object) -> None:
    """Index the archives below ``path`` into the folder ``index``, over an older one."""
    found = member_index(spark, path, **options)
    found.repartitionByRange("url_hash", "path", "pos").sortWithinPartitions("url_hash", "path", "pos").write.mode("overwrite").parquet(f"{index}/members")
    each = max(1, int(split_mb * (1 << 20)))
    members = spark.read.parquet(f"{index}/members")
    splits = members.groupBy("path", F.floor(F.col("pos") / each).alias("part")).agg(F.min("pos").alias("pos")).where("part > 0").select("path", "pos")
    splits.write.mode("overwrite").parquet(f"{index}/splits")


def runs(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges within) of reads that cover sorted (position, size) ranges; near ones share a read."""
    held: list[tuple[int, int]] = []
    start = end = 0
    for pos, size in ranges:
        if held and (pos - end > GAP or max(end, pos + size) - start > READ_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = end = pos
        held.append((pos, size))
        end = max(end, pos + size)
    if held:
        yield start, end, held


def read_members(places: DataFrame, path: str, item: bool = False, prefix: str = PREFIX, drop_malformed: bool = False, bytes_read: Accumulator | None = None) -> DataFrame:
    """The records at the rows (path, pos, size) of ``places``, in the schema of a scan, reading their bytes alone.

    Places are sorted and dealt in ranges, so that one file's may go to many
    tasks, and near ones share a read. A place that repeats is read once a
    time; nulls are left out. ``bytes_read`` adds up what the store was asked for.
    """
    make, arrow, schema = (item_row, _ARROW_ITEM, schemas.ITEM) if item else (raw_row, _ARROW_RAW, schemas.RAW_RECORD)

    def work(found):
        where, base = _place(path)
        single = where.get_file_info(base).is_file

        def rows():
            file, name = None, None
            for batch in found:
                names, pos, size = (batch.column(i).to_pylist() for i in range(3))
                a = 0
                while a < len(names):
                    b = a
                    while b < len(names) and names[b] == names[a]:
                        b += 1
                    if names[a] != name:
                        if file is not None:
                            file.close()
                        name = names[a]
                        file = Resuming(where, base if single else f"{base}/{name}", RETRIES)
                    for start, end, parts in runs(list(zip(pos[a:b], size[a:b], strict=True))):
                        file.seek(start)
                        data = bytearray(end - start)
                        view, at = memoryview(data), 0
                        while at < len(data) and (n := file.readinto(view[at:])):
                            at += n
                        if bytes_read is not None:
                            bytes_read.add(at)
                        for p, n in parts:
                            try:
                                r = parse_record(zlib.decompress(bytes(view[p - start : p - start + n]), 31), p, n)
                            except (zlib.error, ArcError) as e:
                                if drop_malformed:
                                    continue
                                raise ArcError(f"no record at {name}:{p}+{n}: {e}") from e
                            yield make(r, name, True, prefix)
                    a = b
            if file is not None:
                file.close()

        yield from batches(rows(), arrow)

    wanted = places.select(F.col("path").cast("string"), F.col("pos").cast("long"), F.col("size").cast("long")).dropna()
    return wanted.repartitionByRange(*_WHERE).sortWithinPartitions(*_WHERE).mapInArrow(work, schema)


def lookup(spark: SparkSession, urls: DataFrame, path: str, index: str, url_col: str = "url", **more: object) -> DataFrame:
    """All captures of the given urls, by the index: a join with its members, then ``read_members``.

    Urls that repeat count once; nulls and unknown urls find nothing.
    """
    asked = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().withColumn("url_hash", F.xxhash64("url"))
    if asked.count() <= BROADCAST_URLS:
        asked = F.broadcast(asked)
    places = spark.read.parquet(f"{index}/members").join(asked, ["url_hash", "url"])
    return read_members(places.select(*_WHERE), path, **more)
