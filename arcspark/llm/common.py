"""Shared pieces of the training-data operators: tables, scratch space, words, joins with what was found.

Every operator here takes a DataFrame plus the names of its id and text
columns and selects just those, so extra or clashing columns never matter.
Operators that return their input's columns carry them packed in one struct.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.storage import shared_dir

#: Entries that a Python worker's cache keeps (about 200 bytes each); past it the cache starts anew.
CACHE_WORDS = 150_000
#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Bytes of text that are split into words at once.
PIECE = 1 << 22
#: Bits of the map of found keys, as a power of two: 16 MB.
MAP_BITS = 27
#: Share of its greatest heap past which the driver collects what ended queries left.
HEAP_SHARE = 0.5

# Arrow's own allocators keep what they have freed; batches of texts are large enough for the system's to return.
pa.set_memory_pool(pa.system_memory_pool())

_scopes: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str, scope: str | None = None) -> str:
    """A new path in the shared folder; ``sweep(scope)`` removes it later."""
    path = f"{shared_dir(spark)}/arcspark/{name}-{uuid.uuid4().hex}"
    if scope:
        _scopes.setdefault(scope, []).append(path)
    return path


def new_scope(name: str) -> str:
    """A scope of tables that no result reads, swept when the operator has planned its result."""
    return f"{name}-{uuid.uuid4().hex}"


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has taken HEAP_SHARE of what it may.

    Plans, collected rows and broadcasts of ended queries are garbage that the
    heap grows over rather than collects, and it keeps what it has grown to; a
    full collection hands that back. Shuffle files and the executors' copies of
    broadcasts go with it.
    """
    pa.default_memory_pool().release_unused()
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # frames of Python hold their plans
        jvm.java.lang.System.gc()


def sweep(spark: SparkSession, scope: str) -> None:
    """Delete the scratch tables of ``scope``; their readers must be done."""
    for path in _scopes.pop(scope, []):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    settle(spark)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Whole texts go to Python ``rows`` at a time, at most, in what runs meanwhile: a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name, scope)
    with small_batches(spark):
        df.write.parquet(path)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def sized(side: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """Mark a side of ``rows`` narrow rows for broadcast if the bound allows it."""
    return F.broadcast(side) if rows <= (BROADCAST_ROWS if limit is None else limit) else side


def _marked(docs: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``docs`` with ``_may``: false where the key is surely not among ``keys`` (one column).

    A map of one bit for each hash cell, in blocks of 4096 bytes, goes to every
    executor; its size depends on ``bits`` alone.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    block = keys.groupBy(F.shiftright(cell, 15).alias("_block")).agg(F.bitmap_construct_agg(cell.bitwiseAND(F.lit(32767))).alias("_bits"))
    at = cell.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))) > 0
    return docs.withColumn("_block", F.shiftright(cell, 15)).join(F.broadcast(block), "_block", "left").withColumn("_may", F.coalesce(bit, F.lit(False))).drop("_block", "_bits")


def joined(docs: DataFrame, found: DataFrame, key: str, how: str = "inner", limit: int | None = None, bits: int = MAP_BITS) -> DataFrame:
    """``docs`` joined with ``found`` (one row a key) so that no text moves that has no match.

    Up to ``limit`` rows, the elements of arrays counted as rows, ``found`` is
    broadcast. Past it a bitmap tells which keys may be found; only those rows
    are shuffled, the others pass by.
    """
    entries = sum((F.coalesce(F.size(f.name), F.lit(0)) for f in found.schema if f.dataType.typeName() == "array"), F.lit(1))
    if (found.agg(F.sum(entries)).first()[0] or 0) <= (BROADCAST_ROWS if limit is None else limit):
        return docs.join(F.broadcast(found), key, how)
    marked = _marked(docs, found.select(key), key, bits)
    moved = marked.where("_may").drop("_may").join(found, key, how)
    if how == "inner" or how == "left_semi":
        return moved
    rest = marked.where("NOT _may").drop("_may")
    if how == "left":
        rest = rest.withColumns({f.name: F.lit(None).cast(f.dataType) for f in found.schema if f.name != key})
    return moved.unionByName(rest)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns, and ``more`` beside it: nothing of ours can clash with a name in ``docs``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone; a null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def hand_back() -> None:
    """Give memory that was freed back to the machine: allocators keep it for the process otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


class Kept(dict):
    """A worker's cache within CACHE_WORDS entries.

    Workers live on from task to task, beside another and a JVM that uses all
    its heap: ``take`` empties the caches of other operators and hands their
    memory back.
    """

    _all: list[Kept] = []
    _last: Kept | None = None

    def __init__(self):
        super().__init__()
        Kept._all.append(self)

    def take(self) -> Kept:
        if Kept._last is not self:
            Kept._last = self
            for other in Kept._all:
                if other is not self:
                    other.clear()
            hand_back()
        return self


class WordHashes(Kept):
    """bytes -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.take().__getitem__, words), np.uint64, len(words))


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about PIECE bytes that end at a blank."""
    at = 0
    while len(data) - at > PIECE:
        blank = _BLANK.search(data, at + PIECE)
        if blank is None:
            break
        yield data[at : blank.start()]
        at = blank.start()
    yield data[at:] if at else data


def text_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased; words end at blanks and the control characters 9 to 13."""
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE:
        return word_hashes(data.split())
    return np.concatenate([word_hashes(x.split()) for x in pieces(data)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def in_runs(texts: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(first, end, texts) of runs of about ``size`` bytes, so that few texts of a batch are held as Python strings at once."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // size, prepend=0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if b > a:
            yield a, b, texts.slice(a, b - a).to_pylist()
