"""Aggregations: combining values, histograms, running averages, Bloom filters, bandwidth."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from arcspark import schemas
from arcspark.functions.hashing import murmur2_many


def combine(df: DataFrame, keys: list[str], **how: Column) -> DataFrame:
    """One row for each key; every value takes part, whatever fits in memory."""
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in how.items())).orderBy(*keys)


def combine_with(df: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """As ``combine``, with a function of all rows of a key; a key's rows must fit in a task."""
    return df.groupBy(*keys).applyInPandas(fold, schema)


def histogram(df: DataFrame, key: Column, bar: int | None = None) -> DataFrame:
    """(key, n), by key, and with ``bar`` a bar of one mark for each ``bar`` counts."""
    out = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    if bar:
        out = out.withColumn("bar", F.concat(F.col("key").cast("string"), F.lit(":"), F.repeat(F.lit("#"), (F.col("n") / bar).cast("int"))))
    return out.orderBy("key")


def moving_average(value: Column, order: list[Column], samples: int, partition: list[Column]) -> Column:
    """The mean of a row and the ``samples - 1`` before it, within a partition: one task orders each, so name one."""
    return F.avg(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(samples - 1), 0))


def smoothed_average(df: DataFrame, value: str, order: list[str], alpha: float, partition: list[str], out: str = "ema") -> DataFrame:
    """s0 = x0, then alpha x + (1 - alpha) s, within each partition, in one pass over the sorted rows.

    Rows stream through in order, so a partition of any size needs no more than its last value.
    """
    if not partition:
        raise ValueError("name the partition: one task smooths each")
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    names = df.columns

    def work(frames):
        last, state = None, 0.0
        for frame in frames:
            values, result = frame[value].to_numpy(float), np.empty(len(frame))
            keys = list(zip(*(frame[p] for p in partition), strict=True))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                first = keys[a] != last
                run = np.concatenate([values[a : a + 1] if first else [state], values[a + 1 : b] if first else values[a:b]])
                smooth = pd.Series(run).ewm(alpha=alpha, adjust=False).mean().to_numpy()
                result[a:b] = smooth if first else smooth[1:]
                last, state = keys[a], smooth[-1]
            yield frame.assign(**{out: result})[[*names, out]]

    return df.repartition(*partition).sortWithinPartitions(*partition, *order).mapInPandas(work, schema)


def medians(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n, near, median) of each key's numbers: the exact median and the sketched one near it; nulls don't count.

    Sketches bracket the median at 0.49 and 0.51, a hundred times their error
    of 1 in 10,000; only what lies between is counted by value, and one task a
    key adds those counts up. No key's numbers are held in one place.
    """
    rows = df.select(F.col(key).alias("_key"), value.alias("_v"))
    cuts = rows.groupBy("_key").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", [0.49, 0.5, 0.51], 10000).alias("_cuts"))
    known = cuts.select(F.col("_key").alias("_k"), "_n", "_cuts")
    near = rows.join(F.broadcast(known), F.col("_key").eqNullSafe(F.col("_k"))).where(F.col("_v") <= F.col("_cuts")[2])
    # all that lies below is one null, which is first in order
    near = near.groupBy("_key", "_n", F.when(F.col("_v") >= F.col("_cuts")[0], F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_key").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_end", F.sum("_c").over(order))
    at = lambda rank: F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))
    found = near.groupBy(F.col("_key").alias("_k")).agg(at(F.floor((F.col("_n") - 1) / 2)).alias("_low"), at(F.floor(F.col("_n") / 2)).alias("_high"))
    both = cuts.join(F.broadcast(found), F.col("_key").eqNullSafe(F.col("_k")), "left")
    return both.select(F.col("_key").alias(key), F.col("_n").alias("n"), F.col("_cuts")[1].alias("near"), (F.col("_low") / 2 + F.col("_high") / 2).alias("median"))


def bandwidth(df: DataFrame, when_ms: Column, n_bytes: Column, order: list[Column], partition: list[str], samples: int = 20) -> DataFrame:
    """Adds bytes and bits a second over a connection's last samples, and bytes in units of 1024."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(samples - 1), 0)
    rate = F.sum(n_bytes).over(w) / (F.greatest(F.max(when_ms).over(w) - F.min(when_ms).over(w), F.lit(1)) / 1000.0)
    out = df.withColumn("bytes_per_second", rate).withColumn("bits_per_second", F.col("bytes_per_second") * 8)
    scaled, unit = F.col("bytes_per_second"), F.lit("B/s")
    for i, name in enumerate(("KB/s", "MB/s", "GB/s"), 1):
        over = F.col("bytes_per_second") >= 1024**i
        scaled, unit = F.when(over, F.col("bytes_per_second") / 1024**i).otherwise(scaled), F.when(over, name).otherwise(unit)
    return out.withColumn("scaled", scaled).withColumn("unit", unit)


# Milliseconds of a bucket at least, buckets kept, milliseconds without a byte that are a stall.
BUCKET_MS, BUCKETS, STALL_MS = 150, 20, 5000


class _Transfer:
    """Buckets of one transfer: the last BUCKETS full ones, and the one being filled since ``began``."""

    def __init__(self):
        self.began: int | None = None
        self.recent, self.stalled = 0, False
        self.full: deque[tuple[int, int]] = deque(maxlen=BUCKETS)

    def update(self, now: int, n: int) -> tuple[bool, int, float]:
        """(stalled, full buckets, bytes a second) after ``n`` bytes at ``now``."""
        if self.began is None:
            self.began = now
        self.recent += n
        age = now - self.began
        if age >= BUCKET_MS and n:
            # what follows a stall is as if it had just begun
            self.full.append((1 if self.stalled else age, self.recent))
            self.stalled, self.began, self.recent = False, now, 0
        elif age >= STALL_MS and not n:
            self.stalled, self.recent = True, 0
            self.full.clear()
        amount = sum(b for _, b in self.full) + self.recent
        took = sum(t for t, _ in self.full) + (0 if self.stalled else now - self.began)
        return self.stalled, len(self.full), 1000.0 * amount / took if amount and took else 0.0


def bandwidth_buckets(df: DataFrame, when_ms: str, n_bytes: str, partition: list[str], order: list[str] | None = None) -> DataFrame:
    """Adds ``stalled``, ``buckets`` and ``bytes_per_second`` after each row of a transfer, from greedy buckets of time.

    A bucket closes with the first bytes that come BUCKET_MS or more after it
    began; the last BUCKETS count. A row without bytes STALL_MS or more after
    the bucket began is a stall: what was counted is forgotten. Null bytes
    count as none; rows without a time keep nulls and change nothing. Rows
    stream through in order, by time and then by ``order``: a transfer of any
    length needs no more than its buckets.
    """
    if not partition:
        raise ValueError("name the partition: a transfer is one")
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("stalled", BooleanType()), StructField("buckets", IntegerType()), StructField("bytes_per_second", DoubleType())])

    def work(frames):
        last, now = None, _Transfer()
        for frame in frames:
            out = []
            for *key, when, n in zip(*(frame[p] for p in partition), frame[when_ms], frame[n_bytes], strict=True):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != last:
                    last, now = key, _Transfer()
                out.append((None, None, None) if pd.isna(when) else now.update(int(when), 0 if pd.isna(n) else int(n)))
            new = pd.DataFrame(out, columns=["stalled", "buckets", "bytes_per_second"], index=frame.index, dtype=object)
            yield pd.concat([frame, new.astype({"stalled": "boolean", "buckets": "Int32", "bytes_per_second": "Float64"})], axis=1)[[*names, *new.columns]]

    return df.repartition(*partition).sortWithinPartitions(*partition, when_ms, *(order or ())).mapInPandas(work, schema)


def rate_limit(df: DataFrame, ts: str, want: str, budget: float, key: list[str], tie: str) -> DataFrame:
    """What each row is granted of its second's budget: min(budget - used before, wanted)."""
    second = F.date_trunc("second", F.col(ts))
    w = Window.partitionBy(*key, second).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(want).over(w), F.lit(0.0))
    return df.withColumn("granted", F.least(F.greatest(F.lit(budget) - used, F.lit(0.0)), F.col(want)))


# -------------------------------------------------------------- Bloom filters

# The best number of hashes for a number of buckets an element, and false-positive rates by both.
BEST_K = (1, 1, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8, 8, 8, 8, 8)
RATES = (
    (1.0,),
    (1.0, 1.0),
    (1.0, 0.393, 0.400),
    (1.0, 0.283, 0.237, 0.253),
    (1.0, 0.221, 0.155, 0.147, 0.160),
    (1.0, 0.181, 0.109, 0.092, 0.092, 0.101),
    (1.0, 0.154, 0.0804, 0.0609, 0.0561, 0.0578, 0.0638),
    (1.0, 0.133, 0.0618, 0.0423, 0.0359, 0.0347, 0.0364),
    (1.0, 0.118, 0.0489, 0.0306, 0.024, 0.0217, 0.0216, 0.0229),
    (1.0, 0.105, 0.0397, 0.0228, 0.0166, 0.0141, 0.0133, 0.0135, 0.0145),
    (1.0, 0.0952, 0.0329, 0.0174, 0.0118, 0.00943, 0.00844, 0.00819, 0.00846),
    (1.0, 0.0869, 0.0276, 0.0136, 0.00864, 0.0065, 0.00552, 0.00513, 0.00509),
    (1.0, 0.08, 0.0236, 0.0108, 0.00646, 0.00459, 0.00371, 0.00329, 0.00314),
    (1.0, 0.074, 0.0203, 0.00875, 0.00492, 0.00332, 0.00255, 0.00217, 0.00199),
    (1.0, 0.0689, 0.0177, 0.00718, 0.00381, 0.00244, 0.00179, 0.00146, 0.00129),
    (1.0, 0.0645, 0.0156, 0.00596, 0.003, 0.00183, 0.00128, 0.001, 0.000852),
)


#: Bytes of a block of a filter that is being built, and of the largest filter.
BLOOM_BLOCK, MOST_BLOOM_BYTES = 1 << 16, 1 << 28


def best_k(buckets: int) -> int:
    return BEST_K[min(buckets, len(BEST_K) - 1)]


def buckets_and_k(rate: float) -> tuple[int, int]:
    """Buckets an element and hashes for a false-positive rate: the fewest buckets that reach it, then the fewest hashes."""
    if rate >= RATES[2][1]:
        return 2, BEST_K[2]
    for buckets in range(2, len(RATES)):
        if RATES[buckets][min(BEST_K[buckets], len(RATES[buckets]) - 1)] <= rate:
            return buckets, next(k for k in range(1, len(RATES[buckets])) if RATES[buckets][k] <= rate)
    return 15, 8


def bloom_bits(n: int, buckets: int) -> int:
    """Bits of the filter: a multiple of 64."""
    return -(-max(1, n * buckets) // 64) * 64


def bloom_cells_many(data: list[bytes], k: int, m: int) -> np.ndarray:
    """k cells for each byte string, by double hashing in 32 bits; the remainder keeps its sign, then loses it."""
    a = murmur2_many(data, 0)
    b = murmur2_many(data, a)
    with np.errstate(over="ignore"):
        x = (a[:, None] + np.arange(k, dtype=np.uint32) * b[:, None]).view(np.int32)
    return np.abs(x.astype(np.int64)) % m


def bloom_cells(data: bytes, k: int, m: int) -> list[int]:
    return bloom_cells_many([data], k, m)[0].tolist()


def bloom_key(value: str | int) -> bytes:
    return value.to_bytes(8, "big", signed=True) if isinstance(value, int) else b"\xfe\xff" + value.encode("utf-16-be", "surrogatepass")


def _bloom_keys(values: pd.Series) -> list[bytes]:
    return [bloom_key(v if isinstance(v, str) else int(v)) for v in values]


def build_bloom(df: DataFrame, column: str, n: int, buckets: int = 10) -> bytes:
    """The filter of all values; its size is fixed by ``n`` and ``buckets`` and may not pass MOST_BLOOM_BYTES.

    Each task sets bits in blocks of its own; blocks of one place are joined
    by OR, each place by one task, and only the finished filter reaches the driver.
    """
    m, k = bloom_bits(n, buckets), best_k(buckets)
    if m // 8 > MOST_BLOOM_BYTES:
        raise ValueError(f"a filter of {m // 8} bytes is too large to be held in one piece")

    def blocks(parts: dict[int, np.ndarray]):
        yield pd.DataFrame({"block": list(parts), "part": [np.packbits(x, bitorder="little").tobytes() if len(x) == 8 * BLOOM_BLOCK else x.tobytes() for x in parts.values()]})

    def work(frames):
        bits: dict[int, np.ndarray] = {}
        for frame in frames:
            values = frame[column].dropna()
            if len(values):
                cells = np.unique(bloom_cells_many(_bloom_keys(values), k, m))
                place = cells // (8 * BLOOM_BLOCK)
                for block, own in zip(*np.unique(place, return_index=True), strict=True):
                    end = np.searchsorted(place, block, "right")
                    bits.setdefault(int(block), np.zeros(8 * BLOOM_BLOCK, np.uint8))[cells[own:end] % (8 * BLOOM_BLOCK)] = 1
        yield from blocks(bits)

    def either(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, part in zip(frame["block"], frame["part"], strict=True):
                x = np.frombuffer(part, np.uint8)
                total[block] = total[block] | x if block in total else x
        yield from blocks(total)

    schema = "block int, part binary"
    out = np.zeros(-(-m // (8 * BLOOM_BLOCK)) * BLOOM_BLOCK, np.uint8)
    for r in df.select(column).mapInPandas(work, schema).repartition("block").mapInPandas(either, schema).toLocalIterator():
        out[r["block"] * BLOOM_BLOCK : (r["block"] + 1) * BLOOM_BLOCK] = np.frombuffer(r["part"], np.uint8)
    return out[: m // 8].tobytes()


def bloom_contains(column: Column, bits: bytes, buckets: int = 10) -> Column:
    """Whether a value may be in the filter, which goes to each executor once."""
    m, k = 8 * len(bits), best_k(buckets)
    shared = SparkSession.active().sparkContext.broadcast(bits)

    @F.pandas_udf(schemas.BOOLEAN)
    def probe(values: pd.Series) -> pd.Series:
        table, known = np.frombuffer(shared.value, np.uint8), values.notna().to_numpy()
        out = pd.Series(pd.NA, index=values.index, dtype="boolean")
        if known.any():
            cells = bloom_cells_many(_bloom_keys(values[known]), k, m)
            out[known] = (table[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(1)
        return out

    return probe(column)
