"""The cache of addresses that expire: over tables, over streams, and over a stream that stops and goes on."""

import datetime as dt
import random

import pytest

from arcspark.streaming import ttl

BASE = dt.datetime(2024, 1, 1)
KIND = "host string, ts timestamp, ip string, expires long, cname string"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def ms(seconds):
    return int((BASE - dt.datetime(1970, 1, 1)).total_seconds() * 1000) + 1000 * seconds


def simulated(rows):
    """Row after row by time: a cache of entries by name."""
    cache, out = {}, []
    for host, ts, ip, expires, cname in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2] is None)):
        now = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        if ip is not None:
            cname = cname if cname != host else None
            cache[host] = [ip, expires, cname]
            if cname and (cname not in cache or cache[cname][1] < expires):
                cache[cname] = [ip, expires, cache.get(cname, [None, None, None])[2]]
            continue
        known = cache.get(host)
        if known is None:
            out.append((host, ts, None, None, None, False))
            continue
        found, via = known, "host"
        if known[1] <= now and known[2] in cache and cache[known[2]][1] > known[1]:
            found, via = cache[known[2]], "cname"
        out.append((host, ts, found[0], found[1], via, found[1] > now))
    return sorted(out, key=repr)


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        host = f"h{rng.randrange(4)}"
        sighting = rng.random() < 0.5
        cname = rng.choice([None, host, "c0", "c1", f"h{rng.randrange(4)}"]) if sighting else None
        rows.append((host, at(t * 10), f"ip{t}" if sighting else None, ms(t * 10 + rng.randrange(0, 200)) if sighting else None, cname))
    return rows


def collected(df):
    return sorted((tuple(r[c] for c in ("host", "ts", "ip", "expires", "via", "fresh")) for r in df.collect()), key=repr)


def test_over_a_table(spark):
    rows = made(300)
    assert {r[4] for r in simulated(rows)} == {"host", "cname", None}
    assert collected(ttl.answers(spark.createDataFrame([*rows, (None, at(1), "x", 1, None)], KIND).repartition(3))) == simulated(rows)
    assert ttl.answers(spark.createDataFrame([], KIND)).count() == 0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_over_a_stream_that_restarts(spark, rocksdb, tmp_path):
    """Three runs from one checkpoint; the state lives on, a late sighting counts when it comes and undoes nothing newer."""

    def run(rows, name):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = ttl.answer_stream(spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), late="1 hour", keep_ms=3_600_000)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return collected(spark.read.parquet(str(tmp_path / "out")))

    rows = made(60)
    assert run(rows[:30], "a") == simulated(rows[:30])
    late = ("h0", at(1), "late", ms(10_000), None)
    got = run([late, *rows[30:]], "b")
    # what is newer than the late sighting stands
    newest = max(t for h, t, ip, *_ in rows[:30] if h == "h0" and ip)
    assert newest > at(1) and not any(r[2] == "late" for r in got) and got == simulated(rows)
    # three hours on, entries that expired more than an hour ago are gone
    far = [("h1", at(20_000), "ipx", ms(30_000), None), ("h1", at(20_001), None, None, None)]
    run(far, "c")
    gone = [("h2", at(20_002), None, None, None), ("h1", at(20_003), None, None, None)]
    got = [r for r in run(gone, "d") if r[1] >= at(20_000)]
    assert got == [("h1", at(20_001), "ipx", ms(30_000), "host", True), ("h1", at(20_003), "ipx", ms(30_000), "host", True), ("h2", at(20_002), None, None, None, False)]
