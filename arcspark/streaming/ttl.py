"""A cache of addresses that expire, with a host's canonical name to fall back on: over streams and over tables.

Rows are sightings (host, ts, ip, expires, cname) and questions (host and ts
alone); times are instants, ``expires`` is in milliseconds. A sighting also
counts for its canonical name, unless that has an address that lasts longer.
A question gets the address that its host has at the time while it lasts;
after that the canonical name's, if that lasts longer than the host's own did;
else the expired one, which is said to be stale.

Both steps of a stream keep one entry a name and drop it by a timer when the
watermark has passed ``keep`` beyond its expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "name string, ts timestamp, ip string, expires long, cname string, alias boolean, host string, question boolean"
ENTRY = "ip string, expires long, cname string, seen timestamp"
ANSWER = "host string, ts timestamp, ip string, expires long, via string, fresh boolean"
#: An answer, and for those that go on to a canonical name, which.
STEP = f"{ANSWER}, name string"
_STEP = ["host", "ts", "ip", "expires", "via", "fresh", "name"]


def _named(rows: DataFrame) -> DataFrame:
    """Sightings by host and by canonical name, and questions by host."""
    seen = rows.where("host IS NOT NULL AND ts IS NOT NULL").select("host", F.col("ts").cast("timestamp").alias("ts"), "ip", F.col("expires").cast("long").alias("expires"), "cname")
    sighting = F.col("ip").isNotNull() & F.col("expires").isNotNull()
    names = F.when(sighting & (F.col("cname") != F.col("host")), F.array(F.struct(F.col("host").alias("name"), F.lit(False).alias("alias")), F.struct(F.col("cname").alias("name"), F.lit(True).alias("alias"))))
    names = F.coalesce(names, F.array(F.struct(F.col("host").alias("name"), F.lit(False).alias("alias"))))
    out = seen.withColumn("n", F.explode(names))
    return out.select("n.name", "ts", "ip", "expires", F.when(F.col("cname") != F.col("host"), F.col("cname")).alias("cname"), "n.alias", "host", (~sighting).alias("question"))


class _Step(StatefulProcessor):
    """The entry of a name; ``final`` answers every question, otherwise stale ones with a canonical name go on."""

    def __init__(self, final: bool, keep_ms: int):
        self._final, self._keep_ms = final, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", ENTRY)

    def _answer(self, r, known: tuple | None) -> tuple:
        now = int(r.ts.timestamp() * 1000)
        if self._final:
            # what is known of the canonical name counts if it lasts longer than what the host had
            better = known is not None and known[1] > r.expires
            ip, expires, via = (known[0], known[1], "cname") if better else (r.ip, r.expires, "host")
            return r.host, r.ts, ip, expires, via, bool(expires > now), None
        if known is None:
            return r.host, r.ts, None, None, None, False, None
        fresh = known[1] > now
        return r.host, r.ts, known[0], known[1], "host", fresh, None if fresh else known[2]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).astype({"ip": object, "cname": object})
        frame = frame.where(frame.notna(), None).sort_values(["ts", "question", "alias", "expires", "ip"], kind="stable")
        known, out = tuple(self._entry.get()) if self._entry.exists() else None, []
        for r in frame.itertuples(index=False):
            if r.question:
                out.append(self._answer(r, known))
            elif not r.alias:
                # a sighting that comes late must not undo a newer one
                if known is None or known[3] is None or known[3] <= r.ts.to_pydatetime():
                    known = (r.ip, int(r.expires), r.cname, r.ts.to_pydatetime())
            elif known is None or known[1] < r.expires:
                known = (r.ip, int(r.expires), *(known[2:] if known else (None, None)))
        if known is not None:
            self._entry.update(known)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(max(known[1] + self._keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=_STEP).astype({"ts": "datetime64[us]", "expires": "Int64", "fresh": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def _forwarded(step: DataFrame) -> DataFrame:
    """Questions that go on to a canonical name, with what their host had."""
    return step.where("name IS NOT NULL").select("name", "ts", "ip", "expires", F.lit(None).cast("string").alias("cname"), F.lit(False).alias("alias"), "host", F.lit(True).alias("question"))


_ORDER = ["ts", "question", "alias", "expires", "ip"]


def _step(named: DataFrame, final: bool) -> DataFrame:
    """A step over tables: the entry of a name is its last sighting, or what lasts longest of that and of what came as a canonical name since."""
    order = Window.partitionBy("name").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ~F.col("question") & ~F.col("alias")
    rows = named.withColumns({"nth": F.row_number().over(Window.partitionBy("name").orderBy(*_ORDER)), "since": F.sum(own.cast("int")).over(order)})
    held = Window.partitionBy("name", "since").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.when(~F.col("question"), F.struct("expires", (-F.col("nth")).alias("first"), "ip"))).over(held)
    # the last sighting begins its run; before the first one there is no canonical name
    known = rows.withColumns({"best": best, "on": F.when(F.col("since") > 0, F.first("cname").over(held))}).where("question")
    now = F.unix_millis("ts")
    if final:
        better = F.coalesce(F.col("best.expires") > F.col("expires"), F.lit(False))
        pick = lambda c: F.when(better, F.col(f"best.{c}")).otherwise(F.col(c))
        return known.select("host", "ts", pick("ip").alias("ip"), pick("expires").alias("expires"), F.when(better, "cname").otherwise("host").alias("via"), (pick("expires") > now).alias("fresh"))
    fresh = F.coalesce(F.col("best.expires") > now, F.lit(False))
    return known.select("host", "ts", F.col("best.ip").alias("ip"), F.col("best.expires").alias("expires"), F.when(F.col("best").isNotNull(), "host").alias("via"), fresh.alias("fresh"), F.when(~fresh & F.col("best").isNotNull(), F.col("on")).alias("name"))


def answers(rows: DataFrame) -> DataFrame:
    """(host, ts, ip, expires, via, fresh) for each question of a table.

    Without any sighting before it a question has nulls and is not fresh. Rows
    without a host or time are left out; a cname that is the host is none.
    Sightings at the time of a question count, of equal times the one that
    lasts longest. A name's rows are sorted by one task, which spills.
    """
    named = _named(rows)
    first = _step(named, False)
    second = _step(_forwarded(first).unionByName(named.where("NOT question")), True)
    return first.where("name IS NULL").drop("name").unionByName(second)


def answer_stream(rows: DataFrame, late: str = "10 minutes", keep_ms: int = 0) -> DataFrame:
    """The same on a stream, in append mode, with rows up to ``late``; what has expired ``keep_ms`` ago is forgotten.

    The state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    A late sighting counts from when it comes, and never undoes a newer one.
    """
    named = _named(rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    step = lambda df, final: df.groupBy("name").transformWithStateInPandas(_Step(final, keep_ms), STEP, "Append", "EventTime", eventTimeColumnName="ts")
    first = step(named, False)
    second = step(_forwarded(first).unionByName(named.where("NOT question")), True)
    return first.where("name IS NULL").drop("name").unionByName(second.drop("name"))
