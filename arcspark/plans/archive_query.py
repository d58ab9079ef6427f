"""Queries with an identity: cached, paged results that are computed once.

A query states its domain and parameters; their fingerprints are its canonical
id. Its result is sorted, given row positions and kept as Parquet under
``<root>/<id>/<time>``. While that is young enough, pages come from the file;
identical queries that run at the same time share one computation.
"""

from __future__ import annotations

import threading
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.functions.hashing import rabin_text
from arcspark.operators.ordering import seek, with_row_index
from arcspark.plans.shards import ShardedResult


class SortOrder(IntEnum):
    ASC = 0
    DESC = 1


class State(IntEnum):
    PENDING = 0
    RUNNING = 1
    FINISHED = 2
    ERROR = 3
    CANCELLED = 4


@dataclass
class Status:
    query_id: str
    state: State = State.PENDING
    rows: int = 0
    started: float = 0.0
    finished: float = 0.0
    error: str = ""


@dataclass
class Page:
    rows: DataFrame
    number: int
    size: int
    total: int


class ArchiveQuery(ABC):
    """What a query is: subclass and register.

    With ``shards`` the result is computed by ``build_shards`` and each shard
    kept as it is done: a query that failed goes on from there.
    """

    max_age_s: float = 24 * 3600.0
    single_row = False
    shards = 0

    @abstractmethod
    def domain_id(self) -> str: ...

    @abstractmethod
    def params(self) -> str: ...

    @abstractmethod
    def build(self, spark: SparkSession) -> DataFrame: ...

    def build_shards(self, spark: SparkSession, shards: Sequence[int]) -> DataFrame:
        """The rows of some shards, with their ``shard``."""
        raise NotImplementedError

    @abstractmethod
    def sort_keys(self) -> list[str]: ...

    def canonical_id(self) -> str:
        unsigned = lambda x: x & ((1 << 64) - 1)
        return f"{unsigned(rabin_text(self.domain_id())):016x}-{unsigned(rabin_text(self.params())):016x}"


REGISTRY: dict[str, type[ArchiveQuery]] = {}


def register(kind: type[ArchiveQuery]) -> type[ArchiveQuery]:
    REGISTRY[kind.__name__] = kind
    return kind


def create(name: str, *args: object, **kwargs: object) -> ArchiveQuery:
    return REGISTRY[name](*args, **kwargs)


@dataclass
class Controller:
    """Runs queries and serves their pages."""

    spark: SparkSession
    root: str
    statuses: dict[str, Status] = field(default_factory=dict)

    #: Queries that run at once; the others wait in the order they came.
    concurrency: int = 1

    def __post_init__(self):
        self._lock, self._running = threading.Lock(), {}
        self._queue = ThreadPoolExecutor(self.concurrency, thread_name_prefix="query")

    def submit(self, query: ArchiveQuery) -> Future:
        """Puts a query in the queue; the future has its result's rows."""
        return self._queue.submit(self.result, query)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self, query: ArchiveQuery) -> str | None:
        """The youngest complete result that is not too old."""
        base = f"{self.root}/{query.canonical_id()}"
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(base)
        if not fs.exists(path):
            return None
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        newest = max(((int(n.partition("-")[0]), n) for n in done if n.partition("-")[0].isdigit()), default=None)
        return f"{base}/{newest[1]}" if newest is not None and time.time() - newest[0] / 1000 <= query.max_age_s else None

    def _compute(self, query: ArchiveQuery) -> str:
        status = self.statuses[query.canonical_id()]
        status.state, status.started = State.RUNNING, time.time()
        try:
            # two drivers may share the root: the time alone could be taken
            path = f"{self.root}/{query.canonical_id()}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
            parts = ShardedResult(self.spark, f"{self.root}/{query.canonical_id()}/shards", query.shards)
            built = parts.refresh(query.build_shards).rows().drop("shard") if query.shards else query.build(self.spark)
            with_row_index(built.limit(1) if query.single_row else built, query.sort_keys()).write.parquet(path)
            if query.shards:
                parts.clear()
            status.rows = self.spark.read.parquet(path).count()
            status.state = State.FINISHED
            return path
        except Exception as e:
            status.state, status.error = State.ERROR, str(e)
            raise
        finally:
            status.finished = time.time()

    def result(self, query: ArchiveQuery) -> DataFrame:
        """The whole result with its row positions, from the cache if it can be."""
        key = query.canonical_id()
        with self._lock:
            future = self._running.get(key)
            mine = future is None
            if mine and (known := self._newest(query)):
                return self.spark.read.parquet(known)
            if mine:
                future = self._running[key] = Future()
                self.statuses[key] = Status(key)
        if mine:
            try:
                future.set_result(self._compute(query))
            except Exception as e:
                future.set_exception(e)
            finally:
                with self._lock:
                    del self._running[key]
        return self.spark.read.parquet(future.result())

    def page(self, query: ArchiveQuery, number: int = 0, size: int = 100, order: SortOrder = SortOrder.ASC) -> Page:
        """A page by number; from the end for DESC. An empty result is a result: total 0."""
        rows = self.result(query)
        total = rows.agg(F.coalesce(F.max("row_idx") + 1, F.lit(0))).first()[0]
        if order == SortOrder.ASC:
            return Page(seek(rows, number * size, (number + 1) * size), number, size, total)
        found = rows.where((F.col("row_idx") < total - number * size) & (F.col("row_idx") >= total - (number + 1) * size))
        return Page(found.orderBy(F.desc("row_idx")), number, size, total)

    def status_table(self) -> DataFrame:
        rows = [(s.query_id, s.state.name, s.rows, s.started, s.finished, s.error) for s in self.statuses.values()]
        return self.spark.createDataFrame(rows, "query_id string, state string, rows long, started double, finished double, error string")

    def status_json(self) -> list[str]:
        return [r[0] for r in self.status_table().select(F.to_json(F.struct("*"))).collect()]


def progress(phase: str, done: float = 0, total: float = 1) -> float:
    """Of a query, from 0 to 1: the shards are a third, the local merge the next, and only serving is left at 0.99."""
    part = min(max(done / total, 0.0), 1.0) if total else 1.0
    # The shares of the phases.
    return {"shards": 0.33 * part, "local": 0.66 + 0.33 * part, "cached": 0.99}[phase]


def job_progress(spark: SparkSession, group: str) -> float:
    """``progress`` of the shards phase from Spark's own counts of the group's tasks."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())]
    known = [s for s in stages if s is not None]
    return progress("shards", sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known))


def missing_parts(expected: int, present: list[str]) -> list[int]:
    """Shards whose ``part-NNNNN`` is not there yet."""
    have = {int(name[5:10]) for name in present if name.startswith("part-") and name[5:10].isdigit()}
    return [i for i in range(expected) if i not in have]
