"""A batch job as map, partition, sort and reduce, declared step by step and run by Spark.

    Job(spark).read("arc", path).map(f, "k string, v long").group_by("k").sort_by("v").reduce(g, "k string, n long").write("parquet", out)

``map`` takes a function of pandas frames, or ``map_arrow`` one of Arrow
batches; ``combine`` names built-in aggregates, which Spark runs before and
after the shuffle; ``reduce`` takes a function of the rows of one partition in
key order, streamed frame by frame, so a key of any size fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from arcspark.session import KNOBS


@dataclass(frozen=True)
class Job:
    """Each step gives a new job; nothing runs before ``rows`` or ``write``."""

    spark: SparkSession
    frame: DataFrame | None = None
    keys: tuple[str, ...] = ()
    order: tuple[str | Column, ...] = ()
    partitions: int | None = None
    by_range: bool = False

    def read(self, kind: str, *paths: str, **options: object) -> Job:
        """Inputs of one format; several are taken together."""
        reader = self.spark.read.format(kind).options(**{k: str(v) for k, v in options.items()})
        frame = None
        for path in paths:
            part = reader.load(path)
            frame = part if frame is None else frame.unionByName(part)
        return replace(self, frame=frame)

    def rows_of(self, frame: DataFrame) -> Job:
        return replace(self, frame=frame)

    def map(self, f: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> Job:
        return replace(self, frame=self.frame.mapInPandas(f, schema))

    def map_arrow(self, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> Job:
        return replace(self, frame=self.frame.mapInArrow(f, schema))

    def group_by(self, *keys: str, partitions: int | None = None, by_range: bool = False) -> Job:
        """The partitioner: rows of equal keys meet, by hash or in ranges."""
        return replace(self, keys=keys, partitions=partitions, by_range=by_range)

    def sort_by(self, *order: str | Column) -> Job:
        """The order within a key."""
        return replace(self, order=order)

    def combine(self, **how: Column) -> Job:
        """Built-in aggregates of each key, combined before rows move."""
        return replace(self, frame=self.frame.groupBy(*self.keys).agg(*(c.alias(name) for name, c in how.items())))

    def _dealt(self) -> DataFrame:
        if not self.keys:
            return self.frame.sortWithinPartitions(*self.order) if self.order else self.frame
        args = [*([self.partitions] if self.partitions else []), *self.keys]
        dealt = self.frame.repartitionByRange(*args) if self.by_range else self.frame.repartition(*args)
        return dealt.sortWithinPartitions(*self.keys, *self.order)

    def reduce(self, f: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> Job:
        """``f`` sees a partition's rows in order of keys and of ``sort_by``."""
        return replace(self, frame=self._dealt().mapInPandas(f, schema), keys=(), order=())

    def rows(self) -> DataFrame:
        return self._dealt() if self.keys or self.order else self.frame

    def write(self, kind: str, path: str, mode: str = "errorifexists", **options: object) -> None:
        self.rows().write.format(kind).mode(mode).options(**{k: str(v) for k, v in options.items()}).save(path)

    def with_knobs(self, **knobs: object) -> Job:
        """Settings of the job by the names batch users know (``arcspark.session.KNOBS``); those fixed at start can't be set here."""
        for knob, value in knobs.items():
            self.spark.conf.set(KNOBS[knob], str(value).lower() if isinstance(value, bool) else str(value))
        return self
