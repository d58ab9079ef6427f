"""Results kept by shard: what is there stays, what is missing is computed.

A shard's rows lie in ``<root>/shard=<n>``; the folder is written aside and
moved into place whole, so it is there or it isn't. A run asks for the missing
shards in one job. If that fails they are asked for in halves, so that sound
shards are kept and only the failing ones are tried again; a later run starts
from there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Builds the rows of some shards, with a column ``shard``.
Build = Callable[[SparkSession, Sequence[int]], DataFrame]


class ShardsFailed(RuntimeError):
    """Some shards could not be computed; the others are kept."""

    def __init__(self, errors: dict[int, Exception]):
        super().__init__(f"shards {sorted(errors)}: {next(iter(errors.values()))}")
        self.errors = errors


@dataclass
class ShardedResult:
    """``shards`` parts of a result below ``root``, numbered from 0.

    A shard is tried ``attempts`` times, ``wait_s`` seconds apart.
    """

    spark: SparkSession
    root: str
    shards: int
    attempts: int = 5
    wait_s: float = 5.0
    #: The shards of each job that this object ran.
    ran: list[list[int]] = field(default_factory=list)

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def present(self) -> list[int]:
        """Shards whose results are complete."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path()) if s.isDirectory()]
        found = {int(n.removeprefix("shard=")) for n in names if n.startswith("shard=") and n.removeprefix("shard=").isdigit()}
        return sorted(n for n in found if n < self.shards)

    def missing(self) -> list[int]:
        have = set(self.present())
        return [n for n in range(self.shards) if n not in have]

    def drop(self, *shards: int) -> None:
        """Forget some shards, so that the next run computes them."""
        for n in shards:
            self._fs().delete(self._path(f"shard={n}"), True)

    def clear(self) -> None:
        """Forget all of them."""
        self._fs().delete(self._path(), True)

    def _keep(self, build: Build, shards: Sequence[int]) -> None:
        """One job for some shards; each is moved into place when all are written."""
        self.ran.append(list(shards))
        fs, aside = self._fs(), f"_aside-{uuid.uuid4().hex}"
        try:
            rows = build(self.spark, shards)
            if not fs.exists(self._path("schema.json")):
                self._write("schema.json", rows.drop("shard").schema.json())
            rows.where(F.col("shard").isin(list(shards))).write.partitionBy("shard").parquet(f"{self.root.rstrip('/')}/{aside}")
            for n in shards:
                own, place = self._path(aside, f"shard={n}"), self._path(f"shard={n}")
                fs.mkdirs(own)  # a shard without rows has a folder too
                if not fs.exists(place):
                    fs.rename(own, place)  # another driver may have been faster: its rows are as good
        finally:
            fs.delete(self._path(aside), True)

    def _write(self, name: str, text: str) -> None:
        out = self._fs().create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _schema(self) -> StructType:
        text = self.spark.read.text(f"{self.root.rstrip('/')}/schema.json", wholetext=True).first()[0]
        return StructType.fromJson(json.loads(text))

    def refresh(self, build: Build) -> ShardedResult:
        """Compute what is missing. Shards that fail to the end are named in ShardsFailed, after the others were kept."""
        errors: dict[int, Exception] = {}

        def run(shards: Sequence[int]) -> None:
            if not shards:
                return
            for attempt in range(self.attempts if len(shards) == 1 else 1):
                try:
                    return self._keep(build, shards)
                except Exception as e:  # noqa: BLE001  whatever a job fails with
                    error = e
                    if len(shards) == 1 and attempt + 1 < self.attempts:
                        time.sleep(self.wait_s)
            if len(shards) == 1:
                errors[shards[0]] = error
                return
            half = len(shards) // 2
            run(shards[:half])
            run(shards[half:])

        run(self.missing())
        if errors:
            raise ShardsFailed(errors)
        return self

    def rows(self, partial: bool = False) -> DataFrame:
        """All rows with their ``shard``; an error if shards are missing, unless ``partial``."""
        if (missing := self.missing()) and not partial:
            raise FileNotFoundError(f"shards {missing} of {self.root} are missing")
        present, schema = self.present(), self._schema()
        whole = StructType([*schema.fields]).add("shard", "integer")
        if not present:
            return self.spark.createDataFrame([], whole)
        # the folders are named, so that nothing else below the root is read
        root = self.root.rstrip("/")
        return self.spark.read.schema(whole).option("basePath", root).parquet(*(f"{root}/shard={n}" for n in present))
