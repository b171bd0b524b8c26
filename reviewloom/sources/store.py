"""Versioned Parquet snapshots of several tables behind one commit log.

A commit writes new table parts and then puts the next numbered commit, so all
tables of a commit become visible together or not at all; writers of the same
store never lose each other's commits. A commit may carry a ``batch_id`` of a
writer; one that was committed before is a no-op, which makes a replayed
micro-batch harmless. A replacement keeps the parts that others appended while
it was being written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.commits import CommitLog

TARGET_BYTES = 134_217_728  # of a compacted file (a fixed value of the maintenance job)
_EMPTY = {"tables": {}, "batches": {}}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    def _state(self) -> dict:
        return self.log.current(_EMPTY)[1]

    def exists(self, name: str) -> bool:
        return name in self._state()["tables"]

    def parts(self, name: str) -> list[str]:
        """The parts of the current version."""
        return self._state()["tables"].get(name, [])

    def read(self, name: str, schema: str | None = None, parts: list[str] | None = None) -> DataFrame:
        """The current version (or the given parts of it); an empty frame of ``schema`` if the table was never written."""
        found = self.parts(name) if parts is None else parts
        if not found:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in found])

    def committed(self, writer: str, batch_id: int) -> bool:
        return self._state()["batches"].get(writer, -1) >= batch_id

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, writer: str | None = None, batch_id: int | None = None, parts: dict[str, list[str]] | None = None) -> bool:
        """Write and publish; False if the writer's batch was already committed.

        ``parts``: per table the old parts that its new ones stand for, as they
        were read; by default all parts there are when the commit begins. Parts
        replaced by another writer in the meantime are a conflict (ValueError).
        """
        done = lambda state: writer is not None and batch_id is not None and state["batches"].get(writer, -1) >= batch_id
        before = self._state()
        if done(before):
            return False
        read = {name: (parts or {}).get(name, before["tables"].get(name, [])) for name in replace or {}}
        written: dict[str, list[str]] = {}
        for name, df in [*(replace or {}).items(), *(append or {}).items()]:
            part = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{part}")
            written.setdefault(name, []).append(part)

        def change(state: dict) -> dict | None:
            if done(state):
                return None
            for name, new in written.items():
                have = state["tables"].get(name, [])
                gone = read.get(name, [])
                if set(gone) - set(have):
                    raise ValueError(f"{name} was replaced by another writer")
                state["tables"][name] = [*[p for p in have if p not in gone], *new]
            if writer is not None and batch_id is not None:
                state["batches"][writer] = batch_id
            return state

        return self.log.update(_EMPTY, change) is not None

    def compact(self, name: str, target_bytes: int = TARGET_BYTES) -> int:
        """Rewrite the parts of a table that are smaller than half of ``target_bytes`` into files of about that size; the number of files written."""
        sizes = {p: self.log.size(f"{self.root}/{p}") for p in self.parts(name)}
        small = [p for p, n in sizes.items() if 2 * n < target_bytes] or list(sizes)[:1]
        if not small:
            return 0
        files = max(1, -(-sum(sizes[p] for p in small) // target_bytes))
        self.commit(replace={name: self.read(name, parts=small).repartition(files)}, parts={name: small})
        return files


def write_by_day(df: DataFrame, path: str, day_of: str, *more: str) -> None:
    """Create or replace a table partitioned by the UTC day of a time (and further columns)."""
    df.withColumn("event_date", F.to_date(day_of)).write.mode("overwrite").partitionBy("event_date", *more).parquet(path)
