"""Messages delivered more than once: idempotent upsert into hash-bucketed, sorted storage.

The store is a set of Parquet files bucketed by the message's identifier and
sorted by it inside each bucket. Every upsert appends one sorted run per
bucket; within a run equal identifiers are already one. Compaction reads the
runs bucket by bucket, merges them so that equal identifiers collapse to the
kept delivery, and writes the next version. As the files are bucketed, neither
the merge nor a later lookup by identifier shuffles.

The kept delivery of an identifier is the one with the earliest ``ingested_at``,
then the smallest ``delivery_id``. Keeping a minimum is idempotent, so an upsert
repeated after a failure, or batches in another order, give the same store.

The store is known by its path alone: its number of buckets and its current
version stand in a commit log beside the files, so another session goes on with it.

Defined cases: rows with a null payload are no messages and never stored; a
null ``ingested_at`` counts as later than any time; an empty input gives an
empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.late_counters import message_key
from reviewloom.session import fresh_path, shuffle_width
from reviewloom.sources.commits import CommitLog

_RUN = "msg_key binary, ingested_at timestamp, delivery_id bigint"
_LAST = "timestamp'9999-12-31 00:00:00'"


def _keep(df: DataFrame) -> DataFrame:
    """One row per identifier; partial minima are taken before any exchange."""
    return df.groupBy("msg_key").agg(F.min(F.struct("ingested_at", "delivery_id")).alias("k")).select("msg_key", "k.ingested_at", "k.delivery_id")


class MessageStore:
    """A bucketed store at ``path``, which outlives the session; without one, an intermediate below the shared folder.

    ``buckets`` counts for a new store (default: the shuffle width); an existing
    one keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or fresh_path(spark, "messages")).rstrip("/")
        self.log = CommitLog(spark, self.path)
        first = {"buckets": buckets or shuffle_width(spark), "version": 0}
        self.log.update(first, lambda state: state if self.log.numbers() == [] else None)
        self._name = f"messages_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"

    @property
    def buckets(self) -> int:
        return self.log.current({})[1]["buckets"]

    @property
    def version(self) -> int:
        return self.log.current({})[1]["version"]

    def _table(self, version: int) -> str:
        """The catalog's name of a version; one written by an earlier session is made known first."""
        name = f"{self._name}_v{version}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table if not exists {name} ({_RUN}) using parquet clustered by (msg_key) sorted by (msg_key) into {self.buckets} buckets location '{self.path}/v{version}'")
        return name

    def _append(self, df: DataFrame, version: int) -> None:
        df.write.mode("append").format("parquet").bucketBy(self.buckets, "msg_key").sortBy("msg_key").saveAsTable(self._table(version))

    def upsert(self, deliveries: DataFrame) -> None:
        """Add one batch (delivery_id, payload_json, ingested_at) as sorted runs."""
        arriving = deliveries.where(F.col("payload_json").isNotNull()).select(message_key(F.col("payload_json")).alias("msg_key"), F.coalesce("ingested_at", F.expr(_LAST)).alias("ingested_at"), "delivery_id")
        self._append(_keep(arriving), self.version)

    def compact(self) -> DataFrame:
        """Merge all runs into the next version and return it: one row per identifier.

        The version before stays for readers under way; older ones are deleted.
        """
        old = self.version
        self.log.remove(f"{self.path}/v{old + 1}")  # of a compaction that didn't end
        self._append(_keep(self.spark.table(self._table(old))), old + 1)
        self.log.update({}, lambda state: state | {"version": old + 1})
        for v in range(max(0, old - 1), old):
            self.spark.sql(f"drop table if exists {self._name}_v{v}")
            self.log.remove(f"{self.path}/v{v}")
        return self.kept()

    def kept(self) -> DataFrame:
        """The current version (call after :meth:`compact`)."""
        return self.spark.table(self._table(self.version))


def surplus_deliveries(deliveries: DataFrame, kept: DataFrame) -> DataFrame:
    """The deliveries of messages that are not the kept one.

    An anti-join by ``delivery_id``, which is unique: a message with any number
    of copies can't make a hot join key, and no payload moves.
    """
    return deliveries.where(F.col("payload_json").isNotNull()).select("delivery_id").join(kept.select("delivery_id"), "delivery_id", "left_anti")


def one_copy_each(deliveries: DataFrame, kept: DataFrame) -> DataFrame:
    """The deliveries, each message once, all columns kept."""
    return deliveries.join(kept.select("delivery_id"), "delivery_id", "left_semi")
