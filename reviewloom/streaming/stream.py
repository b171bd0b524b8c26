"""The two streaming queries: valid events into bronze and silver, the others into quarantine.

Both come from one source of broker-shaped records. Valid events are
deduplicated by hash within the watermark (state is evicted), and the sink is
idempotent by hash and by batch id, so a redelivery after eviction or a replayed
batch changes nothing. Late events are flagged, never dropped by the sink; what
the watermark drops shows in the query's progress.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.functions import contract
from reviewloom.operators import state
from reviewloom.schemas import EVENT, RECORD
from reviewloom.sources.store import SnapshotStore

WATERMARK = "24 hours"
BRONZE = "event_hash string, payload_json string, kafka_partition int, kafka_offset bigint, ingested_at timestamp"
QUARANTINE = "event_hash string, payload_json string, error_reason string, kafka_partition int, kafka_offset bigint, quarantined_at timestamp"
SILVER = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT.fields) + ", event_hash string, is_late boolean, kafka_offset bigint, processed_at timestamp"


def file_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of broker-shaped records from Parquet files."""
    reader = spark.readStream.schema(RECORD)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The same from Kafka; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "false").load()
    return raw.select(F.col("value").cast("string").alias("value"), "partition", "offset", "timestamp")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def process_valid(store: SnapshotStore, batch: DataFrame, batch_id: int) -> bool:
    """Append new events to bronze and merge the newest of each review into silver, in one commit."""
    if store.committed("valid", batch_id):
        return False
    batch = batch.persist()
    try:
        if batch.isEmpty():
            return False
        at = F.lit(_now())
        old = store.read("bronze", BRONZE)
        first = batch.dropDuplicates(["event_hash"])
        fresh = first.join(old.select("event_hash"), "event_hash", "left_anti")
        bronze = fresh.select("event_hash", "payload_json", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), at.alias("ingested_at"))
        rows = fresh.select("event.*", "event_hash", F.col("offset").alias("kafka_offset"), "timestamp").withColumn("updated_at", F.coalesce("updated_at", "created_at"))
        rows = state.with_late_vs_broker(rows).drop("timestamp").withColumn("processed_at", at)
        newest = state.latest_per_key(rows, "review_id", ["updated_at", "kafka_offset"])
        silver = state.merge_newest(store.read("silver", SILVER), newest, "review_id", "updated_at", "kafka_offset")
        return store.commit(replace={"silver": silver}, append={"bronze": bronze}, writer="valid", batch_id=batch_id)
    finally:
        batch.unpersist()


def process_invalid(store: SnapshotStore, batch: DataFrame, batch_id: int) -> bool:
    """Append rejected records with their reason, each payload once."""
    if store.committed("invalid", batch_id) or batch.isEmpty():
        return False
    rows = batch.select("event_hash", "payload_json", "error_reason", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.lit(_now()).alias("quarantined_at"))
    key = F.coalesce("event_hash", F.concat_ws(":", F.lit("null"), "kafka_partition", "kafka_offset"))
    rows = rows.withColumn("_k", key).dropDuplicates(["_k"])
    old = store.read("quarantine", QUARANTINE).select(key.alias("_k"))
    return store.commit(append={"quarantine": rows.join(old, "_k", "left_anti").drop("_k")}, writer="invalid", batch_id=batch_id)


def start(records: DataFrame, store: SnapshotStore, checkpoint: str, available_now: bool = True) -> list[StreamingQuery]:
    """Start both queries, each with its own checkpoint."""
    valid, invalid = contract.split(contract.parse_events(records))
    unique = valid.withWatermark("timestamp", WATERMARK).dropDuplicatesWithinWatermark(["event_hash"])
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    accepted = unique.writeStream.foreachBatch(lambda df, i: process_valid(store, df, i) and None).option("checkpointLocation", f"{checkpoint}/valid").trigger(**trigger).start()
    refused = invalid.writeStream.foreachBatch(lambda df, i: process_invalid(store, df, i) and None).option("checkpointLocation", f"{checkpoint}/invalid").trigger(**trigger).start()
    return [accepted, refused]


def run_to_end(queries: list[StreamingQuery]) -> None:
    for q in queries:
        q.awaitTermination()
