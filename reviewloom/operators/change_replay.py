"""Applying a change feed: commit-ordered transactional replay.

1. *Assemble.* Deliveries of one change (one ``event_hash``) are one change.
   Changes of one transaction (``txn``; without such a column every change is its
   own) are held until all ``txn_size`` of them are there, and then committed at
   the position of the last. Deliveries without a key, hash or known operation
   are ``rejected``.
2. *Hold sequence gaps.* Offsets of a partition are one sequence. Present
   offsets are kept as bitmaps of 32,768 bits (built map-side), so the end of
   the contiguous prefix, the committed watermark, is found from one small row
   per block. Transactions that reach beyond it are held.
3. *Replay.* Keys don't conflict with each other, so they are replayed in
   parallel. For one key the commit-ordered application of "newer version wins"
   gives the version with the greatest (event time, offset), an associative
   maximum that is combined map-side; a hot key costs one row per map task.
4. *Expose* the state through the watermark: only transactions that lie whole
   within the contiguous prefix are applied, the others stay held. Only where
   the caller knows that missing offsets won't come any more (``feed_complete``)
   are they released behind it, in commit order; transactions of which changes
   are missing stay held even then.

Defined cases: the event time of a change is ``updated_at``, else
``created_at``, else before all others; a change beats a base row of equal
time, since the feed follows the snapshot; deletes of unknown keys leave a
tombstone; an update of a missing key creates it; base rows loaded twice are
one; null offsets are position -1 and always behind the watermark; operations
are read in any case and with surrounding blanks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.text import key_form

DELETES = ("d", "delete", "deleted", "del", "tombstone", "remove")
WRITES = ("c", "i", "u", "r", "insert", "create", "update", "upsert", "merge", "replace", "read")
BLOCK = 32768  # bits of one of Spark's bitmaps


def operation(column: Column) -> Column:
    """``delete``, ``write`` or null for an unknown spelling."""
    op = F.lower(F.trim(column))
    return F.when(op.isin(*DELETES), "delete").when(op.isin(*WRITES), "write")


def event_time() -> Column:
    return F.coalesce("updated_at", "created_at", F.lit("0002-01-01 00:00:00").cast("timestamp"))


def assemble(changes: DataFrame) -> DataFrame:
    """One row per change: change, key, kind, t, part, pos, and ``txn``, ``txn_size`` (null without such columns)."""
    of_txn = [F.col("txn").cast("string").alias("txn"), F.col("txn_size").cast("long").alias("txn_size")] if {"txn", "txn_size"} <= set(changes.columns) else [F.lit(None).cast("string").alias("txn"), F.lit(None).cast("long").alias("txn_size")]
    rows = changes.select(
        F.lower(F.trim("event_hash")).alias("change"), key_form(F.col("review_id")).alias("key"), operation(F.col("op")).alias("kind"), event_time().alias("t"), F.coalesce("kafka_partition", F.lit(-1)).alias("part"), F.coalesce("kafka_offset", F.lit(-1)).cast("long").alias("pos"), *of_txn
    ).where("change is not null and key is not null and kind is not null")
    first = F.min(F.struct("pos", "part", "t", "kind", "key", "txn", "txn_size"))
    return rows.groupBy("change").agg(first.alias("f")).select("change", "f.*")


def held_back(changes: DataFrame, marks: DataFrame) -> DataFrame:
    """The assembled changes with ``committed`` of their partition and ``is_held``: beyond the watermark, or of a transaction that isn't whole before it; ``is_partial``: of a transaction that isn't whole at all."""
    # One row per Kafka partition: the number of partitions bounds it, not the data.
    placed = assemble(changes).join(F.broadcast(marks), "part", "left").withColumn("is_held", F.coalesce(F.col("pos") > F.col("committed"), F.lit(False)))
    if not {"txn", "txn_size"} <= set(changes.columns):
        return placed.withColumn("is_partial", F.lit(False))
    whole = placed.where("txn is not null").groupBy("txn").agg((F.count_if(~F.col("is_held")) >= F.max("txn_size")).alias("whole"), (F.count(F.lit(1)) >= F.max("txn_size")).alias("there"))
    partial = placed.join(whole, "txn", "left").withColumn("is_partial", ~F.coalesce("there", F.lit(True)))
    return partial.withColumn("is_held", F.col("is_held") | ~F.coalesce("whole", F.lit(True))).drop("whole", "there")


@F.pandas_udf(T.LongType())
def _first_bit(bitmaps: pd.Series) -> pd.Series:
    return pd.Series([int(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little"))[0]) for b in bitmaps], dtype="int64")


@F.pandas_udf(T.LongType())
def _hole_after(bitmaps: pd.Series, start: pd.Series) -> pd.Series:
    """First unset bit at or after ``start``; BLOCK if there is none."""
    out = []
    for raw, s in zip(bitmaps, start):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        holes = np.flatnonzero(bits[int(s) :] == 0)
        out.append(int(s) + int(holes[0]) if len(holes) else BLOCK)
    return pd.Series(out, dtype="int64")


def watermarks(changes: DataFrame) -> DataFrame:
    """Per partition: ``committed``, the last offset of the contiguous prefix, and ``last_seen``."""
    pos = F.col("kafka_offset").cast("long")
    blocks = (
        changes.where(pos.isNotNull() & (pos >= 0))
        .select(F.coalesce("kafka_partition", F.lit(-1)).alias("part"), F.floor(pos / BLOCK).alias("block"), F.expr("bitmap_bit_position(cast(kafka_offset % 32768 as bigint) + 1)").alias("bit"), pos.alias("pos"))
        .groupBy("part", "block")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"), F.max("pos").alias("hi"))
    )
    w = Window.partitionBy("part").orderBy("block")
    # where this block starts in the sequence: its first bit if it is the first block, else 0
    marked = blocks.withColumn("prev", F.lag("block").over(w)).withColumn("start", F.when(F.col("prev").isNull(), _first_bit("bits")).otherwise(F.lit(0)))
    marked = marked.withColumn("hole", _hole_after("bits", "start"))
    broken = (F.col("hole") < BLOCK) | (F.lead("block").over(w) != F.col("block") + 1) | F.lead("block").over(w).isNull()
    ends = marked.withColumn("ends", broken)
    first_end = F.min(F.when(F.col("ends"), F.struct("block", "hole", "start")))
    return (
        ends.groupBy("part")
        .agg(first_end.alias("e"), F.max("hi").alias("last_seen"))
        .select("part", (F.col("e.block") * BLOCK + F.col("e.hole") - 1).alias("committed"), "last_seen")
    )


@dataclass(frozen=True)
class Replay:
    """``state``: one row per key of the feed or the base; ``held``: changes not applied."""

    state: DataFrame
    held: DataFrame
    marks: DataFrame


def replay(changes: DataFrame, base: DataFrame, feed_complete: bool = False) -> Replay:
    """Apply ``changes`` to ``base`` (review_id, updated_at, created_at, event_hash).

    ``state`` has review_id, event_hash, deleted, in_feed, t; take
    ``not deleted`` for the current table.
    """
    marks = watermarks(changes)
    placed = held_back(changes, marks)
    waits = F.col("is_partial" if feed_complete else "is_held")
    live = placed.where(~waits)
    versions = live.select("key", F.struct("t", F.lit(1).alias("from_feed"), "pos", "change", (F.col("kind") == "delete").alias("gone")).alias("v"))
    rows = base.select(
        key_form(F.col("review_id")).alias("key"), F.struct(event_time().alias("t"), F.lit(0).alias("from_feed"), F.lit(-1).cast("long").alias("pos"), F.lower(F.trim("event_hash")).alias("change"), F.lit(False).alias("gone")).alias("v")
    ).where("key is not null")
    state = (
        versions.unionByName(rows)
        .groupBy("key")
        .agg(F.max("v").alias("v"), F.max("v.from_feed").alias("in_feed"))
        .select(F.col("key").alias("review_id"), F.col("v.change").alias("event_hash"), F.col("v.gone").alias("deleted"), (F.col("in_feed") == 1).alias("in_feed"), F.col("v.t").alias("t"))
    )
    held = placed.where(waits).select("change", "txn", F.col("key").alias("review_id"), "kind", "part", "pos", "committed")
    return Replay(state, held, marks)
