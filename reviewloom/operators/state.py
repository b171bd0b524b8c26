"""State operators: first copy, pending, stale, late, newest per key, merge, marts' inputs.

Everything is a DataFrame-to-DataFrame function; the order of events is
``seq_cols`` (a total order ends in a unique column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, seq_cols: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key: insert, and do nothing on conflict. Combined map-side."""
    rest = [c for c in keep if c not in (key, *seq_cols)]
    return df.groupBy(key).agg(F.min(F.struct(*seq_cols, *rest)).alias("f")).select(key, "f.*")


def pending(bronze: DataFrame, processed: DataFrame, key: str = "event_hash") -> DataFrame:
    """Rows whose key has no outcome yet."""
    return bronze.join(processed.select(key).distinct(), key, "left_anti")


def with_stale(events: DataFrame, silver: DataFrame | None, key: str, version: str, seq_cols: list[str]) -> DataFrame:
    """``is_stale``: an earlier event of the key, or the stored row, has a greater version. Equal versions win."""
    earlier = Window.partitionBy(key).orderBy(*seq_cols).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.max(version).over(earlier)
    if silver is not None:
        events = events.join(silver.select(key, F.col(version).alias("_stored")), key, "left")
        prior = F.greatest(prior, F.col("_stored"))
    out = events.withColumn("is_stale", F.coalesce(prior > F.col(version), F.lit(False)))
    return out.drop("_stored") if silver is not None else out


def with_late_vs_running_max(events: DataFrame, time: str, arrived: str, seq_cols: list[str], hours: int = 24, seed: Column | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """``is_late``: older than the greatest earlier event time by more than ``hours``.

    The running maximum has no key. It is taken in two levels: over one row per
    arrival bucket, then inside each bucket, so no task holds all events.
    """
    bucketed = events.withColumn("_b", F.floor(F.unix_timestamp(arrived) / bucket_seconds))
    per = bucketed.groupBy("_b").agg(F.max(time).alias("_m"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per hour of arrival
    start = F.max("_m").over(before)
    carried = per.select("_b", (F.greatest(start, seed) if seed is not None else start).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(*seq_cols).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(carried, "_b").withColumn("_prior", F.greatest(F.max(time).over(inside), F.col("_start")))
    return out.withColumn("is_late", F.coalesce(F.col(time) < F.col("_prior") - F.expr(f"interval {hours} hours"), F.lit(False))).drop("_b", "_start", "_prior")


def with_late_vs_broker(events: DataFrame, time: str = "created_at", broker: str = "timestamp", hours: int = 24) -> DataFrame:
    """``is_late``: the event is older than its broker time by more than ``hours``; nothing is dropped."""
    return events.withColumn("is_late", F.col(time) < F.col(broker) - F.expr(f"interval {hours} hours"))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key by ``order``, all columns; a maximum combined map-side, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in (key, *order)]
    top = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("t"))
    return top.select(key, "t.*").select(*df.columns)


def merge_newest(target: DataFrame, source: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """Conditional merge: a source row replaces the stored one if its version is not older; new keys are inserted."""
    tagged = target.withColumn("_src", F.lit(0)).unionByName(source.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(tagged, key, [version, "_src", tie]).drop("_src")


def replace_children(children: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Delete the children of the changed keys and insert the fresh ones."""
    return children.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def incremental(existing: DataFrame, arriving: DataFrame, key: str, version: str) -> DataFrame:
    """Delete and insert the arriving rows that are not older than the newest stored version."""
    newest = existing.agg(F.coalesce(F.max(version), F.expr("timestamp'1900-01-01'")).alias("_w"))
    taken = arriving.join(F.broadcast(newest), F.col(version) >= F.col("_w")).drop("_w")
    return replace_children(existing, taken, taken, key)
