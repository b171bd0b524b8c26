"""Late and out-of-order events: conflict-free counters per period.

Every record is a *dot* of one replica. A replica is one writer's share of one
group (period, product, source): the consumer partition that first ingested the
record, cut by the message's hash into SHARDS so that no replica of a hot group
grows with it. The state of a replica is a sequence-tracked version
``(seq, n, rated, rating_sum, late_n, beyond_n)`` whose fields only grow.

1. *Publish.* With each ingest batch (UTC day of ingestion) every replica that
   the batch touched publishes its state. A batch that only redelivers messages
   publishes the version of before once more.
2. *Merge.* Two states of one replica merge by taking the larger ``seq``; the
   value of a group is the sum over its replicas. Both steps are idempotent,
   commutative and associative: a retried or reordered batch changes nothing.
3. *Correct.* What a merge adds to ``late_n`` or ``beyond_n`` of a replica is a
   correction; the records behind it are the late dots of that replica and batch.

A record reaches its replica when *any* delivery of its message was first
ingested; ``min`` over the deliveries is the merge of that register.

* up to ``late_after`` after the event: on time;
* later, but within ``cutoff``: the group's counters are corrected;
* beyond ``cutoff``: kept apart in ``beyond`` and not counted.

Defined cases: a record without key, event time or message is ``unplaced``; a
record loaded twice counts once; a null rating counts as a review but not in
the mean; null product or source form a group of their own; an ingest time
before the event time (a device clock ahead) is on time; the period is the UTC
day of the event time. Two records of one message count as two reviews.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one ingest window, within which running values are taken apart from other windows.
WINDOW_SECONDS = 900
#: Parts of one writer's share of a group.
SHARDS = 16
GROUP = ["period", "product_id", "source"]
REPLICA = [*GROUP, "writer", "shard"]
STATE = ["seq", "n", "rated", "rating_sum", "late_n", "beyond_n"]


def message_key(payload: Column) -> Column:
    """The identity of a message: the SHA-256 of its bytes (32 bytes; null for a null payload)."""
    return F.unhex(F.sha2(payload.cast("binary"), 256))


def first_ingest(deliveries: DataFrame) -> DataFrame:
    """One row per message: the merged register of its earliest delivery.

    ``deliveries`` has payload_json, ingested_at, kafka_partition. The minimum is
    taken map-side first, so a message delivered any number of times moves one
    row per map task.
    """
    return (
        deliveries.where(F.col("payload_json").isNotNull() & F.col("ingested_at").isNotNull())
        .select(message_key(F.col("payload_json")).alias("_key"), "ingested_at", F.coalesce("kafka_partition", F.lit(-1)).alias("_writer"))
        .groupBy("_key")
        .agg(F.min(F.struct("ingested_at", "_writer")).alias("_first"), F.max("ingested_at").alias("_last"))
        .select("_key", F.col("_first.ingested_at").alias("first_ingested_at"), F.col("_first._writer").alias("writer"), F.col("_last").alias("last_ingested_at"))
    )


@dataclass(frozen=True)
class LateCounters:
    """The outputs of :func:`late_counters`; all are lazy."""

    dots: DataFrame
    late_after: str
    cutoff: str

    @property
    def beyond(self) -> DataFrame:
        """Records past the cut-off, kept apart."""
        return self.dots.where(F.col("outcome") == "too_late")

    @property
    def corrections(self) -> DataFrame:
        """Records that arrived late but within the cut-off."""
        return self.dots.where(F.col("outcome") == "corrects")

    def published(self) -> DataFrame:
        """The states that the replicas publish, one row per replica and batch that touched it.

        The dots of a batch are counted map-side first; the running sums go over
        the batches of one replica, not over its dots.
        """
        new = F.struct(F.to_date("first_ingested_at").alias("batch"), F.lit(1).alias("w"))
        again = F.when(F.to_date("last_ingested_at") > F.to_date("first_ingested_at"), F.struct(F.to_date("last_ingested_at").alias("batch"), F.lit(0).alias("w")))
        touched = self.dots.withColumn("_t", F.explode(F.array_compact(F.array(new, again)))).withColumn("batch", F.col("_t.batch")).withColumn("_w", F.col("_t.w") == 1)
        counted = F.col("_w") & (F.col("outcome") != "too_late")
        step = touched.groupBy(*REPLICA, "batch").agg(
            F.count_if("_w").alias("seq"),
            F.count_if(counted).alias("n"),
            F.count_if(counted & F.col("rating").isNotNull()).alias("rated"),
            F.coalesce(F.sum(F.when(counted, F.col("rating").cast("long"))), F.lit(0)).alias("rating_sum"),
            F.count_if(counted & (F.col("outcome") == "corrects")).alias("late_n"),
            F.count_if(F.col("_w") & (F.col("outcome") == "too_late")).alias("beyond_n"),
        )
        upto = Window.partitionBy(*REPLICA).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
        return step.select(*REPLICA, "batch", *[F.sum(c).over(upto).alias(c) for c in STATE])

    def totals(self) -> DataFrame:
        """The group values as they finally stand: all published states merged, then the sum over the replicas."""
        return merge_states(self.published()).where("reviews > 0")

    def late_dots(self) -> DataFrame:
        """The records behind the corrections that the merges make: late within the cut-off, and beyond it."""
        steps = corrections_of(self.published()).where("late_step > 0 or beyond_step > 0").alias("s")
        late = self.dots.where(F.col("outcome") != "on_time").withColumn("batch", F.to_date("first_ingested_at")).alias("d")
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*REPLICA, "batch")]
        grown = F.when(F.col("d.outcome") == "corrects", F.col("s.late_step")).otherwise(F.col("s.beyond_step")) > 0
        return late.join(steps, same).where(grown).select("d.*")

    def history(self) -> DataFrame:
        """One row per correcting record: the group's values right after it.

        Three levels: the states of a group's ingest windows are prefix-summed
        (few rows, whatever the number of records), then those of the seconds of
        a window, and dots only inside one second.
        """
        counted = self.dots.where(F.col("outcome") != "too_late").withColumn("ingest_second", F.unix_seconds("first_ingested_at"))
        sums = ["n", "rated", "sum"]
        seconds = counted.groupBy(*GROUP, "ingest_window", "ingest_second").agg(
            F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.coalesce(F.sum(F.col("rating").cast("long")), F.lit(0)).alias("sum"), F.max((F.col("outcome") == "corrects").cast("int")).alias("late")
        )
        windows = seconds.groupBy(*GROUP, "ingest_window").agg(*[F.sum(c).alias(c) for c in sums], F.max("late").alias("late"))
        before = Window.partitionBy(*GROUP).orderBy("ingest_window").rowsBetween(Window.unboundedPreceding, -1)
        outer = windows.select(*GROUP, "ingest_window", "late", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in sums]).where("late = 1").drop("late")
        inside = Window.partitionBy(*GROUP, "ingest_window").orderBy("ingest_second").rowsBetween(Window.unboundedPreceding, -1)
        inner = seconds.select(*GROUP, "ingest_window", "ingest_second", "late", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"i_{c}") for c in sums]).where("late = 1").drop("late")
        same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
        at = (*GROUP, "ingest_window", "ingest_second")
        prefix = inner.alias("i").join(outer.alias("o"), same("i", "o", at[:-1])).select(*[F.col(f"i.{c}") for c in at], *[(F.col(f"i_{c}") + F.col(f"o_{c}")).alias(f"b_{c}") for c in sums])
        in_second = Window.partitionBy(*[F.col(f"d.{c}") for c in at]).orderBy("d.first_ingested_at", "d.review_id", "d._key").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.alias("d").join(prefix.alias("p"), same("p", "d", at))
        n = F.col("p.b_n") + F.count(F.lit(1)).over(in_second)
        rated = F.col("p.b_rated") + F.count("d.rating").over(in_second)
        total = F.col("p.b_sum") + F.coalesce(F.sum(F.col("d.rating").cast("long")).over(in_second), F.lit(0))
        return placed.select(
            *[F.col(f"d.{c}") for c in GROUP], F.col("d.review_id"), F.col("d.first_ingested_at"), F.col("d.outcome").alias("_o"), n.alias("reviews"), rated.alias("rated"), total.alias("rating_sum")
        ).where("_o = 'corrects'").drop("_o").withColumn("mean_rating", mean_of("rating_sum", "rated"))


def mean_of(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.round(F.col(total).cast("double") / F.col(n), 4))


def merge_replicas(states: DataFrame) -> DataFrame:
    """One state per replica, the largest version. ``states`` may hold any number of versions of a replica, in any order and repeated."""
    return states.groupBy(*REPLICA).agg(F.max(F.struct(*STATE)).alias("s")).select(*REPLICA, "s.*")


def merge_states(states: DataFrame) -> DataFrame:
    """The values of the groups: the largest version of each replica, then the sum over replicas."""
    return (
        merge_replicas(states)
        .groupBy(*GROUP)
        .agg(F.sum("n").alias("reviews"), F.sum("rated").alias("rated"), F.sum("rating_sum").alias("rating_sum"), F.sum("late_n").alias("late_reviews"))
        .withColumn("mean_rating", mean_of("rating_sum", "rated"))
    )


def corrections_of(states: DataFrame) -> DataFrame:
    """What the merge of each batch adds to the late counters of each replica (late_step, beyond_step).

    The merged state after a batch is the largest version published so far, so
    a version published again, or an older one that comes late, adds nothing.
    """
    upto = Window.partitionBy(*REPLICA).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    merged = states.groupBy(*REPLICA, "batch").agg(F.max(F.struct(*STATE)).alias("s")).withColumn("m", F.max("s").over(upto))
    last = F.lag("m").over(Window.partitionBy(*REPLICA).orderBy("batch"))
    step = lambda c: (F.col(f"m.{c}") - F.coalesce(last[c], F.lit(0))).alias(c.replace("_n", "_step"))
    return merged.select(*REPLICA, "batch", step("late_n"), step("beyond_n"))


def late_counters(records: DataFrame, deliveries: DataFrame, late_after: str = "24 hours", cutoff: str = "7 days") -> LateCounters:
    """Place every record in its replica and decide whether it is on time, corrects, or is too late.

    ``records``: review_id, product_id, source, rating, created_at, event_hash
    (hex); ``deliveries``: payload_json, ingested_at, kafka_partition. Other
    columns are ignored.
    """
    key = F.when(F.length(F.trim("event_hash")) == 64, F.unhex(F.lower(F.trim("event_hash"))))
    once = (
        records.select("review_id", "product_id", "source", "rating", "created_at", key.alias("_key"))
        .where(F.col("review_id").isNotNull() & F.col("created_at").isNotNull() & F.col("_key").isNotNull())
        .groupBy("_key", "review_id")
        .agg(F.max(F.struct("created_at", "product_id", "source", "rating")).alias("r"))
        .select("_key", "review_id", "r.*")
    )
    delay_over = lambda span: F.col("first_ingested_at") > F.col("created_at") + F.expr(f"interval {span}")
    dots = (
        once.join(first_ingest(deliveries), "_key")
        .withColumn("outcome", F.when(delay_over(cutoff), "too_late").when(delay_over(late_after), "corrects").otherwise("on_time"))
        .withColumn("period", F.to_date("created_at"))
        .withColumn("ingest_window", F.floor(F.unix_seconds("first_ingested_at") / WINDOW_SECONDS))
        .withColumn("shard", F.pmod(F.xxhash64("_key"), F.lit(SHARDS)).cast("int"))
    )
    return LateCounters(dots, late_after, cutoff)
