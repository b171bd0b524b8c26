import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from reviewloom.operators import late_counters as lc

T0 = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)
REC = "review_id string, product_id string, source string, rating int, created_at timestamp, event_hash string, extra string"
DEL = "payload_json string, ingested_at timestamp, kafka_partition int, review_id string"


def h(i):
    return hashlib.sha256(f"m{i}".encode()).hexdigest()


def frames(spark, delays, copies=1):
    recs = [(f"r{i}", "p", "web", None if i % 7 == 0 else 1 + i % 5, T0, h(i), "x") for i in range(len(delays))]
    dels = [(f"m{i}", T0 + dt.timedelta(hours=d + c), i % 3, "clash") for i, d in enumerate(delays) for c in range(copies)]
    return recs, dels


def test_outcomes_and_totals(spark):
    delays = [0, -2, 24, 24.1, 100, 168, 168.1, 400]
    recs, dels = frames(spark, delays, 3)
    dels += [(None, T0, 0, None), ("unknown", T0, 0, None)]
    recs += [recs[0], (None, "p", "web", 1, T0, h(0), None), ("n", "p", "web", 1, None, h(1), None), ("q", None, None, 3, T0, h(2).upper(), None)]
    c = lc.late_counters(spark.createDataFrame(recs, REC), spark.createDataFrame(dels, DEL))
    got = {r["review_id"]: r["outcome"] for r in c.dots.collect()}
    assert got == {"r0": "on_time", "r1": "on_time", "r2": "on_time", "r3": "corrects", "r4": "corrects", "r5": "corrects", "r6": "too_late", "r7": "too_late", "q": "on_time"}
    totals = {(r["product_id"], r["source"]): r for r in c.totals().collect()}
    assert totals["p", "web"]["reviews"] == 6 and totals["p", "web"]["late_reviews"] == 3 and totals["p", "web"]["rated"] == 5
    assert totals[None, None]["reviews"] == 1
    assert {r["review_id"] for r in c.beyond.collect()} == {"r6", "r7"}


def test_merge_is_idempotent_and_order_free(spark):
    """Batches merged one after the other into a kept state, shuffled and repeated, give the same values."""
    recs, dels = frames(spark, [0, 5, 30, 60, 90, 200, 31, 32, 33, 150], 2)
    c = lc.late_counters(spark.createDataFrame(recs, REC), spark.createDataFrame(dels, DEL))
    want = c.totals().collect()
    states = c.published().collect()
    days = sorted({r["batch"] for r in states})
    assert len(days) >= 4
    schema = c.published().schema
    random.seed(2)
    for _ in range(3):
        order = days + days[1:3]
        random.shuffle(order)
        kept = spark.createDataFrame([], schema).drop("batch")
        for day in order:
            arriving = spark.createDataFrame([r for r in states if r["batch"] == day], schema).drop("batch")
            kept = spark.createDataFrame(lc.merge_replicas(kept.unionByName(arriving)).collect(), kept.schema)
        assert lc.merge_states(kept).collect() == want
    assert want[0]["reviews"] == 9 and want[0]["late_reviews"] == 7


def test_redelivery_publishes_again_and_corrects_nothing(spark):
    recs, dels = frames(spark, [30, 400])
    dels += [("m0", T0 + dt.timedelta(days=9), 1, None), ("m1", T0 + dt.timedelta(days=30), 1, None)]
    c = lc.late_counters(spark.createDataFrame(recs, REC), spark.createDataFrame(dels, DEL))
    assert c.published().count() == 4
    steps = [(r["late_step"], r["beyond_step"]) for r in lc.corrections_of(c.published()).collect()]
    assert sorted(steps) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    assert {(r["review_id"], r["outcome"]) for r in c.late_dots().collect()} == {("r0", "corrects"), ("r1", "too_late")}
    again = lc.corrections_of(c.published().unionByName(c.published()))
    assert sorted((r["late_step"], r["beyond_step"]) for r in again.collect()) == sorted(steps)


def test_late_dots_are_all_late_records(spark):
    random.seed(5)
    recs, dels = frames(spark, [random.uniform(0, 300) for _ in range(60)], 2)
    c = lc.late_counters(spark.createDataFrame(recs, REC), spark.createDataFrame(dels, DEL))
    want = {(r["review_id"], r["outcome"]) for r in c.dots.where("outcome <> 'on_time'").collect()}
    assert {(r["review_id"], r["outcome"]) for r in c.late_dots().collect()} == want


def test_history_is_a_running_total(spark):
    random.seed(3)
    recs, dels = frames(spark, [random.uniform(0, 160) for _ in range(40)])
    rows = lc.late_counters(spark.createDataFrame(recs, REC), spark.createDataFrame(dels, DEL)).history().collect()
    first = {d[0]: d[1] for d in dels}
    order = sorted(recs, key=lambda r: first["m" + r[0][1:]])
    for r in rows:
        k = [x[0] for x in order].index(r["review_id"])
        assert r["reviews"] == k + 1
        assert r["rating_sum"] == sum(x[3] or 0 for x in order[: k + 1])


def test_empty(spark):
    c = lc.late_counters(spark.createDataFrame([], REC), spark.createDataFrame([], DEL))
    assert c.totals().count() == 0 and c.history().count() == 0 and c.late_dots().count() == 0
