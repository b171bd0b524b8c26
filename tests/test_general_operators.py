import datetime as dt
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.functions.bitmaps import Bitmap
from reviewloom.operators import change_replay as cr
from reviewloom.operators import message_store as ms
from reviewloom.operators import orphan_bitmaps as ob
from reviewloom.plans import data_problems

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
ids = st.sets(st.one_of(st.integers(0, 300), st.integers(0, 400_000)), max_size=200)


@settings(max_examples=150, deadline=None)
@given(ids, ids)
def test_bitmaps_are_sets(a, b):
    x, y = Bitmap.of(np.array(list(a))), Bitmap.of(np.array(list(b)))
    assert set(x.and_not(y).decode().tolist()) == a - b
    assert set((x | y).decode().tolist()) == a | b
    assert len(x) == len(a)


def test_dense_bitmaps():
    x, y = Bitmap.of(np.arange(0, 70_000)), Bitmap.of(np.arange(0, 70_000, 2))
    assert x.and_not(y).decode().tolist() == list(range(1, 70_000, 2))
    assert (y | x).decode().tolist() == list(range(70_000)) and x.nbytes() < 20_000


DEL = "delivery_id bigint, payload_json string, ingested_at timestamp, msg_key string"


def test_message_store(spark):
    rows = [(1, "a", T0, "x"), (2, "a", T0 - dt.timedelta(hours=1), None), (3, "b", None, None), (4, "b", T0, None), (5, None, T0, None), (6, "c", T0, None), (7, "c", T0, None)]
    store = ms.MessageStore(spark)
    df = spark.createDataFrame(rows, DEL)
    store.upsert(df.where("delivery_id in (1, 3, 7)"))
    store.upsert(df)
    store.upsert(df)  # a retry
    kept = store.compact()
    assert {r["delivery_id"] for r in kept.collect()} == {2, 4, 6}
    assert {r[0] for r in ms.surplus_deliveries(df, kept).collect()} == {1, 3, 7}
    assert {r["delivery_id"] for r in ms.one_copy_each(df, kept).collect()} == {2, 4, 6}
    store.upsert(spark.createDataFrame([(8, "a", T0 - dt.timedelta(days=1), None)], DEL))
    assert {r["delivery_id"] for r in store.compact().collect()} == {8, 4, 6}


def test_message_store_merges_without_a_shuffle(spark):
    store = ms.MessageStore(spark, buckets=4)
    store.upsert(spark.createDataFrame([(i, str(i % 9), T0, None) for i in range(50)], DEL))
    plan = ms._keep(spark.table(store._table(0)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert store.compact().count() == 9


def test_message_store_is_reopened_by_its_path(spark, tmp_path):
    path = str(tmp_path / "store")
    first = ms.MessageStore(spark, path, buckets=3)
    first.upsert(spark.createDataFrame([(i, str(i % 9), T0, None) for i in range(50)], DEL))
    first.compact()
    other = spark.newSession()  # a catalog of its own would not know the tables
    for v in (0, 1):
        spark.sql(f"drop table if exists {first._name}_v{v}")
    again = ms.MessageStore(other, path, buckets=7)
    assert (again.buckets, again.version, again.kept().count()) == (3, 1, 9)
    again.upsert(other.createDataFrame([(99, "3", T0 - dt.timedelta(hours=1), None), (98, "new", T0, None)], DEL))
    kept = {r["delivery_id"] for r in again.compact().collect()}
    assert len(kept) == 10 and {99, 98} <= kept and 3 not in kept
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("v")) == ["v1", "v2"]


def test_message_store_empty(spark):
    store = ms.MessageStore(spark)
    store.upsert(spark.createDataFrame([], DEL))
    assert store.compact().count() == 0


CH = "op string, review_id string, created_at timestamp, updated_at timestamp, event_hash string, kafka_partition int, kafka_offset bigint, arrived_at timestamp"
BASE = "review_id string, created_at timestamp, updated_at timestamp, event_hash string, op string"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def test_replay(spark):
    changes = [
        ("insert", "A", at(0), None, "a1", 0, 1), ("U ", " a ", at(0), at(5), "a2", 0, 2), ("update", "a", at(0), at(3), "a0", 0, 3), ("update", "a", at(0), at(5), "a2", 0, 4),
        ("delete", "b", None, at(9), "b1", 1, 1), ("update", "b", at(0), at(4), "b0", 1, 2), ("update", "c", at(0), at(4), "c1", 1, 3), ("D", "c", None, at(4), "c2", 1, 4),
        ("update", "d", at(0), at(1), "d1", 1, 5), ("noop", "e", at(0), at(1), "e1", 1, 6), ("update", None, at(0), at(1), "f1", 1, 7), ("update", "g", None, None, "g1", 1, 8),
    ]
    base = [("b", at(0), at(1), "b_base", None), ("d", at(0), at(2), "d_base", None), ("d", at(0), at(2), "d_base", None), ("z", at(0), at(2), "z", None)]
    done = cr.replay(spark.createDataFrame([(*c, T0) for c in changes], CH), spark.createDataFrame(base, BASE))
    state = {r["review_id"]: r for r in done.state.collect()}
    now = {k: r["event_hash"] for k, r in state.items() if r["in_feed"] and not r["deleted"]}
    assert now == {"a": "a2", "d": "d_base", "g": "g1"}
    assert state["b"]["deleted"] and state["c"]["deleted"] and not state["z"]["in_feed"]


def test_replay_matches_a_loop_in_any_order(spark):
    rnd = random.Random(5)
    for _ in range(4):
        log = [(rnd.choice(["insert", "update", "delete"]), f"k{rnd.randint(0, 5)}", at(0), at(rnd.randint(0, 6)), f"e{i}", 0, i) for i in range(60)]
        best = {}
        for op, key, _c, u, e, _p, o in log:
            if key not in best or (u, o) >= best[key][:2]:
                best[key] = (u, o, e, op == "delete")
        shuffled = log + rnd.sample(log, 20)
        rnd.shuffle(shuffled)
        got = cr.replay(spark.createDataFrame([(*c, T0) for c in shuffled], CH), spark.createDataFrame([], BASE)).state  # offsets without a gap
        assert {r["review_id"]: (r["event_hash"], r["deleted"]) for r in got.collect()} == {k: (v[2], v[3]) for k, v in best.items()}


def test_gaps_are_held(spark):
    offsets = [100, 101, 102, 104, 105, 101]
    changes = spark.createDataFrame([("update", f"k{o}", at(0), at(1), f"e{o}", 0, o, T0) for o in offsets] + [("update", "m", at(0), at(1), "m", 1, 65_535, T0), ("update", "n", at(0), at(1), "n", 1, 65_536, T0)], CH)
    marks = {r["part"]: (r["committed"], r["last_seen"]) for r in cr.watermarks(changes).collect()}
    assert marks == {0: (102, 105), 1: (65_536, 65_536)}
    open_feed = cr.replay(changes, spark.createDataFrame([], BASE), feed_complete=False)
    assert {r["review_id"] for r in open_feed.state.collect()} == {"k100", "k101", "k102", "m", "n"}
    assert {r["change"] for r in open_feed.held.collect()} == {"e104", "e105"}
    assert cr.replay(changes, spark.createDataFrame([], BASE), feed_complete=True).state.count() == 7


def test_transactions_are_applied_whole(spark):
    cols = CH + ", txn string, txn_size int"
    rows = [("update", "a", at(0), at(1), "a1", 0, 1, T0, "t1", 2), ("update", "b", at(0), at(1), "b1", 0, 2, T0, "t1", 2), ("update", "b", at(0), at(1), "b1", 0, 2, T0, "t1", 2), ("update", "c", at(0), at(1), "c1", 0, 3, T0, "t2", 3), ("update", "d", at(0), at(1), "d1", 0, 4, T0, "t2", 3),
            ("update", "e", at(0), at(1), "e1", 0, 5, T0, "t3", 2), ("update", "f", at(0), at(1), "f1", 0, 7, T0, "t3", 2), ("update", "g", at(0), at(1), "g1", 0, 5, T0, None, None)]
    done = cr.replay(spark.createDataFrame(rows, cols), spark.createDataFrame([], BASE))
    assert {r["review_id"] for r in done.state.collect()} == {"a", "b", "g"}
    assert {r["change"] for r in done.held.collect()} == {"c1", "d1", "e1", "f1"}


def test_a_complete_feed_applies_no_part_of_a_transaction(spark):
    cols = CH + ", txn string, txn_size int"
    rows = [("update", "a", at(0), at(1), "a1", 0, 1, T0, "t1", 2), ("update", "b", at(0), at(1), "b1", 0, 9, T0, "t1", 2), ("update", "c", at(0), at(1), "c1", 0, 2, T0, "t2", 2), ("update", "d", at(0), at(1), "d1", 0, 12, T0, None, None)]
    done = cr.replay(spark.createDataFrame(rows, cols), spark.createDataFrame([], BASE), feed_complete=True)
    assert {r["review_id"] for r in done.state.collect()} == {"a", "b", "d"}
    assert {r["change"] for r in done.held.collect()} == {"c1"}


def test_queries_apply_changes_behind_a_gap(spark, tmp_path):
    changes = [("insert", "a", at(0), None, "a1", 0, 1, T0), ("update", "b", at(0), at(5), "b1", 0, 9, T0), ("delete", "c", None, at(5), "c1", 0, 12, T0)]
    spark.createDataFrame(changes, CH).write.parquet(f"{tmp_path}/feedback_changes.parquet")
    spark.createDataFrame([("b", at(0), at(1), "b0", T0), ("c", at(0), at(1), "c0", T0)], "review_id string, created_at timestamp, updated_at timestamp, event_hash string, processed_at timestamp").write.parquet(f"{tmp_path}/silver_feedback.parquet")
    spark.createDataFrame([("a", T0, T0)], "review_id string, created_at timestamp, processed_at timestamp").write.parquet(f"{tmp_path}/stg_feedback.parquet")
    spark.createDataFrame([("c", "x", T0, at(9))], "review_id string, aspect string, created_at timestamp, processed_at timestamp").write.parquet(f"{tmp_path}/aspect_sentiment.parquet")
    assert {tuple(r) for r in data_problems.p5_found(spark, str(tmp_path)).collect()} == {("a", "a1"), ("b", "b1")}
    assert {(r["review_id"], r["reason"]) for r in data_problems.p6_found(spark, str(tmp_path)).collect()} == {("c", "deleted"), ("a", "missing")}


def test_replay_empty(spark):
    done = cr.replay(spark.createDataFrame([], CH), spark.createDataFrame([], BASE))
    assert done.state.count() == 0 and done.marks.count() == 0


def test_orphans(spark):
    child = spark.createDataFrame(
        [(" A ", "x", T0, at(1)), ("a", "y", T0, at(5)), ("b", "x", T0, at(1)), ("c", "x", T0, at(1)), ("c", "x", T0, at(1)), (None, "x", T0, at(1)), ("  ", "x", T0, at(1)), ("A\t", "z", T0, None), ("d", "x", T0, at(60)), ("e", "x", None, at(1))],
        "review_id string, aspect string, created_at timestamp, processed_at timestamp",
    )
    parent = spark.createDataFrame([("a", at(3)), ("A", at(4)), ("d", None), ("d", at(80)), (None, at(0))], "review_id string, processed_at timestamp")
    deleted = spark.createDataFrame([("b",), ("a",)], "key string")
    found = ob.find_orphans(ob.references(child, "review_id", "aspect", "processed_at", "created_at"), ob.parents(parent, "review_id", "processed_at"), deleted)
    assert {(r["key"], r["part"], r["reason"], r["rows"]) for r in found.collect()} == {("a", "x", "later", 1), ("b", "x", "deleted", 1), ("c", "x", "missing", 2), ("e", "x", "missing", 1)}
    report = ob.per_table_and_period({"t": found}).collect()
    assert sum(r["orphan_rows"] for r in report) == 5
    empty = ob.find_orphans(ob.references(child.limit(0), "review_id", None, None, "created_at"), ob.parents(parent.limit(0), "review_id", None))
    assert empty.count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 4 * 24)), max_size=30), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 4 * 24)), max_size=12))
def test_orphans_in_a_range_match_a_loop(refs, known):
    hour = 3_600_000_000
    r = pd.DataFrame([(f"k{k}", "", None, t * hour, 1) for k, t in refs], columns=["key", "part", "period", "made", "rows"])
    first = {}
    for k, t in known:
        first[k] = min(first.get(k, t), t)
    p = pd.DataFrame([(f"k{k}", t * hour) for k, t in first.items()], columns=["key", "first"])
    got = ob.orphans_in_range(r, p)
    want = [("k%d" % k, "later" if k in first else "missing") for k, t in refs if k not in first or first[k] > t]
    assert sorted(zip(got["key"], got["reason"])) == sorted(want)
