import datetime as dt
import json

import pytest

from reviewloom import cli, schemas
from reviewloom.functions import contract, sentiment
from reviewloom.functions.hashing import canonical_json
from reviewloom.operators import state
from reviewloom.pipeline import Lakehouse
from reviewloom.sources import files
from reviewloom.sources.store import SnapshotStore
from reviewloom.streaming import stream

EVENT = {"review_id": "r1", "product_id": "p", "rating": 4, "review_text": "The camera is excellent, but the battery drains quickly.", "source": "web", "created_at": "2026-09-15T10:00:00Z", "schema_version": 1}


def ev(**k):
    return json.dumps(EVENT | k)


def test_lenient_routing(spark):
    values = [ev(), ev(rating=8), json.dumps({k: v for k, v in EVENT.items() if k != "rating"}), ev(schema_version=2), ev(review_id=None), ev(created_at=None), "{this is not json", "{}", None]
    df = spark.createDataFrame([(v, 0, i, None) for i, v in enumerate(values)], schemas.RECORD)
    parsed = contract.parse_events(df)
    valid, invalid = contract.split(parsed)
    reasons = {r["offset"]: r["error_reason"] for r in invalid.collect()}
    assert valid.count() == 1 and len(reasons) == 8
    assert reasons == {1: "rating must be between 1 and 5", 2: "rating must be between 1 and 5", 3: "unsupported schema_version", 4: "review_id is required", 5: "created_at is required", 6: "payload is not valid JSON", 7: "review_id is required", 8: "payload is not valid JSON"}


def test_strict_contract(spark):
    cases = [(ev(), None), (ev(rating="4"), None), (ev(rating=4.0), None), (ev(rating=0), "rating"), (ev(rating=6), "rating"), (ev(rating=4.5), "rating"), (ev(extra=1), "unknown_field"), (ev(review_id="  "), "review_id"), (ev(review_text="ab"), "review_text"), (ev(created_at="2026-09-15T10:00:00"), "created_at"), (ev(updated_at="2026-09-14T10:00:00Z"), "updated_at"), (ev(schema_version=2), "schema_version"), (ev(customer_id_hash="x" * 129), "customer_id_hash"), ("[]", "not_an_object"), ("nope", "not_an_object"), (None, "not_an_object")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", contract.strict_reason(df["v"]).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_sentiment(spark):
    texts = ["The camera is excellent, but the battery drains quickly.", "Great value for the price. However the support agent was unhelpful; refund was slow!", "I bought it because the photos are great.", "The flag on the box was torn.", "", None, "Nothing relevant."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    flat = {(r["id"], r["aspect"]): (r["sentiment_score"], r["sentiment_label"]) for r in sentiment.best_per_aspect(df, "t", ["id"]).collect()}
    assert flat[0, "camera"] == (1.0, "positive") and flat[0, "battery"] == (-1.0, "negative")
    assert flat[1, "support"][1] == "negative" and (2, "usability") not in flat and (3, "performance") not in flat and flat[3, "packaging"] == (0.0, "neutral")
    alone = {(i, x["aspect"]): (x["sentiment_score"], x["sentiment_label"]) for i, t in enumerate(texts) for x in sentiment.score_aspects(t)}
    assert alone == flat
    inside = {(r["id"], x["aspect"]): (x["sentiment_score"], x["sentiment_label"]) for r in df.select("id", sentiment.aspect_array(df["t"]).alias("a")).collect() for x in r["a"]}
    assert inside == flat


def test_stale_and_late_match_a_loop(spark):
    import random

    rnd = random.Random(1)
    t0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, f"k{rnd.randint(0, 6)}", t0 + dt.timedelta(hours=rnd.randint(0, 90)), t0 + dt.timedelta(minutes=20 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "seq int, key string, t timestamp, arrived timestamp")
    stale = {r["seq"]: r["is_stale"] for r in state.with_stale(df, None, "key", "t", ["seq"]).collect()}
    late = {r["seq"]: r["is_late"] for r in state.with_late_vs_running_max(df, "t", "arrived", ["seq"]).collect()}
    best, top = {}, None
    for seq, key, t, _ in rows:
        assert stale[seq] == (key in best and best[key] > t)
        best[key] = max(best.get(key, t), t)
        assert late[seq] == (top is not None and t < top - dt.timedelta(hours=24))
        top = t if top is None else max(top, t)


def test_pipeline_and_cli(spark, tmp_path, capsys):
    rows = [ev(), ev(review_id="r2", created_at="2026-09-11T09:00:00Z", rating=2, review_text="The price is bad."), ev(review_id="r3", rating=8), ev(review_id="r1", updated_at="2026-09-16T10:00:00Z", rating=5), ev(review_id="r1", updated_at="2026-09-15T12:00:00Z", rating=1), ev()]
    src = tmp_path / "in.jsonl"
    src.write_text("\n".join(rows) + "\n\nnot json\n")
    house = Lakehouse(spark, str(tmp_path / "lake"))
    out = house.run(str(src))
    assert out["ingest"]["records_seen"] == 7 and out["ingest"]["inserted"] == 6
    assert out["transform"] == {"accepted": 3, "quarantined": 2, "stale_updates": 1}
    assert out["counts"] == {"files": 1, "bronze_events": 6, "silver_feedback": 2, "aspect_rows": 3, "quarantined_events": 2, "late_events": 1}
    silver = {r["review_id"]: r for r in house.table("silver").collect()}
    assert silver["r1"]["rating"] == 5 and silver["r2"]["is_late"]
    again = house.run(str(src))
    assert again["ingest"]["skipped"] and again["transform"]["accepted"] == 0 and again["counts"] == out["counts"]
    assert all(house.quality_checks().values())
    assert house.table("product_health_daily").count() == 2
    assert cli.main(["report", "--database", str(tmp_path / "lake")]) == 0
    assert json.loads(capsys.readouterr().out)["checks"]["no_orphan_aspects"]
    house.store.commit(append={"aspects": spark.createDataFrame([("ghost", "price", 1.0, "positive", "x", None)], house.table("aspects").schema)})
    assert cli.main(["report", "--database", str(tmp_path / "lake")]) == 1
    with pytest.raises(ValueError):
        files.kind_of("x.xml")


def test_csv_and_json_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('review_id,rating\nr1,4\n"r,2","5"\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["review_id", "rating"]).collect()
    assert [(r["review_id"], r["rating"]) for r in got] == [("r1", "4"), ("r,2", "5")]
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [json.loads(r["payload_json"]) for r in files.read_json(spark, str(tmp_path / "b.json")).collect()] == [{"a": 1}, {"a": 2}]
    assert canonical_json('{"b": "é", "a": 1.0}') == '{"a":1.0,"b":"\\u00e9"}' and canonical_json("x") is None
    assert schemas.contract_schema()["additionalProperties"] is False


def test_stream_and_replay(spark, tmp_path):
    ts = dt.datetime(2026, 9, 15, 10, 30, tzinfo=dt.timezone.utc)
    rows = [(ev(), 0, 1, ts), (ev(), 1, 5, ts), (ev() + " ", 0, 2, ts), (ev(review_id="r2", created_at="2026-09-01T00:00:00Z"), 0, 3, ts), (ev(review_id="r3", rating=0), 0, 4, ts), ("garbage", 0, 5, ts)]
    spark.createDataFrame(rows, schemas.RECORD).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "lake"))
    stream.run_to_end(stream.start(stream.file_source(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")))
    assert store.read("bronze").count() == 3
    silver = {r["review_id"]: r["is_late"] for r in store.read("silver").collect()}
    assert silver == {"r1": False, "r2": True}
    assert {r["error_reason"] for r in store.read("quarantine").collect()} == {"rating must be between 1 and 5", "payload is not valid JSON"}
    valid, _ = contract.split(contract.parse_events(spark.createDataFrame(rows, schemas.RECORD)))
    assert stream.process_valid(store, valid, 0) is False  # a replayed batch
    stream.process_valid(store, valid, 99)  # the same events in a new batch
    assert store.read("bronze").count() == 3
    assert store.compact("bronze") == 1 and store.read("bronze").count() == 3


def test_two_writers_lose_no_commit(spark, tmp_path):
    import threading

    store = SnapshotStore(spark, str(tmp_path / "lake"))
    frame = spark.createDataFrame([(1,)], "i int").coalesce(1)
    failed = []

    def write(writer):
        mine = SnapshotStore(spark, str(tmp_path / "lake"))
        try:
            for i in range(50):
                assert mine.commit(append={f"of_{writer}": frame, "both": frame}, writer=writer, batch_id=i)
                assert not mine.commit(append={"both": frame}, writer=writer, batch_id=i)
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    crew = [threading.Thread(target=write, args=(w,)) for w in ("a", "b")]
    for t in crew:
        t.start()
    for t in crew:
        t.join()
    assert not failed
    assert (len(store.parts("of_a")), len(store.parts("of_b")), len(store.parts("both"))) == (50, 50, 100)
    assert store.committed("a", 49) and store.committed("b", 49)


def test_compaction_keeps_what_is_appended_meanwhile(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "lake"))
    frame = spark.createDataFrame([(1,)], "i int").coalesce(1)
    for _ in range(3):
        store.commit(append={"t": frame})
    old = store.parts("t")
    store.commit(append={"t": frame})
    store.commit(replace={"t": store.read("t", parts=old)}, parts={"t": old})
    assert store.read("t").count() == 4 and len(store.parts("t")) == 2
    with pytest.raises(ValueError):
        store.commit(replace={"t": frame}, parts={"t": old})


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from reviewloom.session import shared_dir

    far = N(conf=N(get=lambda *a: None), sparkContext=N(getConf=lambda: N(get=lambda *a: None), getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(far)
