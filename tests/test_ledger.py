import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import ledger as L
from millrace.streaming import leases as SL

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
CLAIM, RENEW, COMMIT, FAIL, CANCEL = (
    "LEASE_CLAIMED", "LEASE_RENEWED", "COMMIT_OFFERED", "TASK_ATTEMPT_FAILED", "TASK_CANCELLED",
)


def ledger(spark, *rows, task="t"):
    """Rows: (type, seconds, lease[, valid])."""
    data = [
        (i, "j", task, "node-" + (r[2] or "x"), r[2], r[0], T0 + timedelta(seconds=r[1]), r[3] if len(r) > 3 else True)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, schemas.LEDGER)


def tasks(spark, max_attempts=3, lease=60.0, names=("t",)):
    return spark.createDataFrame([("j", n, max_attempts, lease) for n in names], schemas.TASKS)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def state(spark, events, as_of, **kw):
    t = tasks(spark, **kw)
    leased = L.leases(events, t, at(as_of))
    return L.task_states(leased, t, at(as_of), events).first()


def test_renewal_moves_the_deadline(spark):
    events = ledger(spark, (CLAIM, 0, "a"), (RENEW, 30, "a"), (COMMIT, 40, "a"))
    d = L.deadlines(events, tasks(spark)).select(F.unix_seconds("deadline").alias("d")).first()["d"]
    assert d == T0.timestamp() + 90
    assert state(spark, events, 1000)["state"] == "COMPLETED"
    assert state(spark, events, 35)["state"] == "LEASED"


def test_expiry_boundary_and_late_renewal(spark):
    events = ledger(spark, (CLAIM, 0, "a"), (RENEW, 60, "a"))
    assert state(spark, events, 59)["state"] == "LEASED"
    assert state(spark, events, 60)["state"] == "PENDING"
    assert state(spark, events, 61)["state"] == "PENDING"


def test_slow_worker_loses_to_its_successor(spark):
    events = ledger(spark, (CLAIM, 0, "a"), (CLAIM, 61, "b"), (COMMIT, 71, "b"), (COMMIT, 81, "a"))
    judged = L.judged_leases(events, tasks(spark), at(100))
    rows = {r["lease_id"]: r for r in L.commits(events, judged).collect()}
    assert rows["b"]["accepted"] and rows["b"]["reason"] is None
    assert not rows["a"]["accepted"] and rows["a"]["reason"] == "duplicate"
    outcome = {r["lease_id"]: (r["attempt_number"], r["outcome"]) for r in L.attempts(L.leases(events, tasks(spark), at(100))).collect()}
    assert outcome == {"a": (1, "rejected"), "b": (2, "committed")}
    rec = L.recoveries(L.leases(events, tasks(spark), at(100))).first()
    assert (rec["mttd_s"], rec["mttr_s"], rec["dead_node"]) == (61.0, 10.0, "node-a")


def test_second_commit_and_invalid_output(spark):
    events = ledger(spark, (CLAIM, 0, "a"), (COMMIT, 1, "a", False), (CLAIM, 2, "b"), (COMMIT, 3, "b"), (COMMIT, 4, "b"))
    judged = L.judged_leases(events, tasks(spark), at(100))
    reasons = [r["reason"] for r in L.commits(events, judged).orderBy("seq").collect()]
    assert reasons == ["invalid_output", None, "duplicate"]


def test_attempts_run_out(spark):
    one = [(CLAIM, 0, "a"), (FAIL, 5, "a")]
    two = one + [(CLAIM, 6, "b"), (FAIL, 9, "b")]
    assert state(spark, ledger(spark, *one), 20, max_attempts=2)["state"] == "PENDING"
    assert state(spark, ledger(spark, *two), 20, max_attempts=2)["state"] == "FAILED"
    late = two + [(CLAIM, 30, "c"), (COMMIT, 31, "c")]
    assert state(spark, ledger(spark, *late), 40, max_attempts=2)["state"] == "FAILED"


def test_cancel_is_final(spark):
    events = ledger(spark, (CLAIM, 0, "a"), (CANCEL, 5, None), (COMMIT, 6, "a"))
    assert state(spark, events, 20)["state"] == "CANCELLED"
    assert state(spark, ledger(spark, (CANCEL, 5, None)), 20)["state"] == "CANCELLED"
    done = ledger(spark, (CLAIM, 0, "a"), (COMMIT, 4, "a"), (CANCEL, 5, None))
    assert state(spark, done, 20)["state"] == "COMPLETED"


def test_job_state_order(spark):
    def job(*states):
        df = spark.createDataFrame([("j", s) for s in states], "job_id string, state string")
        return L.job_states(df).first()["state"]

    assert job("COMPLETED", "PENDING") == "RUNNING"
    assert job("COMPLETED", "FAILED", "LEASED") == "RUNNING"
    assert job("COMPLETED", "FAILED") == "FAILED"
    assert job("COMPLETED", "COMPLETED") == "SUCCEEDED"
    assert job("COMPLETED", "CANCELLED") == "CANCELLED"


def test_node_view_online_limit(spark):
    regs = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    beats = spark.createDataFrame([("a", at(0)), ("b", at(6))], "node_id string, ts timestamp")
    none = spark.createDataFrame([], "node_id string, accepted boolean")
    view = {r["node_id"]: r["online"] for r in L.node_view(regs, beats, none, at(15)).collect()}
    assert view == {"a": False, "b": True, "c": False}


def test_fold_events_keeps_bad_rows_apart(spark):
    events = ledger(spark, (CLAIM, 0, "a"))
    reported = spark.createDataFrame(
        [("j", "ITERATION_COMPLETED", T0), (None, "ITERATION_COMPLETED", T0), ("j", "NONSENSE", T0)],
        "job_id string, type string, ts timestamp",
    )
    both, bad = L.fold_events(events, reported, schemas.EVENT_TYPES)
    assert both.count() == 2 and bad.count() == 2


def random_ledger(spark, seed, names):
    rnd = random.Random(seed)
    rows, seq = [], 0
    for t in names:
        ts, lease, count = 0.0, None, 0
        for _ in range(rnd.randrange(1, 14)):
            ts += rnd.choice([1, 5, 20, 59, 60, 61, 100])
            kind = rnd.choice([CLAIM, CLAIM, RENEW, RENEW, COMMIT, FAIL])
            if kind == CLAIM:
                count += 1
                lease = f"{t}-{count}"
            old = f"{t}-{rnd.randrange(1, count + 1)}" if count and rnd.random() < 0.2 else lease
            name = lease if kind == CLAIM else old
            rows.append((seq, "j", t, f"n{seq % 5}", name, kind, T0 + timedelta(seconds=ts), rnd.random() < 0.8))
            seq += 1
    return spark.createDataFrame(rows, schemas.LEDGER)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_agree(spark, tmp_path, seed):
    """Rows shuffled over five batches, late by up to two minutes, then the end."""
    names = [f"t{i}" for i in range(40)]
    events, dims = random_ledger(spark, seed, names), tasks(spark, 3, 60.0, names)
    src, store = str(tmp_path / "ledger"), str(tmp_path / "store")
    rows = sorted(events.collect(), key=lambda r: (r["ts"].timestamp() + random.Random(r["seq"]).randrange(120)))
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        random.Random(seed).shuffle(part)
        spark.createDataFrame(part, schemas.LEDGER).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    early = SL.run_leases(stream, dims, store, 120.0).collect()
    out = SL.finish(spark, dims, store, at(100_000)).persist()
    assert early and set(early) <= set(out.collect()) and out.distinct().count() == out.count()
    judged = L.judged_leases(events, dims, at(100_000))
    batch = {(r["seq"], r["accepted"], r["reason"]) for r in L.commits(events, judged).collect()}
    live = {(r["seq"], r["accepted"], r["reason"]) for r in SL.stream_commits(out).collect()}
    assert batch == live
    leased = L.leases(events, dims, at(100_000))
    claims = {(r["lease_id"], r["attempt"]) for r in leased.collect()}
    assert claims == {(r["lease_id"], r["attempt"]) for r in out.filter("type = 'LEASE_CLAIMED'").collect()}
    ended = {r["task_id"]: r["state"] for r in L.task_states(leased, dims, at(100_000)).collect()}
    for kind, state in SL.TERMINAL.items():
        done = {r["task_id"] for r in out.filter(F.col("type") == kind).collect()}
        assert done == {t for t, s in ended.items() if s == state}
    states = {r["state"] for r in SL.job_states(spark, store).collect()}
    assert not states or "FAILED" in states


def test_a_renewal_of_a_later_batch_counts(spark, tmp_path):
    src, store, dims = str(tmp_path / "in"), str(tmp_path / "out"), tasks(spark, 3, 60.0)
    first = ledger(spark, (CLAIM, 0, "a"), (COMMIT, 100, "a"))
    first.write.parquet(src)
    run = lambda: SL.run_leases(spark.readStream.schema(first.schema).parquet(src), dims, store, 3600.0)
    assert run().count() == 0
    ledger(spark, (RENEW, 50, "a")).write.mode("append").parquet(src)
    run()
    kinds = [r["type"] for r in SL.finish(spark, dims, store, at(200)).orderBy("ts_us").collect()]
    assert kinds == [CLAIM, RENEW, "TASK_COMMIT_ACCEPTED"]
    assert SL.job_states(spark, store).collect()[0]["state"] == "SUCCEEDED"


def test_stream_restarts_from_its_progress_and_times_out(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "out")
    dims = tasks(spark, 1, 60.0, ["t", "u"])
    first = ledger(spark, (CLAIM, 0, "a"))
    first.write.parquet(src)
    run = lambda: SL.run_leases(spark.readStream.schema(first.schema).parquet(src), dims, store, 0.0)
    kinds = lambda df: [r["type"] for r in df.filter("task_id = 't'").orderBy("ts_us", "type").collect()]
    assert kinds(run()) == [CLAIM]
    # Another task's event moves the clock; nothing more is heard from t.
    ledger(spark, (CLAIM, 500, "b"), task="u").write.mode("append").parquet(src)
    assert kinds(run()) == [CLAIM, "LEASE_EXPIRED", "TASK_EXHAUSTED"]
