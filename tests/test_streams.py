from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.streaming import keyed, windows
from millrace.streaming.runner import drain

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A folder that grows between runs of the same stream."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema = spark, schema
        self.src, self.base = str(tmp_path / "in"), str(tmp_path / "out")

    def run(self, operator, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.src)
        stream = self.spark.readStream.schema(self.schema).parquet(self.src)
        return drain(operator(stream), "x", self.base).collect()


def seconds(us):
    return us / 1e6 - T0.timestamp()


def test_silent_node_goes_offline_and_returns(spark, tmp_path):
    feed = Feed(spark, tmp_path, "node_id string, ts timestamp, pools array<string>")
    op = lambda s: keyed.node_liveness(s, 15.0, "10 seconds")
    feed.run(op, ("a", at(10), None), ("b", at(11), None))
    feed.run(op, ("a", at(5), ["p"]))
    feed.run(op, ("b", at(100), None))
    feed.run(op, ("a", at(200), ["q"]))
    rows = feed.run(op, ("b", at(300), None))
    mine = sorted((seconds(r["ts_us"]), r["change"], r["pools"]) for r in rows if r["node_id"] == "a")
    assert mine == [(5.0, "ONLINE", ["p"]), (25.0, "OFFLINE", ["p"]), (200.0, "ONLINE", ["q"]), (215.0, "OFFLINE", ["q"])]


def kinds(rows):
    return {(r["round"], r["key"]): r["kind"] for r in rows}


def test_round_closes_on_quorum_or_timeout(spark, tmp_path):
    feed = Feed(spark, tmp_path, "round bigint, key string, ts timestamp")
    op = lambda s: keyed.close_rounds(s, 2, 60.0, "0 seconds")
    feed.run(op, (1, "a", at(0)), (1, "b", at(5)), (1, "c", at(9)), (2, "a", at(0)))
    rows = feed.run(op, (3, "a", at(500)))
    assert kinds(rows)[(1, "a")] == kinds(rows)[(1, "b")] == "participant" and kinds(rows)[(1, "c")] == "late"
    assert kinds(rows)[(2, None)] == "quorum_not_met" and kinds(rows)[(2, "a")] == "participant"
    feed.run(op, (1, "d", at(501)), (2, "b", at(502)))
    late = kinds(feed.run(op, (3, "b", at(600))))
    assert late[(1, "d")] == late[(2, "b")] == "late"


def test_rounds_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rows = [(1, "a", at(0)), (1, "b", at(5)), (1, "c", at(9))]
    end = (9, "z", at(1000))
    for n, order in enumerate(([0, 1, 2], [2, 0, 1], [1, 2, 0])):
        feed = Feed(spark, tmp_path / str(n), "round bigint, key string, ts timestamp")
        op = lambda s: keyed.close_rounds(s, 2, 60.0, "30 seconds")
        for k in order:
            feed.run(op, rows[k])
        got = kinds(feed.run(op, end))
        assert [got[(1, k)] for k in "abc"] == ["participant", "participant", "late"]


def test_step_rate_carries_over_batches_in_any_order(spark, tmp_path):
    feed = Feed(spark, tmp_path, "run_id string, ts double, step bigint")
    op = lambda s: keyed.stream_step_rate(s, "30 seconds")
    feed.run(op, ("r", 1000.0, 0), ("r", 1020.0, 30))
    feed.run(op, ("r", 1010.0, 10), ("r", 1030.0, 30), (None, 1005.0, 1), ("r", None, 2))
    rows = feed.run(op, ("r", 1040.0, 35), ("z", 1500.0, 1))
    assert sorted((r["ts"], r["rate"]) for r in rows) == [(1010.0, 1.0), (1020.0, 2.0), (1040.0, 0.5)]


def test_worker_loss_and_replacement_with_a_late_snapshot(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job_id string, ts timestamp, seq bigint, workers array<string>")
    op = lambda s: keyed.worker_changes(s, "60 seconds")
    feed.run(op, ("j", at(0), 0, ["a", "b"]))
    feed.run(op, ("j", at(20), 2, ["b", "c"]))
    feed.run(op, ("j", at(10), 1, ["b"]))
    rows = feed.run(op, ("k", at(1000), 0, []))
    assert [(r["seq"], r["worker"], r["job_state"]) for r in sorted(rows, key=lambda r: r["seq"])] == [
        (1, "a", "RECOVERING"), (2, "c", "RUNNING")]


def test_state_goes_with_a_key(spark, tmp_path):
    """A run that has been silent long enough leaves nothing behind, and starts anew."""
    feed = Feed(spark, tmp_path, "run_id string, ts double, step bigint")
    op = lambda s: keyed.stream_step_rate(s, "0 seconds", forget_s=100.0)
    feed.run(op, ("r", 1000.0, 0), ("r", 1010.0, 10))
    feed.run(op, ("s", 1050.0, 1))

    def held():
        state = spark.read.format("statestore").option("stateVarName", "clock").load(f"{feed.base}/progress")
        return sorted(r["key"]["run_id"] for r in state.select("key").collect())

    assert held() == ["r", "s"]
    feed.run(op, ("s", 1130.0, 2))
    assert held() == ["s"]
    rows = feed.run(op, ("r", 1140.0, 50), ("s", 1150.0, 3))
    assert [(r["run_id"], r["ts"]) for r in rows if r["run_id"] == "r"] == [("r", 1010.0)]


def test_sessions_close_after_the_gap(spark, tmp_path):
    feed = Feed(spark, tmp_path, "node_id string, ts timestamp")
    op = lambda s: windows.node_sessions(s, "60 seconds", "0 seconds")
    rows = feed.run(op, ("a", at(0)), ("a", at(30)), ("a", at(100)), ("b", at(1000)))
    got = sorted((r["start"].timestamp() % 3600, r["beats"]) for r in rows)
    assert got == [(0.0, 2), (100.0, 1)]


class Batches(Feed):
    """The same for operators that write their own tables."""

    def run(self, operator, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.src)
        return operator(self.spark.readStream.schema(self.schema).parquet(self.src), self.base).collect()


def test_incidents_across_windows_and_batches(spark, tmp_path):
    """Twenty to seventy-five minutes span two tumbling hours; rows come late and mixed."""
    feed = Batches(spark, tmp_path, "pool string, ts timestamp")
    op = lambda s, at_: windows.correlated_incidents(s, at_, 3600.0, delay_s=7200.0)
    feed.run(op, ("p", at(3000)), ("q", at(0)))
    feed.run(op, ("p", at(4500)), ("p", at(4900)))
    feed.run(op, ("p", at(1200)), ("q", at(40_000)))
    rows = feed.run(op, ("q", at(80_000)))
    got = sorted((r["pool"], r["ts"].timestamp() - at(0).timestamp(), r["failures"]) for r in rows)
    assert got == [("p", 4500.0, 3), ("p", 4900.0, 3)]
    held = spark.read.parquet(f"{feed.base}/held").orderBy("batch", "ts").collect()
    assert [(r["pool"], r["ts"].timestamp() - at(0).timestamp()) for r in held if r["batch"] == 3] == [("q", 80_000.0)]


def test_incident_and_decision_streams(spark, tmp_path):
    feed = Batches(spark, tmp_path, "pool string, ts timestamp, exit_code int, log string")
    op = lambda s, at_: windows.correlated_incidents(s, at_, 600.0, delay_s=0.0)
    fails = [("p", at(i), 1, "NameError: x" if i else "killed") for i in range(3)]
    rows = feed.run(op, *fails, ("q", at(5), 1, ""), ("q", at(5000), 1, ""))
    assert sorted((r["pool"], r["ts"].second, r["failures"]) for r in rows) == [("p", 2, 3)]
    stream = spark.readStream.schema(feed.schema).parquet(feed.src)
    decided = drain(windows.stream_decisions(stream, "independent_tasks"), "d").filter("pool = 'p'")
    assert sorted(r["action"] for r in decided.collect()) == ["fail_job", "fail_job", "retry_task"]
    assert decided.select(F.countDistinct("policy_version")).first()[0] == 1
