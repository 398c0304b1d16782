from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import logs
from millrace.operators import triage as R

CLASSES = {row[0] for row in R.policy_rows()}


def classify(spark, **signals):
    kinds = {bool: "boolean", int: "int", str: "string"}
    cols = [F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in signals.items()] or [F.lit(1).alias("x")]
    return R.classify(spark.range(1).select(*cols)).first()["failure_class"]


@pytest.mark.parametrize(
    "signals, expected",
    [
        (dict(heartbeat_lost=True, exit_code=137, concurrent_failures=3), "correlated_incident"),
        (dict(heartbeat_lost=True, concurrent_failures=2), "node_loss"),
        (dict(exit_code=1, message="NCCL watchdog timeout on rank 3"), "communication_error"),
        (dict(exit_code=1, exit_deterministic=True), "application_error"),
        (dict(exit_code=137), "worker_crash"),
        (dict(xid_event=True, heartbeat_lost=True), "accelerator_failure"),
        (dict(preemption_notice=True, xid_event=True), "preemption"),
        (dict(control_plane_unreachable=True, preemption_notice=True), "control_plane_failure"),
        (dict(message="Storage Timeout", validation_failed=True), "storage_timeout"),
        (dict(storage_errors=1), "storage_timeout"),
        (dict(message="training loss is nan"), "storage_timeout"),
        (dict(validation_failed=True, exit_code=1), "artifact_corruption"),
        (dict(exit_code=0), "unknown"),
        (dict(), "unknown"),
    ],
)
def test_classes_by_precedence(spark, signals, expected):
    assert classify(spark, **signals) == expected


@pytest.mark.parametrize(
    "code, log, expected",
    [
        (1, "boot\nModuleNotFoundError: no x", True),
        (1, "boot\npkg.mod.NameError: x", True),
        (1, "NameError", True),
        (1, "NameErrorX: y", False),
        (1, "2026 WARNING ImportError: x not available", False),
        (1, "Traceback (most recent call last):\n  boom\nValueError: x", True),
        (1, "Traceback (most recent call last):\n ChildFailedError", False),
        (-9, "killed", False),
        (0, "NameError: x", False),
        (None, "NameError: x", False),
        (1, None, False),
    ],
)
def test_deterministic_exits(spark, code, log, expected):
    row = spark.createDataFrame([(code, log)], "exit_code int, log string")
    assert R.log_signals(row).first()["exit_deterministic"] is expected


def test_whole_word_storage_markers(spark):
    df = spark.createDataFrame([("loss went up",), ("S3 said no",)], "m string")
    got = df.select(logs.has_storage_marker(F.col("m"), whole_words=True)).collect()
    assert [r[0] for r in got] == [False, True]


def test_policy_has_one_row_per_class_and_mode(spark):
    rows = R.policy_rows()
    assert len(rows) == 26 and len({r[:2] for r in rows}) == 26 and len(CLASSES) == 13
    every = spark.createDataFrame([(r[0], r[1]) for r in rows], "failure_class string, m string")
    assert R.decide(every, F.col("m")).count() == 26


def test_unknown_pair_is_an_error(spark):
    df = spark.createDataFrame([("node_loss",)], "failure_class string")
    with pytest.raises(Exception, match="no policy for node_loss in mode other"):
        R.decide(df, "other").collect()


def test_window_makes_an_incident_of_three(spark):
    ts = [datetime(2024, 1, 1, 0, m, tzinfo=timezone.utc) for m in (0, 5, 10, 30)]
    df = spark.createDataFrame(
        [("p", t, 1, "killed") for t in ts] + [("q", ts[2], 1, "killed")],
        "pool string, ts timestamp, exit_code int, log string",
    )
    out = R.triage(df, "independent_tasks", 600).orderBy("pool", "ts").collect()
    assert [r["action"] for r in out] == ["retry_task", "retry_task", "freeze_automation", "retry_task", "retry_task"]


def test_restart_budget(spark):
    rows = [
        ("a", "task-000", 2, "retry_task"), ("a", "task-000-r1", 2, None),
        ("b", "task-000", 2, "fail_job"),
        ("c", "t", 1, "retry_task"), ("c", "t-r1", 1, "retry_task"),
    ]
    df = spark.createDataFrame(rows, "run_id string, attempt_id string, max_restarts int, action string")
    got = {r["run_id"]: (r["restarts_used"], r["may_restart"]) for r in R.restart_budget(df).collect()}
    assert got == {"a": (1, True), "b": (0, False), "c": (1, False)}
