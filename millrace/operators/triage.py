"""From failed attempts to recovery decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import logs
from millrace.functions.keys import is_restart
from millrace.operators.ordered import count_in_window

POLICY_VERSION = "0.1.0"

# The decision for every failure class, first for independent
# tasks, then for coordinated training: action, scope, cordon, needs checkpoint.
POLICY = [
    ("application_error", "independent_tasks", "fail_job", "job", False, False),
    ("application_error", "coordinated_training", "fail_job", "job", False, False),
    ("data_error", "independent_tasks", "retry_task", "task", False, False),
    ("data_error", "coordinated_training", "fail_job", "job", False, False),
    ("worker_crash", "independent_tasks", "retry_task", "task", False, False),
    ("worker_crash", "coordinated_training", "restart_group", "group", False, True),
    ("node_loss", "independent_tasks", "retry_task", "task", True, False),
    ("node_loss", "coordinated_training", "replace_node", "group", True, True),
    ("accelerator_failure", "independent_tasks", "retry_task", "node", True, False),
    ("accelerator_failure", "coordinated_training", "replace_node", "group", True, True),
    ("communication_error", "independent_tasks", "retry_task", "task", False, False),
    ("communication_error", "coordinated_training", "restart_group", "group", False, True),
    ("network_degradation", "independent_tasks", "retry_task", "task", False, False),
    ("network_degradation", "coordinated_training", "restart_group", "group", False, True),
    ("storage_timeout", "independent_tasks", "pause_job", "job", False, False),
    ("storage_timeout", "coordinated_training", "pause_job", "job", False, False),
    ("artifact_corruption", "independent_tasks", "retry_task", "task", False, False),
    ("artifact_corruption", "coordinated_training", "restart_group", "group", False, True),
    ("preemption", "independent_tasks", "retry_task", "task", False, False),
    ("preemption", "coordinated_training", "replace_node", "group", False, True),
    ("correlated_incident", "independent_tasks", "freeze_automation", "pool", False, False),
    ("correlated_incident", "coordinated_training", "freeze_automation", "pool", False, False),
    ("control_plane_failure", "independent_tasks", "pause_job", "job", False, False),
    ("control_plane_failure", "coordinated_training", "pause_job", "job", False, False),
    ("unknown", "independent_tasks", "retry_task", "task", False, False),
    ("unknown", "coordinated_training", "pause_job", "job", False, True),
]

#: Why an action is taken, for people reading a decision.
ACTION_REASONS = {
    "fail_job": "the same input would fail again",
    "retry_task": "another attempt can succeed",
    "restart_group": "the group's state is lost; restart it from a checkpoint",
    "replace_node": "the node is gone; replace it and restart the group",
    "pause_job": "protect state until the cause is understood or gone",
    "freeze_automation": "many failures at once; stop acting and escalate",
}


def policy_rows() -> list[tuple]:
    return [(*row, ACTION_REASONS[row[2]], POLICY_VERSION) for row in POLICY]


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        policy_rows(),
        "failure_class string, mode string, action string, scope string, cordon_node boolean, "
        "needs_checkpoint boolean, reason string, policy_version string",
    )


def log_signals(df: DataFrame) -> DataFrame:
    """Add ``exit_deterministic`` from ``exit_code`` and ``log``."""
    return df.withColumn(
        "exit_deterministic", logs.is_deterministic(F.col("exit_code"), F.col("log"))
    )


def concurrent_failures(df: DataFrame, seconds: float, pool: str = "pool", ts: str = "ts") -> DataFrame:
    """Failures of the same pool in the window ending at each failure, itself included."""
    return count_in_window(df, [pool], ts, seconds, "concurrent_failures")


def classify(df: DataFrame) -> DataFrame:
    """Add ``failure_class`` from whatever evidence columns the frame has."""
    columns = set(df.columns)

    def signal(name: str, default: Column) -> Column:
        return F.col(name) if name in columns else default

    return df.withColumn("failure_class", logs.failure_class(signal))


def decide(df: DataFrame, mode: Column | str, table: DataFrame | None = None) -> DataFrame:
    """Look up the action for each failure; a pair the policy lacks is an error.

    The policy is a constant of one row per class and mode, so it is broadcast.
    """
    rules = table if table is not None else policy(df.sparkSession)
    asked = df.withColumn("mode", F.lit(mode) if isinstance(mode, str) else mode)
    joined = asked.join(F.broadcast(rules), ["failure_class", "mode"], "left")
    missing = F.raise_error(
        F.concat(F.lit("no policy for "), "failure_class", F.lit(" in mode "), "mode")
    ).cast("string")
    return joined.withColumn("action", F.coalesce("action", missing))


def triage(df: DataFrame, mode: Column | str, window_s: float) -> DataFrame:
    """Signals, correlation, class and decision in one plan."""
    return decide(classify(concurrent_failures(log_signals(df), window_s)), mode)


def restart_budget(attempts: DataFrame) -> DataFrame:
    """Per run: attempts and restarts used against the budget, and whether it may go on.

    ``attempts``: ``run_id, attempt_id, max_restarts, action`` where ``action`` is
    the decision taken after the attempt (NULL if it succeeded).
    """
    used = F.count_if(is_restart(F.col("attempt_id")))
    stopped = F.coalesce(F.bool_or(F.col("action") == "fail_job"), F.lit(False))
    return attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        used.alias("restarts_used"),
        F.max("max_restarts").alias("max_restarts"),
        stopped.alias("stopped"),
        (~stopped & (used < F.max("max_restarts"))).alias("may_restart"),
    )
