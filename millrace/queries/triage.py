"""Failure-triage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import triage as R
from millrace.queries import query

_F = B.FAILURES_SQL

_POLICY_SQL = "pol(failure_class, mode, action, scope, cordon_node, needs_checkpoint) AS (VALUES " + ", ".join(
    f"('{k}', '{m}', '{a}', '{s}', {str(c).lower()}, {str(n).lower()})"
    for k, m, a, s, c, n, _, _ in R.policy_rows()
) + ")"


@query(
    "log_signals",
    f"WITH {_F} SELECT id, exit_code, exit_deterministic, length(log) AS log_chars FROM sg",
)
def log_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = R.log_signals(B.failures(spark, sf))
    return out.select(
        "id", "exit_code", "exit_deterministic", F.length("log").cast("bigint").alias("log_chars")
    )


@query(
    "concurrent_failures",
    f"WITH {_F} SELECT id, pool, concurrent_failures FROM sg",
)
def concurrent_failures(spark: SparkSession, sf: str) -> DataFrame:
    f = B.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("pool-"), F.col("user_id") % 5).alias("pool"),
        "ts",
    )
    return R.concurrent_failures(f, 3600.0).drop("ts")


@query("failure_classes", f"WITH {_F} SELECT id, failure_class FROM kl")
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    f = R.concurrent_failures(R.log_signals(B.failures(spark, sf)), 3600.0)
    return R.classify(f).select("id", "failure_class")


@query(
    "triage",
    f"""WITH {_F}, {_POLICY_SQL}
SELECT k.id, k.failure_class, k.mode, p.action, p.scope, p.cordon_node, p.needs_checkpoint
FROM kl k JOIN pol p USING (failure_class, mode)""",
)
def triage(spark: SparkSession, sf: str) -> DataFrame:
    out = R.triage(B.failures(spark, sf), F.col("mode"), 3600.0)
    return out.select(
        "id", "failure_class", "mode", "action", "scope", "cordon_node", "needs_checkpoint"
    )


@query(
    "restart_budget",
    f"""WITH {_F}, {_POLICY_SQL},
att AS (SELECT 'run-' || (k.id // 50) AS run_id, k.id % 3 > 0 AS restart, p.action
       FROM kl k JOIN pol p USING (failure_class, mode))
SELECT run_id, count(*) AS attempts, count_if(restart)::BIGINT AS restarts_used, 4 AS max_restarts,
  bool_or(action = 'fail_job') AS stopped,
  NOT bool_or(action = 'fail_job') AND count_if(restart) < 4 AS may_restart
FROM att GROUP BY run_id""",
)
def restart_budget(spark: SparkSession, sf: str) -> DataFrame:
    decided = R.triage(B.failures(spark, sf), F.col("mode"), 3600.0)
    base = F.concat(F.lit("task-"), F.col("id"))
    attempts = decided.select(
        F.concat(F.lit("run-"), F.expr("id div 50")).alias("run_id"),
        F.when(F.col("id") % 3 > 0, F.concat(base, F.lit("-r"), F.col("id") % 3))
        .otherwise(base)
        .alias("attempt_id"),
        F.lit(4).alias("max_restarts"),
        "action",
    )
    return R.restart_budget(attempts)
