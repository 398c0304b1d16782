"""Run-statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import runstats as S
from millrace.queries import query, rounded

_T = B.TRIALS_SQL


@query(
    "summary_percentiles",
    """SELECT event_type AS scenario, count(value) AS repeats,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10,
    round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events GROUP BY event_type""",
)
def summary_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = S.summarize(B.samples(spark, sf), ["scenario"])
    return out.select("scenario", "repeats", *[F.round(c, 6).alias(c) for c in S.SUMMARY])


@query(
    "goodput",
    f"""WITH {_T} SELECT run_id, round(sum(steps) / sum(steps + resumed_from)::DOUBLE, 9) AS goodput_lower_bound,
    sum(steps)::BIGINT AS useful_steps, sum(steps + resumed_from)::BIGINT AS charged_steps,
    count_if(resumed_from > 0)::BIGINT AS crashed_first_attempt FROM tr GROUP BY run_id""",
)
def goodput(spark: SparkSession, sf: str) -> DataFrame:
    out = S.goodput(B.trials(spark, sf), ["run_id"])
    return out.withColumn("goodput_lower_bound", F.round("goodput_lower_bound", 9))


@query(
    "recompute",
    f"""WITH {_T}, m AS (SELECT *, resumed_from > 0 AND crashed_at IS NOT NULL AS ok FROM tr)
    SELECT run_id, round(coalesce(sum(CASE WHEN ok THEN crashed_at - resumed_from END), 0)
      / sum(steps)::DOUBLE, 9) AS recompute_fraction,
    coalesce(sum(CASE WHEN ok THEN crashed_at - resumed_from END), 0)::BIGINT AS recomputed_steps,
    sum(steps)::BIGINT AS useful_steps, count_if(ok)::BIGINT AS measured_crashes FROM m GROUP BY run_id""",
)
def recompute(spark: SparkSession, sf: str) -> DataFrame:
    out = S.recompute(B.trials(spark, sf), ["run_id"])
    return out.withColumn("recompute_fraction", F.round("recompute_fraction", 9))


@query(
    "integrity",
    """SELECT event_type AS scenario,
    round(count_if(event_id % 3 <> 0 AND value > 10) / count_if(event_id % 3 <> 0)::DOUBLE, 9) AS integrity_rate,
    count_if(event_id % 3 <> 0)::BIGINT AS hits, count_if(event_id % 3 = 0)::BIGINT AS missed
    FROM events GROUP BY event_type""",
)
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = B.table(spark, sf, "events").select(
        F.col("event_type").alias("scenario"),
        (F.col("event_id") % 3 != 0).alias("fired"),
        (F.col("value") > 10).alias("survived"),
    )
    out = S.integrity(outcomes, ["scenario"])
    return out.withColumn("integrity_rate", F.round("integrity_rate", 9))


@query(
    "throughput",
    """SELECT l_shipdate_year, round(sum(tasks) / sum(wall) * 60, 6) AS tasks_per_min,
    round((sum(wall) - sum(tasks * 0.5)) / sum(wall), 9) AS overhead_fraction
    FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year, l_linenumber AS tasks,
      l_quantity AS wall FROM lineitem) GROUP BY 1""",
)
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    runs = B.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("l_shipdate_year"),
        F.col("l_linenumber").alias("tasks"),
        F.lit(0.5).alias("seconds_per_task"),
        F.col("l_quantity").alias("wall_s"),
    )
    out = S.throughput(runs, ["l_shipdate_year"])
    return out.select(
        "l_shipdate_year",
        F.round("tasks_per_min", 6).alias("tasks_per_min"),
        F.round("overhead_fraction", 9).alias("overhead_fraction"),
    )


_PAIRS = """pr AS (SELECT 's' || (event_id // 2 % 4) AS scenario,
  max(CASE WHEN event_id % 2 = 0 THEN value END) AS a, max(CASE WHEN event_id % 2 = 1 THEN value END) AS b
  FROM events GROUP BY event_id // 2 HAVING a IS NOT NULL AND b IS NOT NULL)"""


@query(
    "paired_overhead",
    f"""WITH {_PAIRS} SELECT scenario, count(*) AS repeats, round(quantile_cont(a - b, 0.5), 6) AS median,
    round(quantile_cont(a - b, 0.1), 6) AS p10, round(quantile_cont(a - b, 0.9), 6) AS p90
    FROM pr GROUP BY scenario""",
)
def paired_overhead(spark: SparkSession, sf: str) -> DataFrame:
    out = S.paired_diff(B.paired_samples(spark, sf), ["scenario"], "a", "b")
    return out.select("scenario", "repeats", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90")])


@query(
    "paired_penalty",
    f"""WITH {_PAIRS}, q AS (SELECT scenario, CASE WHEN b <> 0 THEN (a - b) / b ELSE 0 END AS v FROM pr)
    SELECT scenario, count(*) AS repeats, round(quantile_cont(v, 0.5), 6) AS median,
    round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM q GROUP BY scenario""",
)
def paired_penalty(spark: SparkSession, sf: str) -> DataFrame:
    out = S.paired_diff(B.paired_samples(spark, sf), ["scenario"], "a", "b", relative=True)
    return out.select("scenario", "repeats", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90")])


@query(
    "phase_split",
    """SELECT event_type, count(*) AS starts, round(avg(value / 10), 9) AS launch_s,
    round(avg(value / 4), 9) AS child_s, round(avg(value / 10 + value / 4), 9) AS total_s
    FROM events GROUP BY event_type""",
)
def phase_split(spark: SparkSession, sf: str) -> DataFrame:
    starts = B.table(spark, sf, "events").select(
        "event_type",
        F.col("event_id").cast("double").alias("submitted_at"),
        (F.col("event_id") + F.col("value") / 10).alias("process_started_at"),
        (F.col("event_id") + F.col("value") / 10 + F.col("value") / 4).alias("first_step_at"),
    )
    return S.phase_split(starts).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("starts"),
        *[rounded(F.avg(c)).alias(c) for c in ("launch_s", "child_s", "total_s")],
    )


@query(
    "recovery_score",
    """WITH c AS (SELECT event_type, user_id % 5 AS fault, user_id % 3 AS act, value,
      CASE WHEN event_id % 4 <> 0 THEN event_id % 40 END AS kept FROM events)
    SELECT event_type, count(*) AS cases,
      count_if(act = CASE WHEN fault < 3 THEN fault END)::BIGINT AS correct,
      count_if(NOT coalesce(act = CASE WHEN fault < 3 THEN fault END, false))::BIGINT AS manual_interventions,
      round(avg(value), 9) AS mean_recovery_s, round(avg(kept), 9) AS mean_steps_preserved
    FROM c GROUP BY event_type""",
)
def recovery_score(spark: SparkSession, sf: str) -> DataFrame:
    events = B.table(spark, sf, "events")
    cases = events.select(
        "event_type",
        (F.col("user_id") % 5).alias("fault"),
        (F.col("user_id") % 3).alias("action"),
        F.col("value").alias("recovery_s"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 40).alias("steps_preserved"),
    )
    expected = events.select((F.col("user_id") % 5).alias("fault")).distinct().select(
        "fault", F.when(F.col("fault") < 3, F.col("fault")).alias("expected_action")
    )
    out = S.recovery_score(cases, expected, ["event_type"])
    return out.select(
        "event_type",
        "cases",
        "correct",
        "manual_interventions",
        rounded("mean_recovery_s").alias("mean_recovery_s"),
        rounded("mean_steps_preserved").alias("mean_steps_preserved"),
    )


@query(
    "best_trial",
    """WITH t AS (SELECT 'run-' || l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS trial,
      CASE WHEN l_partkey % 7 <> 0 THEN round(l_discount, 2) END AS score FROM lineitem)
    SELECT run_id, max(score) AS score, arg_min(trial, (-score, trial)) AS trial
    FROM t WHERE score IS NOT NULL GROUP BY run_id""",
)
def best_trial(spark: SparkSession, sf: str) -> DataFrame:
    t = B.table(spark, sf, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_suppkey")).alias("run_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"),
        F.when(
            F.col("l_partkey") % 7 != 0,
            F.create_map(F.lit("accuracy"), F.round("l_discount", 2)),
        )
        .otherwise(F.create_map(F.lit("other"), F.lit(0.0)))
        .alias("metrics"),
    )
    out = S.best_trial(t, "accuracy", True, ["run_id"])
    return out.select("run_id", F.col("metrics")["accuracy"].alias("score"), "trial")


@query(
    "run_states",
    """WITH a AS (SELECT 'run-' || (event_id // 60) AS run_id, event_id // 4 AS trial,
      event_id AS attempt, CASE WHEN event_type IN ('error') THEN 'FAILED' ELSE 'SUCCEEDED' END AS state FROM events),
    f AS (SELECT run_id, trial, arg_max(state, attempt) AS s FROM a GROUP BY run_id, trial)
    SELECT run_id, count(*) AS trials,
      CASE WHEN bool_and(s = 'SUCCEEDED') THEN 'SUCCEEDED' ELSE 'FAILED' END AS state FROM f GROUP BY run_id""",
)
def run_states(spark: SparkSession, sf: str) -> DataFrame:
    attempts = B.table(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.expr("event_id div 60")).alias("run_id"),
        F.expr("event_id div 4").alias("trial"),
        F.col("event_id").alias("attempt"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("state"),
    )
    return S.run_states(attempts)


@query(
    "publishable_rows",
    """SELECT scenario, section, CAST(repeats AS BIGINT) AS repeats FROM
    (SELECT 'part-' || l_partkey AS scenario,
       CASE l_partkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'resilience' ELSE 'other' END AS section,
       count(*) AS repeats FROM lineitem GROUP BY l_partkey) WHERE repeats >= 3""",
)
def publishable_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = (
        B.table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.count(F.lit(1)).alias("repeats"))
        .select(
            F.concat(F.lit("part-"), F.col("l_partkey")).alias("scenario"),
            F.when(F.col("l_partkey") % 3 == 0, "performance")
            .when(F.col("l_partkey") % 3 == 1, "resilience")
            .otherwise("other")
            .alias("section"),
            "repeats",
        )
    )
    fit, _ = S.publishable(rows)
    return S.order_sections(fit)
