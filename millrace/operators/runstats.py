"""Statistics over trials, paired runs and fault experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quantiles import exact_percentiles

SUMMARY = {"median": 0.5, "p10": 0.1, "p90": 0.9, "p95": 0.95}
#: Report sections in print order and the least repeats to print.
SECTION_ORDER = ["performance", "resilience"]
MIN_REPEATS = 3


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0.0 when there is no whole."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def summarize(
    samples: DataFrame, keys: Sequence[str], probs: Mapping[str, float] = SUMMARY, value: str = "value"
) -> DataFrame:
    """Median and outer percentiles per group with the number of repeats."""
    return exact_percentiles(samples, keys, value, probs)


def goodput(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower bound: useful steps over steps plus everything that was resumed."""
    useful = F.coalesce(F.sum("steps"), F.lit(0))
    charged = F.coalesce(
        F.sum(F.coalesce("steps", F.lit(0)) + F.coalesce("resumed_from", F.lit(0))), F.lit(0)
    )
    return trials.groupBy(*keys).agg(
        ratio(useful, charged).alias("goodput_lower_bound"),
        useful.alias("useful_steps"),
        charged.alias("charged_steps"),
        F.count_if(F.col("resumed_from") > 0).alias("crashed_first_attempt"),
    )


def recompute(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps done twice over useful steps; crashes nobody observed are left out."""
    measured = (F.col("resumed_from") > 0) & F.col("crashed_at").isNotNull()
    redone = F.coalesce(
        F.sum(F.when(measured, F.col("crashed_at") - F.col("resumed_from"))), F.lit(0)
    )
    useful = F.coalesce(F.sum("steps"), F.lit(0))
    return trials.groupBy(*keys).agg(
        ratio(redone, useful).alias("recompute_fraction"),
        redone.alias("recomputed_steps"),
        useful.alias("useful_steps"),
        F.count_if(measured).alias("measured_crashes"),
    )


def integrity(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Survived hits over hits. Kills that missed the window prove nothing."""
    hits = F.count_if("fired")
    return outcomes.groupBy(*keys).agg(
        ratio(F.count_if(F.col("fired") & F.col("survived")), hits).alias("integrity_rate"),
        hits.alias("hits"),
        F.count_if(~F.col("fired")).alias("missed"),
    )


def throughput(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks per minute, and the share of wall time that was not intended work.

    ``runs``: ``tasks, seconds_per_task, wall_s``.
    """
    tasks, wall = F.sum("tasks"), F.sum("wall_s")
    ideal = F.sum(F.col("tasks") * F.col("seconds_per_task"))
    return runs.groupBy(*keys).agg(
        (ratio(tasks, wall) * 60.0).alias("tasks_per_min"),
        ratio(wall - ideal, wall).alias("overhead_fraction"),
    )


def paired_values(samples: DataFrame, keys: Sequence[str], arm_a: str, arm_b: str) -> DataFrame:
    """Both arms of each repeat side by side; repeats missing one are left out."""
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    return (
        samples.groupBy(*keys, "repeat")
        .agg(value(arm_a).alias("a"), value(arm_b).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def paired_diff(
    samples: DataFrame,
    keys: Sequence[str],
    arm_a: str,
    arm_b: str,
    scale: float = 1.0,
    relative: bool = False,
) -> DataFrame:
    """Percentiles of ``(a - b) * scale`` over repeats: overhead, seconds saved, cost
    per checkpoint. ``relative`` divides by ``b`` (0 where ``b`` is 0): penalty.

    The median of differences, not the difference of medians.
    """
    gap = F.col("a") - F.col("b")
    value = ratio(gap, F.col("b")) if relative else gap * F.lit(float(scale))
    pairs = paired_values(samples, keys, arm_a, arm_b).withColumn("value", value)
    return summarize(pairs, keys, {"median": 0.5, "p10": 0.1, "p90": 0.9})


def phase_split(starts: DataFrame) -> DataFrame:
    """Start-up time split at the instant the child process began.

    ``starts``: ``submitted_at, process_started_at, first_step_at`` in seconds.
    """
    return starts.withColumn(
        "launch_s", F.col("process_started_at") - F.col("submitted_at")
    ).withColumn("child_s", F.col("first_step_at") - F.col("process_started_at")).withColumn(
        "total_s", F.col("first_step_at") - F.col("submitted_at")
    )


def recovery_score(cases: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases that ended with the expected action, counted one by one.

    ``cases``: ``fault, action, recovery_s, steps_preserved``; ``expected``:
    ``fault, expected_action``, one row per fault.
    """
    judged = cases.join(expected, "fault", "left").withColumn(
        "_ok", F.coalesce(F.col("action") == F.col("expected_action"), F.lit(False))
    )
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("_ok").alias("correct"),
        F.count_if(~F.col("_ok")).alias("manual_interventions"),
        F.avg("recovery_s").alias("mean_recovery_s"),
        F.avg("steps_preserved").alias("mean_steps_preserved"),
    )


def publishable(rows: DataFrame, min_repeats: int = MIN_REPEATS, smoke: bool = False):
    """``(rows fit to print, refused rows)``: too few repeats are refused unless smoke."""
    fit = F.lit(True) if smoke else F.coalesce(F.col("repeats") >= min_repeats, F.lit(False))
    return rows.filter(fit), rows.filter(~fit)


def order_sections(rows: DataFrame) -> DataFrame:
    """Known sections first in report order, the others after them by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section"))
    return rows.orderBy(
        F.when(place > 0, place).otherwise(len(SECTION_ORDER) + 1), "section", "scenario"
    )


def best_trial(
    trials: DataFrame, metric: str, maximize: bool, keys: Sequence[str] = (), order: str = "trial"
) -> DataFrame:
    """Best trial by a metric; trials without it are ignored, the first wins a tie.

    ``trials``: ``trial, metrics MAP<STRING,DOUBLE>``.
    """
    score = F.col("metrics")[metric]
    rank = F.struct(score if maximize else -score, -F.col(order))
    rest = [c for c in trials.columns if c not in keys]
    grouped = trials.filter(score.isNotNull()).groupBy(*keys)
    return grouped.agg(F.max_by(F.struct(*rest), rank).alias("_t")).select(*keys, "_t.*")


def run_states(attempts: DataFrame) -> DataFrame:
    """A run succeeded only if it has trials and the last attempt of each succeeded.

    ``attempts``: ``run_id, trial, attempt, state``.
    """
    final = attempts.groupBy("run_id", "trial").agg(F.max_by("state", "attempt").alias("_s"))
    return final.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trials"),
        F.when(F.bool_and(F.col("_s") == "SUCCEEDED"), "SUCCEEDED").otherwise("FAILED").alias("state"),
    )
