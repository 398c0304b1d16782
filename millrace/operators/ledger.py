"""Task, lease and commit state from an append-only ledger.

Ledger rows (``schemas.LEDGER``) are requests in sequence order. A claim is a
grant: it opens the task's next attempt and supersedes the one before. The
``tasks`` table carries what events do not: ``max_attempts``, ``lease_seconds``.

Rows are reduced to one row per lease by aggregates that combine before the
shuffle; windows only ever see the first ``max_attempts`` leases of a task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import seconds_between, time_bucket
from millrace.operators.quantiles import exact_percentiles

TASK = ["job_id", "task_id"]
LEASE = [*TASK, "lease_id"]

#: Fixed value: a node is online while its last beat is younger than this.
OFFLINE_AFTER_S = 15.0
#: Renewals are compared inside slices of this length (see ``previous_row``).
SLICE_S = 3600.0


def instant(value) -> Column:
    """A Column, datetime or ``YYYY-MM-DD HH:MM:SS`` text as a timestamp."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return F.lit(value)
    return F.to_timestamp(F.lit(value))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(
        (F.unix_micros(ts) + F.round(seconds * 1_000_000)).cast("bigint")
    )


def is_online(last_beat: Column, now: Column) -> Column:
    return seconds_between(last_beat, now) < OFFLINE_AFTER_S


# -- leases -------------------------------------------------------------------


def last_beats(events: DataFrame, tasks: DataFrame, slice_s: float = SLICE_S) -> DataFrame:
    """Last beat of each lease that still counted: a renewal after a silence as long
    as the lease comes too late and extends nothing.

    Beats are ordered inside slices of time, then slices are compared by their
    first and last beat, so a lease with endless renewals is not one sort.
    """
    slice_ = [*LEASE, "_b"]
    inside = Window.partitionBy(*slice_).orderBy("ts", "seq")
    across = Window.partitionBy(*LEASE).orderBy("_b")

    def late(prev: Column, ts: Column) -> Column:
        return F.unix_micros(ts) - F.unix_micros(prev) >= F.col("lease_seconds") * 1_000_000

    beats = (
        events.filter(F.col("type").isin("LEASE_CLAIMED", "LEASE_RENEWED"))
        .join(tasks.select(*TASK, "lease_seconds"), TASK)
        .select(*LEASE, "lease_seconds", "ts", "seq", time_bucket(F.col("ts"), slice_s).alias("_b"))
        .withColumn("_p", F.lag("ts").over(inside))
    )
    slices = (
        beats.groupBy(*slice_)
        .agg(
            F.first("lease_seconds").alias("lease_seconds"),
            F.min("ts").alias("_first"),
            F.max("ts").alias("_last"),
            F.min(F.when(late(F.col("_p"), F.col("ts")), F.col("_p"))).alias("_gap"),
        )
        .withColumn("_p", F.lag("_last").over(across))
    )
    gap = F.least("_gap", F.when(late(F.col("_p"), F.col("_first")), F.col("_p")))
    return slices.groupBy(*LEASE).agg(
        F.coalesce(F.min(gap), F.max("_last")).alias("last_beat"),
        F.first("lease_seconds").alias("lease_seconds"),
    )


def most_attempts(tasks: DataFrame) -> int:
    """The largest attempt limit of any task."""
    return tasks.agg(F.max("max_attempts")).first()[0] or 0


def granted_leases(events: DataFrame, tasks: DataFrame, bound: int | None = None) -> DataFrame:
    """The first ``max_attempts`` claims of each task with everything said about them.

    One number (the largest attempt limit) is read up front, where it is not given: a
    constant bound lets Spark drop surplus claims before they are shuffled by task.
    """
    bound = most_attempts(tasks) if bound is None else bound
    kind = F.col("type")
    closing = kind.isin("COMMIT_OFFERED", "TASK_ATTEMPT_FAILED")
    per_lease = (
        events.filter(F.col("lease_id").isNotNull())
        .groupBy(*LEASE)
        .agg(
            F.min(F.when(kind == "LEASE_CLAIMED", F.struct("ts", "seq", "node_id"))).alias("claim"),
            F.min(F.when(closing, F.struct("ts", "seq", "type", "output_valid"))).alias("c"),
            F.count_if(kind == "COMMIT_OFFERED").alias("offers"),
        )
        .filter(F.col("claim").isNotNull())
        .join(last_beats(events, tasks), LEASE)
    )
    order = Window.partitionBy(*TASK).orderBy("claim.ts", "claim.seq")
    return (
        per_lease.withColumn("attempt", F.row_number().over(order))
        .filter(F.col("attempt") <= bound)
        .join(tasks.select(*TASK, "max_attempts"), TASK)
        .filter(F.col("attempt") <= F.col("max_attempts"))
        .select(
            *LEASE,
            "claim.node_id",
            "attempt",
            "max_attempts",
            "lease_seconds",
            F.col("claim.ts").alias("claim_ts"),
            F.col("claim.seq").alias("claim_seq"),
            "last_beat",
            plus_seconds(F.col("last_beat"), F.col("lease_seconds")).alias("deadline"),
            "c",
            "offers",
            F.lead(F.struct("claim.ts", "claim.seq")).over(order).alias("next"),
        )
    )


def deadlines(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Deadline of every lease: last beat that counted plus ``lease_seconds``."""
    return granted_leases(events, tasks).drop("c", "offers", "next")


def leases(events: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    """One row per attempt, with how it ended as seen at ``as_of``.

    ``outcome``: committed, failed (reported, or output did not validate),
    rejected (a commit was offered, but not in time), expired, or running.
    Attempts of a task that was already finished are left out.
    """
    every = judged_leases(events, tasks, as_of)
    return every.filter(F.col("won").isNull() | (F.col("attempt") <= F.col("won")))


def judged_leases(events: DataFrame, tasks: DataFrame, as_of, bound: int | None = None) -> DataFrame:
    """As :func:`leases`, with the claims made after a task had its result."""
    now = instant(as_of)
    seen = events.filter(F.col("ts") <= now)
    cancels = (
        seen.filter(F.col("type") == "TASK_CANCELLED")
        .groupBy(*TASK)
        .agg(F.min(F.struct("ts", "seq")).alias("cancel"))
    )
    joined = granted_leases(seen, tasks, bound).join(cancels, TASK, "left")
    close_at = F.struct("c.ts", "c.seq")
    closed = F.coalesce(
        (F.col("c.ts") < F.col("deadline"))
        & (F.col("next").isNull() | (close_at < F.col("next")))
        & (F.col("cancel").isNull() | (close_at < F.col("cancel"))),
        F.lit(False),
    )
    committed = (F.col("c.type") == "COMMIT_OFFERED") & F.coalesce("c.output_valid", F.lit(True))
    outcome = (
        F.when(F.col("closed") & committed, "committed")
        .when(F.col("closed"), "failed")
        .when(F.col("offers") > 0, "rejected")
        .when(
            F.col("next").isNotNull() | (F.col("deadline") <= now) | F.col("cancel").isNotNull(),
            "expired",
        )
        .otherwise("running")
    )
    claim_at = F.struct(F.col("claim_ts").alias("ts"), F.col("claim_seq").alias("seq"))
    ended_at = F.when(F.col("closed"), F.col("c.ts")).when(
        F.col("outcome") != "running", F.least("deadline", "next.ts", "cancel.ts")
    )
    judged = (
        joined.filter(F.col("cancel").isNull() | (claim_at < F.col("cancel")))
        .withColumn("closed", closed)
        .withColumn("outcome", outcome)
        .withColumn("ended_at", ended_at)
    )
    winner = F.min(
        F.when(
            F.col("outcome") == "committed",
            F.struct("attempt", F.col("ended_at").alias("ts"), F.col("c.seq").alias("seq")),
        )
    ).over(Window.partitionBy(*TASK))
    return judged.withColumn("_won", winner).select(
        *LEASE,
        "node_id",
        "attempt",
        "max_attempts",
        "lease_seconds",
        "claim_ts",
        "claim_seq",
        "last_beat",
        "deadline",
        "outcome",
        "ended_at",
        "closed",
        F.col("_won.attempt").alias("won"),
        F.struct(F.col("_won.ts"), F.col("_won.seq")).alias("won_at"),
        F.when(F.col("closed"), F.col("c.seq")).alias("closing_seq"),
        F.col("cancel.ts").alias("cancelled_at"),
    )


def attempts(leased: DataFrame) -> DataFrame:
    """One row per attempt: who ran it, when, and with what outcome."""
    return leased.select(
        *LEASE,
        "node_id",
        F.col("attempt").alias("attempt_number"),
        F.col("claim_ts").alias("started"),
        F.col("ended_at").alias("finished"),
        "outcome",
        (F.col("outcome") == "committed").alias("accepted"),
    )


def expired_leases(leased: DataFrame) -> DataFrame:
    """Leases whose deadline has passed (``deadline <= now``) unanswered."""
    return leased.filter(F.col("outcome").isin("expired", "rejected"))


def _live(now: Column) -> Column:
    return ~F.col("closed") & (F.col("deadline") > now) & F.col("cancelled_at").isNull()


def live_scope(leased: DataFrame, as_of) -> DataFrame:
    """(job, task) each node may currently write to."""
    newest = leased.groupBy(*TASK).agg(
        F.max_by(
            F.struct("node_id", "closed", "deadline", "cancelled_at"), "attempt"
        ).alias("l")
    )
    return newest.select(*TASK, "l.*").filter(_live(instant(as_of))).select("node_id", *TASK)


# -- commits ------------------------------------------------------------------


def commits(events: DataFrame, judged: DataFrame) -> DataFrame:
    """Every offered commit, accepted or rejected with a reason.

    ``judged`` comes from :func:`judged_leases`. At most one commit per task is
    accepted. Reasons: ``unknown_lease`` (never granted), ``duplicate`` (the task
    already has its result), ``invalid_output``, ``late``.
    """
    known = judged.select(*LEASE, "closing_seq", "won", "won_at", F.lit(True).alias("_known"))
    offered = events.filter(F.col("type") == "COMMIT_OFFERED").join(known, LEASE, "left")
    accepted = F.coalesce(F.col("seq") == F.col("won_at.seq"), F.lit(False))
    after = F.struct("ts", "seq") > F.col("won_at")
    return offered.select(
        "seq",
        *LEASE,
        "node_id",
        "ts",
        accepted.alias("accepted"),
        F.when(accepted, F.lit(None))
        .when(F.col("_known").isNull(), "unknown_lease")
        .when(F.col("won").isNotNull() & after, "duplicate")
        .when(F.col("seq") == F.col("closing_seq"), "invalid_output")
        .otherwise("late")
        .alias("reason"),
    )


def accepted_by_node(commit_rows: DataFrame) -> DataFrame:
    """Accepted work only: how many results of each node were kept."""
    return (
        commit_rows.filter("accepted")
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("accepted_tasks"))
    )


# -- states -------------------------------------------------------------------


def task_states(leased: DataFrame, tasks: DataFrame, as_of, events: DataFrame | None = None) -> DataFrame:
    """State of every task; terminal states are final.

    ``events`` is only needed where tasks may be cancelled without ever having
    been claimed.
    """
    now = instant(as_of)
    newest = leased.groupBy(*TASK).agg(
        F.count(F.lit(1)).alias("attempts_used"),
        F.max("won").alias("_won"),
        F.max_by(
            F.struct("node_id", "deadline", "closed", "cancelled_at"), "attempt"
        ).alias("_l"),
    )
    out = tasks.select(*TASK, "max_attempts").join(newest, TASK, "left")
    if events is not None:
        cancels = (
            events.filter((F.col("type") == "TASK_CANCELLED") & (F.col("ts") <= now))
            .groupBy(*TASK)
            .agg(F.min("ts").alias("_cancelled"))
        )
        out = out.join(cancels, TASK, "left")
        cancelled = F.coalesce(F.col("_l.cancelled_at"), F.col("_cancelled")).isNotNull()
    else:
        cancelled = F.col("_l.cancelled_at").isNotNull()
    used = F.coalesce(F.col("attempts_used"), F.lit(0)).cast("bigint")
    live = (
        F.col("_l").isNotNull()
        & ~F.col("_l.closed")
        & (F.col("_l.deadline") > now)
        & F.col("_l.cancelled_at").isNull()
    )
    exhausted = (used >= F.col("max_attempts")) & ~live
    state = (
        F.when(F.col("_won").isNotNull(), "COMPLETED")
        .when(cancelled & ~F.coalesce(exhausted & F.col("_l.closed"), F.lit(False)), "CANCELLED")
        .when(live, "LEASED")
        .when(exhausted, "FAILED")
        .otherwise("PENDING")
    )
    return out.select(
        *TASK,
        state.alias("state"),
        used.alias("attempts_used"),
        "max_attempts",
        F.col("_l.node_id").alias("node_id"),
        F.when(state == "LEASED", F.col("_l.deadline")).alias("deadline"),
    )


def task_view(states: DataFrame) -> DataFrame:
    """Task list with the last holder, in task order."""
    return states.orderBy(*TASK)


def task_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "PENDING").alias("pending"),
        F.count_if(F.col("state") == "LEASED").alias("leased"),
        F.count_if(F.col("state") == "COMPLETED").alias("completed"),
        F.count_if(F.col("state") == "FAILED").alias("failed"),
        F.count_if(F.col("state") == "CANCELLED").alias("cancelled"),
    )


def job_states(states: DataFrame) -> DataFrame:
    """Job state derived from its task counts; nothing is stored by hand."""
    return task_counts(states).withColumn(
        "state",
        F.when(F.col("total") == 0, "PENDING")
        .when(F.col("pending") + F.col("leased") > 0, "RUNNING")
        .when(F.col("failed") > 0, "FAILED")
        .when(F.col("completed") == F.col("total"), "SUCCEEDED")
        .otherwise("CANCELLED"),
    )


def last_holder(leased: DataFrame) -> DataFrame:
    return leased.groupBy(*TASK).agg(F.max_by("node_id", "attempt").alias("node_id"))


# -- nodes --------------------------------------------------------------------


def node_view(
    registrations: DataFrame, beats: DataFrame, commit_rows: DataFrame, as_of
) -> DataFrame:
    """Per node: last beat, its age, online or not, accepted tasks."""
    now = instant(as_of)
    newest = beats.filter(F.col("ts") <= now).groupBy("node_id").agg(
        F.max("ts").alias("last_heartbeat")
    )
    age = seconds_between(F.col("last_heartbeat"), now)
    return (
        registrations.join(newest, "node_id", "left")
        .join(accepted_by_node(commit_rows), "node_id", "left")
        .withColumn("online", F.coalesce(age < OFFLINE_AFTER_S, F.lit(False)))
        .withColumn("last_heartbeat_age_s", F.round(age, 1))
        .withColumn("accepted_tasks", F.coalesce("accepted_tasks", F.lit(0)))
    )


def node_list(view: DataFrame) -> DataFrame:
    """Nodes of :func:`node_view` by name."""
    return view.orderBy("node_id")


def evidence_rollup(evidence: DataFrame) -> DataFrame:
    """Mean reported wall time and utilisation per node beside the elapsed time the
    coordinator saw. NULL stays "not measured"; zero is a measurement."""
    return evidence.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.avg("wall_seconds").alias("wall_seconds_mean"),
        F.avg("cpu_percent_mean").alias("cpu_percent_mean"),
        F.avg("gpu_util_percent_mean").alias("gpu_util_percent_mean"),
        F.avg("observed_seconds").alias("observed_seconds_mean"),
        F.count("gpu_util_percent_mean").alias("gpu_measured"),
    )


# -- recovery times -----------------------------------------------------------


def recoveries(leased: DataFrame) -> DataFrame:
    """Each dead attempt that was picked up again.

    ``mttd_s``: reclaim minus the dead holder's last beat; ``mttr_s``: commit of
    the new holder minus its claim (NULL if it did not commit).
    """
    order = Window.partitionBy(*TASK).orderBy("attempt")
    before = F.lag(F.struct("outcome", "node_id", "last_beat")).over(order)
    return (
        leased.withColumn("_d", before)
        .filter(F.col("_d.outcome").isin("expired", "rejected"))
        .select(
            *TASK,
            "attempt",
            F.col("_d.node_id").alias("dead_node"),
            "node_id",
            seconds_between(F.col("_d.last_beat"), F.col("claim_ts")).alias("mttd_s"),
            F.when(
                F.col("outcome") == "committed",
                seconds_between(F.col("claim_ts"), F.col("ended_at")),
            ).alias("mttr_s"),
        )
    )


def recovery_latency(leased: DataFrame, tasks: DataFrame, sweep_s: float = 2.0) -> DataFrame:
    """Percentiles of detection and repair times, with the bound lease + sweep."""
    long = recoveries(leased).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                    for m in ("mttd_s", "mttr_s")
                ]
            )
        )
    )
    found = exact_percentiles(long, ["metric"], "value", {"p50": 0.5, "p95": 0.95})
    bound = tasks.agg((F.max("lease_seconds") + F.lit(sweep_s)).alias("mttd_bound_s"))
    return (
        found.withColumn("_one", F.lit(1))
        .join(F.broadcast(bound.withColumn("_one", F.lit(1))), "_one")
        .drop("_one")
    )


def call_latency(calls: DataFrame) -> DataFrame:
    """Round trips of healthy requests: ``kind, calls`` and percentiles in milliseconds.
    ``calls``: ``kind`` (claim, heartbeat ...)``, seconds``; a call without a time is not one."""
    ms = calls.select("kind", (F.col("seconds") * 1000.0).alias("_ms"))
    found = exact_percentiles(ms, ["kind"], "_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "max_ms": 1.0})
    return found.withColumnRenamed("repeats", "calls")


# -- ledger rows --------------------------------------------------------------


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("events"))


def fold_events(events: DataFrame, reported: DataFrame, known_types: list[str]):
    """Append events a workload reported; unusable rows go to the second frame."""
    usable = (
        F.col("job_id").isNotNull()
        & F.col("ts").isNotNull()
        & F.coalesce(F.col("type").isin(known_types), F.lit(False))
    )
    good = reported.filter(usable)
    bad = reported.filter(~usable)
    return events.unionByName(good, allowMissingColumns=True), bad


def event_feed(events: DataFrame) -> DataFrame:
    """Newest events first."""
    return events.orderBy(F.col("ts").desc(), F.col("seq").desc())


def job_list(jobs: DataFrame) -> DataFrame:
    """Newest jobs first."""
    return jobs.orderBy(F.col("created").desc(), "job_id")
