"""Run documents, rank heartbeats, metrics and machine samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import is_restart
from millrace.functions.readings import number_or_null
from millrace.functions.vectors import finite
from millrace.operators.ordered import previous_row, row_numbers, with_index
from millrace.session import written

# How much of a run is shown, and when a rate is no longer live.
TAIL_METRICS = 500
TAIL_TELEMETRY = 150
TAIL_LOG_LINES = 100
RECENT_ATTEMPTS = 16
STALE_AFTER_S = 6.0


def tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows per key. The constant bound is applied before the shuffle too."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def newest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The newest sample per key, over all attempts."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_s"))
        .select(*keys, "_s.*")
    )


def step_rates(beats: DataFrame, run: str = "run_id", slice_s: float = 3600.0) -> DataFrame:
    """Steps per second between consecutive beats of a run (``ts`` in seconds).

    NULL where time did not advance, the step went back, or nothing moved.
    """
    usable = beats.filter(F.col("step").isNotNull() & F.col("ts").isNotNull())
    paired = previous_row(
        usable, [run], ["ts", "step"], ["ts", "step"], F.floor(F.col("ts") / slice_s)
    )
    dt = F.col("ts") - F.col("prev_ts")
    ds = F.col("step") - F.col("prev_step")
    return paired.withColumn("rate", F.when((dt > 0) & (ds > 0), ds / dt)).drop(
        "prev_ts", "prev_step"
    )


def step_rate(
    beats: DataFrame, as_of: float, run: str = "run_id", running: DataFrame | None = None
) -> DataFrame:
    """Current rate and step latency per run; NULL once the newest beat is stale or
    the run is not in ``running`` (a table of run ids, if given)."""
    rates = step_rates(beats, run)
    latest = rates.groupBy(run).agg(
        F.max("ts").alias("last_ts"),
        F.max_by("rate", F.when(F.col("rate").isNotNull(), F.struct("ts", "step"))).alias("_r"),
        F.max_by("step", "ts").alias("step"),
    )
    live = F.lit(float(as_of)) - F.col("last_ts") < STALE_AFTER_S
    if running is not None:
        latest = latest.join(running.select(run, F.lit(True).alias("_run")), run, "left")
        live = live & F.coalesce(F.col("_run"), F.lit(False))
    return latest.select(
        run,
        "step",
        "last_ts",
        F.when(live, F.col("_r")).alias("steps_per_s"),
        F.when(live, F.round(1000.0 / F.col("_r"))).cast("bigint").alias("step_latency_ms"),
    )


def loss_curve(metrics: DataFrame, run: str = "run_id", slice_lines: int = 100_000) -> DataFrame:
    """Loss points of a run over all its attempts: ``run, x, y, loss_key``.

    ``metrics``: ``run, attempt, line, values MAP<STRING,DOUBLE>`` in written order.
    The loss is ``loss`` if present, else the first finite value that is no counter;
    ``x`` is ``step``, else the point's position in the run.
    """
    counters = ["step", "epoch", "index"]
    other = F.get(
        F.filter(
            F.map_entries("values"), lambda e: ~e["key"].isin(counters) & finite(e["value"])
        ),
        0,
    )
    has_loss = F.col("values")["loss"].isNotNull()
    points = (
        metrics.withColumn("loss_key", F.when(has_loss, "loss").otherwise(other["key"]))
        .withColumn("y", F.col("values")[F.col("loss_key")])
        .filter(F.col("loss_key").isNotNull() & finite(F.col("y")))
    )
    placed = row_numbers(
        points,
        [run],
        ["attempt", "line"],
        F.struct("attempt", F.floor(F.col("line") / slice_lines)),
        "_i",
    )
    step = F.col("values")["step"]
    x = F.coalesce(step, (F.col("_i") - 1).cast("double"))
    return placed.select(run, "attempt", "line", x.alias("x"), "y", "loss_key")


def mean_readings(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means that ignore unusable readings: none at all is NULL, zero is data."""
    return df.groupBy(*keys).agg(
        *[F.avg(number_or_null(F.col(c))).alias(c + "_mean") for c in columns],
        *[F.count(number_or_null(F.col(c))).alias(c + "_n") for c in columns],
    )


def rank_processes(ranks: DataFrame, processes: DataFrame) -> DataFrame:
    """Each rank's newest heartbeat with the process sample of the same pid."""
    sample = processes.select(
        "attempt_id", "pid", F.col("cpu_percent").alias("proc_cpu_percent"), "rss_bytes"
    )
    return ranks.join(sample, ["attempt_id", "pid"], "left")


def descendants(
    processes: DataFrame, keys: Sequence[str], is_root: Column, max_rounds: int = 40
) -> DataFrame:
    """Root and depth of every process below a root: adds ``root_pid, depth``.

    Each round doubles the distance that open processes have looked upwards, so a chain of
    a million parents takes twenty joins. A process is open while it does not know its top:
    only open rows are joined and written again, the others are looked up where they are,
    until no row is open.
    """
    keys = list(keys)
    base = processes.select(
        *keys,
        "pid",
        F.when(is_root, F.lit(None)).otherwise(F.col("ppid")).alias("_up"),
        F.coalesce(is_root, F.lit(False)).alias("_root"),
    )
    known = base.select(*keys, F.col("pid").alias("_up"), F.lit(True).alias("_here"))
    named = base.filter(F.col("_up").isNotNull()).join(known, [*keys, "_up"], "left")
    top = [F.col("pid").alias("_top"), F.lit(0).cast("bigint").alias("depth"), "_root"]
    tops = base.filter(F.col("_up").isNull()).select(*keys, "pid", *top)
    tops = tops.unionByName(named.filter(F.col("_here").isNull()).select(*keys, "pid", *top))
    closed = [written(tops, "process-tops")]
    # ``depth`` of an open row is how far ``_up`` lies above it.
    open_ = named.filter("_here").select(*keys, "pid", "_up", F.lit(1).cast("bigint").alias("depth"))
    open_ = written(open_, "processes")
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        done = reduce(DataFrame.unionByName, closed).select(
            *keys, F.col("pid").alias("_up"), "_top", F.col("depth").alias("_d"), F.col("_root")
        )
        far = open_.select(*keys, F.col("pid").alias("_up"), F.col("_up").alias("_up2"), F.col("depth").alias("_d"))
        met = open_.join(far.unionByName(done, allowMissingColumns=True), [*keys, "_up"])
        met = written(met.withColumn("depth", F.col("depth") + F.col("_d")), "processes")
        closed.append(met.filter(F.col("_up2").isNull()).select(*keys, "pid", "_top", "depth", "_root"))
        open_ = met.filter(F.col("_up2").isNotNull()).select(*keys, "pid", F.col("_up2").alias("_up"), "depth")
    else:
        raise ValueError("the parent links contain a cycle")
    state = reduce(DataFrame.unionByName, closed)
    found = state.filter("_root").select(*keys, "pid", F.col("_top").alias("root_pid"), "depth")
    return processes.join(found, [*keys, "pid"])


def recent_attempts(attempts: DataFrame, n: int = RECENT_ATTEMPTS) -> DataFrame:
    """Newest ``n`` attempts per run and how many earlier ones are not shown."""
    shown = tail(attempts, ["run_id"], ["started_at", "attempt_id"], n)
    totals = attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("_total"))
    return shown.join(totals, "run_id").withColumn(
        "hidden", F.greatest(F.col("_total") - n, F.lit(0))
    ).drop("_total")


def kpi_snapshot(
    runs: DataFrame, attempts: DataFrame, ranks: DataFrame, manifests: DataFrame, as_of: float
) -> DataFrame:
    """One row per run: state, elapsed, newest step, restarts used, attempts, checkpoints."""
    a = attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(is_restart(F.col("attempt_id"))).alias("restarts_used"),
    )
    r = ranks.groupBy("run_id").agg(F.max_by("step", "ts").alias("step"))
    m = manifests.groupBy("run_id").agg(
        F.count_if(F.col("validation") == "hash_verified").alias("verified_checkpoints")
    )
    out = runs.join(a, "run_id", "left").join(r, "run_id", "left").join(m, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "run_id",
        "state",
        (F.coalesce("finished_at", F.lit(float(as_of))) - F.col("started_at")).alias("elapsed_s"),
        "step",
        zero("attempts"),
        zero("restarts_used"),
        "max_restarts",
        zero("verified_checkpoints"),
    )


def set_changes(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """Members that left or joined since the snapshot seen before: ``order, key, change``.

    ``order`` may have gaps; the first snapshot has no predecessor.
    """
    here = snapshots.select(order, key).distinct()
    times = with_index(here.select(order).distinct(), [order], "_at")
    ranked = here.join(times, order)
    named = times.select("_at", order)
    shifted = ranked.select((F.col("_at") + 1).alias("_at"), key)
    lost = (
        shifted.join(ranked.select("_at", key), ["_at", key], "left_anti")
        .join(named, "_at")  # the last snapshot has no successor
        .select(order, key, F.lit("lost").alias("change"))
    )
    joined = (
        ranked.filter(F.col("_at") > 0)
        .join(shifted, ["_at", key], "left_anti")
        .select(order, key, F.lit("joined").alias("change"))
    )
    return lost.unionByName(joined)
