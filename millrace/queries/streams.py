"""Streaming queries: whole tables played through a stream, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.queries import query, rounded
from millrace.queries.leases import _COMMITS
from millrace.queries.triage import _F as _FAILURES
from millrace.queries.triage import _POLICY_SQL
from millrace.session import scratch_path
from millrace.streaming import keyed, leases, windows
from millrace.streaming.runner import drain


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _replay(df: DataFrame, name: str) -> DataFrame:
    """A derived table written once and streamed from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


#: How far rows stray from their order, and in how many batches they come.
_LATE_S, _SLICES = 6 * 3600, 3
#: Cuts of the open tasks.
_BUCKETS = 8
#: Longer than the data: no key is forgotten within it.
_KEEP_S = 40 * 86400.0


def _dealt(spark: SparkSession, df: DataFrame, late_s: int = _LATE_S):
    """Play ``df`` up to ``late_s`` out of order, in slices of its time of arrival: yields the
    stream over all that has arrived each time a slice has been added."""
    every, path = scratch_path(spark, "arrivals"), scratch_path(spark, "arrived")
    us = F.unix_micros("ts") + F.pmod(F.xxhash64(*df.columns), F.lit(late_s - 1)) * 1_000_000
    df.withColumn("_us", us).write.parquet(every)
    rows = spark.read.parquet(every)
    edges = rows.agg(F.percentile_approx("_us", [i / _SLICES for i in range(1, _SLICES)])).first()[0]
    bounds = [-(2**62), *edges, 2**62]
    for low, high in zip(bounds, bounds[1:]):
        rows.filter((F.col("_us") > low) & (F.col("_us") <= high)).drop("_us").write.mode("append").parquet(path)
        yield spark.readStream.schema(df.schema).parquet(path)


def _fed(spark: SparkSession, df: DataFrame, operator, name: str, late_s: int = _LATE_S) -> DataFrame:
    """What ``operator`` has written once every slice of ``df`` has come."""
    base = scratch_path(spark, name)
    for stream in _dealt(spark, df, late_s):
        out = drain(operator(stream), name, base)
    return out


def _delay(late_s: int = _LATE_S) -> str:
    return f"{late_s} seconds"


def _mark(of: str, late_s: int = _LATE_S) -> str:
    """The last watermark over rows ``of`` with a column ``t`` in microseconds, as SQL."""
    return f"(SELECT max(t) // 1000 * 1000 - {late_s}000000 AS w FROM {of})"


def _run_ledger(spark: SparkSession, ledger: DataFrame, tasks: DataFrame, jobs: bool = False) -> tuple[DataFrame, str]:
    """All transitions once the stream has ended, and where the job states are."""
    store = scratch_path(spark, "leases")
    for stream in _dealt(spark, ledger):
        leases.run_leases(stream, tasks, store, _LATE_S, buckets=_BUCKETS, jobs=jobs)
    return leases.finish(spark, tasks, store, B.AS_OF, _BUCKETS, jobs), store


def _transitions(spark, sf):
    return _run_ledger(spark, B.ledger(spark, sf), B.ledger_tasks(spark, sf))[0]


@query(
    "stream_lease_states",
    f"""WITH {_COMMITS} SELECT job_id, task_id, count(*) AS claims,
    count_if(outcome = 'committed')::BIGINT AS accepted, count_if(outcome = 'failed')::BIGINT AS failed,
    count_if(outcome IN ('expired', 'rejected'))::BIGINT AS expired
    FROM ls GROUP BY job_id, task_id""",
)
def stream_lease_states(spark: SparkSession, sf: str) -> DataFrame:
    t = _transitions(spark, sf)
    of = lambda kind: F.count_if(F.col("type") == kind)
    counts = t.groupBy("job_id", "task_id").agg(
        of("LEASE_CLAIMED").alias("claims"),
        of("TASK_COMMIT_ACCEPTED").alias("accepted"),
        of("TASK_ATTEMPT_FAILED").alias("failed"),
        of("LEASE_EXPIRED").alias("expired"),
    )
    return counts.filter("claims > 0")


@query(
    "stream_commits",
    f"WITH {_COMMITS} SELECT seq, job_id, task_id, lease_id, accepted, reason FROM cm",
)
def stream_commits(spark: SparkSession, sf: str) -> DataFrame:
    out = leases.stream_commits(_transitions(spark, sf))
    return out.select("seq", "job_id", "task_id", "lease_id", "accepted", "reason")


@query(
    "stream_job_states",
    f"""WITH {_COMMITS}, j AS (SELECT split_part(job_id, '-', 2)::INT * 20 + split_part(task_id, '-', 2)::INT AS n, state FROM states),
    g AS (SELECT 'job-' || (n // 3) AS job_id, count(*) AS total, count_if(state = 'COMPLETED') AS completed,
      count_if(state = 'FAILED') AS failed FROM j GROUP BY n // 3)
    SELECT job_id, CASE WHEN failed > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state FROM g WHERE completed + failed = total""",
)
def stream_job_states(spark: SparkSession, sf: str) -> DataFrame:
    """Three tasks to a job, so that jobs do come to an end."""
    number = F.split_part("job_id", F.lit("-"), F.lit(2)).cast("int") * 20
    number = number + F.split_part("task_id", F.lit("-"), F.lit(2)).cast("int")
    own = lambda df: df.withColumn("_n", number).withColumns(
        {"job_id": F.concat(F.lit("job-"), F.expr("_n div 3")), "task_id": F.concat(F.lit("task-"), "_n")}
    ).drop("_n")
    ledger = B.ledger(spark, sf).filter("type <> 'NODE_HEARTBEAT'")
    _, store = _run_ledger(spark, own(ledger), own(B.ledger_tasks(spark, sf)), jobs=True)
    return leases.job_states(spark, store)


@query(
    "stream_node_liveness",
    f"""WITH e AS (SELECT 'node-' || user_id AS node_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
    m AS {_mark("e")}, b AS (SELECT e.* FROM e, m WHERE t < w),
    l AS (SELECT *, lag(t) OVER (PARTITION BY node_id ORDER BY t) AS p, lead(t) OVER (PARTITION BY node_id ORDER BY t) AS n FROM b)
    SELECT node_id, t AS ts_us, 'ONLINE' AS change FROM l WHERE p IS NULL OR t - p >= 3600000000
    UNION ALL SELECT node_id, t + 3600000000, 'OFFLINE' FROM l, m
      WHERE (n IS NOT NULL AND n - t >= 3600000000) OR (n IS NULL AND t + 3600000000 < w)""",
)
def stream_node_liveness(spark: SparkSession, sf: str) -> DataFrame:
    beats = B.table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("node-"), F.col("user_id")).alias("node_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    live = lambda rows: keyed.node_liveness(rows, 3600.0, _delay(), _KEEP_S)
    return _fed(spark, beats, live, "liveness").select("node_id", "ts_us", "change")


@query(
    "stream_step_rate",
    f"""WITH e AS (SELECT 'run-' || (user_id % 50) AS run_id, epoch_us(ts) AS t, epoch_us(ts) / 1e6 AS ts,
      event_id // 3 + event_id % 2 * 5 AS step FROM events),
    m AS {_mark("e")}, b AS (SELECT e.* FROM e, m WHERE t < w),
    l AS (SELECT *, lag(ts) OVER w AS p, lag(step) OVER w AS ps FROM b WINDOW w AS (PARTITION BY run_id ORDER BY ts, step))
    SELECT run_id, step, round((step - ps) / (ts - p), 8) AS rate FROM l WHERE ts > p AND step > ps""",
)
def stream_step_rate(spark: SparkSession, sf: str) -> DataFrame:
    beats = B.table(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.col("user_id") % 50).alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.expr("event_id div 3") + F.col("event_id") % 2 * 5).alias("step"),
    )

    def rate(rows: DataFrame) -> DataFrame:
        seconds = rows.withColumn("ts", F.unix_micros("ts") / 1_000_000.0)
        return keyed.stream_step_rate(seconds, _delay(), _KEEP_S)

    out = _fed(spark, beats, rate, "step-rate")
    return out.select("run_id", "step", F.round("rate", 8).alias("rate"))


@query(
    "stream_close_rounds",
    f"""WITH {B.COMMITS_SQL}, e AS (SELECT round, key, epoch_us(ts) AS t FROM com),
    m AS {_mark("e")}, f AS (SELECT round, min(t) + 864000000000 AS stop FROM e, m WHERE t < w GROUP BY round),
    b AS (SELECT e.*, stop, t < stop AS inside FROM e JOIN f USING (round), m WHERE t < w),
    rk AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY t, key) AS rn FROM b WHERE inside),
    q AS (SELECT round, max(t) AS done FROM rk WHERE rn <= 5 GROUP BY round HAVING count(*) = 5)
    SELECT round, key, t AS ts_us, CASE WHEN inside AND (done IS NULL OR t <= done) THEN 'participant' ELSE 'late' END AS kind
    FROM b LEFT JOIN q USING (round)
    UNION ALL SELECT round, NULL, stop, 'quorum_not_met' FROM f LEFT JOIN q USING (round), m WHERE done IS NULL AND stop < w""",
)
def stream_close_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of five commits within ten days; some do not get them."""
    from millrace.operators.fedavg import committed_keys

    commits = committed_keys(B.round_commits(spark, sf), B.round_tasks(spark, sf)).select(
        F.col("round").cast("bigint").alias("round"), "key", F.col("ts").cast("timestamp").alias("ts")
    )
    close = lambda rows: keyed.close_rounds(rows, 5, 10 * 86400.0, _delay(), _KEEP_S)
    return _fed(spark, commits, close, "rounds").select("round", "key", "ts_us", "kind")


#: Daily snapshots come up to four days late.
_SNAPSHOT_LATE_S = 4 * 86400


@query(
    "stream_worker_changes",
    f"""WITH e AS (SELECT DISTINCT 'job-' || (user_id % 5) AS job_id,
      CAST(date_diff('day', DATE '2024-01-01', ts::DATE) AS BIGINT) AS seq, epoch_us(ts::DATE) AS t, 'w-' || user_id AS worker FROM events),
    m AS {_mark("e", _SNAPSHOT_LATE_S)}, d AS (SELECT e.* FROM e, m WHERE t < w),
    s AS (SELECT DISTINCT job_id, seq FROM d),
    n AS (SELECT job_id, seq, lead(seq) OVER (PARTITION BY job_id ORDER BY seq) AS nxt FROM s),
    c AS (SELECT job_id, n.nxt AS seq, worker, 'RAY_WORKER_LOST' AS type FROM d JOIN n USING (job_id, seq)
      WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d x WHERE x.job_id = d.job_id AND x.seq = n.nxt AND x.worker = d.worker)
    UNION ALL
    SELECT d.job_id, d.seq, d.worker, 'RAY_WORKER_REPLACED' FROM d JOIN n ON n.job_id = d.job_id AND n.nxt = d.seq
      WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.job_id = d.job_id AND x.seq = n.seq AND x.worker = d.worker))
    SELECT *, CASE WHEN type = 'RAY_WORKER_LOST' THEN 'RECOVERING' ELSE 'RUNNING' END AS job_state FROM c""",
)
def stream_worker_changes(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("ts").cast("date")
    snapshots = (
        B.table(spark, sf, "events")
        .groupBy(F.concat(F.lit("job-"), F.col("user_id") % 5).alias("job_id"), day.cast("timestamp").alias("ts"))
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("w-"), F.col("user_id")))).alias("workers"))
        .withColumn("seq", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint"))
    )
    change = lambda rows: keyed.worker_changes(rows, _delay(_SNAPSHOT_LATE_S), _KEEP_S)
    out = _fed(spark, snapshots, change, "worker-changes", _SNAPSHOT_LATE_S)
    return out.select("job_id", "seq", "worker", "type", "job_state")


@query(
    "stream_correlated_incidents",
    """WITH e AS (SELECT 'pool-' || (user_id % 5) AS pool, epoch_us(ts) AS ts_us FROM events WHERE event_type = 'error'),
    m AS (SELECT max(ts_us) - 21600000000 AS w FROM e),
    c AS (SELECT *, count(*) OVER (PARTITION BY pool ORDER BY ts_us
      RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS failures FROM e)
    SELECT pool, ts_us, failures FROM c, m WHERE ts_us <= w AND failures >= 3""",
)
def stream_correlated_incidents(spark: SparkSession, sf: str) -> DataFrame:
    f = B.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("pool-"), F.col("user_id") % 5).alias("pool"), F.col("ts").cast("timestamp").alias("ts")
    )
    store = scratch_path(spark, "incidents")
    for stream in _dealt(spark, f):
        out = windows.correlated_incidents(stream, store, 3600.0, delay_s=_LATE_S)
    return out.select("pool", F.unix_micros("ts").alias("ts_us"), "failures")


@query(
    "stream_decisions",
    f"""WITH {_FAILURES}, {_POLICY_SQL}, k2 AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'independent_tasks' ELSE 'coordinated_training' END AS mode, CASE WHEN control THEN 'control_plane_failure' WHEN preemption THEN 'preemption'
      WHEN xid THEN 'accelerator_failure' WHEN heartbeat_lost THEN 'node_loss'
      WHEN regexp_matches(lower(message), 'nccl') THEN 'communication_error'
      WHEN regexp_matches(lower(message), 's3|oss|slowdown') THEN 'storage_timeout'
      WHEN hash THEN 'artifact_corruption' WHEN exit_code <> 0 AND exit_deterministic THEN 'application_error'
      WHEN exit_code <> 0 THEN 'worker_crash' ELSE 'unknown' END AS failure_class FROM sg)
    SELECT id, failure_class, mode, action FROM k2 JOIN pol USING (failure_class, mode)""",
)
def stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    stream = _replay(B.failures(spark, sf), "failures")
    out = drain(windows.stream_decisions(stream, F.col("mode")), "decisions")
    return out.select("id", "failure_class", "mode", "action")


@query(
    "stream_telemetry_rollup",
    """WITH t AS (SELECT 'host-' || (user_id % 20) AS hostname, epoch_us(ts) // 3600000000 * 3600 AS start_s,
      CASE WHEN event_id % 5 <> 0 THEN value END AS cpu, CASE WHEN event_type = 'view' THEN value / 3 END AS gpu FROM events),
    m AS (SELECT max(epoch_us(ts)) // 1000 / 1000.0 - 60 AS w FROM events)
    SELECT hostname, CAST(start_s AS BIGINT) AS start_s, count(*) AS samples, round(avg(cpu), 9) AS cpu_percent_mean,
      round(avg(gpu), 9) AS gpu_percent_mean FROM t, m WHERE start_s + 3600 <= m.w GROUP BY hostname, start_s""",
)
def stream_telemetry_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = _events(spark, sf).select(
        F.concat(F.lit("host-"), F.col("user_id") % 20).alias("hostname"),
        "ts",
        F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("cpu_percent"),
        F.lit(50.0).alias("mem_percent"),
        F.when(F.col("event_type") == "view", F.col("value") / 3).alias("gpu_percent"),
    )
    out = drain(windows.telemetry_rollup(t, "1 hour"), "rollup")
    return out.select(
        "hostname",
        F.unix_seconds("start").alias("start_s"),
        "samples",
        rounded("cpu_percent_mean").alias("cpu_percent_mean"),
        rounded("gpu_percent_mean").alias("gpu_percent_mean"),
    )


@query(
    "stream_node_sessions",
    """WITH b AS (SELECT 'node-' || user_id AS node_id, epoch_us(ts) AS t FROM events),
    l AS (SELECT *, CASE WHEN t - lag(t) OVER w < 7200000000 THEN 0 ELSE 1 END AS n FROM b WINDOW w AS (PARTITION BY node_id ORDER BY t)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY node_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM l),
    m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 60000000 AS w FROM events)
    SELECT node_id, min(t) AS start_us, max(t) + 7200000000 AS end_us, count(*) AS beats FROM g, m
    GROUP BY node_id, s, m.w HAVING max(t) + 7200000000 <= m.w""",
)
def stream_node_sessions(spark: SparkSession, sf: str) -> DataFrame:
    beats = _events(spark, sf).select(F.concat(F.lit("node-"), F.col("user_id")).alias("node_id"), "ts")
    out = drain(windows.node_sessions(beats, "2 hours"), "sessions")
    return out.select(
        "node_id",
        F.unix_micros("start").alias("start_us"),
        F.unix_micros("end").alias("end_us"),
        "beats",
    )
