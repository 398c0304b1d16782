"""Lease-ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace import schemas
from millrace.operators import ledger as L
from millrace.queries import query, rounded

_L = B.LEDGER_SQL


def _leased(spark, sf):
    events, tasks = B.ledger(spark, sf), B.ledger_tasks(spark, sf)
    return events, tasks, L.leases(events, tasks, B.AS_OF)


def _commits(spark, sf):
    events, tasks = B.ledger(spark, sf), B.ledger_tasks(spark, sf)
    return L.commits(events, L.judged_leases(events, tasks, B.AS_OF))


def _us(column: str):
    return F.unix_micros(column).alias(column + "_us")


@query(
    "lease_attempts",
    f"""WITH {_L} SELECT job_id, task_id, lease_id, node_id, CAST(attempt AS INTEGER) AS attempt_number,
    epoch_us(claim_ts) AS started_us, outcome, outcome = 'committed' AS accepted,
    CASE WHEN outcome <> 'running' THEN epoch_us(end_ts) END AS finished_us FROM ls""",
)
def lease_attempts(spark: SparkSession, sf: str) -> DataFrame:
    _, _, leased = _leased(spark, sf)
    a = L.attempts(leased)
    return a.select(
        *L.LEASE, "node_id", "attempt_number", _us("started"), _us("finished"), "outcome", "accepted"
    )


@query(
    "lease_deadlines",
    f"""WITH {_L} SELECT job_id, task_id, lease_id, epoch_us(last_beat) AS last_beat_us,
    epoch_us(deadline) AS deadline_us FROM ls0""",
)
def lease_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    d = L.deadlines(B.ledger(spark, sf), B.ledger_tasks(spark, sf))
    return d.select(*L.LEASE, _us("last_beat"), _us("deadline"))


@query(
    "lease_expired",
    f"""WITH {_L} SELECT job_id, task_id, lease_id, node_id, epoch_us(deadline) AS deadline_us
    FROM ls WHERE outcome IN ('expired', 'rejected')""",
)
def lease_expired(spark: SparkSession, sf: str) -> DataFrame:
    _, _, leased = _leased(spark, sf)
    return L.expired_leases(leased).select(*L.LEASE, "node_id", _us("deadline"))


@query(
    "task_states",
    f"""WITH {_L} SELECT job_id, task_id, state, attempts AS attempts_used, max_attempts,
    last_node AS node_id, CASE WHEN state = 'LEASED' THEN epoch_us(last_deadline) END AS deadline_us
    FROM states""",
)
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    _, tasks, leased = _leased(spark, sf)
    s = L.task_states(leased, tasks, B.AS_OF)
    return L.task_view(s).select(
        *L.TASK, "state", "attempts_used", "max_attempts", "node_id", _us("deadline")
    )


@query(
    "job_states",
    f"""WITH {_L} SELECT job_id, count(*) AS total,
    count_if(state = 'PENDING')::BIGINT AS pending, count_if(state = 'LEASED')::BIGINT AS leased,
    count_if(state = 'COMPLETED')::BIGINT AS completed, count_if(state = 'FAILED')::BIGINT AS failed,
    0::BIGINT AS cancelled,
    CASE WHEN count_if(state IN ('PENDING', 'LEASED')) > 0 THEN 'RUNNING'
         WHEN count_if(state = 'FAILED') > 0 THEN 'FAILED'
         WHEN count_if(state = 'COMPLETED') = count(*) THEN 'SUCCEEDED' ELSE 'CANCELLED' END AS state
    FROM states GROUP BY job_id""",
)
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    _, tasks, leased = _leased(spark, sf)
    return L.job_states(L.task_states(leased, tasks, B.AS_OF))


_COMMITS = f"""{_L},
wn AS (SELECT job_id, task_id, cseq AS wseq FROM ls WHERE outcome = 'committed'),
cm AS (SELECT o.seq, o.job_id, o.task_id, o.lease_id, o.node_id, o.ts,
  coalesce(o.seq = w.wseq, false) AS accepted,
  CASE WHEN o.seq = w.wseq THEN NULL
       WHEN l.lease_id IS NULL THEN 'unknown_lease'
       WHEN w.wseq IS NOT NULL AND o.seq > w.wseq THEN 'duplicate'
       WHEN l.closed AND l.cseq = o.seq THEN 'invalid_output' ELSE 'late' END AS reason
  FROM ledger o LEFT JOIN ls1 l ON l.lease_id = o.lease_id
  LEFT JOIN wn w ON w.job_id = o.job_id AND w.task_id = o.task_id
  WHERE o.type = 'COMMIT_OFFERED')"""


@query(
    "commits",
    f"""WITH {_COMMITS} SELECT seq, job_id, task_id, lease_id, node_id, accepted, reason FROM cm""",
)
def commits(spark: SparkSession, sf: str) -> DataFrame:
    return _commits(spark, sf).drop("ts")


@query(
    "commit_credit",
    f"""WITH {_COMMITS} SELECT node_id, count(*) AS accepted_tasks FROM cm WHERE accepted GROUP BY node_id""",
)
def commit_credit(spark: SparkSession, sf: str) -> DataFrame:
    return L.accepted_by_node(_commits(spark, sf))


@query(
    "node_view",
    f"""WITH {_COMMITS},
reg AS (SELECT DISTINCT 'node-' || user_id AS node_id FROM events),
hb AS (SELECT 'node-' || user_id AS node_id, max(ts) AS last FROM events
       WHERE event_type = 'purchase' GROUP BY user_id),
cr AS (SELECT node_id, count(*) AS n FROM cm WHERE accepted GROUP BY node_id)
SELECT r.node_id, epoch_us(h.last) AS last_heartbeat_us,
  coalesce(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(h.last) < 15000000, false) AS online,
  round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(h.last)) / 1000000.0::DOUBLE, 1) AS last_heartbeat_age_s,
  coalesce(c.n, 0) AS accepted_tasks
FROM reg r LEFT JOIN hb h USING (node_id) LEFT JOIN cr c USING (node_id)""",
)
def node_view(spark: SparkSession, sf: str) -> DataFrame:
    registered = B.table(spark, sf, "events").select(
        F.concat(F.lit("node-"), F.col("user_id")).alias("node_id")
    ).distinct()
    view = L.node_view(registered, B.node_beats(spark, sf), _commits(spark, sf), B.AS_OF)
    return view.select(
        "node_id", _us("last_heartbeat"), "online", "last_heartbeat_age_s", "accepted_tasks"
    )


@query(
    "live_scope",
    f"""WITH {_L} SELECT last_node AS node_id, job_id, task_id FROM states WHERE state = 'LEASED'""",
)
def live_scope(spark: SparkSession, sf: str) -> DataFrame:
    _, _, leased = _leased(spark, sf)
    return L.live_scope(leased, B.AS_OF)


_REC = f"""{_L},
rec AS (SELECT n.job_id, n.task_id, n.attempt, d.node_id AS dead_node, n.node_id,
  (epoch_us(n.claim_ts) - epoch_us(d.last_beat)) / 1e6 AS mttd_s,
  CASE WHEN n.outcome = 'committed' THEN (epoch_us(n.end_ts) - epoch_us(n.claim_ts)) / 1e6 END AS mttr_s
  FROM ls n JOIN ls d ON n.job_id = d.job_id AND n.task_id = d.task_id AND n.attempt = d.attempt + 1
  WHERE d.outcome IN ('expired', 'rejected'))"""


@query(
    "lease_recoveries",
    f"""WITH {_REC} SELECT job_id, task_id, CAST(attempt AS INTEGER) AS attempt, dead_node, node_id,
    round(mttd_s, 6) AS mttd_s, round(mttr_s, 6) AS mttr_s FROM rec""",
)
def lease_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    _, _, leased = _leased(spark, sf)
    r = L.recoveries(leased)
    return r.select(
        *L.TASK,
        "attempt",
        "dead_node",
        "node_id",
        F.round("mttd_s", 6).alias("mttd_s"),
        F.round("mttr_s", 6).alias("mttr_s"),
    )


@query(
    "lease_recovery_latency",
    f"""WITH {_REC}, u AS (SELECT 'mttd_s' AS metric, mttd_s AS v FROM rec
      UNION ALL SELECT 'mttr_s', mttr_s FROM rec)
    SELECT metric, count(v) AS repeats, round(quantile_cont(v, 0.5), 4) AS p50,
      round(quantile_cont(v, 0.95), 4) AS p95, 7202.0::DOUBLE AS mttd_bound_s FROM u GROUP BY metric""",
)
def lease_recovery_latency(spark: SparkSession, sf: str) -> DataFrame:
    _, tasks, leased = _leased(spark, sf)
    r = L.recovery_latency(leased, tasks)
    return r.select(
        "metric", "repeats", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "mttd_bound_s"
    )


@query(
    "event_counts",
    f"""WITH {_L} SELECT job_id, type, count(*) AS events FROM ledger
    WHERE type <> 'NODE_HEARTBEAT' GROUP BY job_id, type""",
)
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.event_counts(B.ledger(spark, sf))


@query(
    "evidence_rollup",
    f"""WITH {_L} SELECT l.node_id, count(*) AS attempts,
    round(avg(CASE WHEN l.claim_seq % 4 <> 0 THEN e.value END), 9) AS wall_seconds_mean,
    round(avg(CASE WHEN l.claim_seq % 5 <> 0 THEN e.value / 5 END), 9) AS gpu_util_percent_mean,
    count(CASE WHEN l.claim_seq % 5 <> 0 THEN 1 END) AS gpu_measured,
    round(avg((epoch_us(l.end_ts) - epoch_us(l.claim_ts)) / 1e6), 9) AS observed_seconds_mean
    FROM ls l JOIN events e ON e.event_id = l.claim_seq WHERE l.outcome <> 'running' GROUP BY l.node_id""",
)
def evidence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    _, _, leased = _leased(spark, sf)
    seen = B.table(spark, sf, "events").select(F.col("event_id").alias("claim_seq"), "value")
    ended = leased.filter(F.col("outcome") != "running").join(seen, "claim_seq")
    evidence = ended.select(
        "node_id",
        F.when(F.col("claim_seq") % 4 != 0, F.col("value")).alias("wall_seconds"),
        F.lit(None).cast("double").alias("cpu_percent_mean"),
        F.when(F.col("claim_seq") % 5 != 0, F.col("value") / 5).alias("gpu_util_percent_mean"),
        L.seconds_between(F.col("claim_ts"), F.col("ended_at")).alias("observed_seconds"),
    )
    out = L.evidence_rollup(evidence)
    return out.select(
        "node_id",
        "attempts",
        rounded("wall_seconds_mean").alias("wall_seconds_mean"),
        rounded("gpu_util_percent_mean").alias("gpu_util_percent_mean"),
        "gpu_measured",
        rounded("observed_seconds_mean").alias("observed_seconds_mean"),
    )


@query(
    "folded_events",
    f"""WITH {_L}, r AS (SELECT CASE WHEN event_id % 5 <> 0 THEN 'job-' || (event_id // 100) END AS job_id,
      CASE WHEN event_id % 7 = 0 THEN 'NONSENSE' ELSE 'ITERATION_COMPLETED' END AS type FROM events),
    u AS (SELECT job_id, type FROM ledger WHERE type <> 'NODE_HEARTBEAT'
      UNION ALL SELECT job_id, type FROM r WHERE job_id IS NOT NULL AND type <> 'NONSENSE')
    SELECT job_id, type, count(*) AS events FROM u GROUP BY job_id, type""",
)
def folded_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    reported = B.table(spark, sf, "events").select(
        F.when(k % 5 != 0, F.concat(F.lit("job-"), F.expr("event_id div 100"))).alias("job_id"),
        F.when(k % 7 == 0, "NONSENSE").otherwise("ITERATION_COMPLETED").alias("type"),
        "ts",
    )
    folded, _ = L.fold_events(B.ledger(spark, sf), reported, schemas.EVENT_TYPES)
    return L.event_counts(folded)


@query(
    "last_holders",
    f"WITH {_L} SELECT job_id, task_id, last_node AS node_id FROM states WHERE attempts > 0",
)
def last_holders(spark: SparkSession, sf: str) -> DataFrame:
    _, _, leased = _leased(spark, sf)
    return L.last_holder(leased)


@query(
    "event_feed",
    f"WITH {_L} SELECT seq, job_id, type FROM ledger WHERE type <> 'NODE_HEARTBEAT'",
)
def event_feed(spark: SparkSession, sf: str) -> DataFrame:
    return L.event_feed(B.ledger(spark, sf)).select("seq", "job_id", "type")
