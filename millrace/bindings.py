"""How the provided tables become operator inputs.

Each function is a plain projection or join of whole tables; the matching SQL
constants let an oracle query start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A provided table; zone-less timestamps become instants (the session is UTC)."""
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    for field in df.schema:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


# -- points -------------------------------------------------------------------


def embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") % 8).cast("int").alias("shard"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def lineitem_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_suppkey") % 8).cast("int").alias("shard"),
        F.array(
            F.col("l_quantity"),
            F.col("l_extendedprice") / 1000.0,
            F.col("l_discount"),
            F.col("l_tax"),
        ).alias("features"),
    )


#: Starting centers for the line-item points, chosen by hand across the range.
LINEITEM_CENTERS = [
    [5.0, 10.0, 0.02, 0.02],
    [20.0, 30.0, 0.04, 0.04],
    [35.0, 60.0, 0.06, 0.04],
    [45.0, 90.0, 0.08, 0.06],
]


# -- federated rounds ---------------------------------------------------------


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    """One update per embedding, split into a 6x8 matrix and a bias of 16.

    Every seventeenth one is a thousand times too large, so the cap has work.
    """
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("round"),
        F.col("vec_id").alias("position"),
        F.concat(F.lit("task-"), F.col("vec_id")).alias("task_id"),
        (F.lit(1) + F.col("vec_id") % 50).alias("samples"),
        ((F.col("vec_id") % 100) / 100.0).alias("loss"),
        F.transform(
            F.col("embedding").cast("array<double>"),
            lambda x: F.when(F.col("vec_id") % 17 == 0, x * 1000.0).otherwise(x),
        ).alias("_v"),
    )
    params = F.array(
        F.struct(
            F.lit("w").alias("param"),
            F.array(F.lit(6), F.lit(8)).alias("shape"),
            F.slice("_v", 1, 48).alias("data"),
        ),
        F.struct(
            F.lit("b").alias("param"),
            F.array(F.lit(16)).alias("shape"),
            F.slice("_v", 49, 16).alias("data"),
        ),
    )
    return e.select("*", F.inline(params)).drop("_v")


CONTRIBUTIONS_SQL = """
con AS (SELECT label AS round, vec_id AS position, 'task-' || vec_id AS task_id,
               1 + vec_id % 50 AS samples, (vec_id % 100) / 100.0::DOUBLE AS loss,
               list_transform(CAST(embedding AS DOUBLE[]),
                 lambda x: CASE WHEN vec_id % 17 = 0 THEN x * 1000.0::DOUBLE ELSE x END) AS v
        FROM embeddings),
nrm AS (SELECT round, position, task_id, samples, loss, v,
               sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM con),
cap AS (SELECT round, 3.0::DOUBLE * quantile_cont(norm, 0.5) AS cap,
               sum(samples) AS total FROM nrm GROUP BY round),
clp AS (SELECT n.*, c.cap, c.total,
               CASE WHEN norm > cap THEN cap / norm ELSE 1.0::DOUBLE END AS scale
        FROM nrm n JOIN cap c USING (round))
"""


def round_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of five events each, twenty to a job; a job is one round."""
    task = F.expr("event_id div 5")
    return (
        table(spark, sf, "events")
        .select(task.alias("t"))
        .distinct()
        .select(
            F.expr("t div 20").alias("round"),
            F.concat(F.lit("job-"), F.expr("t div 20")).alias("job_id"),
            F.concat(F.lit("task-"), F.col("t")).alias("task_id"),
            F.when(F.col("t") % 9 == 0, "FAILED").otherwise("COMPLETED").alias("state"),
        )
    )


def round_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads: sign-up events, some of them below the task's own folder."""
    t = F.expr("event_id div 5")
    job = F.concat(F.lit("job-"), F.expr("event_id div 5 div 20"))
    folder = F.concat(F.lit("jobs/"), job, F.lit("/task-"), t)
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type") == "signup")
        .select(
            job.alias("job_id"),
            F.when(F.col("user_id") % 7 == 0, F.concat(folder, F.lit("/extra/metrics.json")))
            .otherwise(F.concat(folder, F.lit("/metrics.json")))
            .alias("key"),
            "ts",
        )
    )


COMMITS_SQL = """
tk AS (SELECT DISTINCT event_id // 5 AS t FROM events),
tasks AS (SELECT t // 20 AS round, 'job-' || (t // 20) AS job_id, 'task-' || t AS task_id,
                 CASE WHEN t % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS state,
                 'jobs/job-' || (t // 20) || '/task-' || t || '/metrics.json' AS key FROM tk),
ups AS (SELECT 'job-' || (event_id // 5 // 20) AS job_id,
               'jobs/job-' || (event_id // 5 // 20) || '/task-' || (event_id // 5) ||
               CASE WHEN user_id % 7 = 0 THEN '/extra/metrics.json' ELSE '/metrics.json' END AS key,
               ts FROM events WHERE event_type = 'signup'),
com AS (SELECT t.round, t.job_id, t.task_id, t.key, min(u.ts) AS ts
        FROM tasks t JOIN ups u USING (job_id, key) WHERE t.state = 'COMPLETED'
        GROUP BY ALL)
"""


# -- lease ledger -------------------------------------------------------------

#: End of the data: every event is visible.
AS_OF = "2024-01-31 00:00:00"
#: Lease length of even tasks and of odd ones.
LEASE_SECONDS = (7200.0, 60.0)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ledger rows: five events to a task, twenty tasks to a job.

    view claims, click renews, signup offers a commit, error reports a failure.
    A request names the task's newest claim; a task never has more than five
    rows, so the window below stays that small.
    """
    e = table(spark, sf, "events")
    task = F.expr("event_id div 5")
    newest_claim = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(
        Window.partitionBy("_t").orderBy("event_id")
    )
    return (
        e.withColumn("_t", task)
        .withColumn("lease_id", F.concat(F.lit("ls-"), newest_claim))
        .filter("event_type <> 'purchase'")
        .select(*_ledger_columns(), "lease_id")
    )


def _ledger_columns():
    kind = (
        F.when(F.col("event_type") == "view", "LEASE_CLAIMED")
        .when(F.col("event_type") == "click", "LEASE_RENEWED")
        .when(F.col("event_type") == "signup", "COMMIT_OFFERED")
        .when(F.col("event_type") == "error", "TASK_ATTEMPT_FAILED")
        .otherwise("NODE_HEARTBEAT")
    )
    return [
        F.col("event_id").alias("seq"),
        F.concat(F.lit("job-"), F.expr("event_id div 100")).alias("job_id"),
        F.concat(F.lit("task-"), F.expr("(event_id div 5) % 20")).alias("task_id"),
        F.concat(F.lit("node-"), F.col("user_id")).alias("node_id"),
        kind.alias("type"),
        F.col("ts"),
        (F.col("event_id") % 11 != 0).alias("output_valid"),
    ]


def ledger_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    return (
        table(spark, sf, "events")
        .select(F.expr("event_id div 5").alias("t"))
        .distinct()
        .select(
            F.concat(F.lit("job-"), F.expr("t div 20")).alias("job_id"),
            F.concat(F.lit("task-"), t % 20).alias("task_id"),
            (F.lit(1) + t % 3).cast("int").alias("max_attempts"),
            F.when(t % 2 == 0, LEASE_SECONDS[0])
            .otherwise(LEASE_SECONDS[1])
            .alias("lease_seconds"),
        )
    )


def node_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as heartbeats of the buying node."""
    return (
        table(spark, sf, "events")
        .filter("event_type = 'purchase'")
        .select(
            F.concat(F.lit("node-"), F.col("user_id")).alias("node_id"),
            "ts",
            F.col("event_id").alias("seq"),
        )
    )


LEDGER_SQL = """
ledger AS (SELECT event_id AS seq, 'job-' || (event_id // 100) AS job_id,
  'task-' || ((event_id // 5) % 20) AS task_id, 'node-' || user_id AS node_id, ts,
  CASE event_type WHEN 'view' THEN 'LEASE_CLAIMED' WHEN 'click' THEN 'LEASE_RENEWED'
    WHEN 'signup' THEN 'COMMIT_OFFERED' WHEN 'error' THEN 'TASK_ATTEMPT_FAILED'
    ELSE 'NODE_HEARTBEAT' END AS type,
  event_id % 11 <> 0 AS output_valid,
  'ls-' || max(CASE WHEN event_type = 'view' THEN event_id END)
    OVER (PARTITION BY event_id // 5 ORDER BY event_id) AS lease_id
  FROM events),
tasks AS (SELECT DISTINCT 'job-' || (event_id // 100) AS job_id,
  'task-' || ((event_id // 5) % 20) AS task_id,
  CAST(1 + (event_id // 5) % 3 AS INTEGER) AS max_attempts,
  CASE WHEN (event_id // 5) % 2 = 0 THEN 7200 ELSE 60 END AS lease_s FROM events),
cl AS (SELECT l.*, row_number() OVER w AS attempt FROM ledger l WHERE type = 'LEASE_CLAIMED'
       WINDOW w AS (PARTITION BY job_id, task_id ORDER BY seq)),
gr AS (SELECT c.job_id, c.task_id, c.lease_id, c.node_id, c.ts AS claim_ts, c.seq AS claim_seq,
         c.attempt, t.max_attempts, t.lease_s,
         lead(c.seq) OVER w AS next_seq, lead(c.ts) OVER w AS next_ts
       FROM cl c JOIN tasks t USING (job_id, task_id) WHERE c.attempt <= t.max_attempts
       WINDOW w AS (PARTITION BY c.job_id, c.task_id ORDER BY c.seq)),
bt AS (SELECT g.lease_id, g.lease_s, b.ts, lag(b.ts) OVER (PARTITION BY g.lease_id ORDER BY b.seq) AS pts
       FROM gr g JOIN ledger b USING (lease_id) WHERE b.type IN ('LEASE_CLAIMED', 'LEASE_RENEWED')),
dl AS (SELECT lease_id, coalesce(min(CASE WHEN ts >= pts + to_seconds(lease_s) THEN pts END), max(ts))
         AS last_beat FROM bt GROUP BY lease_id),
cz AS (SELECT lease_id, arg_min(type, seq) AS ctype, arg_min(output_valid, seq) AS cvalid,
         min(seq) AS cseq, arg_min(ts, seq) AS cts, count_if(type = 'COMMIT_OFFERED') AS offers
       FROM ledger WHERE type IN ('COMMIT_OFFERED', 'TASK_ATTEMPT_FAILED') AND lease_id IS NOT NULL
       GROUP BY lease_id),
ls0 AS (SELECT g.*, d.last_beat, d.last_beat + to_seconds(g.lease_s) AS deadline, c.*EXCLUDE lease_id,
          coalesce(c.cts < d.last_beat + to_seconds(g.lease_s)
                   AND (g.next_seq IS NULL OR c.cseq < g.next_seq), false) AS closed
        FROM gr g JOIN dl d USING (lease_id) LEFT JOIN cz c USING (lease_id)),
ls1 AS (SELECT *, CASE WHEN closed AND ctype = 'COMMIT_OFFERED' AND cvalid THEN 'committed'
          WHEN closed THEN 'failed' WHEN coalesce(offers, 0) > 0 THEN 'rejected'
          WHEN next_seq IS NOT NULL OR deadline <= TIMESTAMP '2024-01-31 00:00:00' THEN 'expired'
          ELSE 'running' END AS outcome,
          CASE WHEN closed THEN cts ELSE least(deadline, coalesce(next_ts, deadline)) END AS end_ts
        FROM ls0),
ls AS (SELECT * FROM (SELECT *, min(CASE WHEN outcome = 'committed' THEN attempt END)
         OVER (PARTITION BY job_id, task_id) AS won FROM ls1)
       WHERE won IS NULL OR attempt <= won),
st AS (SELECT t.job_id, t.task_id, t.max_attempts, count(l.attempt) AS attempts,
         max(l.won) AS won, arg_max(l.outcome, l.attempt) AS last_outcome,
         arg_max(l.node_id, l.attempt) AS last_node, arg_max(l.deadline, l.attempt) AS last_deadline,
         arg_max(l.deadline > TIMESTAMP '2024-01-31 00:00:00' AND NOT l.closed, l.attempt) AS live
       FROM tasks t LEFT JOIN ls l USING (job_id, task_id) GROUP BY ALL),
states AS (SELECT *, CASE WHEN won IS NOT NULL THEN 'COMPLETED'
         WHEN attempts > 0 AND live THEN 'LEASED'
         WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'PENDING' END AS state FROM st)
"""


# -- failures -----------------------------------------------------------------

#: First lines put before document text, chosen by ``event_id % 6``.
LOG_HEADS = [
    "NameError: name x is not defined",
    "2026 WARNING ImportError: x",
    "Traceback (most recent call last):",
    "Traceback (most recent call last): ChildFailedError",
    "worker lost",
    "pkg.mod.ModuleNotFoundError: No module named y",
]
MESSAGES = ["", "", "NCCL watchdog timeout on rank 3", "S3 slowdown", "training loss is nan", ""]


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Error events with a log: a head line and the whole text of a document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    errors = table(spark, sf, "events").filter("event_type = 'error'")
    n = table(spark, sf, "documents").count()
    keyed = errors.withColumn("doc_id", F.col("event_id") % n)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 6).cast("int"))
    every = lambda k: F.col("event_id") % k == 0
    return keyed.join(docs, "doc_id", "left").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("pool-"), F.col("user_id") % 5).alias("pool"),
        "ts",
        (F.col("event_id") % 4).cast("int").alias("exit_code"),
        F.concat_ws("\n", pick(LOG_HEADS), "text").alias("log"),
        pick(MESSAGES).alias("message"),
        every(13).alias("heartbeat_lost"),
        every(29).alias("preemption_notice"),
        every(31).alias("xid_event"),
        every(37).alias("control_plane_unreachable"),
        every(41).alias("hash_mismatch"),
        F.when(every(2), "independent_tasks").otherwise("coordinated_training").alias("mode"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FAILURES_SQL = f"""
err AS (SELECT e.*, e.event_id % (SELECT count(*) FROM documents) AS doc_id FROM events e
        WHERE event_type = 'error'),
fl AS (SELECT e.event_id AS id, 'pool-' || (e.user_id % 5) AS pool, e.ts,
  CAST(e.event_id % 4 AS INTEGER) AS exit_code,
  ({_sql_list(LOG_HEADS)})[e.event_id % 6 + 1] || coalesce(chr(10) || d.text, '') AS log,
  ({_sql_list(MESSAGES)})[e.event_id % 6 + 1] AS message,
  e.event_id % 13 = 0 AS heartbeat_lost, e.event_id % 29 = 0 AS preemption,
  e.event_id % 31 = 0 AS xid, e.event_id % 37 = 0 AS control, e.event_id % 41 = 0 AS hash,
  CASE WHEN e.event_id % 2 = 0 THEN 'independent_tasks' ELSE 'coordinated_training' END AS mode
  FROM err e LEFT JOIN documents d ON d.doc_id = e.doc_id),
sg AS (SELECT *, exit_code <> 0 AND (
    regexp_matches(log, '(?m)^(?:\\w+\\.)*(?:SyntaxError|IndentationError|ImportError|ModuleNotFoundError|NameError|AttributeError)(?::|$)')
    OR (contains(log, 'Traceback (most recent call last):') AND NOT contains(log, 'ChildFailedError'))) AS exit_deterministic,
  count(*) OVER (PARTITION BY pool ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS concurrent_failures
  FROM fl),
kl AS (SELECT *, CASE WHEN concurrent_failures >= 3 THEN 'correlated_incident'
  WHEN control THEN 'control_plane_failure' WHEN preemption THEN 'preemption'
  WHEN xid THEN 'accelerator_failure' WHEN heartbeat_lost THEN 'node_loss'
  WHEN regexp_matches(lower(message), 'nccl|rccl|gloo|rendezvous|allreduce|all_reduce|process group') THEN 'communication_error'
  WHEN regexp_matches(lower(message), 's3|oss|minio|object store|storage timeout|slowdown') THEN 'storage_timeout'
  WHEN hash THEN 'artifact_corruption'
  WHEN exit_code <> 0 AND exit_deterministic THEN 'application_error'
  WHEN exit_code <> 0 THEN 'worker_crash' ELSE 'unknown' END AS failure_class FROM sg)
"""


# -- checkpoints --------------------------------------------------------------


def _manifest_ids() -> list[Column]:
    """``manifest_id, job_id, attempt_id`` of an order."""
    return [
        F.concat(F.lit("ck-"), "o_orderkey").alias("manifest_id"),
        F.concat(F.lit("job-"), F.col("o_custkey")).alias("job_id"),
        F.concat(F.lit("a"), F.col("o_orderkey") % 3).alias("attempt_id"),
    ]


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        *_manifest_ids(),
        o.alias("step"),
        (F.lit(1) + o % 4).cast("int").alias("world_size"),
        F.when(o % 2 == 0, F.array((F.lit(1) + o % 4).cast("int"), F.lit(8))).alias(
            "compatible_world_sizes"
        ),
        F.col("o_orderdate").alias("created"),
    )


def _line_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their orders as they are: texts are made after the shuffle."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "key", F.concat_ws("-", F.lit("part"), "l_linenumber", "l_partkey", "l_suppkey")
    )


def _part_hash() -> Column:
    return F.sha2(F.col("l_partkey").cast("string"), 256)


def expected_parts(spark: SparkSession, sf: str) -> DataFrame:
    # Names and hashes are one to one with these, which are smaller.
    parts = _line_parts(spark, sf).select("o_orderkey", "o_custkey", "l_partkey", "key").distinct()
    return parts.select(
        *_manifest_ids(), F.col("o_orderkey").alias("step"), "key", _part_hash().alias("sha256")
    )


def registered_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads: returned lines never arrive, some arrive damaged and a few of those
    are uploaded again."""
    damaged = F.col("l_suppkey") % 37 == 0
    good, bad = _part_hash(), F.sha2("key", 256)
    upload = lambda sha, seq: F.struct(sha.alias("sha256"), F.lit(seq).cast("bigint").alias("seq"))
    uploads = (
        F.when(damaged & (F.col("o_orderkey") % 2 == 0), F.array(upload(bad, 1), upload(good, 2)))
        .when(damaged, F.array(upload(bad, 1)))
        .otherwise(F.array(upload(good, 1)))
    )
    arrived = _line_parts(spark, sf).filter("l_returnflag <> 'R'")
    _, job, attempt = _manifest_ids()
    step, size = F.col("o_orderkey").alias("step"), F.col("l_quantity").cast("bigint").alias("size_bytes")
    return arrived.select(job, attempt, step, "key", size, F.inline(uploads))


def validation_marks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .filter("o_orderstatus IN ('P', 'F')")
        .select(
            F.concat(F.lit("ck-"), F.col("o_orderkey")).alias("manifest_id"),
            F.when(F.col("o_orderstatus") == "P", "restore_verified")
            .otherwise("invalid")
            .alias("mark"),
            F.col("o_orderkey").alias("seq"),
        )
    )


MANIFESTS_SQL = """
mf AS (SELECT 'ck-' || o_orderkey AS manifest_id, 'job-' || o_custkey AS job_id,
  'a' || (o_orderkey % 3) AS attempt_id, o_orderkey AS step,
  CAST(1 + o_orderkey % 4 AS INTEGER) AS world_size,
  CASE WHEN o_orderkey % 2 = 0 THEN [1 + o_orderkey % 4, 8] ELSE [1 + o_orderkey % 4] END AS sizes,
  o_orderdate AS created, o_orderstatus FROM orders),
ex AS (SELECT DISTINCT m.manifest_id, m.step, concat_ws('-', 'part', l_linenumber, l_partkey, l_suppkey) AS key,
  l_partkey, l_suppkey, l_returnflag FROM lineitem l JOIN mf m ON m.step = l.l_orderkey),
rg AS (SELECT DISTINCT step, key, l_suppkey % 37 = 0 AND step % 2 <> 0 AS bad FROM ex WHERE l_returnflag <> 'R'),
pp AS (SELECT DISTINCT e.manifest_id, e.step, e.key, r.key IS NULL AS missing, coalesce(r.bad, false) AS bad
       FROM ex e LEFT JOIN rg r USING (step, key)),
au AS (SELECT m.*, count(p.key) AS parts, coalesce(count_if(p.missing), 0)::BIGINT AS missing,
         coalesce(count_if(p.bad), 0)::BIGINT AS mismatched FROM mf m LEFT JOIN pp p USING (manifest_id) GROUP BY ALL),
va AS (SELECT *, parts > 0 AND missing = 0 AND mismatched = 0 AS committed FROM au),
vd AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'invalid' WHEN o_orderstatus = 'P' THEN 'restore_verified'
         ELSE 'hash_verified' END AS validation FROM va WHERE committed),
lv AS (SELECT * FROM vd WHERE validation <> 'invalid'
       QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY step DESC,
         (validation = 'restore_verified') DESC, created DESC, manifest_id DESC) = 1)
"""


# -- trials and samples -------------------------------------------------------


def trials(spark: SparkSession, sf: str) -> DataFrame:
    resumed = F.col("l_linenumber") - 1
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_suppkey")).alias("run_id"),
        F.col("l_orderkey").alias("trial"),
        F.col("l_quantity").cast("bigint").alias("steps"),
        resumed.cast("bigint").alias("resumed_from"),
        F.when(F.col("l_partkey") % 5 != 0, resumed + F.col("l_partkey") % 3)
        .cast("bigint")
        .alias("crashed_at"),
    )


TRIALS_SQL = """
tr AS (SELECT 'run-' || l_suppkey AS run_id, CAST(l_quantity AS BIGINT) AS steps,
  CAST(l_linenumber - 1 AS BIGINT) AS resumed_from,
  CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_linenumber - 1 + l_partkey % 3 AS BIGINT) END AS crashed_at
  FROM lineitem)
"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("scenario"), F.col("event_id").alias("repeat"), "value"
    )


def paired_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring events form a pair; the even one is arm ``a``."""
    pair = F.expr("event_id div 2")
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), pair % 4).alias("scenario"),
        pair.alias("repeat"),
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"),
        "value",
    )


# -- placement ----------------------------------------------------------------


def placement_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """One task per order, its payload put together from the order key; some of the
    values have the wrong type on purpose."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    members = F.array_compact(
        F.array(
            F.when(k % 3 == 0, '"argv":["run"]'),
            F.when(k % 3 == 1, '"module":"m"'),
            F.when(k % 5 == 1, '"gpus":1')
            .when(k % 5 == 2, '"gpus":2')
            .when(k % 15 == 3, '"gpus":true')
            .when(k % 5 == 4, '"gpus":0'),
            F.when(k % 4 == 1, '"pool":"pool-1"')
            .when(k % 4 == 2, '"pool":"pool-2"')
            .when(k % 8 == 3, '"pool":7'),
            F.when(k % 6 == 0, text('"local_inputs":["ds-', k % 10, '"]')).when(
                k % 12 == 1, '"local_inputs":"ds-1"'
            ),
            F.when(k % 11 == 0, text('"exclude_nodes":["node-', k % 100, '"]')),
            F.when(k % 6 == 0, '"isolation":{"tier":"sandboxed","allowFallback":true}')
            .when(k % 6 == 3, '"isolation":{"tier":"sandboxed"}')
            .when(k % 3 == 2, '"isolation":{"tier":"standard"}'),
        )
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), F.expr("o_orderkey div 100")).alias("job_id"),
        F.concat(F.lit("task-"), k).alias("task_id"),
        k.alias("seq"),
        F.parse_json(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).alias("payload"),
        (k % 7).alias("priority"),
    )


def placement_nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    js = lambda c: F.parse_json(c)
    gpus = F.array_join(F.array_repeat(F.lit('{"name":"g"}'), (s % 4).cast("int")), ",")
    pools = F.array_join(
        F.array_compact(F.array(F.when(s % 2 == 0, '"pool-1"'), F.when(s % 3 == 0, '"pool-2"'))), ","
    )
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("node-"), s).alias("node_id"),
        js(F.when(s % 4 == 0, "true").when(s % 4 == 1, '"true"')).alias("argv_capable"),
        js(F.when(s % 3 == 0, "true").otherwise("1")).alias("unsandboxed_argv_capable"),
        js(F.when(s % 5 == 0, "false")).alias("module_capable"),
        js(
            F.when(s % 17 == 0, '"ds-1"').otherwise(
                F.concat(F.lit('["ds-'), s % 10, F.lit('","ds-'), (s + 1) % 10, F.lit('"]'))
            )
        ).alias("local_datasets"),
        js(
            F.when(s % 19 == 0, '"all"').otherwise(
                F.concat(F.lit('{"gpus":['), gpus, F.lit('],"pools":['), pools, F.lit("]}"))
            )
        ).alias("capabilities"),
        js(F.when(s % 2 == 0, "true")).alias("sandbox_capable"),
    )


PLACEMENT_SQL = """
pairs AS (SELECT o_orderkey AS k, s_suppkey AS s,
  (k % 3 <> 0 OR s % 4 = 0 OR (k % 6 = 0 AND k % 4 = 2 AND s % 3 = 0)) AS g_argv,
  (k % 3 <> 1 OR s % 5 <> 0) AS g_module,
  CASE WHEN k % 6 = 0 THEN s % 17 <> 0 AND (s % 10 = k % 10 OR (s + 1) % 10 = k % 10)
       WHEN k % 12 = 1 THEN false ELSE true END AS g_data,
  CASE WHEN k % 5 = 1 THEN s % 19 <> 0 AND s % 4 >= 1 WHEN k % 5 = 2 THEN s % 19 <> 0 AND s % 4 >= 2
       WHEN k % 15 = 3 THEN false ELSE true END AS g_gpus,
  (k % 11 <> 0 OR s <> k % 100) AS g_exclude,
  CASE WHEN k % 4 = 1 THEN s % 19 <> 0 AND s % 2 = 0 WHEN k % 4 = 2 THEN s % 19 <> 0 AND s % 3 = 0
       WHEN k % 8 = 3 THEN false ELSE true END AS g_pool,
  (k % 6 <> 3 OR s % 2 = 0) AS g_isolation
  FROM orders, supplier),
ok AS (SELECT *, g_argv AND g_module AND g_data AND g_gpus AND g_exclude AND g_pool AND g_isolation AS fits
       FROM pairs)
"""


def capacity_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("request_id"),
        F.when(k % 3 > 0, (k % 5).cast("int")).alias("gpus"),
        F.when(k % 4 == 0, F.concat(F.lit("TYPE-"), k % 3)).alias("gpu_type"),
        F.when(k % 2 == 0, (k % 6 * 8).cast("double")).alias("vram_gb"),
        F.when(k % 7 == 0, (k % 32).cast("int")).alias("cpus"),
        F.lit(None).cast("double").alias("memory_gb"),
        F.when(k % 5 == 0, F.concat(F.lit("region-"), k % 4)).alias("region"),
        F.when(k % 9 == 0, F.lit(900.0) + k % 50).alias("max_hourly_usd"),
        (k % 2 == 0).alias("spot_ok"),
    )


def capacity_offers(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("offer-"), p).alias("offer_id"),
        (p % 9).cast("int").alias("gpus"),
        F.concat(F.lit("type-"), p % 3).alias("gpu_type"),
        F.when(p % 10 != 0, (p % 8 * 8).cast("double")).alias("vram_gb"),
        (p % 40).cast("int").alias("cpus"),
        F.lit(64.0).alias("memory_gb"),
        F.concat(F.lit("region-"), p % 4).alias("region"),
        F.col("p_retailprice").alias("hourly_usd"),
        (p % 3 == 0).alias("spot"),
    )


OFFERS_SQL = """
rq AS (SELECT o_orderkey AS k FROM orders),
m AS (SELECT k, p_partkey AS p, p_retailprice AS usd FROM rq, part
  WHERE (k % 3 = 0 OR p_partkey % 9 >= k % 5)
    AND (k % 4 <> 0 OR p_partkey % 3 = k % 3)
    AND (k % 2 <> 0 OR (p_partkey % 10 <> 0 AND p_partkey % 8 * 8 >= k % 6 * 8))
    AND (k % 7 <> 0 OR p_partkey % 40 >= k % 32)
    AND (k % 5 <> 0 OR p_partkey % 4 = k % 4)
    AND (k % 9 <> 0 OR p_retailprice <= 900.0 + k % 50)
    AND (k % 2 = 0 OR p_partkey % 3 <> 0))
"""


# -- labelled rows ------------------------------------------------------------


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: length, language and source as numbers; label = quality."""
    return (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.array(
                F.col("n_chars") / 10000.0,
                (F.col("lang") == "en").cast("double"),
                F.col("toxic").cast("double"),
            ).alias("features"),
            F.col("quality").cast("double").alias("label"),
        )
    )


LABELLED_SQL = """
lab AS (SELECT d.doc_id AS id, row_number() OVER (ORDER BY d.doc_id) - 1 AS idx,
  d.n_chars / 10000.0::DOUBLE AS x0, (d.lang = 'en')::INTEGER::DOUBLE AS x1, l.toxic::DOUBLE AS x2,
  l.quality::DOUBLE AS y FROM labels l JOIN documents d USING (doc_id))
"""


# -- sizing requests ----------------------------------------------------------


def _choose(by: str, values: list) -> str:
    """CASE over ``by % len(values)``; the same text runs in Spark and DuckDB."""
    shown = ["NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown))
    return f"CASE ({by}) % {len(values)} {arms} END"


_LINK_NAMES = ["same_host_nvlink", "same_host_pcie", "multi_node_ib", "multi_node_100g", "multi_node_10g", "wan"]

#: Column, type and expression over ``k`` (order key) and ``j`` (its quarter).
SIZING_COLUMNS = [
    ("kind", "string", _choose("k", ["transformer_finetune", "pytorch_training", "classical_ml", "independent_tasks"])),
    ("model", "string", _choose("j", ["Qwen/Qwen2.5-7B-Instruct", "llama-3.2-1b", "gpt2", "org/custom-13b", "mistral-7b"])),
    ("parameters_b", "double", "CASE WHEN j % 10 = 8 THEN 13.0 END"),
    ("method", "string", _choose("j", ["full", "lora", "qlora"])),
    ("lora_rank", "int", "16"),
    ("precision", "string", _choose("j", ["bf16", "fp32"])),
    ("optimizer", "string", _choose("j", ["adamw", "sgd_momentum", "adamw_8bit", "adamw"])),
    ("seq_len", "int", "2048 * (1 + j % 4)"),
    ("micro_batch", "int", "1 + j % 3"),
    ("grad_accum", "int", "8"),
    ("activation_checkpointing", "boolean", "CASE WHEN j % 7 = 0 THEN true WHEN j % 7 = 1 THEN false END"),
    ("hidden_size", "int", "CASE WHEN j % 11 = 0 THEN 4096 END"),
    ("num_layers", "int", "CASE WHEN j % 11 = 0 THEN 32 END"),
    ("train_tokens_m", "double", "CASE WHEN j % 6 > 0 THEN 10 * (j % 6) END"),
    ("parameters_m", "double", "10 * (1 + j % 500)"),
    ("trainable_fraction", "double", "CASE WHEN j % 2 = 1 THEN 0.5 ELSE 1.0 END"),
    ("activation_gb", "double", "CASE WHEN j % 3 > 0 THEN j % 3 * 4 END"),
    ("est_gpu_hours", "double", "CASE WHEN j % 4 > 0 THEN j % 4 * 5 END"),
    ("dataset_mb", "double", "j % 20000 * 5"),
    ("supports_partial_fit", "boolean", "j % 2 = 0"),
    ("task_count", "int", "1 + j % 50"),
    ("est_minutes_per_task", "double", "12.0"),
    ("needs_gpu", "boolean", "j % 3 = 0"),
    ("vram_gb_per_task", "double", "j % 5 * 6"),
    ("gpus", "int", _choose("j + k", [4, 1, 2, 0, 6, 8, 1])),
    ("gpu_type", "string", _choose("j", ["RTX4090", "a100-80gb", "T4 ", "unheard-of"])),
    ("vram_gb", "double", "CASE WHEN j % 8 = 3 THEN 48.0 END"),
    ("hosts", "int", "1 + j % 3"),
    ("interconnect", "string", _choose("j + 1", _LINK_NAMES)),
    ("cpu_ram_gb", "double", "64 * (1 + j % 4)"),
    ("cpu_cores", "int", "8 + j % 9"),
    ("hourly_cost", "double", "CASE WHEN j % 5 > 0 THEN 0.44 * (j % 5) END"),
    ("mode", "string", _choose("j", ["cheapest", "fastest", "balanced", "reliable", "balanced"])),
    ("deadline_minutes", "double", "CASE WHEN j % 9 = 0 THEN 600.0 END"),
    ("max_cost_usd", "double", "CASE WHEN j % 13 = 0 THEN 50.0 END"),
    ("allow_quantization", "boolean", "j % 4 <> 2"),
    ("allow_cpu_offload", "boolean", "j % 7 <> 1"),
]


def sizing_requests(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_orderkey div 4 AS j")
    return keyed.selectExpr(
        "k AS request_id", *[f"CAST({e} AS {t}) AS {n}" for n, t, e in SIZING_COLUMNS]
    )


_DUCK = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
_REQUESTS = ", ".join(f"CAST({e} AS {_DUCK[t]}) AS {n}" for n, t, e in SIZING_COLUMNS)

SIZING_SQL = f"""
kj AS (SELECT o_orderkey AS k, o_orderkey // 4 AS j FROM orders),
rq AS (SELECT k AS request_id, {_REQUESTS} FROM kj),
mo(mk, mp, mh, ml) AS (VALUES ('qwen2.5-7b', 7.62::DOUBLE, 3584, 28), ('llama-3.2-1b', 1.24, 2048, 16),
  ('gpt2', 0.124, 768, 12), ('mistral-7b', 7.25, 4096, 32)),
gp(gk, gv, gt) AS (VALUES ('rtx4090', 24::DOUBLE, 165::DOUBLE), ('a100-80gb', 80, 312), ('t4', 16, 65)),
lk(link, bw, lat) AS (VALUES ('same_host_nvlink', 250.0::DOUBLE, 0.00001::DOUBLE), ('same_host_pcie', 20.0, 0.00002),
  ('multi_node_ib', 25.0, 0.00005), ('multi_node_100g', 10.0, 0.0001), ('multi_node_10g', 1.1, 0.0003), ('wan', 0.05, 0.03)),
rs AS (SELECT rq.*, coalesce(parameters_b, mp) AS pb, coalesce(vram_gb, gv) AS vram, coalesce(gt, 0) AS tf,
    CASE WHEN hidden_size IS NOT NULL THEN hidden_size WHEN mh IS NOT NULL THEN mh
      WHEN coalesce(parameters_b, mp) <= 16 THEN 5120 END AS hidden,
    CASE WHEN num_layers IS NOT NULL THEN num_layers WHEN ml IS NOT NULL THEN ml
      WHEN coalesce(parameters_b, mp) <= 16 THEN 40 END AS layers,
    CASE precision WHEN 'fp32' THEN 4.0::DOUBLE ELSE 2.0 END AS pby,
    CASE optimizer WHEN 'adamw' THEN 12.0::DOUBLE WHEN 'adamw_8bit' THEN 6.0 ELSE 8.0 END AS oby
  FROM rq LEFT JOIN mo ON mk = CASE model WHEN 'Qwen/Qwen2.5-7B-Instruct' THEN 'qwen2.5-7b' ELSE model END
  LEFT JOIN gp ON gk = lower(trim(gpu_type))),
wd AS (SELECT DISTINCT request_id, w FROM (SELECT request_id, gpus, unnest([1, 2, 4, gpus]) AS w FROM rs WHERE gpus >= 1)
  WHERE w = 1 OR w < gpus OR w = gpus),
fm(family, fno) AS (VALUES ('single_gpu', 0), ('ddp', 0), ('fsdp2', 1), ('zero3_cpu_offload', 2)),
tc AS (SELECT rs.*, wd.w AS world, fm.family, fm.fno, v.variant,
    CASE WHEN v.variant = 1 THEN 'qlora' ELSE method END AS um
  FROM rs JOIN wd USING (request_id) JOIN fm ON (wd.w = 1) = (fm.family = 'single_gpu')
  JOIN (VALUES (0), (1)) v(variant) ON v.variant = 0 OR (rs.kind = 'transformer_finetune' AND method = 'lora' AND allow_quantization)
  WHERE vram IS NOT NULL AND ((kind = 'transformer_finetune' AND pb IS NOT NULL
      AND (allow_cpu_offload OR family <> 'zero3_cpu_offload'))
    OR (kind = 'pytorch_training' AND family <> 'zero3_cpu_offload'))),
t0 AS (SELECT *, pb * 1e9 AS params, CASE WHEN um = 'full' THEN pb * 1e9 ELSE 8.0 * hidden * 16 * layers END AS trn,
    CASE WHEN family IN ('fsdp2', 'zero3_cpu_offload') THEN world ELSE 1 END AS sh
  FROM tc WHERE kind = 'transformer_finetune' AND NOT (family = 'fsdp2' AND um = 'qlora')),
t1 AS (SELECT *, CASE WHEN um = 'full' THEN params * pby ELSE params * CASE WHEN um = 'qlora' THEN 0.55 ELSE pby END + trn * pby END / sh
      + trn * pby / sh + CASE WHEN family = 'zero3_cpu_offload' THEN 0 ELSE trn * oby / sh END
      + CASE WHEN family IN ('fsdp2', 'zero3_cpu_offload') THEN params / layers * pby * 2 ELSE 0 END + 2.5e9 AS fixed,
    CASE WHEN family = 'zero3_cpu_offload' THEN round(trn * oby / sh / 1e9, 2) ELSE 0 END AS offload_gb,
    seq_len * micro_batch * hidden * 18.0::DOUBLE AS pl FROM t0),
t2 AS (SELECT *, round((fixed + layers * pl) / 1e9, 2) AS m0,
    round((fixed + layers * 1.0::DOUBLE * seq_len * micro_batch * hidden * 2.0 + pl) / 1e9, 2) AS m1, vram * 0.95 AS cap FROM t1),
t3 AS (SELECT *, activation_checkpointing IS NULL AND m0 > cap AND m1 <= cap AS auto FROM t2),
t4 AS (SELECT *, auto OR coalesce(activation_checkpointing, false) AS ck,
    CASE WHEN auto OR coalesce(activation_checkpointing, false) THEN m1 ELSE m0 END AS total_gb,
    CASE WHEN tf > 0 THEN 0.30 * tf * 1e12 / (6.0 * params) ELSE 0 END AS tps FROM t3),
g0 AS (SELECT *, parameters_m * 1e6 AS params, parameters_m * 1e6 * trainable_fraction AS trn,
    CASE WHEN family = 'fsdp2' THEN world ELSE 1 END AS sh, vram * 0.95 AS cap FROM tc WHERE kind = 'pytorch_training'),
g1 AS (SELECT *, round((params * pby / sh + trn * pby / sh + trn * oby / sh + (coalesce(activation_gb, 2.0) + 2.5) * 1e9) / 1e9, 2) AS total_gb FROM g0),
ab AS (SELECT request_id, kind, variant, world, fno, family, um, auto, ck, total_gb, offload_gb, cap, vram, tps, params, trn, pby, layers,
    gpus, hosts, interconnect, cpu_ram_gb, train_tokens_m, est_gpu_hours, hourly_cost, deadline_minutes, max_cost_usd, mode,
    CASE WHEN tps > 0 THEN seq_len * micro_batch / tps ELSE 0 END * CASE WHEN family IN ('ddp', 'single_gpu') THEN grad_accum ELSE 1 END AS cs FROM t4
  UNION ALL SELECT request_id, kind, variant, world, fno, family, um, false, false, total_gb, 0, cap, vram, 0, params, trn, pby, 32,
    gpus, hosts, interconnect, cpu_ram_gb, NULL, est_gpu_hours, hourly_cost, deadline_minutes, max_cost_usd, mode, 0 FROM g1),
l0 AS (SELECT *, CASE WHEN hosts = 1 OR world <= greatest(1, gpus // hosts) THEN
    CASE WHEN starts_with(interconnect, 'same_host') THEN interconnect ELSE 'same_host_pcie' END ELSE interconnect END AS link FROM ab),
l1 AS (SELECT *, CASE WHEN family IN ('ddp', 'single_gpu') THEN 2.0 * (world - 1) / world * trn * pby / (bw * 1e9) + lat
    ELSE 3.0 * params * pby * (world - 1) / world / (bw * 1e9) + 3.0 * layers * lat END AS wire FROM l0 JOIN lk USING (link)),
l2 AS (SELECT *, CASE WHEN world <= 1 THEN 1.0 WHEN cs <= 0 THEN CASE WHEN link = 'wan' THEN 0.0 ELSE 1.0 END
    ELSE cs / (cs + greatest(0, wire - 0.5 * cs)) END AS e FROM l1),
l3 AS (SELECT *, round(e, 2) AS eff, total_gb <= cap AND offload_gb <= cpu_ram_gb * 0.8 AS fits,
    CASE WHEN world <= 1 OR cs <= 0 THEN e > 0 ELSE e >= 0.5 END AS lok FROM l2),
l4 AS (SELECT *, fits AND lok AS ok, CASE WHEN fits AND lok THEN CASE WHEN kind = 'transformer_finetune' THEN
      CASE WHEN tps > 0 AND train_tokens_m > 0 THEN round(train_tokens_m * 1e6 * CASE WHEN ck THEN 1.3 ELSE 1 END * CASE WHEN um = 'qlora' THEN 1.35 ELSE 1 END
        * CASE WHEN family = 'zero3_cpu_offload' THEN 4.0 ELSE 1 END / (tps * world * greatest(0.01, eff)) / 60.0, 1) END
      ELSE round(est_gpu_hours * 60.0 / (world * greatest(0.01, eff)), 1) END END AS tm FROM l3),
l5 AS (SELECT *, round(tm / 60.0 * world * hourly_cost, 2) AS usd FROM l4),
cd AS (SELECT request_id, CASE WHEN kind = 'transformer_finetune' THEN CASE WHEN variant = 1 THEN 'qlora_' ELSE '' END || family || CASE WHEN auto THEN '+ackpt' ELSE '' END
      WHEN world = 1 OR NOT ok THEN family ELSE family || '_x' || world END AS name, world::BIGINT AS workers,
    CASE WHEN NOT ok THEN 'infeasible' WHEN coalesce(tm > deadline_minutes, false) OR coalesce(usd > max_cost_usd, false) THEN 'rejected_policy' ELSE 'feasible' END AS status,
    total_gb, CASE WHEN fits THEN eff END AS efficiency, tm AS est_time_min, usd AS est_cost_usd,
    variant, world, fno, mode, family, um = 'qlora' AS quantized, CASE WHEN ok THEN round(vram - total_gb, 2) ELSE 0 END AS headroom FROM l5
  UNION ALL SELECT request_id, 'local_process', 1, CASE WHEN dataset_mb * 3 / 1000.0 <= cpu_ram_gb * 0.8 THEN 'feasible' ELSE 'infeasible' END,
    NULL, NULL, NULL, NULL, 0, 0, 0, mode, 'local_process', false, 0 FROM rs WHERE kind = 'classical_ml'
  UNION ALL SELECT request_id, 'sharded_partial_fit', greatest(2, least(16, CASE WHEN floor(dataset_mb / 500) = 0 THEN 2 ELSE floor(dataset_mb / 500) END))::BIGINT,
    'feasible', NULL, NULL, NULL, NULL, 0, 1, 0, mode, 'sharded_partial_fit', false, 0 FROM rs WHERE kind = 'classical_ml' AND supports_partial_fit
  UNION ALL SELECT request_id, 'lease_tasks', CASE WHEN big THEN 0 ELSE slots END, CASE WHEN big THEN 'infeasible'
    WHEN coalesce(pm > deadline_minutes, false) THEN 'rejected_policy' ELSE 'feasible' END, CASE WHEN big THEN vram_gb_per_task END, NULL,
    CASE WHEN NOT big THEN round(pm, 1) END, NULL, 0, 0, 0, mode, 'lease_tasks', false, 0 FROM ti
  UNION ALL SELECT request_id, 'local_sequential', 1, CASE WHEN slots = 1 THEN 'feasible' ELSE 'rejected_dominated' END, NULL, NULL,
    round(task_count * 12.0, 1), NULL, 0, 1, 0, mode, 'local_process', false, 0 FROM ti WHERE NOT big)
""".replace("\ncd AS (", """
ts AS (SELECT *, coalesce(needs_gpu AND gpus > 0 AND vram_gb_per_task > vram * 0.95, false) AS big,
    greatest(1, least(CASE WHEN needs_gpu THEN gpus ELSE hosts * greatest(1, cpu_cores // 4) END, task_count))::BIGINT AS slots
  FROM rs WHERE kind = 'independent_tasks' AND NOT (needs_gpu AND gpus > 0 AND vram_gb_per_task > 0 AND vram IS NULL)),
ti AS (SELECT *, ceil(task_count / slots::DOUBLE) * 12.0 AS pm FROM ts),
cd AS (""")
