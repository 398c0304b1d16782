"""Telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import telemetry as M
from millrace.operators.ordered import epoch_seconds
from millrace.queries import query, rounded


def _beats(spark, sf):
    """Events as rank heartbeats of the user's run; the step mostly grows."""
    return B.table(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.col("user_id") % 50).alias("run_id"),
        F.concat(F.lit("att-"), F.col("user_id")).alias("attempt_id"),
        epoch_seconds(F.col("ts")).alias("ts"),
        (F.expr("event_id div 3") + F.col("event_id") % 2 * 5).alias("step"),
        F.col("event_id").alias("line"),
        "value",
        "event_type",
    )


_BEATS = """bt AS (SELECT 'run-' || (user_id % 50) AS run_id, 'att-' || user_id AS attempt_id,
  epoch_us(ts) / 1e6 AS ts, event_id // 3 + event_id % 2 * 5 AS step, event_id AS line, value, event_type FROM events)"""


@query(
    "tail_rows",
    f"""WITH {_BEATS} SELECT attempt_id, line, step FROM bt
    QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY line DESC) <= 10""",
)
def tail_rows(spark: SparkSession, sf: str) -> DataFrame:
    return M.tail(_beats(spark, sf), ["attempt_id"], ["line"], 10).select("attempt_id", "line", "step")


@query(
    "newest_sample",
    f"""WITH {_BEATS} SELECT run_id, arg_max(attempt_id, ts) AS attempt_id, arg_max(step, ts) AS step,
    arg_max(value, ts) AS value FROM bt GROUP BY run_id""",
)
def newest_sample(spark: SparkSession, sf: str) -> DataFrame:
    return M.newest(_beats(spark, sf), ["run_id"], "ts").select("run_id", "attempt_id", "step", "value")


_RATES = f"""{_BEATS},
lg AS (SELECT *, lag(ts) OVER w AS pts, lag(step) OVER w AS pstep FROM bt
       WINDOW w AS (PARTITION BY run_id ORDER BY ts, step)),
rt AS (SELECT *, CASE WHEN ts > pts AND step > pstep THEN (step - pstep) / (ts - pts) END AS rate FROM lg)"""


@query(
    "step_rates",
    f"WITH {_RATES} SELECT run_id, line, round(rate, 8) AS rate FROM rt",
)
def step_rates(spark: SparkSession, sf: str) -> DataFrame:
    return M.step_rates(_beats(spark, sf)).select("run_id", "line", F.round("rate", 8).alias("rate"))


@query(
    "step_rate",
    f"""WITH {_RATES},
    g AS (SELECT run_id, max(ts) AS last_ts, arg_max(step, ts) AS step,
      arg_max(rate, (ts, step)) FILTER (WHERE rate IS NOT NULL) AS r FROM rt GROUP BY run_id),
    n AS (SELECT max(ts) + 3 AS now FROM bt)
    SELECT run_id, step, round(last_ts, 3) AS last_ts,
      round(CASE WHEN now - last_ts < 6 THEN r END, 8) AS steps_per_s,
      CAST(round(CASE WHEN now - last_ts < 6 THEN 1000.0 / r END) AS BIGINT) AS step_latency_ms FROM g, n""",
)
def step_rate(spark: SparkSession, sf: str) -> DataFrame:
    """As seen three seconds after the newest beat, when the last runs are still live."""
    beats = _beats(spark, sf)
    out = M.step_rate(beats, beats.agg(F.max("ts")).first()[0] + 3)
    return out.select(
        "run_id",
        "step",
        F.round("last_ts", 3).alias("last_ts"),
        F.round("steps_per_s", 8).alias("steps_per_s"),
        "step_latency_ms",
    )


@query(
    "loss_curve",
    f"""WITH {_BEATS},
    pt AS (SELECT *, CASE WHEN line % 4 = 3 THEN NULL WHEN line % 4 = 2 THEN 'accuracy' ELSE 'loss' END AS k FROM bt),
    nm AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt_id, line) - 1 AS i
           FROM pt WHERE k IS NOT NULL)
    SELECT run_id, line, k AS loss_key, value AS y,
      CAST(CASE WHEN line % 4 = 1 THEN i ELSE step END AS DOUBLE) AS x FROM nm""",
)
def loss_curve(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("step").cast("double")
    kind = F.col("line") % 4
    values = (
        F.when(kind == 0, F.create_map(F.lit("step"), step, F.lit("loss"), F.col("value")))
        .when(kind == 1, F.create_map(F.lit("other"), F.lit(1.0), F.lit("loss"), F.col("value")))
        .when(
            kind == 2,
            F.create_map(
                F.lit("step"), step, F.lit("bad"), F.lit(float("nan")), F.lit("accuracy"), F.col("value")
            ),
        )
        .otherwise(F.create_map(F.lit("step"), step, F.lit("epoch"), F.lit(1.0)))
    )
    metrics = _beats(spark, sf).withColumn("values", values).withColumnRenamed("attempt_id", "attempt")
    return M.loss_curve(metrics).select("run_id", "line", "loss_key", "y", "x")


@query(
    "mean_readings",
    f"""WITH {_BEATS}, c AS (SELECT event_type, run_id, CASE WHEN line % 5 <> 0 THEN value END AS cpu,
      CASE WHEN event_type <> 'view' THEN value / 2 END AS gpu FROM bt)
    SELECT run_id, event_type, round(avg(cpu), 9) AS cpu_mean, round(avg(gpu), 9) AS gpu_mean,
      count(cpu) AS cpu_n, count(gpu) AS gpu_n FROM c GROUP BY run_id, event_type""",
)
def mean_readings(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf).select(
        "run_id",
        "event_type",
        F.when(F.col("line") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("cpu"),
        F.when(F.col("event_type") != "view", F.col("value") / 2).alias("gpu"),
    )
    out = M.mean_readings(b, ["run_id", "event_type"], ["cpu", "gpu"])
    return out.withColumn("cpu_mean", rounded("cpu_mean")).withColumn("gpu_mean", rounded("gpu_mean"))


@query(
    "recent_attempts",
    """WITH a AS (SELECT 'run-' || (user_id % 7) AS run_id, 'att-' || user_id AS attempt_id,
      min(event_id) AS started_at FROM events GROUP BY user_id)
    SELECT run_id, attempt_id, greatest(count(*) OVER (PARTITION BY run_id) - 16, 0) AS hidden FROM a
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, attempt_id DESC) <= 16""",
)
def recent_attempts(spark: SparkSession, sf: str) -> DataFrame:
    a = B.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("started_at"))
    a = a.select(
        F.concat(F.lit("run-"), F.col("user_id") % 7).alias("run_id"),
        F.concat(F.lit("att-"), F.col("user_id")).alias("attempt_id"),
        "started_at",
    )
    return M.recent_attempts(a).drop("started_at")


@query(
    "process_descendants",
    """WITH RECURSIVE p AS (SELECT o_orderkey AS pid,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey - 1 END AS ppid,
        o_orderkey % 10 = 2 AS root FROM orders),
      t AS (SELECT pid, pid AS root_pid, CAST(0 AS BIGINT) AS depth FROM p WHERE root
        UNION ALL SELECT p.pid, t.root_pid, t.depth + 1 FROM p JOIN t ON p.ppid = t.pid WHERE NOT p.root)
    SELECT pid, root_pid, depth FROM t""",
)
def process_descendants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = B.table(spark, sf, "orders").select(
        F.expr("o_orderkey div 10").alias("sample"),
        k.alias("pid"),
        F.when(k % 10 != 0, k - 1).alias("ppid"),
        (k % 10 == 2).alias("launched"),
    )
    out = M.descendants(p, ["sample"], F.col("launched"))
    return out.select("pid", "root_pid", "depth")


@query(
    "rank_processes",
    """WITH r AS (SELECT event_id AS rank, 'att-' || (event_id % 97) AS attempt_id, event_id // 97 AS pid FROM events
      WHERE event_type <> 'view'),
    s AS (SELECT 'att-' || (event_id % 97) AS attempt_id, event_id // 97 AS pid, value AS cpu FROM events
      WHERE event_type <> 'click')
    SELECT r.rank, r.attempt_id, r.pid, s.cpu AS proc_cpu_percent FROM r LEFT JOIN s USING (attempt_id, pid)""",
)
def rank_processes(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select(
        F.col("event_id").alias("rank"),
        F.concat(F.lit("att-"), F.col("event_id") % 97).alias("attempt_id"),
        F.expr("event_id div 97").alias("pid"),
        F.col("value").alias("cpu_percent"),
        F.lit(None).cast("bigint").alias("rss_bytes"),
        "event_type",
    )
    ranks = e.filter("event_type <> 'view'").select("rank", "attempt_id", "pid")
    out = M.rank_processes(ranks, e.filter("event_type <> 'click'"))
    return out.select("rank", "attempt_id", "pid", "proc_cpu_percent")


@query(
    "kpi_snapshot",
    """WITH r AS (SELECT o_custkey % 500 AS r, min(o_orderkey) AS s, max(o_orderkey) AS f FROM orders GROUP BY 1),
    a AS (SELECT o_custkey % 500 AS r, count(*) AS attempts, count_if(o_orderkey % 3 > 0)::BIGINT AS used,
      count_if(o_orderstatus = 'O')::BIGINT AS ok, max(o_orderkey) * 2 AS step FROM orders GROUP BY 1)
    SELECT 'run-' || r AS run_id, CASE WHEN r % 2 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state,
      CAST(CASE WHEN r % 2 = 0 THEN 1000000 ELSE f END - s AS DOUBLE) AS elapsed_s, step, attempts,
      used AS restarts_used, 3 AS max_restarts, ok AS verified_checkpoints FROM r JOIN a USING (r)""",
)
def kpi_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    k, r = F.col("o_orderkey"), F.col("o_custkey") % 500
    o = B.table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), r).alias("run_id"), k, "o_orderstatus", r.alias("r")
    )
    runs = o.groupBy("run_id", "r").agg(F.min(k).alias("s"), F.max(k).alias("f")).select(
        "run_id",
        F.when(F.col("r") % 2 == 0, "RUNNING").otherwise("SUCCEEDED").alias("state"),
        F.col("s").cast("double").alias("started_at"),
        F.when(F.col("r") % 2 != 0, F.col("f").cast("double")).alias("finished_at"),
        F.lit(3).alias("max_restarts"),
    )
    base = F.concat(F.lit("task-"), k)
    attempts = o.select(
        "run_id",
        F.when(k % 3 > 0, F.concat(base, F.lit("-r"), k % 3)).otherwise(base).alias("attempt_id"),
    )
    ranks = o.select("run_id", k.alias("ts"), (k * 2).alias("step"))
    manifests = o.select(
        "run_id",
        F.when(F.col("o_orderstatus") == "O", "hash_verified").otherwise("invalid").alias("validation"),
    )
    return M.kpi_snapshot(runs, attempts, ranks, manifests, 1000000.0)


@query(
    "worker_set_changes",
    """WITH s AS (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', ts::DATE) AS BIGINT) AS iteration,
      user_id AS node FROM events), t AS (SELECT DISTINCT iteration FROM s)
    SELECT iteration + 1 AS iteration, node, 'lost' AS change FROM s
      WHERE iteration + 1 IN (SELECT iteration FROM t)
        AND (iteration + 1, node) NOT IN (SELECT (iteration, node) FROM s)
    UNION ALL SELECT iteration, node, 'joined' FROM s
      WHERE iteration - 1 IN (SELECT iteration FROM t)
        AND (iteration - 1, node) NOT IN (SELECT (iteration, node) FROM s)""",
)
def worker_set_changes(spark: SparkSession, sf: str) -> DataFrame:
    snap = B.table(spark, sf, "events").select(
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
        .cast("bigint")
        .alias("iteration"),
        F.col("user_id").alias("node"),
    )
    return M.set_changes(snap, "node", "iteration")
