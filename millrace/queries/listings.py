"""Ordered lists, documents read back from files, and runs that go on after a stop.

The position of a row in an ordered list is a column, so that the order is compared too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import checkpoint_files as CF
from millrace.operators import ledger as L
from millrace.operators import sizing as Z
from millrace.operators.kmeans import initial_centroids
from millrace.operators.ordered import with_index
from millrace.plans.sgd import logistic_resume, logistic_sgd
from millrace.queries import query
from millrace.queries.fitting import _LR, _STEPS, _sgd_sql
from millrace.queries.leases import _commits
from millrace.queries.sizing import _RANKED, _Z
from millrace.session import scratch_path
from millrace.sources import files
from millrace.sources.artifacts import put_artifacts
from millrace.streaming.runner import drain
from millrace.streaming.windows import stream_checkpoints


def _positions(ordered: DataFrame) -> DataFrame:
    """``position`` of each row, from 0, in the order in which the frame has them."""
    return with_index(ordered.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "position").drop("_at")


def _put(rows: DataFrame, path: str) -> str:
    put_artifacts(rows, path).agg(F.count(F.lit(1))).collect()
    return path


# -- lists --------------------------------------------------------------------


@query(
    "node_list",
    "SELECT 'node-' || user_id AS node_id, row_number() OVER (ORDER BY 'node-' || user_id) - 1 AS position "
    "FROM (SELECT DISTINCT user_id FROM events)",
)
def node_list(spark: SparkSession, sf: str) -> DataFrame:
    registered = B.table(spark, sf, "events").select(F.concat(F.lit("node-"), F.col("user_id")).alias("node_id")).distinct()
    view = L.node_view(registered, B.node_beats(spark, sf), _commits(spark, sf), B.AS_OF)
    return _positions(L.node_list(view)).select("node_id", "position")


@query(
    "job_list",
    """SELECT job_id, row_number() OVER (ORDER BY created DESC, job_id) - 1 AS position
    FROM (SELECT 'job-' || (event_id // 100) AS job_id, min(ts) AS created FROM events GROUP BY 1)""",
)
def job_list(spark: SparkSession, sf: str) -> DataFrame:
    job = F.concat(F.lit("job-"), F.expr("event_id div 100")).alias("job_id")
    jobs = B.table(spark, sf, "events").groupBy(job).agg(F.min("ts").alias("created"))
    return _positions(L.job_list(jobs)).select("job_id", "position")


@query(
    "event_order",
    """SELECT event_id AS seq, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS position
    FROM events WHERE event_type <> 'purchase'""",
)
def event_order(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(L.event_feed(B.ledger(spark, sf))).select("seq", "position")


@query(
    "job_events",
    """SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events
    WHERE event_type <> 'purchase' AND event_id // 100 = (SELECT max(event_id) // 200 FROM events)""",
)
def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events of one job, from a ledger store that is cut by day."""
    path = scratch_path(spark, "ledger")
    files.append_events(B.ledger(spark, sf), path)
    middle = B.table(spark, sf, "events").agg(F.expr("max(event_id) div 200")).first()[0]
    found = files.events_for(spark.read.parquet(path), f"job-{middle}")
    return _positions(found).select("seq", "position")


@query(
    "ranked_candidates",
    f"""WITH {_RANKED} SELECT request_id, name, CAST(rank AS INTEGER) AS rank,
    lead(name) OVER (PARTITION BY request_id ORDER BY rank) AS runner_up FROM rk""",
)
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = Z.rank_candidates(Z.candidates(B.sizing_requests(spark, sf)))
    return out.select("request_id", "name", "rank", "runner_up")


@query(
    "ordered_candidates",
    f"""WITH {_Z}, k AS (SELECT request_id, status, workers, name, count(*) AS same FROM cd GROUP BY ALL)
    SELECT request_id, status, workers, name, same, rank() OVER (ORDER BY request_id,
      list_position(['selected', 'feasible', 'rejected_policy', 'rejected_dominated', 'infeasible'], status), workers, name) - 1 AS place
    FROM k""",
)
def ordered_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with equal names of a request are one row, at the first one's place."""
    rows = Z.candidates(B.sizing_requests(spark, sf)).select("request_id", "status", "workers", "name")
    kinds = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("same"))
    return _positions(Z.order_candidates(kinds)).withColumnRenamed("position", "place")


@query(
    "call_latency",
    """SELECT CASE event_type WHEN 'view' THEN 'claim' ELSE 'heartbeat' END AS kind, count(*) AS calls,
    round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
    round(max(value), 6) AS max_ms FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""",
)
def call_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Values of views and clicks as the milliseconds of claims and heartbeats."""
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "heartbeat")
    calls = B.table(spark, sf, "events").select(kind.alias("kind"), (F.col("value") / 1000.0).alias("seconds"))
    out = L.call_latency(calls.filter("kind IS NOT NULL"))
    return out.select("kind", "calls", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "max_ms")])


@query("initial_centroids", "SELECT 8::BIGINT AS centers, 8::BIGINT AS found, 8::BIGINT AS same_again")
def initial_centers(spark: SparkSession, sf: str) -> DataFrame:
    """Eight rows of the table, the same ones each time."""
    points = B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )
    first, again = (initial_centroids(points, 8, seed=3) for _ in range(2))
    asked = spark.createDataFrame([(c, d) for c, d in zip(first, again)], "features array<double>, again array<double>")
    held = asked.join(points.select("features").distinct(), "features", "left_semi")
    return held.agg(
        F.countDistinct("features").alias("centers"), F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("features") == F.col("again")).alias("same_again"),
    )


# -- documents ----------------------------------------------------------------


def _runs(spark: SparkSession, sf: str) -> str:
    """A run document for every supplier; some are torn, some of another contract."""
    s = F.col("s_suppkey")
    attempts = F.transform(
        F.sequence(F.lit(0), (s % 3).cast("int")),
        lambda k: F.struct(F.concat(F.lit("a"), k).alias("attempt_id"), F.lit("RUNNING").alias("state")),
    )
    body = F.to_json(
        F.struct(
            F.when(s % 7 == 0, "other").otherwise("viewer_v1").alias("contract"), F.lit("RUNNING").alias("state"),
            attempts.alias("attempts"),
        )
    )
    torn = F.when(s % 5 == 0, F.expr("substring(body, 1, 20)")).otherwise(F.col("body"))
    key = F.concat(F.lit("run-"), s, F.lit("/run.json")).alias("key")
    rows = B.table(spark, sf, "supplier").withColumn("body", body).select(key, F.encode(torn, "UTF-8").alias("body"))
    return _put(rows, scratch_path(spark, "runs"))


@query(
    "run_documents",
    """SELECT 'run-' || s_suppkey AS run, CASE WHEN s_suppkey % 5 = 0 THEN 'unreadable' WHEN s_suppkey % 7 = 0 THEN 'foreign contract' END AS error,
    CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN s_suppkey % 3 + 1 END AS attempts FROM supplier""",
)
def run_documents(spark: SparkSession, sf: str) -> DataFrame:
    run = F.regexp_extract("path", r"([^/]+)/run\.json\z", 1).alias("run")
    runs, rejects = files.read_runs(spark, _runs(spark, sf), "run.json")
    attempts, _, _ = files.run_parts(runs)
    made = attempts.groupBy(run).agg(F.lit(None).cast("string").alias("error"), F.count(F.lit(1)).alias("attempts"))
    return made.unionByName(rejects.select(run, "error", F.lit(None).cast("bigint").alias("attempts")))


@query(
    "rank_heartbeats",
    """SELECT 'att-' || (s_suppkey // 8) AS attempt_id, CAST(s_suppkey % 8 AS INTEGER) AS rank, s_suppkey * 3 AS step
    FROM supplier WHERE s_suppkey % 6 <> 0""",
)
def rank_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """Eight ranks to an attempt; every sixth file is torn."""
    s = F.col("s_suppkey")
    attempt, rank = F.concat(F.lit("att-"), F.expr("s_suppkey div 8")), (s % 8).cast("int")
    body = F.to_json(F.struct(attempt.alias("attempt_id"), rank.alias("rank"), (s * 3).cast("bigint").alias("step")))
    body = F.when(s % 6 == 0, F.substring(body, 1, 12)).otherwise(body)
    key = F.concat(attempt, F.lit("/ranks/rank-"), rank, F.lit(".json")).alias("key")
    path = _put(B.table(spark, sf, "supplier").select(key, F.encode(body, "UTF-8").alias("body")), scratch_path(spark, "ranks"))
    return files.read_ranks(spark, path).select("attempt_id", "rank", "step")


def _checkpoints(spark: SparkSession, sf: str) -> str:
    """A step folder for every thousand parts of the table: two parts, one of them empty, and
    a manifest; in every third the manifest states another hash, every fifth is torn."""
    step = F.expr("p_partkey div 1000").cast("bigint").alias("step")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), ",")
    steps = B.table(spark, sf, "part").groupBy(step).agg(body.alias("body"))
    told = F.when(F.col("step") % 3 == 1, F.lit("0" * 64)).otherwise(F.sha2(F.encode("body", "UTF-8"), 256))
    part = lambda key, sha, size: F.struct(F.lit(key).alias("key"), sha.alias("sha256"), size.cast("bigint").alias("size_bytes"))
    manifest = F.to_json(
        F.struct(
            F.concat(F.lit("ck-"), "step").alias("manifest_id"), F.lit("job").alias("job_id"), F.lit("a0").alias("attempt_id"), "step",
            F.lit(1).alias("world_size"), F.array(F.lit(1)).alias("compatible_world_sizes"),
            F.array(part("rank0.pt", told, F.octet_length("body")), part("rank1.pt", F.sha2(F.lit(b""), 256), F.lit(0))).alias("parts"),
            F.lit("registered").alias("validation"), F.lit("2024-01-01T00:00:00Z").alias("created"),
        )
    )
    manifest = F.when(F.col("step") % 5 == 4, F.substring(manifest, 1, 30)).otherwise(manifest)
    of = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    each = F.inline(F.array(of("rank0.pt", F.col("body")), of("rank1.pt", F.lit("")), of("manifest.json", manifest)))
    rows = steps.select("step", each).select(
        F.concat(F.lit("step-"), "step", F.lit("/"), "name").alias("key"), F.encode("text", "UTF-8").alias("body")
    )
    return _put(rows, scratch_path(spark, "checkpoint-files"))


_STEPS_SQL = "st AS (SELECT DISTINCT p_partkey // 1000 AS step FROM part)"


@query(
    "checkpoint_documents",
    f"WITH {_STEPS_SQL} SELECT step, 'ck-' || step AS manifest_id, 2::BIGINT AS parts FROM st WHERE step % 5 <> 4",
)
def checkpoint_documents(spark: SparkSession, sf: str) -> DataFrame:
    read = files.read_manifests(spark, _checkpoints(spark, sf))
    return read.select("step", "manifest_id", F.size("parts").cast("bigint").alias("parts"))


@query(
    "checkpoint_report",
    f"""WITH {_STEPS_SQL}, v AS (SELECT step, step % 3 <> 1 AS good FROM st WHERE step % 5 <> 4)
    SELECT step, CASE WHEN good THEN 'hash_verified' ELSE 'invalid' END AS validation, 60.0::DOUBLE AS age_s,
    step = (SELECT max(step) FROM v WHERE good) AS latest_valid, row_number() OVER (ORDER BY step) - 1 AS position FROM v""",
)
def checkpoint_report(spark: SparkSession, sf: str) -> DataFrame:
    report = CF.checkpoint_report(spark, _checkpoints(spark, sf), "2024-01-01 00:01:00")
    return _positions(report).select("step", "validation", "age_s", "latest_valid", "position")


@query(
    "new_checkpoints",
    """WITH s AS (SELECT p_partkey // 1000 AS step, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS body FROM part GROUP BY 1)
    SELECT step, sha256(body) AS sha256, strlen(body)::BIGINT AS size_bytes FROM s""",
)
def new_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that appear in two goes, each picked up once."""
    step = F.expr("p_partkey div 1000").alias("step")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), ",")
    rows = B.table(spark, sf, "part").groupBy(step).agg(body.alias("body")).select(
        "step", F.concat(F.lit("step-"), "step", F.lit(".json")).alias("key"), F.encode("body", "UTF-8").alias("body")
    )
    path, base = scratch_path(spark, "new-checkpoints"), scratch_path(spark, "picked-up")
    for rest in (0, 1):
        _put(rows.filter(F.col("step") % 2 == rest).select("key", "body"), path)
        out = drain(stream_checkpoints(spark, path), "picked-up", base)
    return out.select("step", "sha256", "size_bytes")


# -- stopped runs -------------------------------------------------------------


@query("logistic_resumed", f"SELECT * FROM ({_sgd_sql()}) WHERE step = {_STEPS}")
def logistic_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A fit that stops after five steps and goes on from its last written checkpoint ends
    where an unbroken one does."""
    data = with_index(B.labelled(spark, sf), ["id"])
    batch = -(-data.count() // _STEPS)
    path = scratch_path(spark, "fit")
    logistic_sgd(data, _STEPS - 1, lr=_LR, batch=batch, checkpoint_every=2, checkpoint_path=path)
    fit = logistic_sgd(data, _STEPS, lr=_LR, batch=batch, start=logistic_resume(spark, path))
    return spark.range(1).select(
        F.lit(fit.step).alias("step"), *[F.round(F.lit(fit.weights[i]), 9).alias(f"w{i}") for i in range(3)],
        F.round(F.lit(fit.bias), 9).alias("bias"), F.round(F.lit(fit.final_loss), 9).alias("loss"),
    )
