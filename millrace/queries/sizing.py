"""Capacity-sizing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import sizing as Z
from millrace.queries import query

_Z = B.SIZING_SQL


@query(
    "sizing_resolve",
    f"""WITH {_Z} SELECT request_id, pb AS params_b, CAST(hidden AS INTEGER) AS hidden, CAST(layers AS INTEGER) AS layers, vram, tf AS tflops,
    CASE WHEN kind = 'transformer_finetune' AND pb IS NULL THEN 'model size unknown'
      WHEN vram IS NULL AND (kind IN ('transformer_finetune', 'pytorch_training')
        OR (kind = 'independent_tasks' AND needs_gpu AND gpus > 0 AND vram_gb_per_task > 0)) THEN 'GPU memory unknown'
      WHEN kind IN ('transformer_finetune', 'pytorch_training') AND gpus < 1 THEN 'needs a GPU' END AS problem
    FROM rs""",
)
def sizing_resolve(spark: SparkSession, sf: str) -> DataFrame:
    out = Z.resolve(B.sizing_requests(spark, sf))
    return out.select("request_id", "params_b", "hidden", "layers", "vram", "tflops", "problem")


@query(
    "sizing_candidates",
    f"""WITH {_Z} SELECT request_id, name, workers, status, round(total_gb, 1) AS total_gb,
    round(efficiency, 1) AS efficiency, round(est_time_min, 0) AS est_time_min, round(est_cost_usd, 1) AS est_cost_usd FROM cd""",
)
def sizing_candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = Z.candidates(B.sizing_requests(spark, sf))
    return out.select(
        "request_id",
        "name",
        "workers",
        "status",
        F.round("total_gb", 1).alias("total_gb"),
        F.round("efficiency", 1).alias("efficiency"),
        F.round("est_time_min", 0).alias("est_time_min"),
        F.round("est_cost_usd", 1).alias("est_cost_usd"),
    )


_RANKED = f"""{_Z},
inf AS (SELECT 'infinity'::DOUBLE AS x),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
    CASE mode WHEN 'fastest' THEN coalesce(est_time_min, inf.x) WHEN 'reliable' THEN workers ELSE coalesce(est_cost_usd, inf.x) END,
    CASE mode WHEN 'fastest' THEN coalesce(est_cost_usd, inf.x) WHEN 'reliable' THEN (family = 'zero3_cpu_offload')::INTEGER ELSE coalesce(est_time_min, inf.x) END,
    CASE mode WHEN 'reliable' THEN quantized::INTEGER ELSE workers END,
    CASE mode WHEN 'reliable' THEN -headroom ELSE 0 END, variant, world, fno) AS rank
  FROM cd, inf WHERE status = 'feasible')"""


@query(
    "sizing_plans",
    f"""WITH {_RANKED}
    SELECT r.request_id, a.name AS selected, a.workers, round(a.est_time_min, 0) AS est_time_min, b.name AS runner_up,
      (SELECT count(*) FROM cd WHERE cd.request_id = r.request_id) AS candidates
    FROM rq r LEFT JOIN rk a ON a.request_id = r.request_id AND a.rank = 1
    LEFT JOIN rk b ON b.request_id = r.request_id AND b.rank = 2""",
)
def sizing_plans(spark: SparkSession, sf: str) -> DataFrame:
    out = Z.select_plans(B.sizing_requests(spark, sf))
    return out.select(
        "request_id",
        "selected",
        "workers",
        F.round("est_time_min", 0).alias("est_time_min"),
        "runner_up",
        "candidates",
    )


@query(
    "sizing_task_waves",
    """WITH t AS (SELECT p_partkey AS id, 1 + p_partkey % 90 AS n, 1 + p_size % 4 AS hosts, p_size AS cores FROM part),
    s AS (SELECT *, greatest(1, least(hosts * greatest(1, cores // 4), n))::BIGINT AS slots FROM t)
    SELECT id, slots, CAST(ceil(n / slots::DOUBLE) AS BIGINT) AS waves, ceil(n / slots::DOUBLE) * 12.5 AS parallel_min FROM s""",
)
def sizing_task_waves(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = B.table(spark, sf, "part").select(
        p.alias("id"),
        (F.lit(1) + p % 90).alias("task_count"),
        (F.lit(1) + F.col("p_size") % 4).alias("hosts"),
        F.col("p_size").alias("cpu_cores"),
        F.lit(False).alias("needs_gpu"),
        F.lit(0).alias("gpus"),
        F.lit(12.5).alias("est_minutes_per_task"),
    )
    return Z.task_waves(rows).select("id", "slots", "waves", "parallel_min")


@query(
    "sizing_measured",
    f"""WITH {_Z}, p AS (SELECT DISTINCT request_id, (10 + request_id % 7)::DOUBLE AS peak,
      CASE WHEN request_id % 2 = 0 THEN (30 + request_id % 11)::DOUBLE END AS minutes FROM cd WHERE request_id % 3 = 0)
    SELECT c.request_id, c.name, c.workers, round(coalesce(p.peak, c.total_gb), 1) AS total_gb,
      round(coalesce(p.minutes, c.est_time_min), 0) AS est_time_min,
      CASE WHEN p.peak IS NOT NULL THEN 'profiled' ELSE 'static' END AS basis FROM cd c LEFT JOIN p USING (request_id)""",
)
def sizing_measured(spark: SparkSession, sf: str) -> DataFrame:
    requests = B.sizing_requests(spark, sf)
    profiles = requests.filter("request_id % 3 = 0").select(
        "request_id",
        (F.lit(10) + F.col("request_id") % 7).cast("double").alias("peak_vram_gb"),
        F.when(F.col("request_id") % 2 == 0, (F.lit(30) + F.col("request_id") % 11).cast("double")).alias("est_time_min_measured"),
    )
    out = Z.prefer_measured(Z.candidates(requests), profiles, ["request_id"])
    return out.select(
        "request_id", "name", "workers", F.round("total_gb", 1).alias("total_gb"),
        F.round("est_time_min", 0).alias("est_time_min"), "basis",
    )


def _json_sql() -> str:
    """The record as JSON: the stated fields in order, those that are null left out."""
    quote = lambda n, t: f"""'"' || {n} || '"'""" if t == "string" else f"{n}::VARCHAR"
    parts = [f"""CASE WHEN {n} IS NOT NULL THEN '"{n}":' || {quote(n, t)} END""" for n, t, _ in B.SIZING_COLUMNS]
    return "'{' || array_to_string(list_filter([" + ", ".join(parts) + """, '"version":"1"'], lambda x: x IS NOT NULL), ',') || '}'"""


@query("request_digests", f"WITH {_Z} SELECT request_id, substr(sha256({_json_sql()}), 1, 16) AS digest FROM rq")
def request_digests(spark: SparkSession, sf: str) -> DataFrame:
    return Z.request_digest(B.sizing_requests(spark, sf), "1").select("request_id", "digest")
