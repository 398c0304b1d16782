"""Placement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import eligibility as E
from millrace.queries import query

_P = B.PLACEMENT_SQL


@query(
    "eligible_counts",
    f"""WITH {_P} SELECT 'job-' || (k // 100) AS job_id, 'task-' || k AS task_id,
    count_if(fits)::BIGINT AS eligible_nodes FROM ok GROUP BY k""",
)
def eligible_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.eligible_counts(B.placement_tasks(spark, sf), B.placement_nodes(spark, sf))


@query(
    "unplaceable_tasks",
    f"""WITH {_P} SELECT 'job-' || (k // 100) AS job_id, 'task-' || k AS task_id
    FROM ok GROUP BY k HAVING NOT bool_or(fits)""",
)
def unplaceable_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return E.unplaceable_tasks(B.placement_tasks(spark, sf), B.placement_nodes(spark, sf))


@query(
    "first_choice",
    f"""WITH {_P} SELECT 'node-' || s AS node_id, 'job-' || (min(k) // 100) AS job_id,
    'task-' || min(k) AS task_id, min(k) AS seq FROM ok WHERE fits GROUP BY s""",
)
def first_choice(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_choice(B.placement_tasks(spark, sf), B.placement_nodes(spark, sf))


@query(
    "first_choice_scored",
    f"""WITH {_P} SELECT 'node-' || s AS node_id,
    'task-' || arg_min(k, (-(k % 7), k)) AS task_id FROM ok WHERE fits GROUP BY s""",
)
def first_choice_scored(spark: SparkSession, sf: str) -> DataFrame:
    out = E.first_choice(
        B.placement_tasks(spark, sf), B.placement_nodes(spark, sf), score="priority"
    )
    return out.select("node_id", "task_id")


@query(
    "reject_reasons",
    f"""WITH {_P}, gt AS (
      SELECT k, 'argv' AS gate, count_if(NOT g_argv) AS n FROM ok GROUP BY k
      UNION ALL SELECT k, 'module', count_if(NOT g_module) FROM ok GROUP BY k
      UNION ALL SELECT k, 'gpus', count_if(NOT g_gpus) FROM ok GROUP BY k
      UNION ALL SELECT k, 'pool', count_if(NOT g_pool) FROM ok GROUP BY k
      UNION ALL SELECT k, 'isolation', count_if(NOT g_isolation) FROM ok GROUP BY k
      UNION ALL SELECT k, 'data', count_if(NOT g_data) FROM ok GROUP BY k)
    SELECT 'task-' || k AS task_id, gate, n::BIGINT AS nodes_lacking FROM gt WHERE n > 0""",
)
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    out = E.reject_reasons(B.placement_tasks(spark, sf), B.placement_nodes(spark, sf))
    head = F.split("need", ":")
    gate = (
        F.when(head[0] == "never", head[1])
        .when(head[0] == "sandbox", "isolation")
        .otherwise(head[0])
    )
    return out.select("task_id", gate.alias("gate"), "nodes_lacking")


@query(
    "match_offers",
    f"""WITH {B.OFFERS_SQL} SELECT k AS request_id, 'offer-' || arg_min(p, (usd, 'offer-' || p)) AS offer_id,
    min(usd) AS hourly_usd FROM m GROUP BY k""",
)
def match_offers(spark: SparkSession, sf: str) -> DataFrame:
    return E.match_offers(B.capacity_requests(spark, sf), B.capacity_offers(spark, sf))
