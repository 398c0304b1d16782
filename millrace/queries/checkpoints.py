"""Checkpoint queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import checkpoints as C
from millrace.queries import query

_M = B.MANIFESTS_SQL

#: What is ranked and returned of a manifest; with ``_SIZES`` where a topology is asked for.
_RANKED, _SIZES = ["job_id", "manifest_id", "step", "validation", "created"], ["world_size", "compatible_world_sizes"]


def _audited(spark, sf):
    return C.audit_manifests(
        B.manifests(spark, sf), B.expected_parts(spark, sf), B.registered_parts(spark, sf)
    )


def _valid(spark, sf):
    return C.apply_validation(
        _audited(spark, sf).filter("committed"), B.validation_marks(spark, sf)
    )


@query(
    "manifest_audit",
    f"WITH {_M} SELECT manifest_id, parts, missing, mismatched, committed FROM va",
)
def manifest_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).select("manifest_id", "parts", "missing", "mismatched", "committed")


@query(
    "part_problems",
    f"""WITH {_M} SELECT manifest_id, key,
    CASE WHEN missing THEN 'missing part ' || key ELSE 'hash mismatch for ' || key END AS problem
    FROM pp WHERE missing OR bad""",
)
def part_problems(spark: SparkSession, sf: str) -> DataFrame:
    out = C.part_problems(B.expected_parts(spark, sf), B.registered_parts(spark, sf))
    return out.select("manifest_id", "key", "problem")


@query(
    "manifest_validation",
    f"WITH {_M} SELECT manifest_id, job_id, step, validation FROM vd",
)
def manifest_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf).select("manifest_id", "job_id", "step", "validation")


@query(
    "latest_valid",
    f"WITH {_M} SELECT job_id, manifest_id, step, validation FROM lv",
)
def latest_valid(spark: SparkSession, sf: str) -> DataFrame:
    return C.latest_valid(_valid(spark, sf).select(*_RANKED)).select("job_id", "manifest_id", "step", "validation")


@query(
    "latest_valid_topology",
    f"""WITH {_M} SELECT job_id, manifest_id, step FROM vd
    WHERE validation = 'restore_verified' AND list_contains(sizes, 8)
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY step DESC, created DESC, manifest_id DESC) = 1""",
)
def latest_valid_topology(spark: SparkSession, sf: str) -> DataFrame:
    offered = _valid(spark, sf).select(*_RANKED, *_SIZES)
    out = C.latest_valid(offered, world_size=8, require_restore_verified=True)
    return out.select("job_id", "manifest_id", "step")


@query(
    "lost_work",
    f"""WITH {_M} SELECT 'job-' || o.o_custkey AS job_id, o.o_orderkey + 70 AS failed_at_step,
    l.step AS restore_step,
    CASE WHEN l.step IS NOT NULL THEN greatest(0, o.o_orderkey + 70 - l.step) END AS lost_steps
    FROM orders o LEFT JOIN lv l ON l.job_id = 'job-' || o.o_custkey""",
)
def lost_work(spark: SparkSession, sf: str) -> DataFrame:
    failures = B.table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), F.col("o_custkey")).alias("job_id"),
        (F.col("o_orderkey") + 70).alias("failed_at_step"),
    )
    return C.lost_work(failures, _valid(spark, sf)).drop("manifest_id")


@query(
    "checkpoint_timeline",
    f"""WITH {_M} SELECT v.job_id, v.step, v.validation, l.manifest_id IS NOT NULL AS latest_valid
    FROM vd v LEFT JOIN lv l USING (manifest_id)""",
)
def checkpoint_timeline(spark: SparkSession, sf: str) -> DataFrame:
    out = C.checkpoint_timeline(_valid(spark, sf))
    return out.select("job_id", "step", "validation", "latest_valid")
