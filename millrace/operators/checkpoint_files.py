"""Checkpoints on a file system: build manifests, verify them, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.checkpoints import HASH_VERIFIED, INVALID, latest_valid
from millrace.operators.ledger import instant
from millrace.operators.ordered import seconds_between
from millrace.sources.artifacts import hash_artifacts
from millrace.sources.files import read_manifests

MANIFEST = "manifest.json"


def _split_key(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_extract("key", r"^(.*)/[^/]*\z", 1).alias("folder"),
        F.regexp_extract("key", r"([^/]*)\z", 1).alias("key"),
        "size_bytes",
        "sha256",
    )


def build_parts(spark: SparkSession, root: str) -> DataFrame:
    """Every part below ``root`` with its hash: ``folder, step, key, sha256, size_bytes``.

    The folder's name ends in the step number. Manifests are not parts.
    """
    parts = _split_key(hash_artifacts(spark, root)).filter(F.col("key") != MANIFEST)
    return parts.withColumn(
        "step", F.nullif(F.regexp_extract("folder", r"(\d+)\z", 1), F.lit("")).cast("bigint")
    )


def build_manifests(parts: DataFrame, job_id: str, attempt_id: str, world_size: int = 1) -> DataFrame:
    """One manifest row per step folder; its parts stay in ``parts``, joined by folder.

    A folder without parts has no row, hence no manifest.
    """
    return parts.groupBy("folder", "step").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size_bytes").alias("size_bytes")
    ).select(
        F.concat(F.lit("ck-"), F.substring(F.sha2(F.concat(F.lit(job_id + "/"), "folder"), 256), 1, 12)).alias(
            "manifest_id"
        ),
        F.lit(job_id).alias("job_id"),
        F.lit(attempt_id).alias("attempt_id"),
        "step",
        F.lit(world_size).alias("world_size"),
        F.array(F.lit(world_size)).alias("compatible_world_sizes"),
        F.col("folder").alias("storage_prefix"),
        "parts",
        "size_bytes",
        F.lit(HASH_VERIFIED).alias("validation"),
    )


def verify_files(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Verdict per folder: every part present and hashing to what was recorded.

    ``expected``: ``folder, key, sha256``; ``stored``: ``folder, key, sha256`` as hashed now.
    """
    now = stored.select("folder", "key", F.col("sha256").alias("_now"))
    return (
        expected.join(now, ["folder", "key"], "left")
        .groupBy("folder")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.count_if(F.col("_now").isNull()).alias("missing"),
            F.count_if(F.col("_now") != F.col("sha256")).alias("mismatched"),
        )
        .withColumn("valid", (F.col("missing") == 0) & (F.col("mismatched") == 0))
    )


def checkpoint_report(spark: SparkSession, root: str, as_of, pattern: str = "step-*") -> DataFrame:
    """Manifests below ``root`` with the state they verify to now, parts, age, and the
    one recovery would pick."""
    documents = read_manifests(spark, root, pattern).withColumn(
        "folder", F.regexp_extract("folder", r"([^/]*)\z", 1)
    )
    stored = _split_key(hash_artifacts(spark, root)).withColumn(
        "folder", F.regexp_extract("folder", r"([^/]*)\z", 1)
    )
    expected = documents.select("folder", F.inline("parts"))
    verdict = verify_files(expected, stored).select("folder", "valid")
    judged = documents.join(verdict, "folder", "left").withColumn(
        "validation",
        F.when(F.coalesce("valid", F.size("parts") == 0), HASH_VERIFIED).otherwise(INVALID),
    )
    best = latest_valid(judged.drop("valid", "parts", "framework")).select(
        "job_id", F.col("folder").alias("_best")
    )
    return (
        judged.join(best, "job_id", "left")
        .select(
            "job_id",
            "step",
            "validation",
            F.size("parts").alias("parts"),
            seconds_between(F.col("created"), instant(as_of)).alias("age_s"),
            F.coalesce(F.col("folder") == F.col("_best"), F.lit(False)).alias("latest_valid"),
        )
        .orderBy("job_id", "step")
    )
