"""Checkpoint manifests: audit, validation marks, selection, lost work.

A checkpoint exists only through a manifest whose every part was registered with
the hash it expects. ``schemas.PARTS`` and ``schemas.MANIFESTS`` give the columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = ["job_id", "attempt_id", "step"]

#: A part of a step; numbers first, as they sort faster than texts.
PART = ["step", "attempt_id", "job_id", "key"]

HASH_VERIFIED = "hash_verified"
RESTORE_VERIFIED = "restore_verified"
INVALID = "invalid"


def last_registration(parts: DataFrame, values: Sequence[str] = ("sha256", "size_bytes")) -> DataFrame:
    """Latest registration of each part: a repeated upload replaces the earlier one.

    ``values`` are the columns to keep of it; each is carried through the shuffle.
    """
    return (
        parts.groupBy(*PART)
        .agg(F.max_by(F.struct(*values), "seq").alias("_p"))
        .select(*STEP, "key", "_p.*")
    )


def _with_registered(expected: DataFrame, registered: DataFrame) -> DataFrame:
    """``expected`` with the registered hash of each part as ``_got``, null where there is none.

    A left join, written as a union and a window: a join deals out both sides by all of
    its keys, whereas this leaves them where they are if parts of a step are together
    already, so keys and hashes are not shuffled once more.
    """
    named = reduce(and_, (F.col(c).isNotNull() for c in PART))  # a null is equal to none
    got = last_registration(registered, ["sha256"]).select(*PART, F.when(named, F.col("sha256")).alias("_got"))
    want = expected.withColumn("_want", F.lit(True))
    return (
        want.unionByName(got, allowMissingColumns=True)
        .withColumn("_got", F.max("_got").over(Window.partitionBy(*PART)))
        .filter("_want")
        .drop("_want")
    )


def part_problems(expected: DataFrame, registered: DataFrame) -> DataFrame:
    """Expected parts that are missing or whose hash differs, one row each."""
    problem = F.when(
        F.col("_got").isNull(), F.concat(F.lit("missing part "), "key")
    ).when(F.col("_got") != F.col("sha256"), F.concat(F.lit("hash mismatch for "), "key"))
    return (
        _with_registered(expected, registered)
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select("manifest_id", *STEP, "key", "problem")
    )


def audit_manifests(manifests: DataFrame, expected: DataFrame, registered: DataFrame) -> DataFrame:
    """Verdict per offered manifest: committed (hash verified) or rejected.

    Counts rather than lists: a manifest may name any number of parts.
    :func:`part_problems` has the details.
    """
    counts = (
        _with_registered(expected, registered)
        .groupBy("manifest_id")
        .agg(
            F.count(F.lit(1)).alias("_parts"),
            F.count_if(F.col("_got").isNull()).alias("_missing"),
            F.count_if(F.col("_got") != F.col("sha256")).alias("_mismatched"),
        )
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return (
        manifests.join(counts, "manifest_id", "left")
        .withColumn("parts", n("_parts"))
        .withColumn("missing", n("_missing"))
        .withColumn("mismatched", n("_mismatched"))
        .withColumn(
            "committed",
            (F.col("parts") > 0) & (F.col("missing") == 0) & (F.col("mismatched") == 0),
        )
        .withColumn("validation", F.when(F.col("committed"), HASH_VERIFIED))
        .drop("_parts", "_missing", "_mismatched")
    )


def apply_validation(manifests: DataFrame, marks: DataFrame) -> DataFrame:
    """Raise or withdraw manifests by ``marks``: ``manifest_id, mark, seq``.

    A quarantined manifest is never selectable again, whatever comes later.
    """
    verdict = marks.groupBy("manifest_id").agg(
        F.bool_or(F.col("mark") == INVALID).alias("_invalid"),
        F.max_by("mark", "seq").alias("_mark"),
    )
    return (
        manifests.join(verdict, "manifest_id", "left")
        .withColumn(
            "validation",
            F.when(F.col("_invalid"), INVALID).otherwise(F.coalesce("_mark", "validation")),
        )
        .drop("_invalid", "_mark")
    )


def latest_valid(
    manifests: DataFrame, world_size: int | None = None, require_restore_verified: bool = False
) -> DataFrame:
    """The manifest recovery would restore, one per job.

    Highest step; a tie goes to a restore-verified manifest, then to the newest.
    ``compatible_world_sizes`` defaults to the manifest's own world size.
    """
    accepted = [RESTORE_VERIFIED] if require_restore_verified else [HASH_VERIFIED, RESTORE_VERIFIED]
    usable = manifests.filter(F.col("validation").isin(accepted))
    if world_size is not None:
        sizes = F.coalesce("compatible_world_sizes", F.array("world_size"))
        usable = usable.filter(F.array_contains(sizes, world_size))
    rank = F.struct("step", F.col("validation") == RESTORE_VERIFIED, "created", "manifest_id")
    kept = [c for c in manifests.columns if c != "job_id"]
    return (
        usable.groupBy("job_id").agg(F.max_by(F.struct(*kept), rank).alias("_m")).select("job_id", "_m.*")
    )


def _to_rank(manifests: DataFrame, world_size: int | None = None) -> DataFrame:
    """The columns by which :func:`latest_valid` chooses: it carries all that it is given."""
    sizes = [] if world_size is None else ["world_size", "compatible_world_sizes"]
    return manifests.select("job_id", "manifest_id", "step", "validation", "created", *sizes)


def lost_work(failures: DataFrame, manifests: DataFrame, world_size: int | None = None) -> DataFrame:
    """Steps lost if each failure restored now; NULL where nothing can be restored."""
    best = latest_valid(_to_rank(manifests, world_size), world_size).select(
        "job_id", "manifest_id", F.col("step").alias("restore_step")
    )
    lost = F.greatest(F.lit(0).cast("bigint"), F.col("failed_at_step") - F.col("restore_step"))
    return failures.join(best, "job_id", "left").withColumn(
        "lost_steps", F.when(F.col("restore_step").isNotNull(), lost)
    )


def checkpoint_timeline(manifests: DataFrame) -> DataFrame:
    """Manifests by job and step, the one recovery would pick marked."""
    best = latest_valid(_to_rank(manifests)).select("manifest_id", F.lit(True).alias("_best"))
    return (
        manifests.join(best, "manifest_id", "left")
        .withColumn("latest_valid", F.coalesce("_best", F.lit(False)))
        .drop("_best")
        .orderBy("job_id", "step", "manifest_id")
    )
