"""Federated averaging over rounds.

A round is: train every shard from the same weights, write the contributions,
check them, reduce them, write the new weights. Only the model itself (one row
per parameter) reaches the driver, and weights are written after a round is
complete, so the newest written round is where a stopped run continues.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import all_finite
from millrace.operators import fedavg
from millrace.plans.local_update import CONTRIBUTION, LocalConfig, shard_update
from millrace.session import scratch_path, written

Weights = dict[str, np.ndarray]


class EmptyShard(ValueError):
    """A worker has nothing to train on."""


@dataclass
class FedAvgFit:
    weights: Weights
    history: list[dict] = field(default_factory=list)
    folder: str = ""

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(h["round"], h["participants"], h["mean_loss"], h["clipped"]) for h in self.history],
            "round int, participants bigint, mean_loss double, "
            "clipped array<struct<task_id:string,norm:double,cap:double,scale:double>>",
        )


def weights_frame(spark: SparkSession, weights: Weights) -> DataFrame:
    return spark.createDataFrame(
        [(k, [int(n) for n in v.shape], [float(x) for x in v.ravel()]) for k, v in weights.items()],
        "param string, shape array<int>, data array<double>",
    )


def collect_weights(df: DataFrame) -> Weights:
    """Model-sized: one row per parameter."""
    return {
        r["param"]: np.asarray(r["data"], dtype=np.float64).reshape(tuple(r["shape"]))
        for r in df.select("param", "shape", "data").collect()
    }


def stored_rounds(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/weights")
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def fedavg_resume(
    spark: SparkSession, folder: str, job_id: str = "run", rounds: list[int] | None = None
) -> tuple[int, Weights | None]:
    """``(next round, weights)`` of a stopped run; ``(0, None)`` for a fresh one.

    ``rounds`` are the rounds the caller remembers starting; by default the
    written ones. Empty or non-finite weights, and a history that starts later
    with nothing completed, are errors.
    """
    stored = stored_rounds(spark, folder)
    remembered = spark.createDataFrame([(int(r),) for r in rounds or []], "round int")
    if stored is None:
        state = remembered.select(
            "round",
            F.lit(job_id).alias("job_id"),
            F.lit(False).alias("weights_found"),
            F.lit(False).alias("empty"),
            F.lit(True).alias("finite"),
        )
    else:
        found = stored.groupBy("round").agg(
            F.coalesce(F.max(F.size("data")) <= 0, F.lit(True)).alias("empty"),
            F.bool_and(all_finite(F.col("data"))).alias("finite"),
            F.lit(True).alias("weights_found"),
        )
        state = (
            remembered.join(found, "round", "full" if rounds is None else "left")
            .withColumn("job_id", F.lit(job_id))
            .withColumn("weights_found", F.coalesce("weights_found", F.lit(False)))
            .withColumn("empty", F.coalesce("empty", F.lit(False)))
            .withColumn("finite", F.coalesce("finite", F.lit(True)))
        )
    point = fedavg.resume_point(state)
    if point["next_round"] == 0:
        return 0, None
    return point["next_round"], collect_weights(stored.filter(F.col("round") == point["next_round"] - 1))


def fedavg_fit(
    data: DataFrame,
    config: LocalConfig,
    rounds: int,
    min_participants: int = 1,
    initial: Weights | None = None,
    folder: str | None = None,
    resume: bool = False,
    clip_factor: float = fedavg.CLIP_FACTOR,
    select: Callable[[int, DataFrame], DataFrame] | None = None,
    on_round: Callable[[dict], None] | None = None,
    walk: bool = False,
    shards: int | None = None,
) -> FedAvgFit:
    """Train for ``rounds`` rounds over ``data``: ``shard, idx, features, label``.

    ``idx`` counts a shard's rows from zero. Only the rows the local steps can
    touch are sent to the workers, so a worker's share is bounded by ``config``.
    Every round begins at a shard's first row; with ``walk`` it goes on where the
    round before ended and wraps around, so that rounds come past all rows. The
    round's number says where, so a resumed run walks on like an unbroken one.
    ``shards`` states how many there must be: one without rows is an error.
    ``select`` may narrow a round's contributions to those that arrived in time.
    """
    spark = data.sparkSession
    folder = (folder or scratch_path(spark, "fedavg")).rstrip("/")
    fedavg.check_clip_factor(clip_factor)
    start, weights = (fedavg_resume(spark, folder) if resume else (0, None))
    if weights is None:
        weights = initial
    sizes = data.groupBy("shard").agg(F.count(F.lit(1)).alias("samples"))
    if shards is not None:
        held = {r["shard"] for r in sizes.select("shard").collect()}  # one row a worker
        if empty := sorted(set(range(shards)) - held):
            raise EmptyShard(f"no rows in shard {empty[0]}")
    rows = data.select("shard", "idx", "features", "label")
    if walk:
        rows = written(rows.join(sizes, "shard"), "fedavg-shards")
    else:
        rows = rows.filter(F.col("idx") < config.rows_touched).join(sizes, "shard").persist()
    fit = FedAvgFit(weights or {}, folder=folder)
    try:
        for r in range(start, rounds):
            work = _walked(rows, r, config) if walk else rows
            made = work.groupBy("shard").applyInPandas(shard_update(config, weights), CONTRIBUTION)
            sent = f"{folder}/contributions/round={r}"
            made.write.mode("overwrite").parquet(sent)
            contributions = spark.read.parquet(sent).withColumn("round", F.lit(r))
            if select is not None:
                contributions = select(r, contributions)
            weights = _close_round(
                spark, fit, r, contributions, weights, min_participants, clip_factor, folder
            )
            if on_round is not None:
                on_round(fit.history[-1])
    finally:
        if not walk:
            rows.unpersist()
    fit.weights = weights or {}
    return fit


def _walked(rows: DataFrame, r: int, config: LocalConfig) -> DataFrame:
    """The rows of round ``r``, counted from where the round before ended."""
    at = F.pmod(F.col("idx") - F.lit(r * config.rows_touched), F.col("samples"))
    return rows.withColumn("idx", at).filter(F.col("idx") < config.rows_touched)


def _close_round(spark, fit, r, contributions, weights, min_participants, clip_factor, folder):
    metrics = fedavg.round_metrics(contributions).collect()
    arrived = metrics[0]["participants"] if metrics else 0
    if arrived < min_participants:
        raise fedavg.QuorumNotMet(f"round {r}: {arrived} of {min_participants} needed")
    bad = fedavg.validate(contributions).filter(F.col("problem").isNotNull()).collect()
    if bad:
        b = bad[0]
        raise fedavg.InvalidRound(
            f"round {r}: {b['problem']} at position {b['position']}, parameter {b['param']}, "
            f"index {b['index']}"
        )
    # Norms are read off the updates once: one small row per contribution is kept.
    kept = f"{folder}/scales/round={r}"
    fedavg.clip_scales(contributions, clip_factor).drop("round").write.mode("overwrite").parquet(kept)
    scales = spark.read.parquet(kept).withColumn("round", F.lit(r))
    clipped = fedavg.clip_events(scales)
    delta = collect_weights(fedavg.weighted_mean(contributions, scales))
    new = delta if not weights else {k: v + delta[k] for k, v in weights.items()}
    for name, value in new.items():
        if not np.isfinite(value).all():
            raise fedavg.InvalidRound(f"round {r}: {name} is not finite after the update")
    weights_frame(spark, new).write.mode("overwrite").parquet(f"{folder}/weights/round={r}")
    fit.history.append(
        {
            "round": r,
            "participants": arrived,
            "mean_loss": metrics[0]["mean_loss"],
            "clipped": [
                (c["task_id"], c["norm"], c["cap"], c["scale"])
                for c in clipped.orderBy("position").collect()
            ],
        }
    )
    return new
