"""Logistic regression by step-indexed SGD with exact resume.

The batch of step ``t`` is the rows ``((t - 1) * B + i) mod n``, so a step needs no
random state and a resumed run repeats the uninterrupted one. A step is one
aggregation over the rows of its batch; sensible batches hold thousands of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import log_loss, sigmoid
from millrace.operators.arrays import matrix


@dataclass
class LogisticFit:
    weights: list[float]
    bias: float
    step: int
    final_loss: float | None = None
    checkpoints: list[tuple[int, list[float], float]] = field(default_factory=list)

    def checkpoint_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.checkpoints, "step int, weights array<double>, bias double"
        )


def score(features: Column, weights: list[float], bias: float) -> Column:
    """``features . weights + bias``, one matrix product per batch."""
    w = np.asarray(weights, dtype=np.float64)

    @F.pandas_udf("double")
    def logits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield pd.Series(_product(matrix(pa.array(values, pa.list_(pa.float64()))), w) + bias)

    return logits(features.cast("array<double>"))


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    if len(x) and x.shape[1] != len(w):
        raise ValueError(f"rows have {x.shape[1]} features, the model {len(w)}")
    return x @ w if len(x) else np.empty(0)


def _gradient(rows: DataFrame, weights: list[float], bias: float) -> list[float]:
    """Sums over the rows ``features, label, _w`` of the errors and of error times
    feature: one vector per batch, added element by element."""
    w = np.asarray(weights, dtype=np.float64)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("features"))
            z = np.clip(_product(x, w) + bias, -700, 700)
            times = np.asarray(batch.column("_w"), dtype=np.float64)
            error = times * (1 / (1 + np.exp(-z)) - np.asarray(batch.column("label"), dtype=np.float64))
            sums = [float(error.sum()), *(error @ x).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["sums"])

    src = rows.select(
        F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"), "_w"
    )
    flat = src.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
    return [r["x"] for r in flat.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]


def mean_log_loss(df: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """One row: mean clipped logistic loss over the whole frame."""
    p = sigmoid(score(F.col("features"), weights, bias))
    return df.agg(F.avg(log_loss(F.col("label"), p)).alias("loss"))


def _batch(df: DataFrame, step: int, batch: int, n: int) -> DataFrame:
    """Rows of a step with their multiplicity; index ranges, so cached blocks prune."""
    base = ((step - 1) * batch) % n
    idx = F.col("idx")
    if batch >= n:
        k = F.pmod(idx - base, F.lit(n))
        times = F.floor((F.lit(batch - 1) - k) / n) + 1
        return df.withColumn("_w", times.cast("double"))
    inside = idx.between(base, base + batch - 1)
    if base + batch > n:
        inside = inside | (idx < base + batch - n)
    return df.filter(inside).withColumn("_w", F.lit(1.0))


def logistic_sgd(
    df: DataFrame,
    steps: int,
    lr: float = 0.1,
    batch: int = 4096,
    checkpoint_every: int = 100,
    checkpoint_path: str | None = None,
    start: tuple[int, list[float], float] | None = None,
) -> LogisticFit:
    """Fit on ``df``: ``idx`` (dense, from zero), ``features``, ``label`` (0 or 1).

    Checkpoints are kept every ``checkpoint_every`` steps except at the last one,
    and written below ``checkpoint_path`` if given.
    """
    spark = df.sparkSession
    cached = df.select("idx", "features", "label").repartitionByRange("idx").sortWithinPartitions(
        "idx"
    )
    cached = cached.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = cached.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")
        ).first()
        n, d = first["n"], first["d"]
        if not n:
            raise ValueError("no rows to fit")
        at, w, b = start if start is not None else (0, [0.0] * d, 0.0)
        w, b = list(w), float(b)
        fit = LogisticFit(w, b, at)
        for step in range(at + 1, steps + 1):
            sums = _gradient(_batch(cached, step, batch, n), w, b)
            b -= lr * sums[0] / batch
            w = [v - lr * g / batch for v, g in zip(w, sums[1:])]
            if checkpoint_every and step % checkpoint_every == 0 and step < steps:
                fit.checkpoints.append((step, list(w), b))
                if checkpoint_path:
                    spark.createDataFrame(
                        [(step, w, b)], "step int, weights array<double>, bias double"
                    ).write.mode("overwrite").parquet(f"{checkpoint_path}/step={step}")
        fit.weights, fit.bias, fit.step = w, b, steps
        fit.final_loss = mean_log_loss(cached, w, b).first()["loss"]
        return fit
    finally:
        cached.unpersist()


def logistic_resume(spark: SparkSession, checkpoint_path: str) -> tuple[int, list[float], float]:
    """Newest checkpoint as ``(step, weights, bias)`` for ``logistic_sgd(start=...)``."""
    row = (
        spark.read.parquet(checkpoint_path)
        .agg(F.max_by(F.struct("step", "weights", "bias"), "step").alias("c"))
        .first()["c"]
    )
    return int(row["step"]), [float(x) for x in row["weights"]], float(row["bias"])
