"""Deterministic data: a shard is a function of the seed and its number only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Shard seeds, spread of the centers, width of the noise.
SHARD_SEED_FACTOR = 1_000_003
CENTER_RANGE = (-10.0, 10.0)
NOISE = 1.5
#: Rows handed to Spark at a time, so a large shard is never held as one frame.
ROWS = 65_536


def true_centers(seed: int, k: int, dims: int) -> np.ndarray:
    return np.random.default_rng(seed).uniform(*CENTER_RANGE, size=(k, dims))


def make_points(
    spark: SparkSession, seed: int, shards: int, per_shard: int, k: int, dims: int
) -> DataFrame:
    """``shard, id, features``: points around ``k`` centers. A shard that is computed
    again, on another machine, gives the same points."""
    centers = true_centers(seed, k, dims)

    def build(batches):
        for batch in batches:
            for shard in batch["id"]:
                rng = np.random.default_rng(seed * SHARD_SEED_FACTOR + int(shard))
                which = rng.integers(0, k, size=per_shard)
                # One draw per row block continues the same random sequence.
                for start in range(0, per_shard, ROWS):
                    part = which[start : start + ROWS]
                    x = centers[part] + rng.normal(0.0, NOISE, size=(len(part), dims))
                    ids = int(shard) * per_shard + np.arange(start, start + len(part))
                    yield pd.DataFrame(
                        {"shard": int(shard), "id": ids, "features": [r.tolist() for r in x]}
                    )

    return spark.range(shards).repartition(shards, "id").mapInPandas(
        build, "shard int, id bigint, features array<double>"
    )


def make_labelled(
    spark: SparkSession, seed: int, n: int, dims: int, kind: str = "separator", parts: int = 8
) -> DataFrame:
    """``id, features, label``: a linear separator (0/1) or a noisy tanh target."""
    if kind not in ("separator", "tanh"):
        raise ValueError(f"unknown kind {kind!r}")
    w = np.random.default_rng(seed).normal(size=dims)

    def build(batches):
        for batch in batches:
            for part in batch["id"]:
                rng = np.random.default_rng(seed * SHARD_SEED_FACTOR + 1 + int(part))
                ids = np.arange(int(part), n, parts)
                for start in range(0, len(ids), ROWS):
                    some = ids[start : start + ROWS]
                    x = rng.normal(size=(len(some), dims))
                    z = x @ w
                    y = (z > 0).astype(float)
                    if kind == "tanh":
                        y = np.tanh(z) + 0.05 * rng.normal(size=len(some))
                    yield pd.DataFrame({"id": some, "features": [r.tolist() for r in x], "label": y})

    return spark.range(parts).repartition(parts, "id").mapInPandas(
        build, "id bigint, features array<double>, label double"
    )

