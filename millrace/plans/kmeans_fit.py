"""K-means to a fixed number of iterations.

Every iteration is one aggregation over the cached points. The driver holds the
``k`` centroids and receives ``k`` rows of sums; no point ever reaches it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.kmeans import Centroids, initial_centroids, partial_stats


class MissingShards(RuntimeError):
    """A shard the caller expects holds no points."""


@dataclass
class KMeansFit:
    centroids: list[list[float]]
    history: list[dict] = field(default_factory=list)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(h["iteration"], h["inertia"], h["movement"], h["duration_s"]) for h in self.history],
            "iteration int, inertia double, movement double, duration_s double",
        )


def kmeans_fit(
    points: DataFrame,
    k: int,
    iterations: int = 5,
    init: Centroids | None = None,
    seed: int = 0,
    expected_shards: int | None = None,
) -> KMeansFit:
    cached = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if expected_shards is not None:
            found = cached.agg(F.countDistinct("shard")).first()[0]
            if found != expected_shards:
                raise MissingShards(f"expected {expected_shards} shards, found {found}")
        centers = [list(map(float, c)) for c in (init or initial_centroids(cached, k, seed))]
        if len(centers) != k:
            raise ValueError(f"{k} clusters need {k} starting points, got {len(centers)}")
        fit = KMeansFit(centers)
        for t in range(iterations):
            started = time.monotonic()
            rows = partial_stats(cached, fit.centroids, by_shard=False).collect()
            updated = [list(c) for c in fit.centroids]
            inertia = 0.0
            for r in rows:
                inertia += r["inertia"]
                if r["count"]:
                    updated[r["cluster"]] = [s / r["count"] for s in r["sums"]]
            moved = math.sqrt(
                sum((a - b) ** 2 for o, n in zip(fit.centroids, updated) for a, b in zip(o, n))
            )
            fit.centroids = updated
            fit.history.append(
                {
                    "iteration": t,
                    "inertia": inertia,
                    "movement": moved,
                    "duration_s": round(time.monotonic() - started, 3),
                }
            )
        return fit
    finally:
        cached.unpersist()
