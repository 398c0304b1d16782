"""Lloyd's K-means as Spark steps.

Points: ``id, features ARRAY<DOUBLE>[, shard]``. Centroids are ``k`` vectors, a
size the caller chooses, so they travel inside the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.vectors import sq_dist
from millrace.operators.arrays import matrix, sum_arrays

Centroids = Sequence[Sequence[float]]


def initial_centroids(points: DataFrame, k: int, seed: int = 0, id_col: str = "id"):
    """``k`` distinct rows chosen by seeded hash, listed in row order."""
    picked = (
        points.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)
        .limit(k)
        .orderBy(id_col)
        .select("features")
        .collect()
    )
    if len(picked) < k:
        raise ValueError(f"need {k} points to start from, found {len(picked)}")
    return [[float(v) for v in r["features"]] for r in picked]


def _assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center (the lowest wins a tie) and its squared distance."""
    if len(x) and x.shape[1] != centers.shape[1]:
        raise ValueError(f"points have {x.shape[1]} elements, centers {centers.shape[1]}")
    d2 = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        diff = x - c
        d2[:, j] = np.einsum("ij,ij->i", diff, diff)
    cluster = d2.argmin(axis=1)
    return cluster, d2[np.arange(len(x)), cluster]


def nearest(points: DataFrame, centroids: Centroids) -> DataFrame:
    """Add ``cluster`` (lowest index wins a tie) and squared distance ``d2``.

    Points of another length than the centers are an error.
    """
    centers = np.asarray(centroids, dtype=np.float64)

    @F.pandas_udf("cluster int, d2 double")
    def assign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for features in parts:
            x = matrix(pa.array(features, pa.list_(pa.float64())))
            cluster, d2 = _assign(x, centers)
            yield pd.DataFrame({"cluster": cluster.astype(np.int32), "d2": d2})

    found = points.withColumn("_near", assign(F.col("features").cast("array<double>")))
    return found.select(*points.columns, "_near.d2", "_near.cluster")


def _batch_stats(keys: list[str], centers: np.ndarray, schema: T.StructType):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("features"))
            cluster, best = _assign(x, centers)
            tags = [np.asarray(batch.column(k), dtype=np.int64) for k in keys] + [cluster]
            groups, tag = np.unique(np.stack(tags, axis=1), axis=0, return_inverse=True)
            tag = tag.ravel()
            sums = np.zeros((len(groups), x.shape[1] + 2))
            np.add.at(sums, tag, np.column_stack([x, np.ones(len(x)), best]))
            columns = [pa.array(groups[:, i], pa.int32()) for i in range(groups.shape[1])]
            columns.append(pa.array(sums.tolist(), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def partial_stats(
    points: DataFrame, centroids: Centroids, by_shard: bool = True
) -> DataFrame:
    """``[shard,] cluster, sums, count, inertia`` of one assignment pass.

    Every batch is reduced to one vector per (shard, cluster), its sums followed by its
    count and inertia, and only those vectors are shuffled, element by element.
    """
    dims = len(centroids[0])
    keys = ["shard"] if by_shard else []
    schema = T.StructType(
        [T.StructField(k, T.IntegerType()) for k in [*keys, "cluster"]]
        + [T.StructField("sums", T.ArrayType(T.DoubleType()))]
    )
    src = points.select(
        *[F.col(k).cast("int") for k in keys],
        F.col("features").cast("array<double>").alias("features"),
    )
    centers = np.asarray(centroids, dtype=np.float64)
    partial = src.mapInArrow(_batch_stats(keys, centers, schema), schema)
    elements = (
        partial.select(*keys, "cluster", F.posexplode("sums").alias("_pos", "_x"))
        .groupBy(*keys, "cluster", "_pos")
        .agg(F.sum("_x").alias("_x"))
    )
    totals = elements.groupBy(*keys, "cluster").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]
        ).alias("_all")
    )
    return totals.select(
        *keys,
        "cluster",
        F.slice("_all", 1, dims).alias("sums"),
        F.col("_all")[dims].cast("bigint").alias("count"),
        F.col("_all")[dims + 1].alias("inertia"),
    )


def centroid_frame(spark, centroids: Centroids) -> DataFrame:
    return spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(centroids)],
        "cluster int, features array<double>",
    )


def reduce_partials(partials: DataFrame, previous: DataFrame) -> DataFrame:
    """New centroids ``cluster, features, count, inertia``.

    A cluster that received no point keeps its previous position.
    """
    totals = partials.groupBy("cluster").agg(
        F.sum("count").alias("count"), F.sum("inertia").alias("inertia")
    )
    merged = sum_arrays(partials, ["cluster"], "sums", name="_sums").join(totals, "cluster")
    joined = previous.select("cluster", F.col("features").alias("_prev")).join(
        merged, "cluster", "left"
    )
    return joined.select(
        "cluster",
        F.when(
            F.coalesce(F.col("count"), F.lit(0)) > 0,
            F.transform("_sums", lambda s: s / F.col("count")),
        )
        .otherwise(F.col("_prev"))
        .alias("features"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.col("inertia"), F.lit(0.0)).alias("inertia"),
    )


def movement(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frobenius norm of the change between two centroid tables."""
    both = old.select("cluster", F.col("features").alias("_a")).join(
        new.select("cluster", F.col("features").alias("_b")), "cluster"
    )
    return both.agg(
        F.sqrt(F.coalesce(F.sum(sq_dist(F.col("_a"), F.col("_b"))), F.lit(0.0))).alias(
            "movement"
        )
    )


def node_contributions(results: DataFrame) -> DataFrame:
    """Tasks, samples and busy time per (node, pod) of map-task results."""
    return results.groupBy("node", "pod").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("samples").alias("samples"),
        F.sum("busy_ms").alias("busy_ms"),
    )


def run_summary(history: DataFrame, events: DataFrame, contributions: DataFrame) -> DataFrame:
    """One row: iterations, last inertia and movement, retries, losses, nodes."""
    h = history.agg(
        F.count(F.lit(1)).alias("iterations"),
        F.max_by("inertia", "iteration").alias("final_inertia"),
        F.max_by("movement", "iteration").alias("final_movement"),
    )
    e = events.agg(
        F.count_if(F.col("type") == "TASK_ATTEMPT_RETRIED").alias("tasks_retried"),
        F.count_if(F.col("type") == "RAY_WORKER_LOST").alias("workers_lost"),
    )
    c = contributions.agg(F.countDistinct("node").alias("nodes_contributing"))
    one = F.lit(1).alias("_one")
    return (
        h.select(one, "*")
        .join(F.broadcast(e.select(one, "*")), "_one")
        .join(F.broadcast(c.select(one, "*")), "_one")
    ).drop("_one")
