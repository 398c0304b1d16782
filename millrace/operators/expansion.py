"""From job descriptions to one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import SCHEME, commit_key


def grid_size(grid: Column) -> Column:
    return F.aggregate(
        F.map_values(grid), F.lit(1).cast("bigint"), lambda n, v: n * F.size(v).cast("bigint")
    )


def grid_point(grid: Column, index: Column) -> Column:
    """Combination number ``index``: keys in sorted order, the last one fastest.

    The index is read as a number with one digit per key, so no product of
    value lists is ever formed.
    """
    keys = F.array_sort(F.map_keys(grid))
    start = F.struct(
        index.cast("bigint").alias("rest"), F.create_map().cast("map<string,string>").alias("point")
    )

    def take(acc: Column, key: Column) -> Column:
        values = grid[key]
        n = F.size(values).cast("bigint")
        digit = (acc["rest"] % n).cast("int")
        return F.struct(
            F.floor(acc["rest"] / n).cast("bigint").alias("rest"),
            F.map_concat(F.create_map(key, F.get(values, digit)), acc["point"]).alias("point"),
        )

    return F.aggregate(F.reverse(keys), start, take, lambda acc: acc["point"])


def expand_grid(jobs: DataFrame, grid: str = "grid") -> DataFrame:
    """One row per trial: ``job columns, trial BIGINT, task_id, params``."""
    numbered = jobs.filter(grid_size(F.col(grid)) > 0).withColumn(
        "trial", F.explode(F.sequence(F.lit(0).cast("bigint"), grid_size(F.col(grid)) - 1))
    )
    return numbered.withColumn(
        "task_id", F.concat(F.lit("trial-"), _padded(F.col("trial"), 3))
    ).withColumn("params", grid_point(F.col(grid), F.col("trial")))


def _padded(n: Column, width: int) -> Column:
    """Zero-padded to at least ``width`` digits, never cut."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def expand_tasks(jobs: DataFrame) -> DataFrame:
    """One row per task of a job, with the payload fields every gate reads.

    ``jobs``: ``job_id, kind`` (``hyperparameter_search``, ``sharded_kmeans``,
    ``federated_averaging``, ``command``), ``grid MAP<STRING,ARRAY<STRING>>``,
    ``shards ARRAY<STRING>``, ``num_shards, iteration, task_count, tier,
    allow_fallback, pool, gpus, max_attempts, lease_seconds``.

    Jobs that cannot be expanded give one row with ``problem`` set. Optional
    payload fields stay NULL unless the job states them.
    """
    kind = F.col("kind")
    count = (
        F.when(kind == "hyperparameter_search", grid_size(F.col("grid")))
        .when(kind == "sharded_kmeans", F.size("shards").cast("bigint"))
        .when(kind == "federated_averaging", F.col("num_shards").cast("bigint"))
        .when(kind == "command", F.greatest(F.coalesce("task_count", F.lit(1)), F.lit(1)).cast("bigint"))
    )
    foreign = F.coalesce(F.exists("shards", lambda s: ~s.startswith(SCHEME)), F.lit(False))
    problem = (
        F.when(count.isNull() & kind.isin("sharded_kmeans", "hyperparameter_search"), "nothing to expand")
        .when(count.isNull(), "unknown kind")
        .when((kind == "federated_averaging") & (count < 1), "number of shards below 1")
        .when((kind == "sharded_kmeans") & foreign, "shard is not an artifact address")
        .when(
            (kind == "command") & F.col("allow_fallback") & (F.col("pool") == "any"),
            "fallback without a pool",
        )
        .when(count < 1, "nothing to expand")
    )
    judged = jobs.withColumn("_n", count).withColumn("problem", problem)
    rows = judged.withColumn(
        "_i",
        F.explode_outer(
            F.when(
                F.col("problem").isNull(),
                F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1),
            )
        ),
    )
    i = _padded(F.col("_i"), 3)
    task_id = (
        F.when(kind == "hyperparameter_search", F.concat(F.lit("trial-"), i))
        .when(
            kind == "sharded_kmeans",
            F.concat(F.lit("it"), _padded(F.col("iteration"), 2), F.lit("-shard-"), i),
        )
        .when(kind == "federated_averaging", F.concat(F.lit("shard-"), i))
        .when(kind == "command", F.concat(F.lit("task-"), i))
    )
    made = rows.withColumn("task_id", F.when(F.col("problem").isNull(), task_id))
    return made.select(
        "job_id",
        "task_id",
        "kind",
        F.col("_i").alias("index"),
        commit_key(F.col("job_id"), F.col("task_id")).alias("commit_key"),
        F.when(kind == "hyperparameter_search", grid_point(F.col("grid"), F.col("_i"))).alias("params"),
        F.when(kind == "sharded_kmeans", F.get("shards", F.col("_i").cast("int"))).alias("input"),
        F.struct(F.col("tier"), F.col("allow_fallback").alias("allowFallback")).alias("isolation"),
        F.when(F.col("pool") != "any", F.col("pool")).alias("pool"),
        F.when(F.col("gpus") > 0, F.col("gpus")).alias("gpus"),
        "max_attempts",
        "lease_seconds",
        "problem",
    )
