"""Ordered computations that do not put one key into one task.

A plain ``Window.partitionBy(key)`` sorts the whole key in a single task. Each
function here first splits a key into buckets along its order column, works
inside ``(key, bucket)``, and carries only one summary row per bucket across
bucket borders, so a key holding a large share of the data still spreads out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage, written


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def seconds_between(start: Column, end: Column) -> Column:
    """Subtracts whole microseconds, so no precision is lost to large epochs."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def time_bucket(ts: Column, seconds: float) -> Column:
    width = int(round(seconds * 1_000_000))
    return F.floor(F.unix_micros(ts) / F.lit(width)).cast("bigint")


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    bucket: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """Add the preceding row's ``values`` within each key (a bucketed ``lag``).

    ``bucket`` must not decrease along ``order``.
    """
    keys, order, values = list(keys), list(order), list(values)
    marked = df.withColumn("_b", bucket)
    position = F.struct(*order)
    summary = marked.groupBy(*keys, "_b").agg(
        F.max_by(F.struct(*values), position).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_b")
    carried = summary.withColumn("_carry", F.lag("_last").over(across)).drop("_last")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = (
        marked.join(carried, [*keys, "_b"])
        .withColumn("_in", F.lag(F.struct(*values)).over(inside))
        .withColumn("_p", F.coalesce("_in", "_carry"))
    )
    for v in values:
        out = out.withColumn(prefix + v, F.col("_p")[v])
    return out.drop("_b", "_in", "_carry", "_p")


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "row_number",
) -> DataFrame:
    """1-based position within each key, numbering buckets independently."""
    keys, order = list(keys), list(order)
    marked = df.withColumn("_b", bucket)
    across = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = marked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(across), F.lit(0))
    ).drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        marked.join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside))
        .drop("_b", "_off")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    bucket: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` within each key."""
    keys, order = list(keys), list(order)
    marked = df.withColumn("_b", bucket)
    across = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = marked.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    offsets = sums.withColumn("_off", F.sum("_s").over(across)).drop("_s")
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.join(offsets, [*keys, "_b"])
        .withColumn(
            name, F.coalesce(F.col("_off"), F.lit(0)) + F.sum(value).over(inside)
        )
        .drop("_b", "_off")
    )


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` within each key along ``order``, in which rows of a
    key differ. Rows are dealt out by ranges of key and order, so that a key is spread over
    as many tasks as its rows need; one total per key and range is carried along."""
    keys, order = list(keys), list(order)
    arranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    arranged = written(arranged, "prefix-sums")
    return running_sum(arranged, keys, order, value, F.col("_range"), name).drop("_range")


def count_in_window(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: float, name: str
) -> DataFrame:
    """Rows of the same key in ``[ts - seconds, ts]``, the row itself included.

    Equal times of a key are counted first. The count up to a time and the one up to just
    before its window are two prefix sums, and what a row sees is their difference; only
    keys, times and counts are sorted. The rows themselves move once at most, to be joined
    with the counts of their time; a null time or key counts nothing and is 0.
    """
    keys = list(keys)
    width = int(round(seconds * 1_000_000))
    points = df.select(*keys, F.unix_micros(ts).alias("_x")).dropna().groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    points = written(points, "window-points")
    # At equal times a question stands after the rows it asks for.
    asked = points.select(*keys, (F.col("_x") - width - 1).alias("_x"), F.lit(0).cast("bigint").alias("_c"), F.lit(1).alias("_k"))
    sums = prefix_sums(points.withColumn("_k", F.lit(0)).unionByName(asked), keys, ["_x", "_k"], "_c", "_s")
    at = F.when(F.col("_k") == 0, F.col("_x")).otherwise(F.col("_x") + width + 1)
    sign = F.when(F.col("_k") == 0, F.col("_s")).otherwise(-F.col("_s"))
    counts = sums.groupBy(*keys, at.alias("_t")).agg(F.sum(sign).alias(name))
    rows = df.withColumn("_t", F.unix_micros(ts)).join(counts, [*keys, "_t"], "left")
    return rows.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint"))).select(*df.columns, name)


def with_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Zero-based position in the total order of ``order`` (which must be unique).

    Rows are range-partitioned and sorted in place; only one count per
    partition reaches the driver. The sorted frame is checkpointed first so
    that the counts and the positions come from the same partitioning.
    """
    order = list(order)
    arranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    arranged = cut_lineage(arranged)
    part = F.shiftright("_mid", 33)
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(
        arranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    if not offsets:
        return arranged.withColumn(name, F.lit(0).cast("bigint")).drop("_mid")
    starts = F.array(*[F.lit(offsets.get(p, 0)) for p in range(max(offsets) + 1)])
    return arranged.withColumn(
        name, (F.get(starts, part.cast("int")) + within).cast("bigint")
    ).drop("_mid")
