"""Exact, linearly interpolated percentiles without gathering a group.

Spark's ``percentile`` keeps every distinct value of a group in one task's memory. Here
equal values are counted first and the tally is stored. A group of more than ``SORTED``
distinct values is cut into buckets by a small sketch, bucket totals locate the ranks that
matter, and only the buckets holding one are kept; those are cut again until they are small
enough to be sorted, so no task sorts more than ``SORTED`` rows of a group, however large
and however unevenly spread it is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

BUCKETS = 256
#: Distinct values that are sorted in one task.
SORTED = 10_000


def _split(live: DataFrame, spans: DataFrame, ids: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Cut every span of ``live`` (``ids, _g, _v, _c``) into buckets and keep those that hold
    a rank. ``spans``: ``ids, _g, _off, _ranks, repeats``, the values before it and its ranks."""
    own = [*ids, "_g"]
    cuts = [i / buckets for i in range(1, buckets)]
    sketch = live.groupBy(*own).agg(F.percentile_approx("_v", cuts, F.lit(10 * buckets)).alias("_cuts"))
    # A value's bucket is the number of cut points below it, found in two strides:
    # whole blocks of cut points first, then the points of the next block.
    below = lambda points: F.size(F.filter(points, lambda c: c < F.col("_v")))
    block = max(2, math.isqrt(buckets))
    ends = F.filter("_cuts", lambda c, i: (i + 1) % block == 0)
    placed = (
        live.join(sketch.withColumn("_ends", ends), own)
        .withColumn("_q", below("_ends") * block)
        .withColumn("_b", F.col("_q") + below(F.slice("_cuts", F.col("_q") + 1, F.lit(block))))
        .select(*own, "_b", "_v", "_c")
    )
    before = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*own, "_b").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    totals = totals.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(spans.drop("_rows"), own)
    off = F.col("_off") + F.col("_in")
    kept = totals.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= off) & (r < off + F.col("_n"))))
    kept = kept.filter(F.size("_ranks") > 0).withColumn("_off", off)
    kept = written(kept.select(*own, "_b", "_off", "_ranks", "repeats", "_rows"), "percentile-spans")
    # The values before a span tell it from the others of its group.
    rows = placed.join(kept.select(*own, "_b", "_off"), [*own, "_b"]).select(*ids, F.col("_off").alias("_g"), "_v", "_c")
    return written(rows, "percentile-rows"), kept.select(*ids, F.col("_off").alias("_g"), "_off", "_ranks", "repeats", "_rows")


def _ranks(probs) -> Column:
    """The ranks on both sides of each position."""
    low = [F.floor(F.lit(q) * (F.col("repeats") - 1)) for q in probs]
    both = [F.array(r, F.least(r + 1, F.col("repeats") - 1)) for r in low]
    return F.array_distinct(F.flatten(F.array(*both)))


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    buckets: int = BUCKETS,
    sorted_: int = SORTED,
) -> DataFrame:
    """One row per group: ``keys``, ``repeats`` and one column per entry of ``probs``.

    Position ``q * (n - 1)`` between the two neighbouring values; an even-sized
    median is therefore the mean of the two middle values. NULLs are ignored.
    """
    keys = list(keys)
    ids = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    tally = (
        base.filter(F.col(value).isNotNull())
        .select(*ids, F.col(value).cast("double").alias("_v"))
        .groupBy(*ids, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    tally = written(tally, "percentile-tally")
    spans = tally.groupBy(*ids).agg(F.sum("_c").alias("repeats"), F.count(F.lit(1)).alias("_rows"))
    spans = written(spans.select(*ids, F.lit(0).cast("bigint").alias("_g"), F.lit(0).cast("bigint").alias("_off"),
                                 _ranks(probs.values()).alias("_ranks"), "repeats", "_rows"), "percentile-spans")
    live = tally.select(*ids, F.lit(0).cast("bigint").alias("_g"), "_v", "_c")
    own = [*ids, "_g"]
    small: list[tuple[DataFrame, DataFrame]] = []
    while True:
        large = spans.filter(F.col("_rows") > sorted_)
        if large.isEmpty():
            small.append((live, spans))
            break
        done = spans.filter(F.col("_rows") <= sorted_)
        small.append((live.join(done.select(*own), own, "left_semi").select(*own, "_v", "_c"), done))
        live, spans = _split(live.join(large.select(*own), own, "left_semi").select(*own, "_v", "_c"), large, ids, buckets)
    inside = Window.partitionBy(*own).orderBy("_v")
    ordered = reduce(DataFrame.unionByName, [rows.join(of.drop("_rows"), own) for rows, of in small])
    ordered = ordered.withColumn("_end", F.col("_off") + F.sum("_c").over(inside)).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )
    hits = ordered.withColumn(
        "_r",
        F.explode(
            F.filter(
                "_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_end"))
            )
        ),
    )
    out = []
    for name, q in probs.items():
        pos = F.lit(q) * (F.col("repeats") - 1)
        low = F.floor(pos)
        high = F.least(low + 1, F.col("repeats") - 1)
        lo_v = F.max(F.when(F.col("_r") == low, F.col("_v")))
        hi_v = F.max(F.when(F.col("_r") == high, F.col("_v")))
        out.append((lo_v + (hi_v - lo_v) * F.max(pos - low)).alias(name))
    result = hits.groupBy(*ids).agg(F.max("repeats").alias("repeats"), *out)
    return result if keys else result.drop("_all")
