"""Federated averaging over tables of weight updates.

A contribution is one worker's update in one round, in long form: one row per
parameter with ``round, position, task_id, samples, loss, param, shape, data``.
``position`` orders contributions inside a round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import vectors as V
from millrace.functions.keys import commit_key
from millrace.operators.arrays import sum_arrays, sum_blocks
from millrace.operators.quantiles import exact_percentiles

#: Fixed value: contributions above this multiple of the median norm are scaled.
CLIP_FACTOR = 3.0

ROUND_KEYS = ["round", "position", "task_id"]


class InvalidRound(ValueError):
    """A round holds a contribution that must not be averaged."""


class QuorumNotMet(RuntimeError):
    """Too few committed contributions for a round."""


def check_clip_factor(factor) -> float:
    usable = isinstance(factor, (int, float)) and not isinstance(factor, bool)
    if not usable or not math.isfinite(factor) or factor <= 0:
        raise ValueError(f"clip factor must be a finite number above zero, got {factor!r}")
    return float(factor)


# -- checks -------------------------------------------------------------------


def _sample_columns(df: DataFrame) -> tuple[Column, Column]:
    """(problem or NULL, numeric value) of the ``samples`` column.

    VARIANT keeps ``true``, ``1``, ``1.5`` and ``"1"`` apart; only a whole number
    above zero is a sample count.
    """
    kind = df.schema["samples"].dataType
    if isinstance(kind, T.VariantType):
        described = F.schema_of_variant("samples")
        value = F.try_variant_get("samples", "$", "double")
        whole = described.isin("BIGINT", "TINYINT", "SMALLINT", "INT")
        boolean = described == "BOOLEAN"
    elif isinstance(kind, T.BooleanType):
        value, whole, boolean = F.col("samples").cast("double"), F.lit(False), F.lit(True)
    else:
        value = F.col("samples").cast("double")
        whole = F.lit(isinstance(kind, T.IntegralType))
        boolean = F.lit(False)
    problem = (
        F.when(~boolean & ~V.finite(value), F.lit("non_finite_samples"))
        .when(~whole, F.lit("non_integer_samples"))
        .when(value <= 0, F.lit("non_positive_samples"))
    )
    return problem, value


def bad_sample_counts(contributions: DataFrame) -> DataFrame:
    """Contributions whose sample count is not a whole number above zero."""
    problem, _ = _sample_columns(contributions)
    return (
        contributions.select(*ROUND_KEYS, problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
        .distinct()
    )


def non_finite(contributions: DataFrame) -> DataFrame:
    """Parameter and first index of every value that is not a number."""
    return (
        contributions.withColumn("index", V.first_non_finite(F.col("data")))
        .filter(F.col("index").isNotNull())
        .select(*ROUND_KEYS, "param", "index")
    )


def _against_base(contributions: DataFrame) -> DataFrame:
    """Each row next to the shape its round's first contribution declares. Only the
    length of its data goes along, so no vector crosses the join."""
    contributions = contributions.withColumn("_len", F.size("data")).drop("data")
    firsts = contributions.groupBy("round").agg(F.min("position").alias("position"))
    base = contributions.join(firsts, ["round", "position"], "left_semi").select(
        "round", "param", F.col("shape").alias("_base_shape"), F.lit(True).alias("_known")
    )
    return contributions.join(base, ["round", "param"], "left")


def shape_mismatches(contributions: DataFrame) -> DataFrame:
    """Parameters that differ from the first contribution of their round, and
    data whose length does not fit its declared shape."""
    return (
        _against_base(contributions)
        .withColumn("problem", _shape_problem())
        .filter(F.col("problem").isNotNull())
        .select(*ROUND_KEYS, "param", "problem")
    )


def _shape_problem() -> Column:
    return (
        F.when(F.col("_known").isNull(), F.lit("parameter_names_differ"))
        .when(~F.col("shape").eqNullSafe(F.col("_base_shape")), F.lit("shape_mismatch"))
        .when(V.shape_size(F.col("shape")) != F.col("_len"), F.lit("length_mismatch"))
    )


def validate(contributions: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """First problem of each round: ``round, problem, position, param, index``.

    ``problem`` is NULL for a sound round. Order of precedence: no contribution,
    negative total, zero total, sample counts by position, then per position
    parameter names, shapes and finally values. ``rounds`` lists the rounds that
    should exist.
    """
    problem, value = _sample_columns(contributions)
    marked = contributions.withColumn("_sp", problem).withColumn("_n", value)
    rows = _against_base(marked.withColumn("_bad", V.first_non_finite(F.col("data")))).select(
        "round",
        "position",
        "param",
        "_sp",
        "_n",
        _shape_problem().alias("_shape"),
        "_bad",
    )

    def issue(stage, sub, kind, param=None, index=None):
        return F.struct(
            F.lit(stage).alias("stage"),
            F.col("position").alias("position"),
            F.lit(sub).alias("sub"),
            (param if param is not None else F.lit(None).cast("string")).alias("param"),
            (index if index is not None else F.lit(None).cast("bigint")).alias("index"),
            kind.alias("problem"),
        )

    per_contribution = rows.groupBy("round", "position").agg(
        F.first("_sp").alias("_sp"),
        F.first("_n").alias("_n"),
        F.count(F.lit(1)).alias("_params"),
        F.min(
            F.when(
                F.col("_shape").isNotNull(),
                issue(2, 1, F.col("_shape"), F.col("param")),
            )
        ).alias("_si"),
        F.max(F.col("_shape") == "parameter_names_differ").alias("_names"),
        F.min(
            F.when(
                F.col("_bad").isNotNull(),
                issue(2, 2, F.lit("non_finite_value"), F.col("param"), F.col("_bad")),
            )
        ).alias("_vi"),
    )
    sizes = per_contribution.groupBy("round").agg(
        F.min_by("_params", "position").alias("_base_params")
    )
    judged = per_contribution.join(sizes, "round").select(
        "round",
        "_n",
        F.least(
            F.when(F.col("_sp").isNotNull(), issue(1, 0, F.col("_sp"))),
            F.when(
                F.coalesce(F.col("_names"), F.lit(False))
                | (F.col("_params") != F.col("_base_params")),
                issue(2, 0, F.lit("parameter_names_differ")),
            ),
            F.col("_si"),
            F.col("_vi"),
        ).alias("_issue"),
    )
    per_round = judged.groupBy("round").agg(
        F.sum("_n").alias("_total"), F.min("_issue").alias("_issue")
    )
    total_problem = F.when(F.col("_total") < 0, F.lit("negative_total")).when(
        F.col("_total") == 0, F.lit("zero_total")
    )
    out = per_round.select(
        "round",
        F.coalesce(total_problem, F.col("_issue.problem")).alias("problem"),
        F.when(total_problem.isNull(), F.col("_issue.position")).alias("position"),
        F.when(total_problem.isNull(), F.col("_issue.param")).alias("param"),
        F.when(total_problem.isNull(), F.col("_issue.index")).alias("index"),
    )
    if rounds is None:
        return out
    missing = rounds.select("round").distinct().join(out, "round", "left_anti")
    return out.unionByName(
        missing.withColumn("problem", F.lit("no_contributions")), allowMissingColumns=True
    )


# -- influence cap ------------------------------------------------------------


def l2_norms(contributions: DataFrame) -> DataFrame:
    """Norm of each contribution over all its parameters."""
    return (
        contributions.select(*ROUND_KEYS, V.sq_norm(F.col("data")).alias("_q"))
        .groupBy(*ROUND_KEYS)
        .agg(F.sqrt(F.sum("_q")).alias("norm"))
    )


def clip_caps(norms: DataFrame, factor: float = CLIP_FACTOR) -> DataFrame:
    """Cap per round: the median norm times ``factor``."""
    factor = check_clip_factor(factor)
    medians = exact_percentiles(norms, ["round"], "norm", {"_median": 0.5})
    return medians.select("round", (F.col("_median") * F.lit(factor)).alias("cap"))


def clip_scales(contributions: DataFrame, factor: float = CLIP_FACTOR) -> DataFrame:
    """``norm``, ``cap`` and ``scale`` of each contribution; 1.0 when not above the cap.

    A norm equal to the cap is left alone, so a zero norm never divides.
    """
    norms = l2_norms(contributions)
    return norms.join(clip_caps(norms, factor), "round").withColumn(
        "scale", F.when(F.col("norm") > F.col("cap"), F.col("cap") / F.col("norm")).otherwise(1.0)
    )


def clip_events(scales: DataFrame) -> DataFrame:
    return scales.filter(F.col("norm") > F.col("cap"))


def clip(contributions: DataFrame, factor: float = CLIP_FACTOR) -> DataFrame:
    """Contributions with oversized ones scaled down to their round's cap."""
    scales = clip_scales(contributions, factor).select(
        *ROUND_KEYS, F.col("scale").alias("_scale"), (F.col("norm") > F.col("cap")).alias("_over")
    )
    return (
        contributions.join(scales, ROUND_KEYS)
        .withColumn(
            "data", F.when(F.col("_over"), V.scale(F.col("data"), F.col("_scale"))).otherwise(F.col("data"))
        )
        .drop("_scale", "_over")
    )


# -- reduce -------------------------------------------------------------------


def _sample_totals(contributions: DataFrame) -> DataFrame:
    _, value = _sample_columns(contributions)
    return (
        contributions.select("round", "position", value.alias("_n"))
        .groupBy("round", "position")
        .agg(F.first("_n").alias("_n"))
        .groupBy("round")
        .agg(F.sum("_n").alias("_total"))
    )


def weighted_mean(contributions: DataFrame, scales: DataFrame | None = None, blocks: bool = False) -> DataFrame:
    """Sample-weighted mean per round and parameter: ``round, param, shape, data``. With
    ``blocks``, ``block`` too: a parameter stays in pieces of ``arrays.BLOCK`` elements, and
    no task holds a whole one.

    Weights are the untouched sample counts over their round's total; ``scales``
    (from :func:`clip_scales`) enters as a factor, so clipped vectors are never
    written out.
    """
    _, value = _sample_columns(contributions)
    weighed, weight = contributions, value
    if scales is not None:
        weighed = contributions.join(scales.select(*ROUND_KEYS, "scale"), ROUND_KEYS)
        weight = value * F.col("scale")
    shapes = contributions.groupBy("round", "param").agg(F.min("shape").alias("shape"))
    # Divided by the round's total at the end: vectors meet no table keyed by round alone.
    total = sum_blocks if blocks else sum_arrays
    sums = total(weighed.withColumn("_w", weight), ["round", "param"], "data", "_w")
    means = sums.join(_sample_totals(contributions), "round").join(shapes, ["round", "param"])
    data = F.transform("data", lambda x: x / F.col("_total"))
    return means.select("round", "param", *(["block"] if blocks else []), "shape", data.alias("data"))


def reduce_round(contributions: DataFrame, factor: float = CLIP_FACTOR):
    """Clip, then average: ``(reduced, clip events)``. Expects a validated frame."""
    scales = clip_scales(contributions, factor)
    return weighted_mean(contributions, scales), clip_events(scales)


def round_metrics(contributions: DataFrame) -> DataFrame:
    """Participants and sample-weighted mean loss per round."""
    _, value = _sample_columns(contributions)
    per_task = (
        contributions.select(*ROUND_KEYS, "loss", value.alias("_n"))
        .groupBy(*ROUND_KEYS)
        .agg(F.first("loss").alias("loss"), F.first("_n").alias("_n"))
    )
    return per_task.groupBy("round").agg(
        F.count(F.lit(1)).alias("participants"),
        (F.sum(F.col("loss") * F.col("_n")) / F.sum("_n")).alias("mean_loss"),
    )


def _combined(base: DataFrame, other: DataFrame, factor: float) -> DataFrame:
    """``base + factor * other``: the same names, shapes and sizes on both sides, finite results."""
    b = base.select("param", "shape", F.col("data").alias("_a"))
    shape = F.col("shape") if "shape" in other.columns else F.lit(None)  # a table without shapes has sizes
    d = other.select("param", shape.cast("array<int>").alias("_shape"), F.col("data").alias("_d"))
    both = b.join(d, "param", "full_outer")
    data = V.axpy(F.col("_a"), factor, F.col("_d"))
    problem = (
        F.when(F.col("_a").isNull() | F.col("_d").isNull(), "is missing on one side")
        .when(F.size("_a") != F.size("_d"), "has another size")
        .when(F.lit("shape" in other.columns) & ~F.col("shape").eqNullSafe(F.col("_shape")), "has another shape")
        .when(~V.all_finite(data), "is not finite after the update")
    )
    text = F.concat(F.lit("parameter "), "param", F.lit(" "), problem)
    bad = F.raise_error(text).cast("array<double>")
    return both.select("param", "shape", F.when(problem.isNotNull(), bad).otherwise(data).alias("data"))


def apply_delta(base: DataFrame, delta: DataFrame, factor: float = 1.0) -> DataFrame:
    """``base + factor * delta`` for tables of ``param, shape, data``.

    A name that one side lacks, another shape or size or a result that is not finite is an error.
    """
    return _combined(base, delta, factor)


def subtract(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new - old`` for tables of ``param, shape, data``, checked like :func:`apply_delta`."""
    return _combined(new, old, -1.0)


def weights_after(initial: DataFrame, reduced: DataFrame) -> DataFrame:
    """Weights after every round: the start plus the running sum of updates.

    ``initial``: ``param, shape, data``; ``reduced``: ``round, param, data``. Every round
    has every parameter, in its size; anything else is an error.
    """
    known = initial.select("param", "shape", F.col("data").alias("_x0"))
    steps = reduced.select("round", "param", "data").join(known, "param", "full_outer")
    per_round = Window.partitionBy("round")
    steps = steps.withColumn("_n", F.count("param").over(per_round))
    names = initial.agg(F.count("*").alias("_names"))
    steps = steps.join(F.broadcast(names), F.lit(True))  # one row
    wrong = F.col("_x0").isNull() | F.col("data").isNull() | (F.size("data") != F.size("_x0"))
    wrong = wrong | (F.col("_n") != F.col("_names"))
    text = F.concat(F.lit("parameter "), "param", F.lit(" does not match the start"))
    data = F.when(wrong, F.raise_error(text).cast("array<double>")).otherwise(F.col("data"))
    over = Window.partitionBy("param", "_pos").orderBy("round")
    elements = steps.select(
        "round", "param", "shape", "_x0", F.posexplode(data).alias("_pos", "_x")
    ).select("round", "param", "shape", F.get("_x0", F.col("_pos")).alias("_x0"), "_pos", "_x")
    running = elements.withColumn("v", F.col("_x0") + F.sum("_x").over(over))
    return running.groupBy("round", "param").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "v"))), lambda s: s["v"]).alias("data"),
        F.first("shape").alias("shape"),
    )


# -- quorum -------------------------------------------------------------------


def expected_keys(tasks: DataFrame) -> DataFrame:
    """Commit key of every task a round dispatched: ``round, job_id, task_id, key``."""
    return tasks.withColumn("key", commit_key(F.col("job_id"), F.col("task_id")))


def committed_keys(commits: DataFrame, tasks: DataFrame) -> DataFrame:
    """Commits under exactly an expected key of a task that completed.

    An upload under any other key, or from a task that did not complete, would
    let one machine count twice and is left out.
    """
    completed = expected_keys(tasks.filter(F.col("state") == "COMPLETED"))
    return commits.join(
        completed.select("round", "job_id", "task_id", "key"),
        ["job_id", "key"],
        "inner",
    ).groupBy("round", "job_id", "task_id", "key").agg(F.min("ts").alias("ts"))


def quorum_times(committed: DataFrame, m: int) -> DataFrame:
    """Instant of the ``m``-th commit of each round; rounds with fewer are absent."""
    order = Window.partitionBy("round").orderBy("ts", "key")
    return (
        committed.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= m)
        .groupBy("round")
        .agg(F.max("ts").alias("quorum_at"), F.max("_rank").alias("_n"))
        .filter(F.col("_n") == m)
        .drop("_n")
    )


def participants(
    commits: DataFrame, tasks: DataFrame, m: int, as_of: Column | None = None
) -> DataFrame:
    """Everyone visible when the round closes: at ``as_of`` if given, otherwise at
    the instant of the ``m``-th commit. Rounds short of ``m`` have no rows."""
    committed = committed_keys(commits, tasks)
    if as_of is None:
        closed = committed.join(quorum_times(committed, m), "round")
        return closed.filter(F.col("ts") <= F.col("quorum_at")).drop("quorum_at")
    seen = committed.filter(F.col("ts") <= as_of)
    enough = seen.groupBy("round").count().filter(F.col("count") >= m)
    return seen.join(enough.select("round"), "round", "left_semi")


def discarded(contributions: DataFrame, frozen: DataFrame) -> DataFrame:
    """Contributions of a round whose sender is not among its frozen participants."""
    return contributions.join(frozen, ["round", "task_id"], "left_anti")


def resume_point(rounds: DataFrame) -> dict:
    """Where a stopped run continues: ``{"next_round", "job_id"}``.

    ``rounds``: ``round, job_id, weights_found BOOLEAN, empty BOOLEAN, finite BOOLEAN``,
    one row per round the caller remembers. One aggregated row reaches the driver.
    """
    newest = F.max_by(
        F.struct("round", "job_id", "empty", "finite"),
        F.when(F.col("weights_found"), F.col("round")),
    )
    row = rounds.agg(
        newest.alias("top"),
        F.min("round").alias("first"),
        F.count_if("weights_found").alias("found"),
    ).first()
    if not row["found"]:
        if row["first"] is not None and row["first"] > 0:
            raise InvalidRound(
                f"history starts at round {row['first']} and none of it completed; "
                "earlier rounds are unknown"
            )
        return {"next_round": 0, "job_id": None}
    top = row["top"]
    if top["empty"]:
        raise InvalidRound(f"weights of round {top['round']} exist but are empty")
    if not top["finite"]:
        raise InvalidRound(f"weights of round {top['round']} are not finite")
    return {"next_round": top["round"] + 1, "job_id": top["job_id"]}
