"""Federated averaging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import fedavg
from millrace.queries import query

_C = B.CONTRIBUTIONS_SQL


@query(
    "fedavg_norms",
    f"WITH {_C} SELECT round, task_id, round(norm, 6) AS norm FROM nrm",
)
def fedavg_norms(spark: SparkSession, sf: str) -> DataFrame:
    norms = fedavg.l2_norms(B.contributions(spark, sf))
    return norms.select("round", "task_id", F.round("norm", 6).alias("norm"))


@query(
    "fedavg_clip_caps",
    f"WITH {_C} SELECT round, round(cap, 6) AS cap FROM cap",
)
def fedavg_clip_caps(spark: SparkSession, sf: str) -> DataFrame:
    caps = fedavg.clip_caps(fedavg.l2_norms(B.contributions(spark, sf)))
    return caps.select("round", F.round("cap", 6).alias("cap"))


@query(
    "fedavg_clip_events",
    f"""WITH {_C} SELECT round, task_id, round(norm, 6) AS norm, round(cap, 6) AS cap,
    round(scale, 9) AS scale FROM clp WHERE norm > cap""",
)
def fedavg_clip_events(spark: SparkSession, sf: str) -> DataFrame:
    events = fedavg.clip_events(fedavg.clip_scales(B.contributions(spark, sf)))
    return events.select(
        "round",
        "task_id",
        F.round("norm", 6).alias("norm"),
        F.round("cap", 6).alias("cap"),
        F.round("scale", 9).alias("scale"),
    )


_REDUCED = f"""{_C},
el AS (SELECT round, samples, total, scale, unnest(v) AS x,
              unnest(generate_series(0, len(v) - 1)) AS i FROM clp),
red AS (SELECT round, CASE WHEN i < 48 THEN 'w' ELSE 'b' END AS param,
               CASE WHEN i < 48 THEN i ELSE i - 48 END AS pos,
               sum(samples / total::DOUBLE * scale * x) AS x FROM el GROUP BY ALL)"""


@query(
    "fedavg_reduce",
    f"""WITH {_REDUCED}
SELECT round, param, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM red""",
)
def fedavg_reduce(spark: SparkSession, sf: str) -> DataFrame:
    reduced, _ = fedavg.reduce_round(B.contributions(spark, sf))
    return reduced.select("round", "param", F.posexplode("data").alias("pos", "x")).select(
        "round", "param", "pos", F.round("x", 6).alias("x")
    )


@query(
    "fedavg_weights_after",
    f"""WITH {_REDUCED}
SELECT round, param, CAST(pos AS INTEGER) AS pos,
       round(sum(x) OVER (PARTITION BY param, pos ORDER BY round), 6) AS w FROM red""",
)
def fedavg_weights_after(spark: SparkSession, sf: str) -> DataFrame:
    reduced, _ = fedavg.reduce_round(B.contributions(spark, sf))
    start = (
        reduced.groupBy("param")
        .agg(F.min("shape").alias("shape"))
        .withColumn("data", F.array_repeat(F.lit(0.0), F.aggregate("shape", F.lit(1), lambda a, b: a * b)))
    )
    after = fedavg.weights_after(start, reduced)
    return after.select("round", "param", F.posexplode("data").alias("pos", "w")).select(
        "round", "param", "pos", F.round("w", 6).alias("w")
    )


@query(
    "fedavg_apply_delta",
    f"""WITH {_REDUCED}
SELECT a.round, a.param, CAST(a.pos AS INTEGER) AS pos, round(a.x + 2 * b.x, 6) AS moved, round(a.x - b.x, 6) AS gap
FROM red a JOIN red b USING (param, pos) WHERE a.round = b.round - 1""",
)
def fedavg_apply_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Each round's update moved by twice the next one's, and their difference."""
    reduced, _ = fedavg.reduce_round(B.contributions(spark, sf))
    name = lambda r: F.concat_ws("/", r.cast("string"), "param")
    rounds = reduced.select("round").distinct()
    later = rounds.select((F.col("round") - 1).alias("round"))
    base = reduced.join(later, "round", "left_semi").withColumn("param", name(F.col("round")))
    earlier = rounds.select((F.col("round") + 1).alias("round"))
    delta = reduced.join(earlier, "round", "left_semi").withColumn("param", name(F.col("round") - 1))
    moved, gap = fedavg.apply_delta(base, delta, 2.0), fedavg.subtract(base, delta)
    both = moved.join(gap.select("param", F.col("data").alias("gap")), "param")
    each = both.select("param", F.posexplode(F.arrays_zip("data", "gap")).alias("pos", "x"))
    return each.select(
        F.split_part("param", F.lit("/"), F.lit(1)).cast("int").alias("round"),
        F.split_part("param", F.lit("/"), F.lit(2)).alias("param"),
        "pos",
        F.round("x.data", 6).alias("moved"),
        F.round("x.gap", 6).alias("gap"),
    )


@query(
    "fedavg_round_metrics",
    f"""WITH {_C} SELECT round, count(*) AS participants,
    round(sum(loss * samples) / sum(samples), 9) AS mean_loss FROM con GROUP BY round""",
)
def fedavg_round_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = fedavg.round_metrics(B.contributions(spark, sf))
    return m.select("round", "participants", F.round("mean_loss", 9).alias("mean_loss"))


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """The contributions with one kind of damage per round, so most rounds fail."""
    c = B.contributions(spark, sf)
    hit = F.col("position") % 5 == 3
    return (
        c.withColumn(
            "samples",
            F.when(F.col("round") == 1, -F.col("samples"))
            .when(F.col("round") == 2, F.lit(0))
            .when((F.col("round") == 3) & hit, -F.lit(1))
            .otherwise(F.col("samples")),
        )
        .withColumn(
            "data",
            F.when(
                (F.col("round") == 4) & hit & (F.col("param") == "b"),
                F.concat(F.slice("data", 1, 15), F.array(F.lit(float("nan")))),
            )
            .when((F.col("round") == 5) & hit & (F.col("param") == "w"), F.slice("data", 1, 47))
            .otherwise(F.col("data")),
        )
        .filter(~((F.col("round") == 6) & hit & (F.col("param") == "w")))
        .withColumn(
            "shape",
            F.when((F.col("round") == 7) & hit & (F.col("param") == "w"), F.array(F.lit(8), F.lit(6)))
            .otherwise(F.col("shape")),
        )
    )


@query(
    "fedavg_validate",
    """WITH first_hit AS (SELECT label AS round,
         min(CASE WHEN vec_id % 5 = 3 THEN vec_id END) AS h, min(vec_id) AS f,
         min(CASE WHEN vec_id % 5 <> 3 THEN vec_id END) AS other
         FROM embeddings GROUP BY label)
SELECT round,
  CASE round WHEN 1 THEN 'negative_total' WHEN 2 THEN 'zero_total'
    WHEN 3 THEN 'non_positive_samples' WHEN 4 THEN 'non_finite_value'
    WHEN 5 THEN 'length_mismatch' WHEN 6 THEN 'parameter_names_differ'
    WHEN 7 THEN 'shape_mismatch' END AS problem,
  CASE WHEN round BETWEEN 3 AND 5 THEN h
       WHEN round BETWEEN 6 AND 7 THEN CASE WHEN h = f THEN other ELSE h END END AS position,
  CASE round WHEN 4 THEN 'b' WHEN 5 THEN 'w' WHEN 7 THEN 'w' END AS param,
  CAST(CASE round WHEN 4 THEN 15 END AS BIGINT) AS index
FROM first_hit""",
)
def fedavg_validate(spark: SparkSession, sf: str) -> DataFrame:
    return fedavg.validate(_damaged(spark, sf))


@query(
    "fedavg_quorum",
    f"""WITH {B.COMMITS_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY ts, key) AS rn FROM com)
SELECT round, epoch_us(max(ts)) AS quorum_at_us FROM rk WHERE rn <= 5
GROUP BY round HAVING count(*) = 5""",
)
def fedavg_quorum(spark: SparkSession, sf: str) -> DataFrame:
    committed = fedavg.committed_keys(B.round_commits(spark, sf), B.round_tasks(spark, sf))
    return fedavg.quorum_times(committed, 5).select(
        "round", F.unix_micros("quorum_at").alias("quorum_at_us")
    )


@query(
    "fedavg_participants",
    f"""WITH {B.COMMITS_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY ts, key) AS rn FROM com),
q AS (SELECT round, max(ts) AS at FROM rk WHERE rn <= 5 GROUP BY round HAVING count(*) = 5)
SELECT c.round, c.task_id, c.key FROM com c JOIN q USING (round) WHERE c.ts <= q.at""",
)
def fedavg_participants(spark: SparkSession, sf: str) -> DataFrame:
    frozen = fedavg.participants(B.round_commits(spark, sf), B.round_tasks(spark, sf), 5)
    return frozen.select("round", "task_id", "key")


@query(
    "fedavg_discarded",
    f"""WITH {B.COMMITS_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY ts, key) AS rn FROM com),
q AS (SELECT round, max(ts) AS at FROM rk WHERE rn <= 5 GROUP BY round HAVING count(*) = 5),
fr AS (SELECT c.round, c.task_id FROM com c JOIN q USING (round) WHERE c.ts <= q.at)
SELECT t.round, t.task_id FROM tasks t ANTI JOIN fr USING (round, task_id)""",
)
def fedavg_discarded(spark: SparkSession, sf: str) -> DataFrame:
    tasks = B.round_tasks(spark, sf)
    frozen = fedavg.participants(B.round_commits(spark, sf), tasks, 5)
    return fedavg.discarded(tasks.select("round", "task_id"), frozen)


_FIRST = """fs AS (SELECT label AS round, min(vec_id) % 5 = 3 AS base_hit FROM embeddings GROUP BY label),
e AS (SELECT label AS round, vec_id AS position, 'task-' || vec_id AS task_id, vec_id % 5 = 3 AS hit, base_hit
      FROM embeddings JOIN fs ON fs.round = label)"""


@query(
    "fedavg_non_finite",
    f"WITH {_FIRST} SELECT round, position, task_id, 'b' AS param, 15::BIGINT AS index FROM e WHERE round = 4 AND hit",
)
def fedavg_non_finite(spark: SparkSession, sf: str) -> DataFrame:
    return fedavg.non_finite(_damaged(spark, sf))


@query(
    "fedavg_bad_samples",
    f"""WITH {_FIRST} SELECT round, position, task_id, 'non_positive_samples' AS problem FROM e
    WHERE round IN (1, 2) OR (round = 3 AND hit)""",
)
def fedavg_bad_samples(spark: SparkSession, sf: str) -> DataFrame:
    return fedavg.bad_sample_counts(_damaged(spark, sf))


@query(
    "fedavg_shape_mismatches",
    f"""WITH {_FIRST} SELECT round, position, task_id, 'w' AS param, CASE round WHEN 5 THEN 'length_mismatch'
      WHEN 6 THEN 'parameter_names_differ' ELSE 'shape_mismatch' END AS problem FROM e
    WHERE (round = 5 AND hit) OR (round = 6 AND base_hit AND NOT hit) OR (round = 7 AND hit <> base_hit)""",
)
def fedavg_shape_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return fedavg.shape_mismatches(_damaged(spark, sf))
