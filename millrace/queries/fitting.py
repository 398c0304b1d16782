"""Model-fitting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators.ordered import with_index
from millrace.plans.fedavg_fit import fedavg_fit
from millrace.plans.local_update import LocalConfig
from millrace.plans.sgd import logistic_sgd, mean_log_loss
from millrace.plans.sweep import fit_many, sweep
from millrace.queries import query

#: Steps whose batches together hold every row, and the learning rate.
_STEPS, _LR = 6, 0.5


def _sgd_sql() -> str:
    ctes = [B.LABELLED_SQL, f"nn AS (SELECT count(*) AS n, (count(*) + {_STEPS - 1}) // {_STEPS} AS b FROM lab)"]
    ctes.append("w0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b)")
    for t in range(1, _STEPS + 1):
        ctes.append(
            f"e{t} AS (SELECT l.*, 1 / (1 + exp(-(x0*w.w0 + x1*w.w1 + x2*w.w2 + w.b))) - y AS e FROM (SELECT lab.* FROM lab, nn "
            f"WHERE (idx >= {t - 1} * nn.b AND idx < {t} * nn.b) OR idx < {t} * nn.b - nn.n) l, w{t - 1} w)"
        )
        ctes.append(
            f"w{t} AS (SELECT w.w0 - {_LR} * g.g0 / nn.b AS w0, w.w1 - {_LR} * g.g1 / nn.b AS w1, "
            f"w.w2 - {_LR} * g.g2 / nn.b AS w2, w.b - {_LR} * g.gb / nn.b AS b FROM w{t - 1} w, nn, "
            f"(SELECT sum(e*x0) AS g0, sum(e*x1) AS g1, sum(e*x2) AS g2, sum(e) AS gb FROM e{t}) g)"
        )
    ctes.append(
        f"pr AS (SELECT y, least(greatest(1 / (1 + exp(-(x0*w.w0 + x1*w.w1 + x2*w.w2 + w.b))), 1e-12), 1 - 1e-12) AS q FROM lab, w{_STEPS} w)"
    )
    loss = "(SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) FROM pr)"
    rows = " UNION ALL ".join(
        f"SELECT {t} AS step, round(w0, 9) AS w0, round(w1, 9) AS w1, round(w2, 9) AS w2, round(b, 9) AS bias, "
        f"{loss if t == _STEPS else 'NULL::DOUBLE'} AS loss FROM w{t}"
        for t in (2, 4, 6)
    )
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + rows


@query("logistic_sgd", _sgd_sql())
def logistic(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over all rows; the last step carries the loss over all of them."""
    data = with_index(B.labelled(spark, sf), ["id"])
    batch = -(-data.count() // _STEPS)
    fit = logistic_sgd(data, _STEPS, lr=_LR, batch=batch, checkpoint_every=2)
    fit.checkpoints.append((fit.step, fit.weights, fit.bias))
    return fit.checkpoint_frame(spark).select(
        "step",
        *[F.round(F.col("weights")[i], 9).alias(f"w{i}") for i in range(3)],
        F.round("bias", 9).alias("bias"),
        F.round(F.when(F.col("step") == fit.step, F.lit(fit.final_loss)), 9).alias("loss"),
    )


@query(
    "mean_log_loss",
    f"""WITH {B.LABELLED_SQL}, p AS (SELECT y, least(greatest(1 / (1 + exp(-(0.3 * x0 + 0.2 * x1 - 0.5 * x2 + 0.1))),
      1e-12), 1 - 1e-12) AS q FROM lab)
    SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS loss FROM p""",
)
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = mean_log_loss(B.labelled(spark, sf), [0.3, 0.2, -0.5], 0.1)
    return out.select(F.round("loss", 9).alias("loss"))


@query("sweep")
def sweep_query(spark: SparkSession, sf: str) -> DataFrame:
    return sweep(B.labelled(spark, sf), {"model": ["logreg"], "C": [0.01, 1.0, 100.0]})


@query(
    "fit_many",
    """SELECT l_partkey, CASE WHEN count(DISTINCT l_quantity) < 2 THEN 'ValueError: constant input' END AS error,
    round(CASE WHEN count(DISTINCT l_quantity) >= 2 THEN regr_slope(l_extendedprice, l_quantity) END, 3) AS slope
    FROM lineitem GROUP BY l_partkey""",
)
def fit_many_query(spark: SparkSession, sf: str) -> DataFrame:
    def slope(pdf):
        x, y = pdf["l_quantity"].to_numpy(), pdf["l_extendedprice"].to_numpy()
        if len(set(x)) < 2:
            raise ValueError("constant input")
        dx = x - x.mean()
        return {"slope": float((dx * (y - y.mean())).sum() / (dx * dx).sum())}

    lines = B.table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    out = fit_many(lines, "l_partkey", slope, "slope double")
    return out.select("l_partkey", "error", F.round("slope", 3).alias("slope"))


@query("fedavg_fit")
def fedavg_fit_query(spark: SparkSession, sf: str) -> DataFrame:
    # Round-robin over ids: the position within a shard is the id's quotient.
    data = B.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4).cast("int").alias("shard"),
        F.expr("vec_id div 4").alias("idx"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
    )
    config = LocalConfig(in_dim=64, hidden=16, out_dim=10, lr=0.5, batch_size=64, local_steps=8)
    most = data.agg(F.max("idx")).first()[0] + 1
    rounds = max(3, -(-most // config.rows_touched))  # as many as it takes to come past every row
    return fedavg_fit(data, config, rounds, min_participants=4, walk=True, shards=4).history_frame(spark)
