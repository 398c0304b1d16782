import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import sizing as Z
from millrace.bindings import SIZING_COLUMNS
from millrace.plans.sgd import logistic_resume, logistic_sgd, mean_log_loss
from millrace.plans.sweep import fit_many, sweep
from millrace.sources.generate import make_labelled


@pytest.fixture(scope="module")
def data(spark):
    return make_labelled(spark, seed=3, n=300, dims=3).withColumnRenamed("id", "idx").persist()


def reference(x, y, steps, lr, batch):
    w, b = np.zeros(x.shape[1]), 0.0
    for t in range(1, steps + 1):
        i = ((t - 1) * batch + np.arange(batch)) % len(x)
        e = 1 / (1 + np.exp(-(x[i] @ w + b))) - y[i]
        w, b = w - lr * x[i].T @ e / batch, b - lr * e.sum() / batch
    return w, b


@pytest.mark.parametrize("batch", [70, 300, 700])
def test_sgd_equals_the_sequential_run(data, batch):
    rows = data.orderBy("idx").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    fit = logistic_sgd(data, 5, lr=0.5, batch=batch, checkpoint_every=2)
    w, b = reference(x, y, 5, 0.5, batch)
    assert np.allclose(fit.weights, w, atol=1e-12) and fit.bias == pytest.approx(b, abs=1e-12)
    assert [c[0] for c in fit.checkpoints] == [2, 4] and 0 < fit.final_loss < 1


def test_resume_equals_uninterrupted(spark, data, tmp_path):
    whole = logistic_sgd(data, 6, batch=64, checkpoint_every=3, checkpoint_path=str(tmp_path))
    start = logistic_resume(spark, str(tmp_path))
    assert start[0] == 3
    rest = logistic_sgd(data, 6, batch=64, start=start)
    assert np.allclose(whole.weights, rest.weights, atol=1e-12)
    assert whole.final_loss == pytest.approx(rest.final_loss, abs=1e-12)
    assert mean_log_loss(data, [0.0] * 3, 0.0).first()["loss"] == pytest.approx(np.log(2))


def test_sweep_beats_the_majority_class(data):
    rows = data.withColumnRenamed("idx", "id")
    grid = {"model": ["logreg"], "C": [0.001, 10.0]}
    out = sweep(rows, grid).orderBy("trial").collect()
    share = rows.agg(F.avg("label")).first()[0]
    assert max(r["accuracy_mean"] for r in out) > max(share, 1 - share) + 0.1
    assert all(len(r["accuracy_folds"]) == 3 and r["n_samples"] == 300 for r in out)
    assert out == sweep(rows, grid).orderBy("trial").collect()


def test_forest_trial(data):
    out = sweep(data.withColumnRenamed("idx", "id"), [{"model": "rf", "n_estimators": 5, "max_depth": 3}], cv=2)
    assert out.first()["accuracy_mean"] > 0.6
    with pytest.raises(ValueError, match="unsupported"):
        sweep(data.withColumnRenamed("idx", "id"), [{"model": "svm"}])


def test_one_bad_group_does_not_stop_the_others(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -1.0)], "g string, v double")

    def fn(pdf):
        if (pdf["v"] < 0).any():
            raise ValueError("negative")
        return {"mean": float(pdf["v"].mean())}

    got = {r["g"]: (r["mean"], r["error"]) for r in fit_many(df, "g", fn, "mean double").collect()}
    assert got == {"a": (2.0, None), "b": (None, "ValueError: negative")}


def test_many_groups_are_fitted_out_of_common_batches(spark):
    """Groups begin and end anywhere in a batch; nulls of one do not change another's types."""
    rows = [(i % 7 or None, i, 2**60 + i if i % 7 < 5 else None, i % 2 == 0 if i % 7 != 3 or i > 9 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id bigint, big bigint, flag boolean")

    def fn(pdf):
        assert list(pdf.index) == list(range(len(pdf)))
        if pdf["g"].iloc[0] == 6:
            raise ValueError("six")
        return {"n": len(pdf), "ids": int(pdf["id"].sum()), "most": None if pdf["big"].isna().all() else pdf["big"].max(),
                "types": f"{pdf['g'].dtype} {pdf['big'].dtype} {pdf['flag'].dtype}"}

    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        big = [r[2] for r in own if r[2] is not None]
        types = f"{'float64' if g is None else 'int32'} {'int64' if big else 'float64'} {'object' if g == 3 else 'bool'}"
        values = (len(own), sum(r[1] for r in own), max(big, default=None), types, None)
        want[g] = (None, None, None, None, "ValueError: six") if g == 6 else values
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(batch)
    try:
        for size in ("1", "4", "25", "10000"):
            spark.conf.set(batch, size)
            out = fit_many(df, "g", fn, "n bigint, ids bigint, most bigint, types string")
            assert {r["g"]: (r["n"], r["ids"], r["most"], r["types"], r["error"]) for r in out.collect()} == want
    finally:
        spark.conf.set(batch, was)
    # A call of Python for every group took most of the time.
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


# -- sizing -------------------------------------------------------------------

DEFAULTS = dict(
    kind="transformer_finetune", model="Qwen/Qwen2.5-7B", method="lora", lora_rank=16, precision="bf16",
    optimizer="adamw", seq_len=2048, micro_batch=1, grad_accum=8, gpus=4, gpu_type="RTX4090", hosts=1,
    interconnect="same_host_pcie", cpu_ram_gb=128.0, cpu_cores=8, mode="balanced", allow_quantization=True,
    allow_cpu_offload=True, needs_gpu=False, supports_partial_fit=False, trainable_fraction=1.0,
)


def request(spark, **kw):
    row = {**DEFAULTS, **kw}
    values = [row.get(n) for n, _, _ in SIZING_COLUMNS]
    schema = "request_id bigint, " + ", ".join(f"{n} {t}" for n, t, _ in SIZING_COLUMNS)
    return spark.createDataFrame([(1, *values)], schema)


def verdicts(spark, **kw):
    return Z.candidates(request(spark, **kw)).collect()


def plan(spark, **kw):
    return Z.select_plans(request(spark, **kw)).first()


def test_full_fine_tune_needs_offload(spark):
    rows = verdicts(spark, method="full")
    for r in rows:
        if r["strategy_family"] in ("single_gpu", "ddp"):
            assert r["status"] == "infeasible" and r["total_gb"] > 100
    chosen = plan(spark, method="full")
    assert chosen["selected"].startswith("zero3_cpu_offload")
    starved = plan(spark, method="full", cpu_ram_gb=8.0)
    assert starved["selected"] is None and "GPU memory" in starved["hint"]


def test_adapters_fit_one_gpu_and_checkpointing_rescues(spark):
    assert any(r["name"] == "single_gpu" and r["status"] == "feasible" for r in verdicts(spark))
    rows = verdicts(spark, gpus=1, seq_len=8192, micro_batch=4)
    assert any(r["name"].endswith("+ackpt") for r in rows)


def test_slow_link_refuses_the_full_gradient(spark):
    rows = verdicts(spark, model="Llama-3.2-1B", method="full", gpus=2, gpu_type="A100-80GB", hosts=2, interconnect="wan")
    assert all(r["status"] == "infeasible" for r in rows if r["strategy_family"] == "ddp")
    assert any(r["status"] == "feasible" for r in rows if r["workers"] == 1)


def test_objectives(spark):
    priced = dict(train_tokens_m=25.0, hourly_cost=0.44)
    assert plan(spark, mode="reliable", **priced)["workers"] == 1
    assert plan(spark, mode="fastest", **priced)["workers"] == 4
    late = plan(spark, deadline_minutes=10.0, **priced)
    assert late["selected"] is None and "deadline" in late["hint"]
    ranked = Z.rank_candidates(Z.candidates(request(spark, **priced))).orderBy("rank").collect()
    best = plan(spark, **priced)
    assert (ranked[0]["name"], ranked[0]["runner_up"]) == (best["selected"], best["runner_up"])
    order = [r["status"] for r in Z.order_candidates(Z.candidates(request(spark, deadline_minutes=10.0, **priced))).collect()]
    assert order == sorted(order, key=Z.STATUS_ORDER.index)


def test_other_kinds(spark):
    waves = plan(spark, kind="independent_tasks", task_count=24, est_minutes_per_task=12.0, hosts=3, gpus=0)
    assert (waves["selected"], waves["workers"], waves["est_time_min"]) == ("lease_tasks", 6, 48.0)
    shards = verdicts(spark, kind="classical_ml", dataset_mb=5000.0, supports_partial_fit=True, cpu_ram_gb=8.0)
    assert {(r["name"], r["workers"], r["status"]) for r in shards} == {
        ("local_process", 1, "infeasible"), ("sharded_partial_fit", 10, "feasible")}
    assert plan(spark, model="who/knows")["hint"] == "model size unknown"
    assert plan(spark, gpu_type="who-knows")["hint"] == "GPU memory unknown"
    assert plan(spark, gpus=0)["hint"] == "needs a GPU"
    a, b = (Z.request_digest(request(spark), "1").first()["digest"] for _ in range(2))
    assert a == b and len(a) == 16 and a != Z.request_digest(request(spark), "2").first()["digest"]
