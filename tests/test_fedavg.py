import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import fedavg
from millrace.plans import fedavg_fit as fit_module
from millrace.plans.fedavg_fit import fedavg_fit, fedavg_resume, weights_frame
from millrace.plans.local_update import LocalConfig, train


def contributions(spark, *parts, round_=0):
    """Each part: (samples, {param: (shape, data)})."""
    rows = []
    for i, (samples, params) in enumerate(parts):
        for name, (shape, data) in params.items():
            rows.append((round_, i, f"t{i}", samples, 0.5 + i, name, list(shape), [float(v) for v in data]))
    return spark.createDataFrame(rows, schemas.CONTRIBUTIONS)


def vector(*data):
    return {"w": ([len(data)], data)}


def problem(df):
    return {r["round"]: r for r in fedavg.validate(df).collect()}[0]


def test_weighted_mean_of_an_honest_round(spark):
    df = contributions(spark, (100, vector(0.1, 0.2)), (300, vector(0.5, -0.2)))
    reduced, events = fedavg.reduce_round(df)
    assert events.count() == 0
    assert reduced.first()["data"] == pytest.approx([0.4, -0.1], abs=1e-12)


def test_oversized_contribution_is_scaled_to_three_medians(spark):
    df = contributions(spark, *[(100, vector(v)) for v in (0.9, 1.0, 1.1, 1e6)])
    reduced, events = fedavg.reduce_round(df)
    hit = events.collect()
    assert len(hit) == 1 and hit[0]["position"] == 3
    assert hit[0]["cap"] == pytest.approx(3.15)
    assert reduced.first()["data"][0] == pytest.approx(1.5375)
    clipped = {r["position"]: r["data"] for r in fedavg.clip(df).collect()}
    assert clipped[3][0] == pytest.approx(3.15) and clipped[0] == [0.9]


def test_single_and_zero_contributions(spark):
    one, events = fedavg.reduce_round(contributions(spark, (5, vector(7.0))))
    assert one.first()["data"] == [7.0] and events.count() == 0
    zeros = contributions(spark, (5, vector(0.0)), (5, vector(0.0)), (5, vector(4.0)))
    reduced, events = fedavg.reduce_round(zeros)
    assert reduced.first()["data"] == [0.0] and events.first()["scale"] == 0.0


@pytest.mark.parametrize("bad", [0, -1.0, float("nan"), float("inf"), "3", None, True])
def test_clip_factor_must_be_usable(bad):
    with pytest.raises(ValueError):
        fedavg.check_clip_factor(bad)


@pytest.mark.parametrize(
    "samples, expected",
    [([1, -3], "negative_total"), ([0, 0], "zero_total"), ([-999, 1000], "non_positive_samples")],
)
def test_sample_totals_and_counts(spark, samples, expected):
    got = problem(contributions(spark, *[(n, vector(1.0)) for n in samples]))
    assert got["problem"] == expected


@pytest.mark.parametrize(
    "text, expected",
    [("true", "non_integer_samples"), ("2.5", "non_integer_samples"), ('"4"', "non_integer_samples"), ("3", None)],
)
def test_sample_types_stay_apart(spark, text, expected):
    df = contributions(spark, (1, vector(1.0)), (1, vector(2.0)))
    df = df.withColumn("samples", F.parse_json(F.when(F.col("position") == 1, text).otherwise("3")))
    got = problem(df)
    assert got["problem"] == expected
    if expected:
        assert got["position"] == 1
        assert fedavg.bad_sample_counts(df).first()["problem"] == expected


def test_first_problem_by_position_then_kind(spark):
    nan = float("nan")
    df = contributions(spark, (1, vector(1.0, 2.0)), (1, vector(1.0, nan)), (1, vector(1.0)))
    got = problem(df)
    assert (got["problem"], got["position"], got["param"], got["index"]) == ("non_finite_value", 1, "w", 1)
    sound = contributions(spark, (1, vector(1.0)), (1, {"w": ([1], [1]), "b": ([1], [1])}))
    assert problem(sound)["problem"] == "parameter_names_differ"
    missing = contributions(spark, (1, {"w": ([1], [1]), "b": ([1], [1])}), (1, vector(1.0)))
    assert problem(missing)["position"] == 1
    shaped = contributions(spark, (1, {"w": ([2, 1], [1, 2])}), (1, {"w": ([1, 2], [1, 2])}))
    assert problem(shaped)["problem"] == "shape_mismatch"
    short = contributions(spark, (1, {"w": ([3], [1, 2])}))
    assert (problem(short)["problem"], problem(short)["position"]) == ("length_mismatch", 0)
    scalar = contributions(spark, (1, {"s": ([], [1.0])}))
    assert problem(scalar)["problem"] is None
    assert fedavg.non_finite(df).first()["index"] == 1
    assert fedavg.shape_mismatches(shaped).count() == 1


def test_missing_round_is_reported(spark):
    df = contributions(spark, (1, vector(1.0)))
    rounds = spark.createDataFrame([(0,), (1,)], "round int")
    got = {r["round"]: r["problem"] for r in fedavg.validate(df, rounds).collect()}
    assert got == {0: None, 1: "no_contributions"}


def test_quorum_counts_only_expected_completed_keys(spark):
    tasks = spark.createDataFrame(
        [(0, "j", "a", "COMPLETED"), (0, "j", "b", "FAILED"), (0, "j", "c", "COMPLETED")],
        "round int, job_id string, task_id string, state string",
    )
    commits = spark.createDataFrame(
        [("j", f"jobs/j/{t}/metrics.json", f"2024-01-01 00:00:0{i}") for i, t in enumerate("abc")]
        + [("j", "jobs/j/a/x/metrics.json", "2024-01-01 00:00:00"), ("j", "jobs/j/zzz/metrics.json", "2024-01-01 00:00:00")],
        "job_id string, key string, ts string",
    ).withColumn("ts", F.to_timestamp("ts"))
    who = {r["task_id"] for r in fedavg.participants(commits, tasks, 2).collect()}
    assert who == {"a", "c"}
    assert fedavg.participants(commits, tasks, 3).count() == 0
    early = fedavg.participants(commits, tasks, 1, F.to_timestamp(F.lit("2024-01-01 00:00:01")))
    assert [r["task_id"] for r in early.collect()] == ["a"]


def shards(spark, n=400, dims=4):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dims))
    y = (x @ rng.normal(size=dims) > 0).astype(int)
    rows = [(i % 4, i // 4, x[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "shard int, idx bigint, features array<double>, label int")


CONFIG = LocalConfig(in_dim=4, hidden=8, out_dim=2, lr=0.3, batch_size=20, local_steps=8)


def test_rounds_converge_and_a_stopped_run_resumes(spark, tmp_path):
    data = shards(spark).persist()
    seen = []
    whole = fedavg_fit(data, CONFIG, rounds=3, min_participants=4, on_round=seen.append)
    losses = [h["mean_loss"] for h in whole.history]
    assert losses[-1] < losses[0] and [h["round"] for h in seen] == [0, 1, 2]
    folder = str(tmp_path / "run")
    fedavg_fit(data, CONFIG, rounds=2, folder=folder)
    assert fedavg_resume(spark, folder)[0] == 2
    rest = fedavg_fit(data, CONFIG, rounds=3, folder=folder, resume=True)
    assert [h["round"] for h in rest.history] == [2]
    for k, v in whole.weights.items():
        assert np.allclose(v, rest.weights[k], atol=1e-9)


def test_rounds_walk_through_all_rows(spark, tmp_path):
    """Shards of 100 and 37 rows, 40 a round: row after row, around the end, also after a stop."""
    data = shards(spark).filter("shard < 2 AND (shard = 0 OR idx < 37)").persist()
    config = LocalConfig(in_dim=4, hidden=8, out_dim=2, lr=0.3, batch_size=10, local_steps=4)
    rows = {s: sorted([r for r in data.collect() if r["shard"] == s], key=lambda r: r["idx"]) for s in (0, 1)}
    weights, losses = None, []
    for r in range(4):
        made = []
        for s, own in rows.items():
            at = [(r * 40 + k) % len(own) for k in range(40)]
            x = np.array([own[k]["features"] for k in at])
            y = np.array([own[k]["label"] for k in at])
            base = weights or config.initial()
            w, loss = train(config, base, x, y, 40)
            made.append((len(own), loss, {k: w[k] - base[k] if weights else w[k] for k in w}))
        norms = [math.sqrt(sum((v**2).sum() for v in d.values())) for _, _, d in made]
        cap = float(np.median(norms)) * fedavg.CLIP_FACTOR
        total = sum(n for n, _, _ in made)
        mean = {k: sum(n * d[k] * min(1.0, cap / q) for (n, _, d), q in zip(made, norms)) / total for k in made[0][2]}
        weights = {k: weights[k] + mean[k] for k in mean} if weights else mean
        losses.append(sum(n * loss for n, loss, _ in made) / total)
    whole = fedavg_fit(data, config, rounds=4, walk=True, shards=2)
    assert np.allclose([h["mean_loss"] for h in whole.history], losses, atol=1e-9)
    assert all(np.allclose(whole.weights[k], weights[k], atol=1e-9) for k in weights)
    folder = str(tmp_path / "run")
    fedavg_fit(data, config, rounds=2, folder=folder, walk=True)
    rest = fedavg_fit(data, config, rounds=4, folder=folder, resume=True, walk=True)
    assert all(np.allclose(rest.weights[k], weights[k], atol=1e-9) for k in weights)
    with pytest.raises(fit_module.EmptyShard, match="shard 2"):
        fedavg_fit(data, config, rounds=1, shards=3)


def test_quorum_not_met_stops_the_round(spark):
    with pytest.raises(fedavg.QuorumNotMet):
        fedavg_fit(shards(spark), CONFIG, rounds=1, min_participants=5)


def test_resume_refuses_bad_weights(spark, tmp_path):
    folder = str(tmp_path)
    assert fedavg_resume(spark, folder) == (0, None)
    with pytest.raises(fedavg.InvalidRound, match="starts at round 5"):
        fedavg_resume(spark, folder, rounds=[5, 6])
    bad = weights_frame(spark, {"w": np.array([1.0, float("nan")])})
    bad.write.parquet(f"{folder}/weights/round=0")
    with pytest.raises(fedavg.InvalidRound, match="not finite"):
        fedavg_resume(spark, folder)
    weights_frame(spark, {"w": np.array([])}).write.parquet(f"{folder}/weights/round=1")
    with pytest.raises(fedavg.InvalidRound, match="empty"):
        fedavg_resume(spark, folder)


def test_weights_after_and_apply(spark):
    start = weights_frame(spark, {"w": np.array([1.0, 2.0])})
    reduced = spark.createDataFrame(
        [(0, "w", [1.0, 0.0]), (1, "w", [0.5, -1.0])], "round int, param string, data array<double>"
    )
    after = {r["round"]: r["data"] for r in fedavg.weights_after(start, reduced).collect()}
    assert after == {0: [2.0, 2.0], 1: [2.5, 1.0]}
    moved = fedavg.apply_delta(start, reduced.filter("round = 1"), 2.0).first()["data"]
    assert moved == [2.0, 0.0]
    assert fedavg.subtract(start, start).first()["data"] == [0.0, 0.0]


@pytest.mark.parametrize(
    "delta, match",
    [({"v": [1.0, 1.0]}, "missing"), ({"w": [1.0]}, "another size"), ({"w": [1.0, float("nan")]}, "not finite")],
)
def test_arithmetic_refuses_what_does_not_match(spark, delta, match):
    start = weights_frame(spark, {"w": np.array([1.0, 2.0])})
    other = weights_frame(spark, {k: np.array(v) for k, v in delta.items()})
    for run in (fedavg.apply_delta, fedavg.subtract):
        with pytest.raises(Exception, match=match):
            run(start, other).collect()
    if match != "not finite":
        rounds = other.select(F.lit(0).alias("round"), "param", "data")
        with pytest.raises(Exception, match="does not match the start"):
            fedavg.weights_after(start, rounds).collect()


def test_arithmetic_refuses_another_shape(spark):
    two, three = (weights_frame(spark, {"w": np.zeros(shape)}) for shape in ((2, 3), (3, 2)))
    for run in (fedavg.apply_delta, fedavg.subtract):
        with pytest.raises(Exception, match="another shape"):
            run(two, three).collect()


def test_means_in_blocks_are_the_means(spark):
    rng = np.random.default_rng(5)
    rows = [(r, t, f"t{t}", 10 + t, 0.5, "w", [10_000], rng.normal(size=10_000).tolist()) for r in (0, 1) for t in range(3)]
    df = spark.createDataFrame(rows, "round int, position int, task_id string, samples bigint, loss double, param string, shape array<int>, data array<double>")
    whole = {r["round"]: r["data"] for r in fedavg.weighted_mean(df).collect()}
    blocks = fedavg.weighted_mean(df, blocks=True).collect()
    assert sorted((b["round"], b["block"], len(b["data"])) for b in blocks) == [
        (r, k, n) for r in (0, 1) for k, n in ((0, 4096), (1, 4096), (2, 1808))]
    for r in (0, 1):
        joined = [x for b in sorted((b for b in blocks if b["round"] == r), key=lambda b: b["block"]) for x in b["data"]]
        want = sum(np.array(row[7]) * row[3] for row in rows if row[0] == r) / 33
        assert np.allclose(joined, want, atol=1e-12) and joined == whole[r]


def test_local_training_ignores_rows_it_cannot_reach():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, size=500)
    full, loss = train(CONFIG, CONFIG.initial(), x, y, 500)
    cut, same = train(CONFIG, CONFIG.initial(), x[: CONFIG.rows_touched], y[: CONFIG.rows_touched], 500)
    assert math.isclose(loss, same) and all(np.array_equal(full[k], cut[k]) for k in full)
    assert fit_module.FedAvgFit({}).history == []
