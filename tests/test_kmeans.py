import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import kmeans
from millrace.plans.kmeans_fit import MissingShards, kmeans_fit
from millrace.sources.generate import make_points, true_centers


def points(spark, rows):
    return spark.createDataFrame(
        [(i, 0, [float(v) for v in r]) for i, r in enumerate(rows)],
        "id bigint, shard int, features array<double>",
    )


def test_partial_stats_of_three_points(spark):
    out = kmeans.partial_stats(points(spark, [(0, 0), (1, 1), (9, 9)]), [[0, 0], [10, 10]])
    rows = {r["cluster"]: r for r in out.collect()}
    assert [rows[0]["count"], rows[1]["count"]] == [2, 1]
    assert rows[0]["sums"] == [1, 1] and rows[1]["sums"] == [9, 9]
    assert sum(r["inertia"] for r in rows.values()) == 4.0


def test_reduce_keeps_the_previous_center_of_an_empty_cluster(spark):
    partials = spark.createDataFrame(
        [(0, 0, [1.0, 1.0], 1, 1.5), (1, 0, [3.0, 3.0], 1, 0.5)],
        "shard int, cluster int, sums array<double>, count bigint, inertia double",
    )
    previous = kmeans.centroid_frame(spark, [[0, 0], [7.5, 7.5]])
    rows = {r["cluster"]: r for r in kmeans.reduce_partials(partials, previous).collect()}
    assert rows[0]["features"] == [2.0, 2.0] and rows[0]["inertia"] == 2.0
    assert rows[1]["features"] == [7.5, 7.5] and rows[1]["count"] == 0


def test_ties_go_to_the_lowest_cluster(spark):
    out = kmeans.nearest(points(spark, [(0, 0)]), [[1, 0], [-1, 0]]).first()
    assert out["cluster"] == 0 and out["d2"] == 1.0


def test_sharded_step_equals_numpy(spark):
    data = make_points(spark, seed=7, shards=6, per_shard=200, k=3, dims=5).persist()
    x = np.array([r["features"] for r in data.collect()])
    centers = true_centers(7, 3, 5) + 1.0
    d2 = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    label = d2.argmin(axis=1)
    rows = kmeans.partial_stats(data, centers.tolist(), by_shard=False).collect()
    for r in rows:
        mine = x[label == r["cluster"]]
        assert r["count"] == len(mine)
        assert np.allclose(r["sums"], mine.sum(axis=0), rtol=1e-9)
    assert math.isclose(sum(r["inertia"] for r in rows), d2.min(axis=1).sum(), rel_tol=1e-9)


def test_partials_and_distances_agree(spark):
    data = make_points(spark, seed=3, shards=2, per_shard=100, k=4, dims=6).persist()
    centers = true_centers(3, 4, 6).tolist()
    inertia = sum(r["inertia"] for r in kmeans.partial_stats(data, centers).collect())
    assert kmeans.nearest(data, centers).agg(F.sum("d2")).first()[0] == pytest.approx(inertia)


@pytest.mark.parametrize("rows", [[(0, 0), (1, 1, 1)], [(0, 0, 0), (1, 1, 1)]])
def test_points_of_another_length_are_an_error(spark, rows):
    for run in (kmeans.nearest, kmeans.partial_stats):
        with pytest.raises(Exception, match="differ in length|elements"):
            run(points(spark, rows), [[0, 0], [9, 9]]).collect()


def test_wide_vectors_and_many_centers(spark):
    x = np.random.default_rng(1).normal(size=(60, 300))
    rows = kmeans.partial_stats(points(spark, x.tolist()), x[:40].tolist(), by_shard=False).collect()
    assert sum(r["count"] for r in rows) == 60 and all(len(r["sums"]) == 300 for r in rows)


def test_fit_is_deterministic_and_improves(spark):
    data = make_points(spark, seed=5, shards=4, per_shard=150, k=3, dims=4)
    a = kmeans_fit(data, 3, iterations=4, seed=1, expected_shards=4)
    b = kmeans_fit(data, 3, iterations=4, seed=1)
    assert np.allclose(a.centroids, b.centroids)
    inertia = [h["inertia"] for h in a.history]
    assert inertia == sorted(inertia, reverse=True)
    with pytest.raises(MissingShards):
        kmeans_fit(data, 3, iterations=1, expected_shards=5)


def test_shards_do_not_depend_on_how_they_are_computed(spark):
    a = make_points(spark, 9, 3, 50, 2, 2).orderBy("id").collect()
    b = make_points(spark, 9, 3, 50, 2, 2).filter("shard = 1").orderBy("id").collect()
    assert [r for r in a if r["shard"] == 1] == b


def test_run_summary(spark):
    history = spark.createDataFrame([(0, 9.0, 1.0), (1, 5.0, 0.5)], "iteration int, inertia double, movement double")
    events = spark.createDataFrame(
        [("TASK_ATTEMPT_RETRIED",), ("RAY_WORKER_LOST",), ("OTHER",)], "type string"
    )
    results = spark.createDataFrame(
        [("n1", "p1", 10, 5), ("n1", "p1", 20, 5), ("n2", "p2", 1, 1)],
        "node string, pod string, samples bigint, busy_ms bigint",
    )
    per_node = kmeans.node_contributions(results)
    assert {(r["node"], r["tasks"], r["samples"]) for r in per_node.collect()} == {("n1", 2, 30), ("n2", 1, 1)}
    row = kmeans.run_summary(history, events, per_node).first()
    assert (row["iterations"], row["final_inertia"], row["tasks_retried"], row["workers_lost"]) == (2, 5.0, 1, 1)
    old, new = kmeans.centroid_frame(spark, [[0, 0]]), kmeans.centroid_frame(spark, [[3, 4]])
    assert kmeans.movement(old, new).first()[0] == 5.0
