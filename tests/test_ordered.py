"""Bucketed operators against plain windows, with one key holding most rows."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ordered, quantiles
from millrace.operators.arrays import sum_arrays
from millrace.operators.ordered import count_in_window, prefix_sums
from millrace.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    data = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(6)}"
        data.append((key, i, rnd.randrange(0, 200_000), round(rnd.random() * 10, 1)))
    df = spark.createDataFrame(data, "k string, id bigint, sec bigint, v double")
    return df.withColumn("ts", F.timestamp_seconds("sec")).persist()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_previous_row(rows):
    got = ordered.previous_row(rows, ["k"], ["ts", "id"], ["v"], ordered.time_bucket(F.col("ts"), 3600))
    w = Window.partitionBy("k").orderBy("ts", "id")
    same(got.select("id", "prev_v"), rows.select("id", F.lag("v").over(w).alias("prev_v")))


def test_row_numbers_and_running_sum(rows):
    w = Window.partitionBy("k").orderBy("ts", "id")
    bucket = ordered.time_bucket(F.col("ts"), 7200)
    same(
        ordered.row_numbers(rows, ["k"], ["ts", "id"], bucket, "n").select("id", "n"),
        rows.select("id", F.row_number().over(w).alias("n")),
    )
    got = ordered.running_sum(rows, ["k"], ["ts", "id"], "v", bucket, "s").select("id", F.round("s", 6))
    want = rows.select("id", F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6))
    same(got, want)


def test_count_in_window_includes_both_ends(rows):
    w = Window.partitionBy("k").orderBy("sec").rangeBetween(-600, 0)
    got = ordered.count_in_window(rows, ["k"], "ts", 600, "n").select("id", "n")
    same(got, rows.select("id", F.count(F.lit(1)).over(w).alias("n")))


def test_with_index_is_the_global_order(rows):
    got = {r["id"]: r["idx"] for r in ordered.with_index(rows.select("id"), ["id"]).collect()}
    assert got == {i: i for i in range(3000)}


@pytest.mark.parametrize("buckets", [4, 64, 256])
def test_percentiles_are_exact(spark, rows, buckets):
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in exact_percentiles(rows, ["k"], "v", probs, buckets).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k]["repeats"] == len(vs)
        for name, q in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, q * 100), abs=1e-9)
    one = exact_percentiles(rows.filter("id = 7"), [], "v", {"m": 0.5}).first()
    assert one["m"] == rows.filter("id = 7").first()["v"]
    assert exact_percentiles(rows.filter("id < 0"), ["k"], "v", {"m": 0.5}).count() == 0


def test_sum_arrays_by_group(spark):
    data = [("a", 0, [1.0, 2.0], 2.0), ("a", 0, [3.0, 4.0], 1.0), ("b", 1, [5.0], 0.5)]
    df = spark.createDataFrame(data, "k string, r int, a array<double>, w double")
    got = {r["k"]: r["data"] for r in sum_arrays(df, ["k", "r"], "a", "w").collect()}
    assert got == {"a": [5.0, 8.0], "b": [2.5]}
    with pytest.raises(Exception, match="differ in length"):
        sum_arrays(df.coalesce(1).withColumn("k", F.lit("x")).withColumn("r", F.lit(1)), ["k", "r"], "a").collect()


def test_percentiles_of_cut_up_groups(spark):
    """Groups of very different size and spread, cut several times over before a sort."""
    rng = random.Random(7)
    rows = [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200)) for _ in range(4000)]
    rows += [("narrow", 1.0 + k * 2**-52) for k in range(3000)] + [("same", 5.0)] * 2000 + [("few", 1.0), ("few", 4.0)]
    rows += [("none", None), ("ties", 3.0), *[("ties", float(k // 40)) for k in range(2000)]]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", probs, buckets=4, sorted_=50).collect()}
    assert set(got) == {"wide", "narrow", "same", "few", "ties"}
    for k, r in got.items():
        values = np.array([v for g, v in rows if g == k and v is not None])
        assert r["repeats"] == len(values)
        for name, q in probs.items():
            low, high = np.sort(values)[[int(q * (len(values) - 1)), min(int(q * (len(values) - 1)) + 1, len(values) - 1)]]
            want = low + (high - low) * (q * (len(values) - 1) - int(q * (len(values) - 1)))
            assert r[name] == pytest.approx(want, rel=1e-12), (k, name)


def test_no_task_sorts_a_whole_group(spark, monkeypatch):
    """A million distinct values of one group: what is sorted at the end stays small."""
    seen = []
    real = quantiles.written

    def watch(df, name):
        out = real(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(quantiles, "written", watch)
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    row = exact_percentiles(df, [], "v", {"p50": 0.5}, sorted_=10_000).first()
    values = np.sort(np.arange(1_000_000) * 7919 % 1_000_003)
    assert row["p50"] == (values[499_999] + values[500_000]) / 2
    rows = [n for name, n in seen if name == "percentile-rows"]
    assert rows and rows[-1] <= 20_000 and rows == sorted(rows, reverse=True)


@pytest.mark.parametrize("seconds", [0.0, 2.5, 3600.0])
def test_window_counts_against_brute_force(spark, seconds):
    rng = random.Random(3)
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.choice("ab"), base + timedelta(microseconds=500_000 * rng.randrange(60)), "text " * k) for k in range(200)]
    rows += [("a", None, "x"), (None, base, "y")]
    df = spark.createDataFrame(rows, "pool string, ts timestamp, log string").repartition(4)
    got = sorted((str(r["pool"]), str(r["ts"]), r["log"], r["n"]) for r in count_in_window(df, ["pool"], "ts", seconds, "n").collect())
    width = timedelta(seconds=seconds)
    seen = lambda p, t: 0 if p is None or t is None else sum(q == p and u is not None and t - width <= u <= t for q, u, _ in rows)
    want = sorted((str(p), str(t.replace(tzinfo=None) if t else None), log, seen(p, t)) for p, t, log in rows)
    assert [(a, c, d) for a, _, c, d in got] == [(a, c, d) for a, _, c, d in want]


def test_prefix_sums_of_one_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") * 7 % 5000).alias("x"), (F.col("id") % 11).alias("v"))
    rows = prefix_sums(df.repartition(6), ["k"], ["x"], "v", "s").orderBy("x").collect()
    assert [r["s"] for r in rows] == np.cumsum([r["v"] for r in rows]).tolist()
