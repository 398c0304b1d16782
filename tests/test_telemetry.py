import json

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import keys as K
from millrace.functions import readings as R
from millrace.operators import expansion, rules
from millrace.operators import runstats as S
from millrace.operators import telemetry as M
from millrace.sources import files, fleet


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# -- readers ------------------------------------------------------------------


def test_torn_lines_do_not_stop_a_scan(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"ts": 1}\n\n{"ts": 2, "x": NaN}\n[{"ts": 9}]\n3\n{"ts": "text"}\n{"ts": 3')
    rows, rejects = files.read_jsonl(spark, str(tmp_path / "m.jsonl"), "ts double, x double")
    assert [r["ts"] for r in rows.collect()] == [1.0, 2.0, None]
    assert sorted(r["value"] for r in rejects.collect()) == ["3", '[{"ts": 9}]', '{"ts": 3']


def test_run_documents(spark, tmp_path):
    run = {"contract": "viewer_v1", "state": "RUNNING", "started_at": 1.0, "max_restarts": 2,
           "attempts": [{"attempt_id": "task-000", "job_id": "j"}, {"attempt_id": "task-000-r1"}],
           "events": [{"ts": 1.0, "type": "X", "message": "m"}], "trials": [{"loss": 0.5}]}
    for name, text in [("a", json.dumps(run)), ("b", '{"contract": "other"}'), ("c", '{"contract": "vie'), ("d", "[]")]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    runs, rejects = files.read_runs(spark, str(tmp_path), "run.json")
    assert runs.first()["state"] == "RUNNING"
    assert sorted(r["error"] for r in rejects.collect()) == ["foreign contract", "unreadable", "unreadable"]
    attempts, events, trials = files.run_parts(runs)
    assert (attempts.count(), events.count(), trials.count()) == (2, 1, 1)
    assert [r[0] for r in attempts.select(K.is_restart(F.col("attempt_id"))).collect()] == [False, True]


def test_ranks_in_order(spark, tmp_path):
    d = tmp_path / "att" / "ranks"
    d.mkdir(parents=True)
    (d / "rank-1.json").write_text('{"rank": 1, "step": 5}')
    (d / "rank-0.json").write_text('{"rank": 0, "step": 4}')
    (d / "rank-2.json").write_text('{"rank": 2, "st')
    assert [r["rank"] for r in files.read_ranks(spark, str(tmp_path)).collect()] == [0, 1]
    assert files.read_ranks(spark, str(tmp_path / "none")).count() == 0


def test_points_and_shards(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("1,2,0\n\n3.5,4,1\n")
    assert sorted(r["features"] for r in files.read_points(spark, str(path)).collect()) == [[1.0, 2.0, 0.0], [3.5, 4.0, 1.0]]
    assert sorted((r["features"], r["label"]) for r in files.read_labelled(spark, str(path)).collect()) == [([1.0, 2.0], 0.0), ([3.5, 4.0], 1.0)]
    path.write_text("1,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_points(spark, str(path)).collect()
    df = spark.range(10).withColumn("features", F.array(F.col("id").cast("double")))
    sharded = files.shard_rows(df, 3, ["id"])
    assert {r["id"]: r["shard"] for r in sharded.collect()} == {i: i % 3 for i in range(10)}
    files.write_points(sharded, str(tmp_path / "out"), digits=6)
    assert (tmp_path / "out" / "shard=2").is_dir()
    assert spark.read.text(str(tmp_path / "out")).filter("value = '7.000000'").count() == 1


def test_ledger_store_and_results(spark, tmp_path):
    rows = frame(spark, "seq bigint, job_id string, type string, ts string", (2, "j", "B", "2024-01-02 00:00:00"), (1, "j", "A", "2024-01-01 00:00:00"), (3, "k", "A", "2024-01-01 00:00:00"))
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    files.append_events(rows, str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert [r["type"] for r in files.events_for(back, "j").collect()] == ["A", "B"]
    assert {(r["job_id"], r["seq"]) for r in files.latest_jobs(rows).collect()} == {("j", 2), ("k", 3)}
    files.write_results(str(tmp_path / "r"), history=rows)
    assert spark.read.parquet(str(tmp_path / "r" / "history")).count() == 3


def test_fleet_inventory(spark):
    probes = frame(
        spark, "node_id string, pool string, gpu_text string, util_text string, cpu_q string, mem_q string",
        ("a", "p", "0, A100, 40536, 550.1, 8.0\n1, [N/A], -5, n/a\nNo devices were found\n-1, x, 1", "0\n50 %\n140\nn/a", "500m", "2Gi"),
        ("b", "p", "", "n/a", "2", "1.5G"),
    )
    devices, nodes, pools = fleet.fleet_inventory(probes)
    got = [(r["index"], r["name"], r["memory_total_mb"], r["driver_version"], r["compute_capability"]) for r in devices.orderBy("index").collect()]
    assert got == [(0, "A100", 40536, "550.1", "8.0"), (1, "", None, "", "")]
    n = {r["node_id"]: r for r in nodes.collect()}
    assert n["a"]["gpu_util_percent"] == 25.0 and n["b"]["gpu_util_percent"] is None
    assert (n["a"]["cpu_cores"], n["a"]["memory_bytes"], n["b"]["memory_bytes"]) == (0.5, 2 * 1024**3, 1_500_000_000)
    p = pools.first()
    assert (p["nodes"], p["gpus"], p["cpu_cores"]) == (2, 2, 2.5)


# -- telemetry ----------------------------------------------------------------


def test_tail_newest_and_recent(spark):
    df = frame(spark, "k string, ts double, cpu int", ("a", 5.0, 10), ("a", 9.0, 90), ("b", 1.0, 5))
    assert M.newest(df, ["k"], "ts").filter("k = 'a'").first()["cpu"] == 90
    assert {r["ts"] for r in M.tail(df, ["k"], ["ts"], 1).collect()} == {9.0, 1.0}
    attempts = spark.range(20).selectExpr("'r' AS run_id", "id AS started_at", "concat('t', id) AS attempt_id")
    shown = M.recent_attempts(attempts)
    assert shown.count() == 16 and shown.first()["hidden"] == 4


def test_step_rate_goes_stale(spark):
    beats = frame(spark, "run_id string, ts double, step bigint",
                  ("a", 0.0, 0), ("a", 10.0, 20), ("a", 10.0, 30), ("a", 20.0, 10), ("b", 0.0, 5))
    live = {r["run_id"]: r for r in M.step_rate(beats, 21.0).collect()}
    assert (live["a"]["steps_per_s"], live["a"]["step_latency_ms"], live["a"]["step"]) == (2.0, 500, 10)
    assert live["b"]["steps_per_s"] is None
    assert {r["steps_per_s"] for r in M.step_rate(beats, 26.0).collect()} == {None}
    stopped = M.step_rate(beats, 21.0, running=frame(spark, "run_id string", ("b",)))
    assert {r["steps_per_s"] for r in stopped.collect()} == {None}


def test_loss_curve(spark):
    m = frame(
        spark, "run_id string, attempt int, line bigint, values map<string,double>",
        ("r", 0, 0, {"step": 1.0, "loss": 3.0}), ("r", 0, 1, {"epoch": 1.0}), ("r", 0, 2, {"acc": 0.5}),
        ("r", 1, 0, {"step": 7.0, "loss": 2.0}), ("r", 1, 1, {"step": 8.0, "loss": float("nan")}),
    )
    pts = sorted((r["x"], r["y"], r["loss_key"]) for r in M.loss_curve(m).collect())
    assert pts == [(1.0, 0.5, "acc"), (1.0, 3.0, "loss"), (7.0, 2.0, "loss")]


def test_descendants_and_cycles(spark):
    p = frame(spark, "s int, pid int, ppid int",
              (1, 10, 1), (1, 11, 10), (1, 12, 11), (1, 99, 98), (1, 1, 0), (2, 10, 11), (2, 11, 5))
    out = M.descendants(p, ["s"], (F.col("s") == 1) & (F.col("pid") == 10))
    assert {(r["pid"], r["root_pid"], r["depth"]) for r in out.collect()} == {(10, 10, 0), (11, 10, 1), (12, 10, 2)}
    loop = frame(spark, "s int, pid int, ppid int", (1, 1, 2), (1, 2, 1))
    with pytest.raises(ValueError, match="cycle"):
        M.descendants(loop, ["s"], F.lit(False), max_rounds=4)


def test_only_open_processes_are_written_again(spark, monkeypatch):
    """A chain of 200 and 300 processes beside their root: the rounds write ever fewer rows."""
    sizes, real = [], M.written

    def watch(df, name):
        out = real(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(M, "written", watch)
    chain = [(1, k, k - 1 if k else None) for k in range(200)] + [(1, 1000 + k, 0) for k in range(300)]
    out = M.descendants(frame(spark, "s int, pid int, ppid int", *chain), ["s"], F.col("pid") == 0)
    depths = {r["pid"]: r["depth"] for r in out.collect()}
    assert depths == {**{k: k for k in range(200)}, **{1000 + k: 1 for k in range(300)}}
    rounds = [n for name, n in sizes if name == "processes"][1:]
    assert len(rounds) == 8 and rounds == sorted(rounds, reverse=True) and rounds[1] < 200


def test_means_and_set_changes(spark):
    df = frame(spark, "n string, cpu double", ("a", 0.0), ("a", float("nan")), ("a", None), ("b", None))
    got = {r["n"]: (r["cpu_mean"], r["cpu_n"]) for r in M.mean_readings(df, ["n"], ["cpu"]).collect()}
    assert got == {"a": (0.0, 1), "b": (None, 0)}
    snaps = frame(spark, "i bigint, w string", (0, "a"), (0, "b"), (1, "b"), (1, "c"))
    changes = {(r["i"], r["w"], r["change"]) for r in M.set_changes(snaps, "w", "i").collect()}
    assert changes == {(1, "a", "lost"), (1, "c", "joined")}
    apart = snaps.withColumn("i", F.col("i") * 7 + 3)
    changes = {(r["i"], r["w"], r["change"]) for r in M.set_changes(apart, "w", "i").collect()}
    assert changes == {(10, "a", "lost"), (10, "c", "joined")}


# -- statistics ---------------------------------------------------------------

TRIALS = "run string, steps bigint, resumed_from bigint, crashed_at bigint"


def test_goodput_and_recompute(spark):
    storm = frame(spark, TRIALS, *[("r", 8, 4, None)] * 8, *[("r", 8, 0, None)] * 8)
    g = S.goodput(storm, ["run"]).first()
    assert (g["goodput_lower_bound"], g["useful_steps"], g["charged_steps"], g["crashed_first_attempt"]) == (0.8, 128, 160, 8)
    assert S.goodput(storm.filter("steps < 0"), []).first()["goodput_lower_bound"] == 0.0
    r = S.recompute(frame(spark, TRIALS, ("r", 8, 4, 6), ("r", 8, 4, None), ("r", 8, 0, None)), ["run"]).first()
    assert (r["recomputed_steps"], r["useful_steps"], r["measured_crashes"]) == (2, 24, 1)
    assert r["recompute_fraction"] == pytest.approx(2 / 24)


@pytest.mark.parametrize(
    "rows, want", [([(1, 1), (0, 1), (1, 1)], (1.0, 2, 1)), ([(1, 0), (1, 1)], (0.5, 2, 0)), ([(0, 1)], (0.0, 0, 1))]
)
def test_integrity_counts_hits_only(spark, rows, want):
    df = frame(spark, "fired boolean, survived boolean", *[(bool(a), bool(b)) for a, b in rows])
    r = S.integrity(df, []).first()
    assert (r["integrity_rate"], r["hits"], r["missed"]) == want


def test_paired_differences_and_scores(spark):
    rows = [("s", 0, "a", 3.0), ("s", 0, "b", 1.0), ("s", 1, "a", 1.0), ("s", 1, "b", 2.0), ("s", 2, "a", 9.0)]
    df = frame(spark, "scenario string, repeat int, arm string, value double", *rows)
    r = S.paired_diff(df, ["scenario"], "a", "b").first()
    assert (r["repeats"], r["median"]) == (2, 0.5)
    assert S.paired_diff(df, ["scenario"], "a", "b", relative=True).first()["median"] == pytest.approx(0.75)
    cases = frame(spark, "fault string, action string, recovery_s double, steps_preserved double", ("x", "retry", 1.0, None), ("y", "retry", 3.0, 4.0), ("z", "retry", None, None))
    want = frame(spark, "fault string, expected_action string", ("x", "retry"), ("y", "fail"))
    s = S.recovery_score(cases, want, []).first()
    assert (s["cases"], s["correct"], s["manual_interventions"], s["mean_recovery_s"], s["mean_steps_preserved"]) == (3, 1, 2, 2.0, 4.0)


def test_reports_and_best_trial(spark):
    rows = frame(spark, "scenario string, section string, repeats int", ("a", "zzz", 5), ("b", "resilience", 3), ("c", "performance", 2), ("d", "performance", 3))
    fit, refused = S.publishable(rows)
    assert [r["scenario"] for r in S.order_sections(fit).collect()] == ["d", "b", "a"]
    assert [r["scenario"] for r in refused.collect()] == ["c"] and S.publishable(rows, smoke=True)[1].count() == 0
    t = frame(spark, "trial int, metrics map<string,double>", (0, {"acc": 0.5}), (1, {"acc": 0.9}), (2, {"acc": 0.9}), (3, {"x": 1.0}))
    assert S.best_trial(t, "acc", True).first()["trial"] == 1
    assert S.best_trial(t, "acc", False).first()["trial"] == 0
    assert S.best_trial(t, "none", True).filter("trial IS NOT NULL").count() == 0
    states = frame(spark, "run_id string, trial int, attempt int, state string", ("a", 0, 0, "FAILED"), ("a", 0, 1, "SUCCEEDED"), ("b", 0, 0, "SUCCEEDED"), ("b", 1, 0, "FAILED"))
    assert {r["run_id"]: r["state"] for r in S.run_states(states).collect()} == {"a": "SUCCEEDED", "b": "FAILED"}


# -- names, rules, expansion --------------------------------------------------


def test_names(spark):
    df = frame(spark, "k string", ("artifact://a/b",), ("s3://x",), ("a/../b",), ("/a",), ("a..b/c",))
    got = df.select("k", K.uri_to_key(F.col("k")).alias("key"), K.is_safe_key(F.col("k")).alias("safe")).collect()
    assert [r["key"] for r in got] == ["a/b", None, None, None, None]
    assert [r["safe"] for r in got[2:]] == [False, False, True]
    f = frame(spark, "f string", ("delta.json",), ("..",), ("%2Fx",), ("a\n",), ("-a",))
    assert [r[0] for r in f.select(K.delta_key(F.lit("jobs/j/t/metrics.json"), F.col("f"))).collect()] == ["jobs/j/t/delta.json", None, None, None, None]
    d = frame(spark, "d string", ("sha256:" + "a" * 64,), ("<no value>",), (None,))
    assert [r[0] for r in d.select(K.is_digest(F.col("d"))).collect()] == [True, False, False]
    m = frame(spark, "m string", ("Qwen/Qwen2.5-7B-Instruct",), ("llama-3.1-8b-chat",), (" GPT2 ",))
    assert [r[0] for r in m.select(K.model_key(F.col("m"))).collect()] == ["qwen2.5-7b", "llama-3.1-8b", "gpt2"]
    labels = frame(spark, "l map<string,string>", ({"kubernetes.io/arch": "x", "secret": "y"},))
    assert labels.select(K.keep_labels(F.col("l"), ["kubernetes.io/"])).first()[0] == {"kubernetes.io/arch": "x"}
    t = frame(spark, "t string, p map<string,string>", ("a {x} {{y}}", {"x": "1"}), ("{z}", {"x": "1"}), ("{}", {}), ("{x", {"x": "1"}))
    assert [r[0] for r in t.select(K.fill(F.col("t"), F.col("p"))).collect()] == ["a 1 {y}", None, None, None]


def test_untrusted_numbers(spark):
    v = frame(spark, "t string", ("5",), ("true",), ('"5"',), ("null",), ("150",), ("-1",), ("99999",), ("0.5",))
    v = v.withColumn("v", F.parse_json("t"))
    got = v.select(R.reading(F.col("v")).alias("r"), R.percent(F.col("v")).alias("p"), R.clean_lease_seconds(F.col("v"), 60.0).alias("s")).collect()
    assert [r["r"] for r in got] == [5.0, None, None, None, 150.0, -1.0, 99999.0, 0.5]
    assert [r["p"] for r in got] == [5.0, None, None, None, None, None, None, 0.5]
    assert [r["s"] for r in got] == [5.0, None, 5.0, 60.0, 150.0, None, 3600.0, 0.5]


def test_job_rules_list_every_problem(spark):
    jobs = frame(spark, "name string, image_tag string, minimum_workers int, maximum_workers int, output_prefix string, max_task_attempts int",
                 ("ok-1", "1.0", 1, 2, "artifact://x/", 1), ("Bad", "latest", 3, 2, "s3://x", 0))
    assert [len(r["problems"]) for r in rules.validate_jobs(jobs).collect()] == [0, 5]


def test_grid_order(spark):
    jobs = frame(spark, "job_id string, grid map<string,array<string>>", ("j", {"b": ["1", "2"], "a": ["x", "y"]}), ("k", {"a": []}))
    rows = expansion.expand_grid(jobs).orderBy("trial").collect()
    assert [(r["task_id"], r["params"]) for r in rows] == [
        ("trial-000", {"a": "x", "b": "1"}), ("trial-001", {"a": "x", "b": "2"}),
        ("trial-002", {"a": "y", "b": "1"}), ("trial-003", {"a": "y", "b": "2"})]


def test_schemas_parse(spark):
    for name in ("LEDGER", "TASKS", "CONTRIBUTIONS", "PARTS", "MANIFESTS", "RUN_DOCUMENT", "TELEMETRY", "RANKS", "METRICS"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
