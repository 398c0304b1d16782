import itertools
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import eligibility as E

FIELDS = ["argv_capable", "unsandboxed_argv_capable", "module_capable", "local_datasets", "capabilities", "sandbox_capable"]


def nodes(spark, *items):
    rows = [(n.get("node_id"), *[json.dumps(n[f]) if f in n else None for f in FIELDS]) for n in items]
    df = spark.createDataFrame(rows, "node_id string, " + ", ".join(f"{f} string" for f in FIELDS))
    return df.select("node_id", *[F.parse_json(f).alias(f) for f in FIELDS])


def tasks(spark, *payloads):
    rows = [("j", f"t{i}", i, json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "job_id string, task_id string, seq bigint, payload string")
    return df.withColumn("payload", F.parse_json("payload"))


GPU = {"gpus": [{"n": 1}, {"n": 2}], "pools": ["p1"]}
CASES = [
    # payload, machine, may run
    ({"argv": ["x"]}, {"argv_capable": True}, True),
    ({"argv": ["x"]}, {"argv_capable": "true"}, False),
    ({"argv": ["x"]}, {"argv_capable": 1}, False),
    ({"argv": None}, {}, False),
    ({"argv": ["x"]}, {"unsandboxed_argv_capable": True}, False),
    ({"argv": ["x"], "pool": "p1", "isolation": {"tier": "sandboxed", "allowFallback": True}},
     {"unsandboxed_argv_capable": True, "capabilities": GPU}, True),
    ({"argv": ["x"], "pool": "p1", "isolation": {"allowFallback": "true"}},
     {"unsandboxed_argv_capable": True, "capabilities": GPU}, False),
    ({"argv": ["x"], "pool": "", "isolation": {"allowFallback": True}},
     {"unsandboxed_argv_capable": True, "capabilities": GPU}, False),
    ({"module": "m"}, {}, True),
    ({"module": "m"}, {"module_capable": False}, False),
    ({"module": "m"}, {"module_capable": None}, True),
    ({"module": "m"}, {"module_capable": 0}, True),
    ({"local_inputs": ["a", "b"]}, {"local_datasets": ["a", "b", "c"]}, True),
    ({"local_inputs": ["a", "z"]}, {"local_datasets": ["a"]}, False),
    ({"local_inputs": []}, {}, True),
    ({"local_inputs": "a"}, {"local_datasets": ["a"]}, False),
    ({"local_inputs": ["a"]}, {"local_datasets": "a"}, False),
    ({"gpus": 1}, {}, False),
    ({"gpus": 2}, {"capabilities": {"gpus": [{}]}}, False),
    ({"gpus": 2}, {"capabilities": GPU}, True),
    ({"gpus": 0}, {}, True),
    ({"gpus": True}, {"capabilities": GPU}, False),
    ({"gpus": "1"}, {"capabilities": GPU}, False),
    ({"gpus": 1.0}, {"capabilities": GPU}, False),
    ({"gpus": -1}, {"capabilities": GPU}, False),
    ({"gpus": 1}, {"capabilities": "all"}, False),
    ({"exclude_nodes": ["node-a"]}, {"node_id": "node-a"}, False),
    ({"exclude_nodes": ["node-a"]}, {"node_id": "node-b"}, True),
    ({"exclude_nodes": ["node-a"]}, {"node_id": None}, False),
    ({"exclude_nodes": []}, {"node_id": None}, True),
    ({"exclude_nodes": ["node-a", 7]}, {"node_id": "node-b"}, False),
    ({"exclude_nodes": ["node-a", None]}, {"node_id": "node-b"}, False),
    ({"exclude_nodes": "node-a"}, {"node_id": "node-b"}, False),
    ({"pool": "p1"}, {"capabilities": GPU}, True),
    ({"pool": "p2"}, {"capabilities": GPU}, False),
    ({"pool": 7}, {"capabilities": GPU}, False),
    ({"pool": "p1"}, {"capabilities": {"pools": ["p1", 7]}}, False),
    ({"pool": "p1", "isolation": {"tier": "sandboxed", "allowFallback": True}}, {}, False),
    ({"isolation": {"tier": "sandboxed"}}, {"sandbox_capable": True}, True),
    ({"isolation": {"tier": "sandboxed"}}, {"sandbox_capable": "yes"}, False),
    ({"isolation": {"tier": "sandboxed", "allowFallback": True}}, {}, True),
    ({"isolation": {"tier": "sandboxed", "allowFallback": 1}}, {}, False),
    ({"isolation": {"tier": "standard"}}, {}, True),
    ({"isolation": {"tier": ""}}, {}, True),
    ({"isolation": {}}, {}, True),
    ({"isolation": {"tier": "gvisor"}}, {}, False),
    ({"isolation": "sandboxed"}, {"sandbox_capable": True}, False),
    ({}, {}, True),
]


def test_every_gate_by_table(spark):
    rows = []
    for i, (payload, node, _) in enumerate(CASES):
        n = {"node_id": "node-x", **node}
        rows.append((i, json.dumps(payload), n["node_id"], *[json.dumps(n[f]) if f in n else None for f in FIELDS]))
    pairs = spark.createDataFrame(
        rows, "case int, payload string, node_id string, " + ", ".join(f"{f} string" for f in FIELDS)
    ).select("case", "node_id", *[F.parse_json(f).alias(f) for f in ["payload", *FIELDS]])
    out = pairs.select("case", E.eligible(F.col("payload")).alias("ok"),
                       *[E.gate(g, F.col("payload")).alias(g) for g in E.GATES])
    for r in out.collect():
        want = CASES[r["case"]][2]
        assert r["ok"] is want, CASES[r["case"]]
        assert all(r[g] for g in E.GATES) is want, CASES[r["case"]]


def brute(spark, t, n):
    pairs = t.crossJoin(n).filter(E.eligible(F.col("payload"))).select("task_id", "seq", "node_id")
    return {(r["task_id"], r["seq"], r["node_id"]) for r in pairs.collect()}


@pytest.fixture(scope="module")
def fleet(spark):
    payloads = [
        {k: v for k, v in zip(("gpus", "pool", "module", "exclude_nodes"), combo) if v is not None}
        for combo in itertools.product(
            (None, 1, 2, True), (None, "p1", "p2"), (None, "m"), (None, ["node-0"], ["node-1", "node-2"])
        )
    ]
    machines = [
        {
            "node_id": f"node-{i}",
            "module_capable": i % 3 != 0,
            "capabilities": {"gpus": [{}] * (i % 4), "pools": [["p1"], ["p2"], [], ["p1", "p2"]][i % 4]},
        }
        for i in range(9)
    ]
    return tasks(spark, *payloads).persist(), nodes(spark, *machines).persist()


def test_class_level_counts_equal_all_pairs(spark, fleet):
    t, n = fleet
    want = {}
    for task, _, _ in brute(spark, t, n):
        want[task] = want.get(task, 0) + 1
    got = {r["task_id"]: r["eligible_nodes"] for r in E.eligible_counts(t, n).collect()}
    assert got == {r["task_id"]: want.get(r["task_id"], 0) for r in t.collect()}
    lonely = {r["task_id"] for r in E.unplaceable_tasks(t, n).collect()}
    assert lonely == {k for k, v in got.items() if v == 0}


@pytest.mark.parametrize("drop", [0, 1, 2, 7])
def test_first_choice_equals_all_pairs(spark, fleet, drop):
    t, n = fleet
    t = t.filter(F.col("seq") % 9 >= drop)
    want = {}
    for task, seq, node in brute(spark, t, n):
        want[node] = min(want.get(node, (10**9, "")), (seq, task))
    got = {r["node_id"]: (r["seq"], r["task_id"]) for r in E.first_choice(t, n, first=1).collect()}
    assert got == want


def test_first_choice_behind_a_long_row_of_exclusions(spark):
    """One machine is named by the first twenty tasks, one by all, one by none."""
    t = tasks(spark, *[{"exclude_nodes": ["a", "c"]} for _ in range(20)], *[{"exclude_nodes": ["c"]} for _ in range(5)])
    n = nodes(spark, {"node_id": "a"}, {"node_id": "b"}, {"node_id": "c"})
    got = {r["node_id"]: r["seq"] for r in E.first_choice(t, n, first=2).collect()}
    want = {}
    for _, seq, node in brute(spark, t, n):
        want[node] = min(want.get(node, 10**9), seq)
    assert got == want and "b" in got


def test_reject_reasons_name_the_missing_need(spark):
    t = tasks(spark, {"gpus": 1, "pool": "p9"})
    n = nodes(spark, {"node_id": "a"}, {"node_id": "b", "capabilities": GPU})
    got = {r["need"]: r["nodes_lacking"] for r in E.reject_reasons(t, n).collect()}
    assert got == {"gpus:1": 1, "pool:p9": 2}


def test_has_all(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["z"], ["a"]), (["a"], None), ([], None)], "r array<string>, a array<string>")
    assert [r[0] for r in df.select(E.has_all(F.col("r"), F.col("a"))).collect()] == [True, False, False, True]


def cheapest(requests, offers):
    out = {}
    for r in requests:
        rid, gpus, kind, vram, cpus, memory, region, most, spot_ok = r
        fits = []
        for oid, ogpus, okind, ovram, ocpus, omemory, oregion, price, spot in offers:
            enough = all(a is None or (b is not None and b >= a) for a, b in ((vram, ovram), (cpus, ocpus), (memory, omemory)))
            enough &= (gpus or 0) <= (ogpus or 0)
            enough &= kind is None or (okind is not None and kind.lower() == okind.lower())
            enough &= region is None or region == oregion
            enough &= bool(spot_ok is None or spot_ok or not spot)
            enough &= most is None or (price is not None and price <= most)
            if enough:
                fits.append((price is not None, price or 0.0, oid, price))
        if fits:
            best = min(fits)
            out[rid] = (best[2], best[3])
    return out


@pytest.mark.parametrize("part", [10_000, 3])
def test_offers_equal_all_pairs(spark, monkeypatch, part):
    import random

    rnd = random.Random(part)
    pick = lambda *v: rnd.choice([None, *v])
    offers = [
        (f"o{k}", pick(0, 1, 2, 8), pick("A100", "h100"), pick(24.0, 40.0, 80.0), pick(4, 8, 64), pick(16.0, 64.0, 512.0),
         pick("eu", "us"), rnd.choice([None, *[round(rnd.uniform(0.1, 9), 2) for _ in range(9)]]), rnd.random() < 0.5)
        for k in range(120)
    ]
    requests = [
        (k, pick(0, 1, 2, 4, 8), pick("a100", "H100"), pick(24.0, 48.0), pick(4, 16), pick(32.0, 64.0), pick("eu", "us", "asia"),
         pick(0.5, 2.0, 5.0), pick(True, False))
        for k in range(150)
    ]
    ask = spark.createDataFrame(requests, "request_id bigint, gpus int, gpu_type string, vram_gb double, cpus int, memory_gb double, region string, max_hourly_usd double, spot_ok boolean")
    give = spark.createDataFrame(offers, "offer_id string, gpus int, gpu_type string, vram_gb double, cpus int, memory_gb double, region string, hourly_usd double, spot boolean")
    monkeypatch.setattr(E, "OFFER_PART", part)
    monkeypatch.setattr(E.skyline, "__defaults__", (part,))
    got = {r["request_id"]: (r["offer_id"], r["hourly_usd"]) for r in E.match_offers(ask, give).collect()}
    assert got == cheapest(requests, offers)
