import hashlib
import json
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace import schemas
from millrace.operators import checkpoint_files as CF
from millrace.operators import checkpoints as C
from millrace.queries.checkpoints import part_problems
from millrace.sources import artifacts, files

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def manifests(spark, *rows):
    """(id, step, validation[, sizes[, minutes]])"""
    data = [
        (r[0], "j", "a", r[1], 2, r[3] if len(r) > 3 else None, "p", r[2], T0 + timedelta(minutes=r[4] if len(r) > 4 else 0))
        for r in rows
    ]
    return spark.createDataFrame(data, schemas.MANIFESTS)


def parts(spark, *rows):
    data = [("j", "a", 100, k, sha, 1, seq) for k, sha, seq in rows]
    return spark.createDataFrame(data, schemas.PARTS)


def expected(spark, *keys):
    data = [("m", "j", "a", 100, k, sha) for k, sha in keys]
    return spark.createDataFrame(data, "manifest_id string, job_id string, attempt_id string, step bigint, key string, sha256 string")


def test_audit_of_parts(spark):
    want = expected(spark, ("rank0.pt", "h0"), ("rank1.pt", "h1"))
    offered = manifests(spark, ("m", 100, None), ("empty", 100, None)).drop("validation")
    good = parts(spark, ("rank0.pt", "h0", 1), ("rank1.pt", "bad", 1), ("rank1.pt", "h1", 2))
    verdict = {r["manifest_id"]: r for r in C.audit_manifests(offered, want, good).collect()}
    assert verdict["m"]["committed"] and verdict["m"]["validation"] == "hash_verified"
    assert not verdict["empty"]["committed"] and verdict["empty"]["parts"] == 0
    bad = parts(spark, ("rank0.pt", "other", 1))
    problems = sorted(r["problem"] for r in C.part_problems(want, bad).collect())
    assert problems == ["hash mismatch for rank0.pt", "missing part rank1.pt"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_that_lie_by_step_are_not_dealt_out_again(spark):
    """Nulls in any key, parts named twice, by two manifests, uploaded again, with no hash."""
    want = [("m", "j", "a", 1, "k1", "h1"), ("m", "j", "a", 1, "k1", "h1"), ("n", "j", "a", 1, "k1", "h2"), ("m", "j", "b", 1, "k1", "h1"),
            ("m", None, "a", 1, "k1", "h1"), ("m", "j", "a", None, "k1", "h1"), ("m", "j", "a", 1, None, "h1"), ("m", "j", "a", 2, "k2", None),
            ("m", "j", "a", 2, "k3", "h3"), ("o", "j", "a", 3, "k4", "h4")]
    have = [("j", "a", 1, "k1", "old", 1, 1), ("j", "a", 1, "k1", "h1", 1, 2), ("j", "a", 1, "k1", "h1", 1, 2), (None, "a", 1, "k1", "h1", 1, 1),
            ("j", "a", None, "k1", "h1", 1, 1), ("j", "a", 1, None, "h1", 1, 1), ("j", "a", 2, "k2", "h", 1, 1), ("j", "a", 2, "k3", None, 1, 1),
            ("j", "a", 3, "k4", "h4", 1, 1), ("j", "a", 9, "k9", "h9", 1, 1)]
    columns = "manifest_id string, job_id string, attempt_id string, step bigint, key string, sha256 string"
    expected = spark.createDataFrame(want, columns).repartition(3, "step")
    registered = spark.createDataFrame(have, schemas.PARTS).repartition(3, "step")
    problems = C.part_problems(expected, registered)
    assert sorted((r["manifest_id"], r["job_id"] or "", r["attempt_id"], r["step"] or 0, r["problem"]) for r in problems.collect()) == [
        ("m", "", "a", 1, "missing part k1"), ("m", "j", "a", 0, "missing part k1"), ("m", "j", "a", 2, "missing part k3"),
        ("m", "j", "b", 1, "missing part k1"), ("n", "j", "a", 1, "hash mismatch for k1")]
    assert plan_of(problems).split("Final Plan")[-1].split("Initial Plan")[0].count("Exchange") == 2
    offered = manifests(spark, ("m", 1, None), ("n", 1, None), ("o", 3, None), ("none", 4, None)).drop("validation")
    verdicts = C.audit_manifests(offered, expected, registered).collect()
    assert {r["manifest_id"]: (r["parts"], r["missing"], r["mismatched"], r["committed"]) for r in verdicts} == {
        "m": (8, 5, 0, False), "n": (1, 0, 1, False), "o": (1, 0, 0, True), "none": (0, 0, 0, False)}


def test_lines_are_shuffled_as_they_are(spark, tmp_path):
    """Rows of the built parts with nulls and rows that come twice; no text or hash is dealt out."""
    lines = [(1, 1, 5, 7, 3.0, "N"), (1, 1, 5, 7, 3.0, "N"), (1, 5, None, 5, 1.0, "A"), (1, None, 5, 37, 2.0, "A"), (2, 2, 5, None, 2.0, "A"), (2, None, 2, 5, 2.0, "A"),
             (2, 1, 5, 74, 2.0, None), (2, 1, 6, 74, 2.0, "R"), (2, 1, 8, 74, None, "N"), (3, 1, 5, 37, 2.0, "N"), (None, 1, 5, 7, 2.0, "N"), (4, 1, 5, 7, 2.0, "N")]
    orders = [(1, 10, "O"), (1, 10, "O"), (2, None, "F"), (3, 11, "P"), (None, 12, "O"), (5, 12, "O")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").withColumn(
        "o_orderdate", F.lit(T0)).write.parquet(f"{tmp_path}/orders.parquet")
    sha = lambda v: None if v is None else hashlib.sha256(str(v).encode()).hexdigest()
    met = [(o, c, x) for x in lines for o, c, _ in orders if o is not None and x[0] == o]
    name = lambda x: "-".join(["part", *(str(v) for v in x[1:4] if v is not None)])
    job = lambda c: None if c is None else f"job-{c}"
    want = {(f"ck-{o}", job(c), f"a{o % 3}", o, name(x), sha(x[2])) for o, c, x in met}
    rows = [tuple(r) for r in B.expected_parts(spark, str(tmp_path)).select("manifest_id", "job_id", "attempt_id", "step", "key", "sha256").collect()]
    assert len(rows) == len(want) and set(rows) == want
    arrived = []
    for o, c, x in met:
        if x[5] not in (None, "R"):
            damaged = x[3] is not None and x[3] % 37 == 0
            uploads = [(sha(name(x)), 1), (sha(x[2]), 2)][: 2 if o % 2 == 0 else 1] if damaged else [(sha(x[2]), 1)]
            arrived += [(job(c), f"a{o % 3}", o, name(x), None if x[4] is None else int(x[4]), *u) for u in uploads]
    got = B.registered_parts(spark, str(tmp_path)).select("job_id", "attempt_id", "step", "key", "size_bytes", "sha256", "seq").collect()
    assert Counter(map(tuple, got)) == Counter(arrived)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")
        shuffles = [x for x in plan_of(part_problems(spark, str(tmp_path))).split("\n") if "Exchange" in x]
    finally:
        spark.conf.set(limit, was)
    assert len(shuffles) == 4 and all("hashpartitioning(l_orderkey" in x or "hashpartitioning(o_orderkey" in x for x in shuffles)


def best(df, **kw):
    row = C.latest_valid(df, **kw).first()
    return row["step"] if row else None


def test_latest_valid(spark):
    m = manifests(spark, ("x", 100, "hash_verified"), ("y", 200, "hash_verified"))
    assert best(m) == 200
    q = C.apply_validation(m, spark.createDataFrame([("y", "invalid", 1)], "manifest_id string, mark string, seq bigint"))
    assert best(q) == 100
    again = C.apply_validation(
        m, spark.createDataFrame([("y", "invalid", 1), ("y", "restore_verified", 2)], "manifest_id string, mark string, seq bigint")
    )
    assert best(again) == 100
    v = manifests(spark, ("x", 100, "restore_verified"), ("y", 200, "hash_verified"))
    assert best(v) == 200 and best(v, require_restore_verified=True) == 100


def test_topology_and_ties(spark):
    m = manifests(spark, ("x", 100, "hash_verified", [2, 4]))
    assert [best(m, world_size=w) for w in (2, 4, 8)] == [100, 100, None]
    own = manifests(spark, ("x", 100, "hash_verified"))
    assert best(own, world_size=2) == 100 and best(own, world_size=4) is None
    tie = manifests(spark, ("old", 100, "hash_verified", None, 5), ("rv", 100, "restore_verified", None, 0))
    assert C.latest_valid(tie).first()["manifest_id"] == "rv"
    newer = manifests(spark, ("old", 100, "hash_verified", None, 0), ("new", 100, "hash_verified", None, 5))
    assert C.latest_valid(newer).first()["manifest_id"] == "new"
    flags = {r["manifest_id"]: r["latest_valid"] for r in C.checkpoint_timeline(tie).collect()}
    assert flags == {"old": False, "rv": True}


def test_lost_work(spark):
    m = manifests(spark, ("x", 400, "hash_verified"))
    f = spark.createDataFrame([("j", 470), ("j", 300), ("other", 470)], "job_id string, failed_at_step bigint")
    got = {(r["job_id"], r["failed_at_step"]): r["lost_steps"] for r in C.lost_work(f, m).collect()}
    assert got == {("j", 470): 70, ("j", 300): 0, ("other", 470): None}


@pytest.fixture
def root(tmp_path):
    for step in (1, 2, 3):
        d = tmp_path / f"step-{step}"
        d.mkdir()
        listed = []
        for rank in (0, 1):
            body = f"{step}-{rank}".encode() * 10
            (d / f"rank{rank}.pt").write_bytes(body)
            listed.append({"key": f"rank{rank}.pt", "sha256": hashlib.sha256(body).hexdigest(), "size_bytes": len(body)})
        doc = {"manifest_id": f"ck-{step}", "job_id": "j", "attempt_id": "a", "step": step, "world_size": 1,
               "storage_prefix": str(d), "parts": listed, "validation": "hash_verified", "created": "2024-01-01T00:00:00Z"}
        (d / "manifest.json").write_text(json.dumps(doc))
    (tmp_path / "step-3" / "rank1.pt").write_bytes(b"damaged")
    (tmp_path / "step-9").mkdir()
    (tmp_path / "step-9" / "manifest.json").write_text('{"manifest_id": "ck-9", "st')
    (tmp_path / "checkpoint-7").mkdir()
    (tmp_path / "checkpoint-7" / "manifest.json").write_text(json.dumps({"job_id": "j", "step": 7, "parts": []}))
    return str(tmp_path)


def test_checkpoint_report_reverifies(spark, root):
    rows = CF.checkpoint_report(spark, root, "2024-01-01 00:01:00").collect()
    assert [(r["step"], r["validation"], r["parts"], r["latest_valid"]) for r in rows] == [
        (1, "hash_verified", 2, False), (2, "hash_verified", 2, True), (3, "invalid", 2, False)]
    assert rows[0]["age_s"] == 60.0
    other = files.read_manifests(spark, root, "checkpoint-*").collect()
    assert [r["step"] for r in other] == [7]
    assert files.read_manifests(spark, root + "/nowhere").count() == 0


def test_built_manifests_match_the_files(spark, root):
    found = CF.build_parts(spark, root)
    built = {r["step"]: r for r in CF.build_manifests(found, "j", "a").collect()}
    assert set(built) == {1, 2, 3} and built[1]["parts"] == 2
    assert all(r["valid"] for r in CF.verify_files(found, found).collect())
    gone = CF.verify_files(found, found.filter("key <> 'rank0.pt'")).first()
    assert not gone["valid"] and gone["missing"] == 1


def test_hashes_and_keys_of_files(spark, root):
    assert len({(r["key"], r["sha256"]) for r in artifacts.hash_artifacts(spark, root).collect()}) == 11
    keys = [r["key"] for r in artifacts.list_artifacts(spark, root, "step-1/").collect()]
    assert keys == ["step-1/manifest.json", "step-1/rank0.pt", "step-1/rank1.pt"]
    assert artifacts.list_artifacts(spark, root + "/none").count() == 0


def test_every_file_is_hashed_in_chunks(spark, tmp_path, monkeypatch):
    """Empty and hidden files, names with signs, files larger than a chunk and a partition."""
    bodies = {"a b.pt": b"0123456789" * 10, "part=1/c.pt": b"x" * 49, "exact": b"1234567", "empty": b"", "_meta": b"m",
              ".hidden": b"h", "step-1/.x/_y.pt": b"deep", "é%20#.bin": b"odd"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(body)
    want = {k: (len(b), hashlib.sha256(b).hexdigest()) for k, b in bodies.items()}
    monkeypatch.setattr(artifacts, "PARTITION_BYTES", 20)
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        rows = artifacts.hash_artifacts(spark, path, chunk=7).collect()
        assert {r["key"]: (r["size_bytes"], r["sha256"]) for r in rows} == want and len(rows) == len(want)
    assert artifacts.hash_artifacts(spark, str(tmp_path / "none")).count() == 0
    sizes = [len(p.files) for p in artifacts.ArtifactReader({"path": str(tmp_path)}).partitions()]
    assert sum(sizes) == len(bodies) and len(sizes) > 3
    listed = artifacts.list_artifacts(spark, str(tmp_path), "step-1/").collect()
    assert [r["uri"] for r in listed] == ["artifact://step-1/.x/_y.pt"]


def test_an_empty_and_a_hidden_part_are_part_of_a_checkpoint(spark, tmp_path):
    rows = [("step-1/empty.pt", b""), ("step-1/_meta.json", b"{}"), ("step-1/rank0.pt", b"r0"), ("step-2/rank0.pt", None)]
    put = artifacts.put_artifacts(spark.createDataFrame(rows, "key string, body binary"), str(tmp_path)).collect()
    assert sorted((r["key"], r["size_bytes"]) for r in put) == [
        ("step-1/_meta.json", 2), ("step-1/empty.pt", 0), ("step-1/rank0.pt", 2), ("step-2/rank0.pt", 0)]
    parts = CF.build_parts(spark, str(tmp_path))
    built = {r["step"]: (r["parts"], r["size_bytes"]) for r in CF.build_manifests(parts, "j", "a").collect()}
    assert built == {1: (3, 4), 2: (1, 0)}
    recorded = spark.createDataFrame(parts.collect(), parts.schema)
    assert all(r["valid"] for r in CF.verify_files(recorded, CF.build_parts(spark, str(tmp_path))).collect())
    now = CF.build_parts(spark, str(tmp_path))
    (tmp_path / "step-1" / "empty.pt").unlink()
    verdicts = CF.verify_files(recorded, now).collect()
    assert {r["folder"]: (r["missing"], r["valid"]) for r in verdicts} == {"step-1": (1, False), "step-2": (0, True)}


def test_new_checkpoints_are_picked_up_once(spark, tmp_path):
    from millrace.streaming.runner import drain
    from millrace.streaming.windows import stream_checkpoints

    src = tmp_path / "ckpt"
    src.mkdir()
    (src / "step-000004.json").write_text('{"step": 4}')
    (src / "other.json").write_text("{}")
    base = str(tmp_path / "out")
    first = drain(stream_checkpoints(spark, str(src)), "c", base)
    assert [(r["step"], r["document"]) for r in first.collect()] == [(4, '{"step": 4}')]
    assert first.first()["sha256"] == hashlib.sha256(b'{"step": 4}').hexdigest()
    (src / "step-000008.json").write_text('{"step": 8}')
    again = drain(stream_checkpoints(spark, str(src)), "c", base)
    assert sorted(r["step"] for r in again.collect()) == [4, 8]
    assert again.select(F.countDistinct("path")).first()[0] == 2
