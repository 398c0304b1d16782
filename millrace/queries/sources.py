"""Reader and writer queries. Each first writes a whole table in the format it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.operators import checkpoint_files as CF
from millrace.queries import query
from millrace.session import scratch_path
from millrace.sources import files
from millrace.sources.artifacts import hash_artifacts, list_artifacts, put_artifacts
from millrace.sources.fleet import fleet_inventory


@query(
    "csv_points",
    """SELECT count(*) AS n, round(sum(l_quantity), 4) AS s0, round(sum(l_extendedprice / 1000.0), 4) AS s1,
    round(sum(l_discount), 4) AS s2, round(sum(l_tax), 4) AS s3 FROM lineitem""",
)
def csv_points(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "points")
    files.write_points(B.lineitem_points(spark, sf).drop("shard"), path)
    p = files.read_points(spark, path)
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(F.col("features")[i]), 4).alias(f"s{i}") for i in range(4)],
    )


@query(
    "csv_labelled",
    """SELECT CAST(l_linenumber AS DOUBLE) AS label, count(*) AS n, round(sum(l_quantity), 4) AS s0
    FROM lineitem GROUP BY l_linenumber""",
)
def csv_labelled(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    rows = B.table(spark, sf, "lineitem").select(
        F.array("l_quantity", "l_discount", F.col("l_linenumber").cast("double")).alias("features")
    )
    files.write_points(rows, path)
    return files.read_labelled(spark, path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("s0")
    )


@query(
    "strided_shards",
    """SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS shard, o_orderkey FROM orders""",
)
def strided_shards(spark: SparkSession, sf: str) -> DataFrame:
    orders = B.table(spark, sf, "orders").select("o_orderkey")
    return files.shard_rows(orders, 7, ["o_orderkey"])


@query(
    "jsonl_scan",
    """SELECT event_type AS type, count(*) AS n, round(sum(CASE WHEN event_id % 10 <> 3 THEN value END), 4) AS total
    FROM events WHERE event_id % 10 > 2 GROUP BY event_type""",
)
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "events-jsonl")
    k = F.col("event_id") % 10
    value = F.when(k == 3, '"text"').otherwise(F.col("value").cast("string"))
    line = F.concat(F.lit('{"type":"'), "event_type", F.lit('","value":'), value, F.lit("}"))
    B.table(spark, sf, "events").select(
        F.when(k == 0, F.substring(line, 1, 12))
        .when(k == 1, F.concat(F.lit("["), line, F.lit("]")))
        .when(k == 2, F.lit("  "))
        .otherwise(line)
        .alias("value")
    ).write.text(path)
    rows, _ = files.read_jsonl(spark, path, "type string, value double")
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "ledger_store",
    """SELECT 'job-' || (event_id // 100) AS job_id, count(*) AS events, max(event_id) AS last_seq
    FROM events GROUP BY event_id // 100""",
)
def ledger_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ledger")
    rows = B.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("job-"), F.expr("event_id div 100")).alias("job_id"),
        F.col("event_type").alias("type"),
        "ts",
    )
    files.append_events(rows.repartition("job_id"), path)
    return spark.read.parquet(path).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq")
    )


@query(
    "written_results",
    """SELECT 'orders' AS name, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus""",
)
def written_results(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results")
    orders = B.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state"))
    lines = B.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("state"))
    n = F.count(F.lit(1)).alias("n")
    files.write_results(path, orders=orders.agg(n), lines=lines.agg(n))
    back = [spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("name"), "state", "n") for k in ("orders", "lines")]
    return back[0].unionByName(back[1])


@query(
    "latest_jobs",
    """SELECT 'job-' || o_custkey AS job_id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS state
    FROM orders GROUP BY o_custkey""",
)
def latest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = B.table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), F.col("o_custkey")).alias("job_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("state"),
    )
    return files.latest_jobs(jobs)


def _part_files(spark: SparkSession, sf: str) -> str:
    """Keys of a thousand parts to a file, one folder per file; folders grow in number
    with the table, not in size. Each folder has a hidden part too, every third an empty one."""
    path = scratch_path(spark, "artifacts")
    step = F.expr("p_partkey div 1000")
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), "\n")
    bodies = B.table(spark, sf, "part").groupBy(step.alias("step")).agg(F.concat(keys, F.lit("\n")).alias("body"))
    part = lambda name, body: F.struct(F.lit(name).alias("name"), body.cast("string").alias("body"))
    parts = F.array(
        part("part-0.txt", F.col("body")), part("_meta.json", F.col("step")),
        F.when(F.col("step") % 3 == 0, part("empty.bin", F.lit(""))),
    )
    rows = bodies.select("step", F.inline(F.array_compact(parts))).select(
        F.concat(F.lit("step-"), "step", F.lit("/"), "name").alias("key"), F.encode("body", "UTF-8").alias("body")
    )
    put_artifacts(rows, path).agg(F.count(F.lit(1))).collect()
    return path


_BLOBS = """fb AS (SELECT p_partkey // 1000 AS step,
  string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey) || chr(10) AS body FROM part GROUP BY 1),
fa AS (SELECT step, 'part-0.txt' AS name, body FROM fb UNION ALL SELECT step, '_meta.json', step::VARCHAR FROM fb
  UNION ALL SELECT step, 'empty.bin', '' FROM fb WHERE step % 3 = 0)"""


@query(
    "artifact_inventory",
    f"""WITH {_BLOBS} SELECT 'step-' || step AS folder, count(*) AS files, sum(strlen(body))::BIGINT AS size_bytes,
    count_if(body = '')::BIGINT AS empty FROM fa GROUP BY step""",
)
def artifact_inventory(spark: SparkSession, sf: str) -> DataFrame:
    listed = list_artifacts(spark, _part_files(spark, sf), "step-")
    return listed.groupBy(F.split("key", "/")[0].alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"), F.count_if(F.col("size_bytes") == 0).alias("empty")
    )


@query(
    "artifact_hashes",
    f"WITH {_BLOBS} SELECT 'step-' || step || '/' || name AS key, sha256(body) AS sha256 FROM fa",
)
def artifact_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return hash_artifacts(spark, _part_files(spark, sf)).select("key", "sha256")


@query(
    "built_manifests",
    f"""WITH {_BLOBS} SELECT step, count(*) AS parts, sum(strlen(body))::BIGINT AS size_bytes,
    'hash_verified' AS validation FROM fa GROUP BY step""",
)
def built_manifests(spark: SparkSession, sf: str) -> DataFrame:
    parts = CF.build_parts(spark, _part_files(spark, sf))
    return CF.build_manifests(parts, "job", "a0").select("step", "parts", "size_bytes", "validation")


@query(
    "verified_files",
    f"""WITH {_BLOBS} SELECT step, count(*) + 1 - (step % 2) AS parts, 1 - step % 2 AS missing,
    count_if(step % 4 = 1)::BIGINT AS mismatched, step % 4 = 3 AS valid FROM fa GROUP BY step""",
)
def verified_files(spark: SparkSession, sf: str) -> DataFrame:
    """Even steps lack a part that was recorded, every fourth has other hashes."""
    parts = CF.build_parts(spark, _part_files(spark, sf))
    recorded = parts.withColumn("sha256", F.when(F.col("step") % 4 == 1, "tampered").otherwise(F.col("sha256")))
    gone = parts.filter((F.col("step") % 2 == 0) & (F.col("key") == "part-0.txt")).withColumn("key", F.lit("gone.bin"))
    out = CF.verify_files(recorded.unionByName(gone), parts)
    return out.select(
        F.regexp_extract("folder", r"(\d+)\z", 1).cast("bigint").alias("step"),
        "parts", "missing", "mismatched", "valid",
    )


_FLEET = """n AS (SELECT s_suppkey AS s, s_suppkey % 4 AS g, 'pool-' || s_nationkey AS pool FROM supplier)"""


def _probes(spark, sf):
    s = F.col("s_suppkey")
    gpu = F.array_join(
        F.transform(
            F.sequence(F.lit(0), (s % 4).cast("int")),
            lambda i: F.when(i == s % 4, F.lit("No more devices were found")).otherwise(
                F.concat(i, F.lit(", card, "), F.when(i == 1, "[N/A]").otherwise("24564 MiB"), F.lit(", 550.1"))
            ),
        ),
        "\n",
    )
    return B.table(spark, sf, "supplier").select(
        F.concat(F.lit("node-"), s).alias("node_id"),
        F.concat(F.lit("pool-"), F.col("s_nationkey")).alias("pool"),
        gpu.alias("gpu_text"),
        F.when(s % 4 == 0, "").otherwise(F.concat(s % 100, F.lit("\n140\nN/A\n 50 %"))).alias("util_text"),
        F.when(s % 2 == 0, F.concat(s, F.lit("500m"))).otherwise(s.cast("string")).alias("cpu_q"),
        F.when(s % 3 == 0, F.concat(s, F.lit("Gi")))
        .when(s % 3 == 1, F.concat(s, F.lit(".5M")))
        .otherwise(s.cast("string"))
        .alias("mem_q"),
    )


@query(
    "fleet_nodes",
    f"""WITH {_FLEET} SELECT 'node-' || s AS node_id, pool, g AS gpus,
    CASE WHEN g > 0 THEN (g - (g > 1)::BIGINT) * 24564 END AS gpu_memory_mb,
    CASE WHEN g > 0 THEN (s % 100 + 50) / 2.0::DOUBLE END AS gpu_util_percent,
    CASE WHEN s % 2 = 0 THEN (s || '500')::DOUBLE / 1000 ELSE s::DOUBLE END AS cpu_cores,
    CASE s % 3 WHEN 0 THEN s * 1073741824 WHEN 1 THEN s * 1000000 + 500000 ELSE s END AS memory_bytes FROM n""",
)
def fleet_nodes(spark: SparkSession, sf: str) -> DataFrame:
    _, nodes, _ = fleet_inventory(_probes(spark, sf))
    return nodes


@query(
    "fleet_devices",
    f"""WITH {_FLEET}, d AS (SELECT s, unnest(generate_series(0, g - 1)) AS i FROM n WHERE g > 0)
    SELECT 'node-' || s AS node_id, CAST(i AS INTEGER) AS index, 'card' AS name,
    CAST(CASE WHEN i <> 1 THEN 24564 END AS BIGINT) AS memory_total_mb, '550.1' AS driver_version,
    '' AS compute_capability FROM d""",
)
def fleet_devices(spark: SparkSession, sf: str) -> DataFrame:
    devices, _, _ = fleet_inventory(_probes(spark, sf))
    return devices


@query(
    "fleet_pools",
    f"""WITH {_FLEET} SELECT pool, count(*) AS nodes, sum(g)::BIGINT AS gpus,
    sum(CASE WHEN g > 0 THEN (g - (g > 1)::BIGINT) * 24564 END)::BIGINT AS gpu_memory_mb,
    round(sum(CASE WHEN s % 2 = 0 THEN (s || '500')::DOUBLE / 1000 ELSE s::DOUBLE END), 6) AS cpu_cores,
    sum(CASE s % 3 WHEN 0 THEN s * 1073741824 WHEN 1 THEN s * 1000000 + 500000 ELSE s END)::BIGINT AS memory_bytes,
    round(avg(CASE WHEN g > 0 THEN (s % 100 + 50) / 2.0::DOUBLE END), 6) AS gpu_util_percent FROM n GROUP BY pool""",
)
def fleet_pools(spark: SparkSession, sf: str) -> DataFrame:
    _, _, pools = fleet_inventory(_probes(spark, sf))
    return pools.select(
        "pool", "nodes", "gpus", "gpu_memory_mb", F.round("cpu_cores", 6).alias("cpu_cores"), "memory_bytes",
        F.round("gpu_util_percent", 6).alias("gpu_util_percent"),
    )
