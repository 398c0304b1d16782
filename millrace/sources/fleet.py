"""Fleet inventory from raw probe texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.readings import PLACEHOLDERS, cell, cpu_cores, memory_bytes


def _whole(text):
    """A non-negative whole number from the first word of a cell, else NULL."""
    n = F.get(F.split(F.trim(text), r"\s+"), 0).try_cast("bigint")
    return F.when(n >= 0, n)


def gpu_devices(probes: DataFrame) -> DataFrame:
    """One row per GPU a driver listed: ``node_id, index, name, memory_total_mb,
    driver_version, compute_capability``. A line without an index is no device."""
    lines = probes.select("node_id", F.explode(F.split("gpu_text", "\n")).alias("_l"))
    cells = lines.withColumn("_c", F.split("_l", ","))
    index = F.trim(F.get("_c", 0)).try_cast("int")
    at = lambda i: F.coalesce(cell(F.get("_c", i)), F.lit(""))
    return (
        cells.withColumn("index", index)
        .filter(F.col("index") >= 0)
        .select(
            "node_id",
            "index",
            at(1).alias("name"),
            _whole(at(2)).alias("memory_total_mb"),
            at(3).alias("driver_version"),
            at(4).alias("compute_capability"),
        )
    )


def mean_utilisation(probes: DataFrame) -> DataFrame:
    """Mean of the readings inside 0..100 per node; no reading is NULL, not zero."""
    lines = probes.select("node_id", F.explode_outer(F.split("util_text", "\n")).alias("_l"))
    text = F.trim("_l")
    value = F.when(
        ~F.lower(text).isin(PLACEHOLDERS), F.get(F.split(text, r"\s+"), 0).try_cast("double")
    )
    return (
        lines.withColumn("_v", value)
        .groupBy("node_id")
        .agg(F.avg(F.when(F.col("_v").between(0.0, 100.0), F.col("_v"))).alias("gpu_util_percent"))
    )


def fleet_inventory(probes: DataFrame):
    """``(devices, nodes, pools)`` from ``node_id, pool, gpu_text, util_text, cpu_q, mem_q``."""
    devices = gpu_devices(probes)
    per_node = devices.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("gpus"), F.sum("memory_total_mb").alias("gpu_memory_mb")
    )
    nodes = (
        probes.select(
            "node_id",
            "pool",
            cpu_cores(F.col("cpu_q")).alias("cpu_cores"),
            memory_bytes(F.col("mem_q")).alias("memory_bytes"),
        )
        .join(per_node, "node_id", "left")
        .join(mean_utilisation(probes), "node_id", "left")
        .withColumn("gpus", F.coalesce("gpus", F.lit(0)))
    )
    pools = nodes.groupBy("pool").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum("cpu_cores").alias("cpu_cores"),
        F.sum("memory_bytes").alias("memory_bytes"),
        F.sum("gpus").alias("gpus"),
        F.sum("gpu_memory_mb").alias("gpu_memory_mb"),
        F.avg("gpu_util_percent").alias("gpu_util_percent"),
    )
    return devices, nodes, pools
