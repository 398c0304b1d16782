"""Windowed and stateless stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.logs import CORRELATED_THRESHOLD
from millrace.functions.readings import number_or_null
from millrace.operators import triage
from millrace.streaming.runner import batch_table, delete_folder, run_batches, write_batch


_HELD, _CLOCK = "pool string, ts timestamp", "mark bigint, latest bigint"
_INCIDENTS = "pool string, ts timestamp, failures bigint"


def incident_batches(store: str, seconds: float, threshold: int = CORRELATED_THRESHOLD, delay_s: float = 60.0):
    """Function for ``foreachBatch`` over failures; see :func:`correlated_incidents`."""
    width = int(round(seconds * 1_000_000))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = batch_table(spark, store, "clock", batch_id - 1, _CLOCK).first()
        old_mark, latest = (clock["mark"], clock["latest"]) if clock else (-(2**62), -(2**62))
        us = F.unix_micros("ts")
        newest = batch.agg(F.max(us)).first()[0]
        latest = max(latest, newest if newest is not None else latest)
        mark = max(old_mark, latest - int(delay_s * 1_000_000))
        fresh = batch.select("pool", "ts").filter(us > old_mark)
        write_batch(batch_table(spark, store, "held", batch_id - 1, _HELD).unionByName(fresh), store, "arrived", batch_id)
        rows = batch_table(spark, store, "arrived", batch_id, _HELD)
        seen = triage.concurrent_failures(rows.filter(us <= mark), seconds)
        found = seen.filter((us > old_mark) & (F.col("concurrent_failures") >= threshold))
        found = found.select("pool", "ts", F.col("concurrent_failures").alias("failures"))
        write_batch(found, store, "incidents", batch_id)
        write_batch(rows.filter(us >= mark - width), store, "held", batch_id)
        write_batch(spark.createDataFrame([(mark, latest)], _CLOCK).coalesce(1), store, "clock", batch_id)
        delete_folder(spark, f"{store}/arrived/batch={batch_id}")
        if batch_id > 1:
            for name in ("held", "clock"):
                delete_folder(spark, f"{store}/{name}/batch={batch_id - 2}")

    return run


def correlated_incidents(
    failures: DataFrame, store: str, seconds: float, threshold: int = CORRELATED_THRESHOLD, delay_s: float = 60.0
) -> DataFrame:
    """Failures that see ``threshold`` of their pool in the window ending at them: the
    batch rule of :func:`triage.concurrent_failures`. ``pool, ts, failures`` of all that
    the stream has had so far.

    A failure is judged once ``delay_s`` have passed it, so rows may come in any order
    within that time. What is carried on is the times of one window; a batch counts them
    by prefix sums, so one pool is spread over many tasks. Calling again goes on from there.
    """
    spark = failures.sparkSession
    run_batches(failures.select("pool", "ts"), incident_batches(store, seconds, threshold, delay_s), store)
    found = spark.read.schema(f"{_INCIDENTS}, batch bigint").parquet(f"{store}/incidents")
    return found.drop("batch")


def stream_decisions(failures: DataFrame, mode) -> DataFrame:
    """Failure stream to decision stream: signals, class and the fixed policy, no state.

    Correlation needs other failures; it arrives as ``concurrent_failures`` if the
    stream carries it, and otherwise through :func:`correlated_incidents`.
    """
    return triage.decide(triage.classify(triage.log_signals(failures)), mode)


def telemetry_rollup(telemetry: DataFrame, window: str, delay: str = "1 minute") -> DataFrame:
    """Mean CPU, memory and GPU use per machine and tumbling window.

    ``telemetry``: ``hostname, ts, cpu_percent, mem_percent, gpu_percent``.
    """
    return (
        telemetry.withWatermark("ts", delay)
        .groupBy("hostname", F.window("ts", window))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            *[
                F.avg(number_or_null(F.col(c))).alias(c + "_mean")
                for c in ("cpu_percent", "mem_percent", "gpu_percent")
            ],
        )
        .select("hostname", "window.start", "window.end", "samples", "cpu_percent_mean",
                "mem_percent_mean", "gpu_percent_mean")
    )


def node_sessions(beats: DataFrame, gap: str, delay: str = "1 minute") -> DataFrame:
    """Stretches of activity: beats of a node closer together than ``gap``."""
    return (
        beats.withWatermark("ts", delay)
        .groupBy("node_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("beats"))
        .select("node_id", "session_window.start", "session_window.end", "beats")
    )


def stream_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Each new ``step-N.json`` once: ``path, step, sha256, size_bytes, document``."""
    files = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", "step-*.json")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.col("_metadata.file_path")
    return files.select(
        name.alias("path"),
        F.regexp_extract(name, r"step-(\d+)\.json\z", 1).try_cast("bigint").alias("step"),
        F.sha2(F.encode("value", "UTF-8"), 256).alias("sha256"),
        F.octet_length("value").cast("bigint").alias("size_bytes"),
        F.col("value").alias("document"),
    )
