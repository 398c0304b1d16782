"""Readers that keep what can be read and report the rest, and the sinks.

Files are whatever Spark can list: any Hadoop file system works.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas
from millrace.operators.ordered import with_index

#: Fixed value: the only run-document layout accepted.
RUN_CONTRACT = "viewer_v1"


# -- points -------------------------------------------------------------------


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(
        F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double")).alias("v")
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV of numbers; blank rows are skipped, other text is an error."""
    return _numbers(spark, path).select(F.col("v").alias("features"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_points`, with the last column as the label."""
    return _numbers(spark, path).select(
        F.slice("v", 1, F.size("v") - 1).alias("features"), F.element_at("v", -1).alias("label")
    )


def shard_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Round-robin shards: row ``i`` of the ordered frame goes to shard ``i mod n``."""
    return with_index(df, order, "_i").withColumn("shard", (F.col("_i") % n).cast("int")).drop("_i")


def write_points(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Points as CSV text, one folder per shard if the frame has one."""
    as_text = (
        (lambda x: F.format_string(f"%.{digits}f", x))
        if digits is not None
        else (lambda x: x.cast("string"))
    )
    line = F.array_join(F.transform("features", as_text), ",").alias("value")
    if "shard" in df.columns:
        df.select(line, "shard").write.partitionBy("shard").text(path)
    else:
        df.select(line).write.text(path)


# -- JSON ---------------------------------------------------------------------


def _parse(text: Column, schema: str) -> tuple[Column, Column]:
    """(record, usable): usable texts hold one JSON object, even if a field's type
    is not the expected one."""
    full = T.StructType.fromDDL(schema).add("_torn", T.StringType())
    record = F.from_json(text, full, {"columnNameOfCorruptRecord": "_torn"})
    usable = F.ltrim(text).startswith("{") & (
        record["_torn"].isNull()
        | F.coalesce(
            F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)
        )
    )
    return record, F.coalesce(usable, F.lit(False))


def parse_jsonl(lines: DataFrame, schema: str, column: str = "value"):
    """``(rows, rejects)`` of a text column; blank lines belong to neither."""
    record, usable = _parse(F.col(column), schema)
    marked = lines.filter(F.trim(column) != "").withColumn("_ok", usable)
    names = T.StructType.fromDDL(schema).fieldNames()
    kept = [c for c in lines.columns if c != column]
    rows = (
        marked.filter("_ok")
        .withColumn("_r", record)
        .select(*kept, *[F.col("_r")[n].alias(n) for n in names])
    )
    return rows, marked.filter("NOT _ok").drop("_ok")


def read_jsonl(spark: SparkSession, path: str, schema: str):
    """``(rows, rejects)``: torn, foreign and non-object lines do not stop the scan.

    Both carry the file they came from in ``path``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_jsonl(lines, schema)


def _documents(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Whole files called ``name`` anywhere below ``path``: ``path, value``."""
    try:
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", name)
            .text(path, wholetext=True)
        )
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, value string")
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def read_runs(spark: SparkSession, path: str, name: str = "*.json"):
    """``(runs, rejects)`` of run documents; unreadable files and foreign contracts
    are rows in ``rejects``, never an exception."""
    record, usable = _parse(F.col("value"), schemas.RUN_DOCUMENT)
    marked = _documents(spark, path, name).select(
        "path",
        record.alias("_r"),
        F.when(~usable, "unreadable")
        .when(F.coalesce(record["contract"], F.lit("")) != RUN_CONTRACT, "foreign contract")
        .alias("error"),
    )
    names = T.StructType.fromDDL(schemas.RUN_DOCUMENT).fieldNames()
    runs = marked.filter("error IS NULL").select("path", *[F.col("_r")[n].alias(n) for n in names])
    return runs, marked.filter("error IS NOT NULL").select("path", "error")


def run_parts(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attempts, events and trials of run documents, one row each."""
    return (
        runs.select("path", F.inline("attempts")),
        runs.select("path", F.inline("events")),
        runs.select("path", F.posexplode("trials").alias("trial", "values")),
    )


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Rank heartbeats (``rank-*.json``) by rank; torn files are skipped."""
    record, usable = _parse(F.col("value"), schemas.RANKS)
    names = T.StructType.fromDDL(schemas.RANKS).fieldNames()
    return (
        _documents(spark, path, "rank-*.json")
        .filter(usable)
        .withColumn("_r", record)
        .select("path", *[F.col("_r")[n].alias(n) for n in names])
        .orderBy("path", "rank")
    )


def read_manifests(spark: SparkSession, path: str, pattern: str = "step-*") -> DataFrame:
    """Checkpoint manifests below folders named by ``pattern``; one that cannot be
    read counts as absent."""
    record, usable = _parse(F.col("value"), schemas.MANIFEST_DOCUMENT)
    folder = "/" + pattern.replace(".", r"\.").replace("*", "[^/]*") + r"/manifest\.json\z"
    names = T.StructType.fromDDL(schemas.MANIFEST_DOCUMENT).fieldNames()
    return (
        _documents(spark, path, "manifest.json")
        .filter(F.col("path").rlike(folder))
        .filter(usable)
        .withColumn("_r", record)
        .filter(F.col("_r.step").isNotNull() & F.col("_r.parts").isNotNull())
        .select(
            F.regexp_replace("path", r"/[^/]*\z", "").alias("folder"),
            *[F.col("_r")[n].alias(n) for n in names],
        )
    )


# -- results ------------------------------------------------------------------


def write_results(folder: str, **frames: DataFrame) -> None:
    """One parquet table per named result."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


# -- ledger -------------------------------------------------------------------


def append_events(events: DataFrame, path: str) -> None:
    """Append to the ledger, one folder per day so that reads prune by date."""
    (
        events.withColumn("event_date", F.to_date("ts"))
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def events_for(ledger: DataFrame, job_id: str) -> DataFrame:
    return ledger.filter(F.col("job_id") == job_id).orderBy("seq")


def latest_jobs(jobs: DataFrame, order: str = "seq") -> DataFrame:
    """Latest record of every job."""
    rest = [c for c in jobs.columns if c != "job_id"]
    return (
        jobs.groupBy("job_id")
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_j"))
        .select("job_id", "_j.*")
    )
