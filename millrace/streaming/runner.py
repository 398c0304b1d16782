"""Start a stream over everything that is available and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import scratch_path


def drain(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run until the input is used up; the result and the stream's progress live below
    ``folder``, so calling again with the same one continues where it stopped."""
    spark = stream.sparkSession
    base = folder or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .option("path", f"{base}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def batch_table(spark: SparkSession, store: str, name: str, batch: int, schema) -> DataFrame:
    """What a micro-batch wrote under a name; before the first one, nothing."""
    if batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/{name}/batch={batch}")


def write_batch(rows: DataFrame, store: str, name: str, batch: int) -> None:
    """A folder for each table of a micro-batch: one that runs again replaces what it wrote."""
    rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch}")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a table that no later batch reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def run_batches(stream: DataFrame, batch_function, store: str) -> None:
    """Hand everything that is available to ``batch_function`` for ``foreachBatch``; progress
    lives below ``store``."""
    query = (
        stream.writeStream.foreachBatch(batch_function)
        .option("checkpointLocation", f"{store}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
