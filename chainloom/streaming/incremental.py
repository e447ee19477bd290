"""Streaming over folders of Parquet files: windowed counts with a watermark, run to their end and read back."""

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.lineage import scratch


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The files below path (a folder, or one file in it) as a stream with the schema of the table."""
    schema = spark.read.parquet(path).schema
    folder, name = str(PurePosixPath(path).parent), PurePosixPath(path).name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder)


def windowed_counts(events: DataFrame, at: str, key: str, value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) of each tumbling window; the same plan runs on a table and on a stream."""
    rows = events.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, size).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that there is and return what it wrote, read from a table in the shared folder.

    Offsets and state live in a checkpoint location beside it, so a stopped run goes on where it was.
    """
    spark = stream.sparkSession
    base = scratch(spark, name)
    versions = lambda batch, number: batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(versions).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates of each key the last one."""
    rest = [c for c in updates.columns if c not in (*keys, "__batch", "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("x")).select(*keys, "x.*")
