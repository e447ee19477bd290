"""Reading the given tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table NAME.parquet (a file or a folder of parts) below folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
