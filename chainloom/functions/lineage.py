"""Cutting lineage with reliable checkpoints in the folder that the cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's spark.checkpoint.dir. Only a local session, of one machine, may
    leave it unset and gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and return the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_place(df: DataFrame) -> DataFrame:
    """Like cut, but later plans know by which columns df's rows are partitioned and sorted, which they don't of plans that
    may still change while they run. So joins on these columns move no row of the copy again."""
    spark = df.sparkSession
    shared_folder(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def stored(df: DataFrame) -> DataFrame:
    """A copy of df in the shared folder as Parquet, which takes a fraction of the room of what cut writes."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
