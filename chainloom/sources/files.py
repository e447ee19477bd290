"""Files in folders: source files read as bytes, sharded caches, results as JSON lines.

Defined results: bytes that are no UTF-8 become the replacement character; a file that holds a NUL is an empty text, as
it is no text; a file without bytes gives no row, as Spark's file sources leave it out; a folder without matching files
gives an empty table; a shard without rows has no folder.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Folders of tests (with - or _), names of test files, folders that hold no sources of the project.
TEST_FOLDERS = ("test", "tests", "devtest", "devtests", "integration-test", "integration-tests", "integrationtest", "integrationtests", "testfixtures", "androidtest")
TEST_NAME = r"(?:Test|Tests|IT|TestCase)\.java$"
SKIPPED_FOLDERS = ("target", "build", "out", "bin", "dist", "node_modules", "generated-sources", "generated", "generated-test-sources", ".git", ".idea", ".gradle", ".mvn", ".settings", ".svn")


def project_sources(read: DataFrame, root: str, include_tests: bool = False, most: int = 0) -> DataFrame:
    """Of the files (file, text) below a folder root those that belong to the project: none in a skipped folder, and no
    tests unless asked for. Only the part of a path below root counts. most is a report of the first files by path; 0
    takes all."""
    below = F.substring_index(F.col("file"), root.rstrip("/") + "/", -1)
    folders = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    plain = F.transform(folders, lambda x: F.regexp_replace(F.lower(x), "_", "-"))
    test = F.arrays_overlap(plain, F.array(*map(F.lit, TEST_FOLDERS))) | below.rlike(TEST_NAME)
    kept = ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    own = read.where(kept if include_tests else kept & ~F.coalesce(test, F.lit(False)))
    return own.orderBy("file").limit(most) if most else own


def read_sources(spark: SparkSession, folder: str, glob: str = "*.java") -> DataFrame:
    """(file, text) of all matching files below the folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(F.col("path").alias("file"), F.when(F.contains(F.col("content"), F.lit(b"\0")), "").otherwise(decoded).alias("text"))


def write_shards(df: DataFrame, shard: str, folder: str) -> None:
    """Append df to a cache with one folder for each shard; every task writes its own file, so a large shard is no one
    task's work."""
    df.write.partitionBy(shard).mode("append").parquet(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """Replace the folder by df as JSON lines; readers see all of it or none, by the committer."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_json(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(folder)
