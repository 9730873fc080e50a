"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Rows of short texts that repeat take up to about so many times the size of their Parquet file (60 copies of the test data's `part`: 5 MB
#: of file, over 100 MB of rows).
ROWS_BY_FILE = 32
#: Scratch tables by application.
_made: dict[str, list[str]] = {}


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them ends; else they stay until the driver happens to collect its garbage, and a chain
    of tables holds the files of all its steps at once. What is read twice is a table here, so no later query misses them."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def judge_by_rows(spark: SparkSession) -> None:
    """Spark takes a table for no larger than its compressed files, and would broadcast millions of rows by way of the driver. Joins
    are planned for the rows' size instead, unless the session has set a factor of its own; small tables are still broadcast."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1:
        spark.conf.set(key, str(float(ROWS_BY_FILE)))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; where it is unset, a local session has a folder of its own. On a cluster
    a machine-local folder would lose rows, so there it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recordloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def clear(spark: SparkSession) -> None:
    """Delete this session's scratch tables: once nothing lazy reads them any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made.get(spark.sparkContext.applicationId):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made[spark.sparkContext.applicationId].pop())
        path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing is at yet; what is written there goes with clear."""
    path = f"{shared_folder(spark).rstrip('/')}/recordloom-scratch/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once and read back: computed once, and a lost executor costs no more than a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_so_far(spark: SparkSession) -> int:
    return len(_made.get(spark.sparkContext.applicationId, []))


def drop_made(spark: SparkSession, first: int, end: int) -> None:
    """Delete the scratch tables that were made from the first to before the end: once nothing lazy reads them any more."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for gone in made[first:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
        path.getFileSystem(conf).delete(path, True)
    del made[first:end]


def settled(make: Callable[[], DataFrame | list[DataFrame]], spark: SparkSession, name: str = "table") -> DataFrame:
    """make()'s rows as a table, those of several DataFrames one after the other, whose shuffle files go in between; the scratch tables that
    were made on the way to it go, so that only the result takes up disk."""
    first, found = made_so_far(spark), make()
    parts = found if isinstance(found, list) else [found]
    path = new_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(path)
    drop_made(spark, first, made_so_far(spark) - 1)
    return spark.read.schema(parts[0].schema).parquet(path)
