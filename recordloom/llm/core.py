"""Shared pieces of the training-data operators: scratch tables, hashing, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators fixed by the contracts: space and the control characters 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_recording: list[list[str]] = []
_memories: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests)
    gets one of its own; a cluster would lose rows in a machine-local folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/recordloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    for made in _recording:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Arrow batches hold at most so many bytes, unless the session says otherwise: what a Python worker and its executor
    hold then follows the longest row, not ten thousand of them. Spark's own default is 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(key, most)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages now: its cleaner follows the driver's garbage collection. A hint
    only, with nothing to wait for; files that it misses go with the next one or with the session."""
    gc.collect()
    for _ in range(2):  # the second round meets what the first one's finalizers let go
        time.sleep(0.2)  # listeners hold plans until they have seen the end of an execution
        spark.sparkContext._jvm.System.gc()


def memory(name: str) -> dict:
    """What a Python worker remembers between the tasks of the operators that name it."""
    return _memories.setdefault(name, {})


def worker(function: Callable, *keep: str) -> Callable:
    """function for mapInArrow, in workers that outlive it: Spark hands them to the next operator's tasks, and what one operator
    remembers or has freed would add to what the next one needs. What isn't named in keep is forgotten first; memory that is
    free goes back to the system when a task ends."""
    return partial(_worked, function, keep)  # by reference: a closure would take a copy of the memories along


def _worked(function: Callable, keep: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name in _memories.keys() - set(keep):
        _memories[name].clear()
    try:
        yield from function(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)


@contextmanager
def recorded(made: list[str]):
    """While open, paths of new scratch tables are added to made."""
    _recording.append(made)
    try:
        yield made
    finally:
        _recording[:] = [x for x in _recording if x is not made]  # lists of equal paths are not the same


def release(spark: SparkSession, made: list[str]) -> None:
    """Delete recorded scratch tables, once nothing lazy reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        name = made.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        for other in _recording:
            if name in other:
                other.remove(name)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable instead of a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, mod n."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def bounded_ids(rows: DataFrame, per_class: int, classes: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most per_class keys of each class, of at most `most` classes (the largest, then the least): the documented bound
    of every training sample.

    Keys are picked by hash. How many keys a class has is counted first (repeated rows once, mostly before they are shuffled; `most`
    of the classes come to the driver), and every class is thinned by hash to about four times its bound while it is
    scanned, before anything is shuffled by class: the ranking never meets a large class, however the classes are spread.
    """
    ids = rows.select(key, classes).where(F.col(classes).isNotNull() & F.col(key).isNotNull())
    sizes = ids.distinct().groupBy(classes).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), classes).limit(most).collect()
    place, many = F.xxhash64(key, F.lit("thin")), 1 << 30
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[classes], min(many, 4 * per_class * many // r["_n"] + 1))]) if sizes else None
    if share is None:
        return ids.limit(0)
    thin = ids.where(F.pmod(place, F.lit(many)) < F.coalesce(F.try_element_at(share, F.col(classes)), F.lit(0))).distinct()
    w = Window.partitionBy(classes).orderBy(F.xxhash64(key), F.col(key))
    return thin.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_class).drop("_rank")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, with the text of least hash: a sample of ids is then one of as many rows, however often an id comes."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
