"""Named stages on disk: skipped while their fingerprint stands; feature groups kept apart by version."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@cache
def library_code() -> str:
    """A digest of the modules that stages are made of: a maker's own text is mostly one call into them."""
    root = Path(__file__).resolve().parent.parent
    folders = ("functions", "operators", "plans", "sources")
    return hashlib.sha1(b"\0".join(f.read_bytes() for k in folders for f in sorted((root / k).rglob("*.py")))).hexdigest()


class Stages:
    """Tables under a root that any Hadoop file system serves. A stage is its Parquet folder and a manifest beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _status(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, time) of every file under path; none if it isn't there."""
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return []
        files, out = fs.listFiles(at, True), []
        while files.hasNext():
            f = files.next()
            out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def fingerprint(self, code: Callable, inputs: list[str], parameters: dict | None = None) -> str:
        said = json.dumps([library_code(), inspect.getsource(code), parameters or {}, [self._status(p) for p in inputs]], sort_keys=True, default=str)
        return hashlib.sha1(said.encode()).hexdigest()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def run(self, name: str, make: Callable[[], DataFrame], inputs: list[str] = (), parameters: dict | None = None, force: bool = False) -> DataFrame:
        """The stage's table; made anew if its code, parameters or inputs changed, or its output is missing."""
        path, mark = f"{self.root}/{name}", self.fingerprint(make, list(inputs), parameters)
        stamp = f"{self.root}/_stamps/{name}"
        known = [r["mark"] for r in self.spark.read.parquet(stamp).collect()] if self._status(stamp) else []
        if force or known != [mark] or not self._status(path):
            make().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(stamp)
        return self.table(name)

    def features(self, groups: dict[str, tuple[int, Callable[[], DataFrame]]], keys: tuple[str, ...] = ("rec", "s1"), inputs: list[str] = ()) -> DataFrame:
        """Feature groups (name -> version, maker), each a table of its own, joined on the keys: a new one costs itself only."""
        out = None
        for name, (version, make) in groups.items():
            part = self.run(f"features/{name}/v{version}", make, inputs, {"version": version})
            out = part if out is None else out.join(part, list(keys), "left")
        return out
