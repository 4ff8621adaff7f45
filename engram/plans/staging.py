"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: list[list[str]] = []


def staging_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, one of our own if all runs on one machine (as in
    tests); on a cluster the executors would each write to their own disk, so that is refused."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="engram-")
            atexit.register(shutil.rmtree, _own[app], True)
        there = f"file://{_own[app]}"
    return there.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it, and its true size is known to the planner. The files go with the
    application, or at the end of the ``staged`` block they were made in."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/engram-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged inside: write the results before. For sessions that live long."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where, fs = _at(spark, path)
            fs.delete(where, True)
