"""Session defaults: adaptive execution on, sizes left to the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "recollect", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, skew splitting and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir.

    Only a local master, where all run on one machine, gets a private one if it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scopes: list[list[str]] = []
_left: dict[str, SparkSession] = {}


def settled(table: DataFrame) -> DataFrame:
    """An intermediate table that plans read several times, computed once and written to the
    shared folder: its lineage ends in files that survive executors.

    It goes with the scope (``temporary``) that it is made in, or at the end of the program.
    """
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/recollect-settled-{uuid.uuid4().hex}"
    table.write.parquet(path)
    out = spark.read.schema(table.schema).parquet(path)
    out._recollect_path = path
    if _scopes:
        _scopes[-1].append(path)
    else:
        _left[path] = spark
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted on leaving, but for those handed to the function that is given."""
    _scopes.append([])
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._recollect_path)
        return table

    try:
        yield keep
    finally:
        for path in _scopes.pop():
            if path not in kept:
                erase(spark, path)
            elif _scopes:
                _scopes[-1].append(path)
            else:
                _left[path] = spark


@atexit.register
def _erase_left() -> None:
    for path, spark in _left.items():
        if spark._jsc is not None and spark._jsc.sc().isStopped() is False:
            erase(spark, path)


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(table: DataFrame) -> DataFrame:
    """Rows of few files dealt over all cores; a table of as many files as cores is left where it lies."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if len(table.inputFiles()) < cores else table
