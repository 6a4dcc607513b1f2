"""Folders that all nodes share, and tables kept there for a session."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine may go without it and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="larkspan-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/larkspan-{name}-{spark._jvm.java.util.UUID.randomUUID()}"


def state_of(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of the files of a table, which change when it does."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root))


_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], object]) -> str:
    """The folder of something built from the sources once per session, and again only if they change."""
    key = (spark.sparkContext.applicationId, name, *((s, state_of(spark, s)) for s in sources))
    if key not in _kept:
        path = fresh(spark, name)
        build(path)
        _kept[key] = path
    return _kept[key]
