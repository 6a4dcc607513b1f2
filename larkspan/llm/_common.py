"""What the training-data operators share: the shared folder, table reads and written cuts of lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_state = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node sees: spark.checkpoint.dir where the session names one.

    Only a session on one machine may go without that setting and gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    known = "file://" + tempfile.mkdtemp(prefix="larkspan-")
    spark.sparkContext.setCheckpointDir(known)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; the session may be gone by then, which leaves the folder."""
    if spark.sparkContext._jsc is None:
        return
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, removed at the driver's exit."""
    path = f"{shared_dir(spark)}/larkspan-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: a cut of lineage that outlives executors.

    Within ``steps`` the folder goes with the block unless it is lasting.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not lasting and getattr(_state, "paths", None):
        _state.paths[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """A block whose written tables are deleted at its end, but for lasting ones."""
    stack = _state.paths = getattr(_state, "paths", None) or []
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _remove(spark, path)
        released(spark)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the driver collects garbage; for steps that shuffle about as much as their input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def place(names: list[str], name: str) -> int:
    """Where a column is, the exact name first, then without regard to case."""
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def unnamed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with columns _0, _1 ... that can't clash with an operator's own, and the names to give back by toDF."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), df.columns
