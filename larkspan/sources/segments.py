"""Binary vector segments: a header (magic VECT, version, count, dimension, little-endian) and rows of 32-bit floats.

Reading is a scan: Spark hands out whole files, and Arrow batches of (idx, vector) come back, so nothing
is gathered on the driver.  Writing makes one file per partition.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.types import DimensionMismatch, EmptyVector, FormatError

MAGIC, VERSION, HEADER = b"VECT", 1, struct.Struct("<4sIII")


def pack(vectors: np.ndarray) -> bytes:
    if vectors.ndim != 2 or not vectors.shape[1]:
        raise EmptyVector
    return HEADER.pack(MAGIC, VERSION, *vectors.shape) + vectors.astype("<f4").tobytes()


def header(raw: bytes) -> tuple[int, int]:
    """(count, dimension)."""
    if len(raw) < HEADER.size:
        raise FormatError("the header is cut")
    magic, version, count, dimension = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise FormatError(f"magic {magic!r}, version {version}")
    return count, dimension


def unpack(raw: bytes) -> np.ndarray:
    count, dimension = header(raw)
    if len(raw) != HEADER.size + 4 * count * dimension:
        raise FormatError("the size differs from the header's")
    return np.frombuffer(raw, "<f4", offset=HEADER.size).reshape(count, dimension)


def write(df: DataFrame, folder: str, dimension: int, vec: str = "vector") -> DataFrame:
    """Writes segments under a URI that all nodes reach; a row (file, count) for each, in the order of the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        rows = []
        for b in batches:
            sizes = set(b.column(0).value_lengths().to_pylist()) - {dimension}
            if sizes:
                raise DimensionMismatch(dimension, next(iter(sizes)) or 0)
            rows.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
        if rows and sum(map(len, rows)):
            fs.create_dir(root, recursive=True)
            name = f"segment_{TaskContext.get().partitionId():016d}.vec"
            vectors = np.concatenate(rows)
            with fs.open_output_stream(f"{root}/{name}.tmp") as out:
                out.write(pack(vectors))
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(vectors)], pa.int64())], ["file", "count"])

    return df.select(vec).mapInArrow(run, "file string, count long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """file, idx and vector of every row of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = unpack(raw.as_buffer().to_pybytes())
                ends = pa.array(np.arange(0, v.size + 1, v.shape[1] or 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(range(len(v)), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["file", "idx", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vec").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, idx long, vector array<float>")


def text_sum(df: DataFrame, column: str = "value") -> DataFrame:
    """Sum of the numbers in lines of text, and how many words are none."""
    each = df.select(F.explode(F.split(F.trim(column), r"\s+")).alias("w")).filter("w <> ''").select(F.expr("try_cast(w AS DOUBLE)").alias("x"))
    return each.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.count_if(F.col("x").isNull()).alias("unreadable"))
