"""Collections on Parquet: an append-only change log, compacted generations and a manifest that commits them.

The log holds (seq, op, id, vector, metadata, crc), one file set per append; the state is the last operation
of each id over the newest generation and the log after its checkpoint.  Compaction writes generation g + 1
and then renames a manifest into place, so a crash before the rename leaves the old state and one after it
leaves log rows that replay to the same state.  All paths go through Hadoop's file system API.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import vectors as V
from larkspan.functions.filters import map_field, where
from larkspan.types import CHANGE_LOG, AlreadyExists, DimensionMismatch, EmptyVector, InvalidParameter, NotFound, StorageError, check_k

POINT = ("id", "vector", "metadata", "seq")


# -- log tables as DataFrames ----------------------------------------------------------------------


def checksum(seq: Column, op: Column, id_: Column, vector: Column, metadata: Column) -> Column:
    """CRC-32 of a row's content in a fixed spelling."""
    pairs = F.concat_ws(",", F.transform(F.array_sort(F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.crc32(F.concat_ws("|", seq.cast("string"), op, id_, F.concat_ws(",", F.transform(vector, lambda x: x.cast("string"))), pairs))


def latest(log: DataFrame, key: str = "id", order: str | Column = "seq") -> DataFrame:
    """The row of the last operation of each id: one aggregation with partial maxima, no window."""
    order = F.col(order) if isinstance(order, str) else order
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("row")).select("row.*")


def live(log: DataFrame, key: str = "id", order: str | Column = "seq", op: str = "op") -> DataFrame:
    """The state that replaying the log gives: last operation wins, deleted ids are gone."""
    return latest(log, key, order).filter(F.col(op) != "delete")


def readable(log: DataFrame, seq: str = "seq", sound: Column | None = None) -> DataFrame:
    """The rows before the first whose checksum fails: what a replay of a damaged log may use."""
    ok = F.col("crc") == checksum(F.col("seq"), F.col("op"), F.col("id"), F.col("vector"), F.col("metadata")) if sound is None else sound
    first = log.agg(F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col(seq))).alias("bad")).first()["bad"]
    return log if first is None else log.filter(F.col(seq) < first)


def upserted(state: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """State after changed rows replace those with their ids."""
    return state.join(changes.select(key), key, "left_anti").select(*state.columns).unionByName(changes.select(*state.columns))


def inserted_if_absent(state: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return state.unionByName(rows.join(state.select(key), key, "left_anti").select(*state.columns))


def deleted(state: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return state.join(ids.select(key), key, "left_anti")


def at(df: DataFrame, index: int, column: str) -> DataFrame:
    """One row by its index; NotFound if there is none."""
    row = df.filter(F.col(column) == index)
    if row.isEmpty():
        raise NotFound(f"index {index}")
    return row


def between(df: DataFrame, start: int, count: int, column: str) -> DataFrame:
    """Rows [start, start + count) by index; a range that reaches over the end is an error."""
    if start < 0 or count < 0:
        raise InvalidParameter("start and count can't be negative")
    rows = df.filter((F.col(column) >= start) & (F.col(column) < start + count))
    if rows.count() != count:
        raise NotFound(f"rows {start} to {start + count}")
    return rows


# -- files -----------------------------------------------------------------------------------------


class Files:
    """The few file operations that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def size(self, folder: str) -> int:
        """Bytes of a folder's files."""
        p = self._path(folder)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise StorageError(f"{new} exists")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Collection:
    """One collection's folder: log/, generation_N/ and manifest_N.json."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        if not self.files.exists("collection.json"):
            raise NotFound(path)
        about = json.loads(self.files.read("collection.json"))
        self.name, self.dimension, self.distance = about["name"], about["dimension"], about["distance"]
        for n in self.files.names():  # what a crashed compaction left
            if n.endswith(".tmp") or n.startswith("staged-") or n.startswith("generation_") and int(n.split("_")[1]) > self.generation:
                self.files.delete(n)

    @property
    def generation(self) -> int:
        return max((int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"manifest_(\d+)\.json", n))), default=0)

    @property
    def manifest(self) -> dict:
        g = self.generation
        return json.loads(self.files.read(f"manifest_{g:016d}.json")) if g else {"generation": 0, "checkpoint": 0}

    def log(self) -> DataFrame:
        """Log rows after the checkpoint."""
        if not self.files.names("log"):
            return self.spark.createDataFrame([], CHANGE_LOG)
        return self.spark.read.schema(CHANGE_LOG).parquet(f"{self.path}/log").filter(F.col("seq") > self.manifest["checkpoint"])

    def segment(self) -> DataFrame:
        g = self.generation
        schema = "id string, vector array<float>, metadata map<string,string>, seq bigint"
        return self.spark.read.schema(schema).parquet(f"{self.path}/generation_{g:016d}") if g else self.spark.createDataFrame([], schema)

    def points(self, ids: DataFrame | Column | None = None) -> DataFrame:
        """Live points; damaged log rows and what follows them don't count.

        ids, a condition on ``id`` or a table of them, is applied to log and generation before the last operations are looked for.
        """
        base = self.segment().withColumn("op", F.lit("insert"))
        tail = readable(self.log()).select("id", "vector", "metadata", "seq", "op")
        if isinstance(ids, Column):
            base, tail = base.filter(ids), tail.filter(ids)
        elif ids is not None:
            base, tail = base.join(ids, "id", "left_semi"), tail.join(ids, "id", "left_semi")
        return live(base.unionByName(tail)).select(*POINT)

    def search(self, query: list[float], k: int = 10, filter: str | None = None) -> DataFrame:  # noqa: A002
        """id, distance, score and metadata of the k nearest live points, by the collection's distance, ties to the smaller id.

        The filter speaks of metadata fields and is below the distance; only k rows get their metadata back.
        """
        if len(query) != self.dimension:
            raise DimensionMismatch(self.dimension, len(query))
        points = self.points()
        if filter:
            points = points.filter(where(filter, map_field(F.col("metadata"))))
        v, q = V.vector(F.col("vector")), V.vector([float(x) for x in query])
        distance = {"euclidean": V.euclidean, "cosine": V.cosine_distance}.get(self.distance, lambda a, b: -V.dot(a, b))(v, q)
        rows = points.select("id", distance.alias("distance"), "metadata").filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
        best = rows.orderBy("distance", "id").limit(check_k(k))
        score = V.distance_to_score(F.col("distance")) if self.distance == "cosine" else -F.col("distance")
        return best.select("id", "distance", score.alias("score"), "metadata")

    def _append(self, rows: DataFrame) -> int:
        """Adds rows (op, id, vector, metadata) to the log with the next numbers; single writer.

        Rows are written once without numbers; then each part gets the numbers behind those of the parts before it, so no task has them all.
        """
        top = self.log().agg(F.max("seq")).first()[0]
        start = max(top or 0, self.manifest["checkpoint"]) + 1
        staged = f"staged-{self.spark._jvm.java.util.UUID.randomUUID()}"
        kept = rows.select("op", "id", F.col("vector").cast("array<float>").alias("vector"), "metadata").sortWithinPartitions("id")
        place = F.monotonically_increasing_id()
        kept.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(f"{self.path}/{staged}")
        there = self.spark.read.parquet(f"{self.path}/{staged}")
        counts = sorted((r["part"], r["n"]) for r in there.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each task of the write
        n, before = 0, []
        for part, c in counts:
            before.append((part, start + n))
            n += c
        if n:
            offsets = F.broadcast(self.spark.createDataFrame(before, "part bigint, first bigint"))
            numbered = there.join(offsets, "part").select((F.col("first") + F.col("place")).alias("seq"), "op", "id", "vector", "metadata")
            crc = checksum(F.col("seq"), F.col("op"), F.col("id"), F.col("vector"), F.col("metadata"))
            numbered.withColumn("crc", crc.cast("bigint")).write.mode("append").parquet(f"{self.path}/log")
        self.files.delete(staged)
        return n

    def upsert(self, points: DataFrame) -> int:
        """Checks and logs points (id, vector, metadata)."""
        size = F.size("vector")
        bad = points.agg(F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("ids"), F.count_if(F.coalesce(size, F.lit(0)) <= 0).alias("empty"), F.max(F.when((size > 0) & (size != self.dimension), size)).alias("other")).first()
        if bad["ids"]:
            raise InvalidParameter("an id is empty")
        if bad["empty"]:
            raise EmptyVector
        if bad["other"]:
            raise DimensionMismatch(self.dimension, bad["other"])
        return self._append(points.withColumn("op", F.lit("insert")))

    def insert_if_absent(self, points: DataFrame) -> int:
        return self.upsert(points.join(self.points().select("id"), "id", "left_anti"))

    def upsert_json(self, points: DataFrame) -> int:
        """As ``upsert`` for points (id, vector, metadata) whose metadata is JSON text; values that are no strings keep their JSON spelling."""
        return self.upsert(points.withColumn("metadata", F.from_json("metadata", "map<string,string>")))

    def delete(self, ids: list[str] | DataFrame) -> int:
        """Logs deletions of the ids that are there; gives their number."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        there = self.points(ids.select("id").distinct()).select("id")
        return self._append(there.select(F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata")))

    def get(self, id_: str):
        row = self.points(F.col("id") == id_).first()
        if row is None:
            raise NotFound(id_)
        return row

    def count(self) -> int:
        return self.points().count()

    def log_bytes(self) -> int:
        return self.files.size("log")

    def should_compact(self, max_rows: int = 10_000, max_bytes: int | None = None, every: float | None = None) -> bool:
        """Whether the log has so many rows or bytes, or holds any rows and the last compaction is so many seconds ago."""
        rows = self.log().count()
        old = every is not None and rows > 0 and time.time() - self.manifest.get("time", 0) >= every
        return rows >= max_rows or (max_bytes is not None and self.log_bytes() >= max_bytes) or old

    def stats(self) -> dict:
        """Rows, log and generation sizes, and the totals of all compactions."""
        m = self.manifest
        return {"points": self.count(), "log_rows": self.log().count(), "log_bytes": self.log_bytes(), "generation": m["generation"], "compactions": m.get("compactions", 0), "bytes_reclaimed": m.get("bytes_reclaimed", 0)}

    def compact(self, crash: str | None = None) -> dict:
        """Writes the live state as the next generation; ``crash`` ("before" or "after" the rename) stops there, for tests."""
        top = readable(self.log()).agg(F.max("seq")).first()[0]
        if top is None:
            raise InvalidParameter("nothing to compact")
        g, last, began = self.generation + 1, self.manifest, time.time()
        before = self.log_bytes() + (self.files.size(f"generation_{g - 1:016d}") if g > 1 else 0)
        rows = self.points()
        rows.write.mode("overwrite").parquet(f"{self.path}/generation_{g:016d}")
        about = {"generation": g, "checkpoint": top, "rows": self.spark.read.parquet(f"{self.path}/generation_{g:016d}").count()}
        size = self.files.size(f"generation_{g:016d}")
        about |= {"time": time.time(), "seconds": time.time() - began, "bytes_before": before, "bytes_after": size}
        about |= {"compactions": last.get("compactions", 0) + 1, "bytes_reclaimed": last.get("bytes_reclaimed", 0) + max(0, before - size)}
        self.files.write(f"manifest_{g:016d}.json.tmp", json.dumps(about))
        if crash == "before":
            return about
        self.files.rename(f"manifest_{g:016d}.json.tmp", f"manifest_{g:016d}.json")
        if crash == "after":
            return about
        self.truncate()
        return about

    def truncate(self) -> None:
        """Removes the log if the checkpoint covers it whole."""
        if self.log().isEmpty():
            self.files.delete("log")
            for n in self.files.names():
                if n.startswith("generation_") and int(n.split("_")[1]) < self.generation:
                    self.files.delete(n)


class LogWriter:
    """Upserts of a collection gathered until its sync policy says so: each call, every so many calls, or so many seconds after the last sync.

    What is gathered is lost if the driver is; ``sync`` and the end of a ``with`` block write it.
    """

    def __init__(self, collection: Collection, calls: int = 1, seconds: float | None = None):
        self.collection, self.calls, self.seconds = collection, calls, seconds
        self.held: list[DataFrame] = []
        self.last = time.monotonic()

    def upsert(self, points: DataFrame) -> int:
        """Rows written by this call, those held before included."""
        self.held.append(points)
        due = len(self.held) >= self.calls if self.seconds is None else time.monotonic() - self.last >= self.seconds
        return self.sync() if due else 0

    def sync(self) -> int:
        # of an id in several calls the last one counts, so each call is appended by itself
        n = sum(self.collection.upsert(p) for p in self.held)
        self.held, self.last = [], time.monotonic()
        return n

    def __enter__(self) -> LogWriter:
        return self

    def __exit__(self, *_) -> None:
        self.sync()


class Database:
    """Collections under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def create(self, name: str, dimension: int, distance: str = "cosine") -> Collection:
        if dimension < 1:
            raise InvalidParameter("the dimension must be at least 1")
        if self.files.exists(f"{name}/collection.json"):
            raise AlreadyExists(name)
        self.files.write(f"{name}/collection.json", json.dumps({"name": name, "dimension": dimension, "distance": distance}))
        return self.open(name)

    def open(self, name: str) -> Collection:
        return Collection(self.spark, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        if not self.files.exists(f"{name}/collection.json"):
            raise NotFound(name)
        self.files.delete(name)

    def info(self, name: str) -> dict:
        c = self.open(name)
        return {"name": c.name, "dimension": c.dimension, "distance": c.distance, "count": c.count()}
