"""Streams of changes: an upserted table, running top-k, and compaction as micro-batches pass."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspan.sources.store import Collection, latest


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "seq", op: str = "op") -> StreamingQuery:
    """Keeps the last operation of each id: a batch is reduced to one row an id, then merged into the next version of the table.

    Versions are numbered by batch, so a batch that is tried again writes its version again and no other.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, key, order)
        if number:
            fresh = latest(spark.read.parquet(f"{path}/version={number - 1}").unionByName(fresh), key, order)
        fresh.write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark, path: str, version: int, op: str = "op") -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").filter(F.col(op) != "delete")


def topk_stream(scored: DataFrame, k: int, path: str, checkpoint: str, score: str = "score", key: str = "id") -> StreamingQuery:
    """Running top-k: a batch's k best and those so far, which is all the state, give the next version's k best."""

    def best(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc(score), key).limit(k)

    def merge(batch: DataFrame, number: int) -> None:
        rows = best(batch.select(key, score))
        if number:
            rows = best(batch.sparkSession.read.parquet(f"{path}/version={number - 1}").unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{path}/version={number}")

    return scored.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_between(collection: Collection, max_rows: int = 10_000) -> bool:
    """What a ticker calls between batches: compacts if the log has grown enough."""
    if not collection.should_compact(max_rows):
        return False
    collection.compact()
    return True


class Ticker:
    """Compacts a collection every so many seconds if its log has grown, until it is stopped; ``stop`` waits for a compaction under way."""

    def __init__(self, collection: Collection, every: float = 60.0, max_rows: int = 10_000):
        self.collection, self.every, self.max_rows = collection, every, max_rows
        self.compactions, self._end = 0, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> Ticker:
        self._thread.start()
        return self

    def _run(self) -> None:
        while not self._end.wait(self.every):
            self.compactions += compact_between(self.collection, self.max_rows)

    def stop(self) -> None:
        self._end.set()
        self._thread.join()


def shut_down(queries: list[StreamingQuery], tickers: list[Ticker] = ()) -> None:
    """Ends streams after what they have read is processed, then tickers."""
    for q in queries:
        if q.isActive:
            q.processAllAvailable()
        q.stop()
    for t in tickers:
        t.stop()
