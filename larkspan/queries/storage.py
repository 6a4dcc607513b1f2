"""Change logs, point tables and streams; ``events`` in order of time stand for changes by user (error deletes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.queries import query, table
from larkspan.sources import store
from larkspan.sources.folders import fresh
from larkspan.streaming import ingest


def log(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"))


def order():
    return F.struct("ts", "event_id")


LATEST = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)\n"


@query("wal_replay", LATEST + "SELECT user_id, event_id, value FROM r WHERE rn = 1 AND event_type <> 'error'")
def wal_replay(spark, d):
    return store.live(log(spark, d), "user_id", order()).select("user_id", "event_id", "value")


@query("upsert_latest", LATEST + "SELECT user_id, event_id, value FROM r WHERE rn = 1")
def upsert_latest(spark, d):
    return store.latest(log(spark, d), "user_id", order()).select("user_id", "event_id", "value")


@query("live_count", LATEST + "SELECT count(*) AS live FROM r WHERE rn = 1 AND event_type <> 'error'")
def live_count(spark, d):
    return store.live(log(spark, d), "user_id", order()).agg(F.count("*").alias("live"))


@query("wal_replay_corrupt", "WITH b AS (SELECT min(event_id) AS bad FROM events WHERE event_id % 1000 = 700) SELECT event_id, value FROM events, b WHERE event_id < bad")
def wal_replay_corrupt(spark, d):
    """A log whose checksums fail at some rows is read up to the first of them."""
    e = table(spark, d, "events").select("event_id", "value")
    crc = F.crc32(F.concat_ws("|", "event_id", "value"))
    damaged = e.withColumn("crc", crc + F.when(F.col("event_id") % 1000 == 700, 1).otherwise(0))
    return store.readable(damaged, "event_id", F.col("crc") == crc).select("event_id", "value")


@query("delete_points", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_points(spark, d):
    ids = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return store.deleted(table(spark, d, "embeddings"), ids, "vec_id").select("vec_id", "label")


@query("insert_if_absent", "SELECT vec_id, label FROM embeddings UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def insert_if_absent(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("int").alias("label"))
    return store.inserted_if_absent(table(spark, d, "embeddings").select("vec_id", "label"), rows, "vec_id")


@query("upsert_rows", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality FROM labels")
def upsert_rows(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("int").alias("label"))
    return store.upserted(table(spark, d, "embeddings").select("vec_id", "label"), rows, "vec_id")


@query("vector_at", "SELECT vec_id, i - 1 AS place, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) AS r(i) WHERE vec_id = 42")
def vector_at(spark, d):
    row = store.at(table(spark, d, "embeddings"), 42, "vec_id")
    return row.select("vec_id", F.posexplode("embedding").alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("value"))


@query("vector_range", "SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 150")
def vector_range(spark, d):
    return store.between(table(spark, d, "embeddings"), 100, 50, "vec_id").select("vec_id", "label")


def _folders(spark):
    name = fresh(spark, "stream")
    return f"{name}/table", f"{name}/checkpoint"


@query("stream_upsert", LATEST + "SELECT user_id, event_id, value FROM r WHERE rn = 1 AND event_type <> 'error'")
def stream_upsert(spark, d):
    """The log as a stream of files, merged batch by batch."""
    path, checkpoint = _folders(spark)
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    changes = e.select("event_id", "ts", "user_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.struct("ts", "event_id").alias("seq"))
    run = ingest.upsert_stream(changes, path, checkpoint, "user_id")
    run.awaitTermination()
    return ingest.upserted(spark, path, run.lastProgress["batchId"]).select("user_id", "event_id", "value")


@query("streaming_topk", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def streaming_topk(spark, d):
    path, checkpoint = _folders(spark)
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("event_id", "value")
    run = ingest.topk_stream(e, 10, path, checkpoint, "value", "event_id")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/version={run.lastProgress['batchId']}")


@query(
    "collection_search",
    """WITH p AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT p.id, p.label, 1 - greatest(-1, least(1, list_cosine_similarity(p.e, q.e))) AS distance FROM p, q)
SELECT id, round(distance, 6) AS distance, label::VARCHAR AS label FROM s WHERE label = 3 ORDER BY s.distance, id LIMIT 10""",
)
def collection_search(spark, d):
    """Points with JSON metadata in a collection: half compacted, half in the log, some deleted; then a filtered search."""
    c = store.Database(spark, fresh(spark, "collections")).create("vectors", 64)
    e = table(spark, d, "embeddings")
    points = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"), "vec_id")
    c.upsert_json(points.filter("vec_id % 2 = 0").drop("vec_id"))
    c.compact()
    c.upsert_json(points.filter("vec_id % 2 = 1").drop("vec_id"))
    c.delete(table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    query_vector = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    return c.search(query_vector, 10, "label:3").select("id", F.round("distance", 6).alias("distance"), F.col("metadata")["label"].alias("label"))
