import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.sources import segments
from larkspan.sources.store import Database, Files, LogWriter
from larkspan.streaming import ingest
from larkspan.types import AlreadyExists, DimensionMismatch, EmptyVector, FormatError, InvalidParameter, NotFound

POINT = "id string, vector array<float>, metadata map<string,string>"


def points(spark, *ids, x=1.0):
    return spark.createDataFrame([(i, [x, 2.0], {"k": i}) for i in ids], POINT)


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}")


def live(c):
    return {r.id: r.vector[0] for r in c.points().collect()}


def test_lifecycle(spark, db):
    c = db.create("docs", 2)
    with pytest.raises(AlreadyExists):
        db.create("docs", 2)
    c.upsert(points(spark, "a", "b"))
    c.upsert(points(spark, "b", x=5.0))
    assert live(c) == {"a": 1, "b": 5}
    assert c.delete(["a", "zz"]) == 1 and live(c) == {"b": 5}
    c.upsert(points(spark, "a", x=7.0))
    assert c.insert_if_absent(points(spark, "a", "c", x=9.0)) == 1
    assert live(c) == {"a": 7, "b": 5, "c": 9} and db.info("docs")["count"] == 3
    c.compact()
    assert live(c) == {"a": 7, "b": 5, "c": 9} and c.log().isEmpty() and c.get("c").metadata == {"k": "c"}
    c.delete(["b"])
    assert live(db.open("docs")) == {"a": 7, "c": 9}
    c.compact()
    assert live(c) == {"a": 7, "c": 9} and c.generation == 2
    with pytest.raises(InvalidParameter):
        c.compact()
    with pytest.raises(NotFound):
        c.get("b")
    db.drop("docs")
    with pytest.raises(NotFound):
        db.open("docs")


@pytest.mark.parametrize("crash", ["before", "after"])
def test_crash_in_compaction(spark, db, crash):
    c = db.create("docs", 2)
    c.upsert(points(spark, "a", "b"))
    c.compact(crash)
    again = db.open("docs")
    assert live(again) == {"a": 1, "b": 1}
    assert not [n for n in again.files.names() if n.endswith(".tmp")]
    assert again.generation == (crash == "after")


def test_validation(spark, db):
    c = db.create("docs", 2)
    with pytest.raises(DimensionMismatch):
        c.upsert(spark.createDataFrame([("a", [1.0], None)], POINT))
    with pytest.raises(EmptyVector):
        c.upsert(spark.createDataFrame([("a", [], None)], POINT))
    with pytest.raises(InvalidParameter):
        c.upsert(spark.createDataFrame([("", [1.0, 2.0], None)], POINT))


def test_damaged_log(spark, db, tmp_path):
    c = db.create("docs", 2)
    c.upsert(points(spark, "a"))
    log = c.log().withColumn("seq", F.lit(2).cast("long")).withColumn("id", F.lit("x"))
    log.unionByName(c.log().withColumn("seq", F.lit(3).cast("long"))).write.mode("append").parquet(f"{c.path}/log")
    assert live(c) == {"a": 1}


def test_segments(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    assert (segments.unpack(segments.pack(x)) == x).all() and segments.header(segments.pack(x)) == (4, 3)
    with pytest.raises(FormatError):
        segments.unpack(segments.pack(x)[:-1])
    with pytest.raises(FormatError):
        segments.header(b"NOPE" + segments.pack(x)[4:])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "vector array<float>")
    folder = f"file://{tmp_path}/seg"
    assert sum(r["count"] for r in segments.write(df, folder, 3).collect()) == 4
    assert sorted(r.vector for r in segments.read(spark, folder).collect()) == x.tolist()
    with pytest.raises(Exception, match="dimension"):
        segments.write(df, folder, 2).collect()


def test_text_sum(spark):
    row = segments.text_sum(spark.createDataFrame([("1 2.5",), ("x 3",)], "value string")).first()
    assert (row.total, row.unreadable) == (6.5, 1)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for i, score in enumerate([10, 5, 15, 3, 20, 8, 25, 7, 12, 30]):
        spark.createDataFrame([(f"t{i % 4}", i, score, "delete" if i == 8 else "insert")], "id string, seq long, score int, op string").write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("id string, seq long, score int, op string").option("maxFilesPerTrigger", 4).parquet(str(src))
    run = ingest.topk_stream(stream(), 5, str(tmp_path / "top"), str(tmp_path / "c1"))
    run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/top/version={run.lastProgress['batchId']}")
    assert sorted(r.score for r in got.collect()) == [12, 15, 20, 25, 30]
    run = ingest.upsert_stream(stream(), str(tmp_path / "up"), str(tmp_path / "c2"))
    run.awaitTermination()
    state = ingest.upserted(spark, str(tmp_path / "up"), run.lastProgress["batchId"])
    assert {r.id: r.score for r in state.collect()} == {"t1": 30, "t2": 25, "t3": 7}


def test_compaction_rule(spark, db):
    c = db.create("docs", 2)
    c.upsert(points(spark, "a", "b"))
    assert not ingest.compact_between(c, 3) and ingest.compact_between(c, 2)
    assert Files(spark, c.path).exists("manifest_0000000000000001.json")


def test_search_and_stats(spark, tmp_path):
    """Search over generation and log with deletions, JSON metadata and a filter; compaction by rows, bytes and time."""
    c = Database(spark, f"file://{tmp_path}/db").create("c", 2, "euclidean")
    rows = [(f"p{i}", [float(i), 0.0], f'{{"parity":"{"even" if i % 2 == 0 else "odd"}","n":{i}}}') for i in range(40)]
    make = lambda x: spark.createDataFrame(x, "id string, vector array<float>, metadata string")
    assert c.upsert_json(make(rows[:20]).repartition(3)) == 20 and not c.should_compact(21)
    assert c.should_compact(20) and c.should_compact(100, max_bytes=1) and c.should_compact(100, every=0)
    about = c.compact()
    assert about["bytes_before"] > 0 and about["compactions"] == 1 and not c.should_compact(1, every=0)
    assert c.upsert_json(make(rows[20:]).repartition(4)) == 20
    assert c.delete(spark.createDataFrame([("p21",), ("gone",)], "id string")) == 1 and c.delete(["p1"]) == 1
    got = c.search([21.4, 0.0], 3).collect()
    assert [r.id for r in got] == ["p22", "p20", "p23"] and abs(got[0].distance - 0.6) < 1e-6
    assert [r.id for r in c.search([0.0, 0.0], 2, "parity:odd AND n:>2").collect()] == ["p3", "p5"]
    assert c.get("p30").metadata["n"] == "30" and c.count() == 38
    seqs = [r.seq for r in c.log().orderBy("seq").collect()]
    assert seqs == list(range(21, 43)) and c.stats()["compactions"] == 1
    with pytest.raises(DimensionMismatch):
        c.search([1.0], 1)


def test_sync_policy(spark, db):
    c = db.create("docs", 2)
    writer = LogWriter(c, calls=3)
    assert [writer.upsert(points(spark, x)) for x in "abc"] == [0, 0, 3] and c.count() == 3
    with LogWriter(c, seconds=3600) as timed:
        assert timed.upsert(points(spark, "d")) == 0 and c.count() == 3
    assert c.count() == 4


def test_ticker(spark, db):
    import time

    c = db.create("docs", 2)
    c.upsert(points(spark, "a", "b"))
    t = ingest.Ticker(c, every=0.2, max_rows=2).start()
    until = time.monotonic() + 60
    while not t.compactions and time.monotonic() < until:
        time.sleep(0.2)
    ingest.shut_down([], [t])
    assert t.compactions >= 1 and c.generation == 1 and live(c) == {"a": 1, "b": 1}
