import math

import pytest
from pyspark.sql import functions as F

from larkspan.functions import vectors as V
from larkspan.operators import evaluate, knn, quantized
from larkspan.types import InvalidParameter, NotFound


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("build", "a", "b", "want"),
    [
        (V.dot, [1, 0], [0, 1], 0),
        (V.dot, [1, 0], [-1, 0], -1),
        (V.dot, [1, 2, 3], [4, 5, 6], 32),
        (V.cosine, [1, 2], [2, 4], 1),
        (V.cosine, [1, 0], [-1, 0], -1),
        (V.cosine, [1, 0], [0, 0], 0),
        (V.euclidean, [0, 0], [3, 4], 5),
        (V.euclidean_sq, [0, 0], [3, 4], 25),
        (V.manhattan, [0, 0], [3, -4], 7),
        (V.cosine_distance, [1, 0], [0, 1], 1),
        (V.cosine_distance, [0, 0], [0, 1], 1),
    ],
)
def test_pairs(spark, build, a, b, want):
    assert value(spark, build(V.vector(a), V.vector(b))) == pytest.approx(want, abs=1e-6)


def test_single(spark):
    assert value(spark, V.magnitude(V.vector([3, 4]))) == 5
    assert value(spark, V.normalize(V.vector([3, 4]))) == pytest.approx([0.6, 0.8])
    assert value(spark, V.normalize(V.vector([0, 0]))) == [0, 0]
    assert [value(spark, V.distance_to_score(F.lit(float(d)))) for d in (0, 1, 2, 3)] == [1, 0.5, 0, 0]
    assert value(spark, V.band(F.lit(0.96))) == "Duplicate"
    assert value(spark, V.minkowski(V.vector([0, 0]), V.vector([3, 4]), 2)) == pytest.approx(5)


def test_dimension_mismatch(spark):
    with pytest.raises(Exception, match="dimension"):
        value(spark, V.dot(V.vector([1.0]), V.vector([1.0, 2.0])))


def test_metric_names():
    assert V.Metric.of(None) is V.Metric.COSINE and V.Metric.of("dot") is V.Metric.DOT
    with pytest.raises(InvalidParameter):
        V.Metric.of("Dot")


def test_quantize(spark):
    q = value(spark, V.quantize(V.vector([-1, 0, 1])))
    assert (list(q["codes"]), q["vmin"], q["vmax"]) == ([0, 128, 255], -1, 1)
    assert list(value(spark, V.quantize(V.vector([2, 2])))["codes"]) == [0, 0]
    back = value(spark, V.dequantize(V.quantize(V.vector([-1, 0, 1]))))
    assert max(abs(x - y) for x, y in zip(back, [-1, 0, 1], strict=True)) < 0.01


def points(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest(spark):
    df = points(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [float("nan"), 1.0]), (5, None)])
    assert [r.vec_id for r in knn.nearest(df, [1, 0], 2).collect()] == [1, 3]
    assert knn.nearest(df, [1, 0], 100).count() == 3
    assert knn.nearest(df.limit(0), [1, 0], 3).count() == 0
    with pytest.raises(InvalidParameter):
        knn.nearest(df, [1, 0], 0)
    with pytest.raises(NotFound):
        knn.vector_of(df, 9)


def test_euclidean_order_and_ties(spark):
    df = points(spark, [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [0.1, 0.1]), (3, [9.0, 9.0]), (4, [1.0, 1.0])])
    assert [r.vec_id for r in knn.nearest(df, [0.5, 0.5], 3, "euclidean").collect()] == [2, 0, 1]


@pytest.mark.parametrize("metric", list(V.Metric))
def test_batch_equals_single(spark, sf, metric):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 200")
    q = e.filter("vec_id in (3, 77)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = knn.batch(e, q, 7, metric).orderBy("query_id", "rank").collect()
    for i in (3, 77):
        want = [r.vec_id for r in knn.nearest(e, knn.vector_of(e, i), 7, metric).collect()]
        assert [r.vec_id for r in got if r.query_id == i] == want


class _Run:
    """Takes the place of a table and gives the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_batch_in_tiles(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    # 6000 queries, 10 000 rows, of which each third is a copy of one vector
    x = np.random.default_rng(1).normal(size=(10_000, 8)).astype("f4")
    x[::3] = x[0]
    ids = np.arange(len(x))
    rows = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float32()))], ["vec_id", "embedding"])]
    run = knn._block(_Run(), ids[:6000], x[:6000].astype(float), 5, V.Metric.EUCLIDEAN, "vec_id", "embedding", True)
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter(rows))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # a product of them all is 480 MB
    found = np.array(got["vec_id"]).reshape(-1, 5)
    for i in (0, 3, 4, 3333, 5999):
        far = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        far[i] = np.inf
        assert found[i].tolist() == np.lexsort((ids, far))[:5].tolist()


def test_batch_leaves_out_what_is_no_number(spark):
    df = points(spark, [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [float("nan"), 0.0]), (4, [1.0, 1.0])])
    assert sorted(tuple(r) for r in knn.graph(df, 3).collect()) == [(0, 1), (0, 4), (1, 0), (1, 4), (4, 0), (4, 1)]


def test_walk():
    import numpy as np

    at = {i: np.array([float(i), 0.0]) for i in range(5)}
    assert knn.greedy_walk({i: [i - 1, i + 1] if 0 < i < 4 else [1 if i == 0 else 3] for i in range(5)}, at, 0, np.array([3.2, 0])) == [0, 1, 2, 3]


def test_rerank_finds_itself(spark, sf):
    e = quantized.encode(spark.read.parquet(f"{sf}/embeddings.parquet"))
    v = e.filter("vec_id = 5").first()["v"]
    assert quantized.reranked(e, list(v), 3).first()["vec_id"] == 5
    assert 3.0 < quantized.stats(e).first()["ratio"] < 4.5


def test_percentiles(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "id long, ms double")
    row = evaluate.percentiles(df, "ms", "id").first()
    assert (row.p50, row.p95, row.p99) == (6, 10, 10)  # places n/2, 0.95 n, 0.99 n from 0


def test_regressions():
    assert evaluate.regressions({"a": 1.0, "b": 1.0}, {"a": 1.05, "b": 1.2}) == {"b": pytest.approx(0.2)}
    assert evaluate.compare({"avg": 2.0}, {"avg": 1.0, "recall": 0.9}) == {"speed_up": 2.0, "recall_loss": pytest.approx(0.1)}


def test_generators(spark):
    v = evaluate.generated(spark, 3, 4).collect()[2]["vector"]
    assert v == pytest.approx([math.sin((62 + 17 * i) * 0.001) for i in range(4)])
    assert all(-1 <= x < 1 for r in evaluate.uniform(spark, 5, 6).collect() for x in r["vector"])


def test_sql_functions(spark):
    from larkspan.functions import sql

    assert "vec_dot" in sql.register(spark)
    row = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_cosine(array(0D, 0D), array(1D, 1D)) AS z, vec_euclidean(array(0D, 3D), array(4D, 0D)) AS e, vec_magnitude(array(3D, 4D)) AS m").first()
    assert (row.d, row.z, row.e, row.m) == (11.0, 0.0, 5.0, 5.0)


def test_sweep(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21)], "query_id long, vec_id long")
    got = evaluate.sweep(lambda ef: truth.filter(f"vec_id % 10 < {ef}"), [1, 2], truth, 2)
    assert [r["recall"] for r in got] == [0.5, 1.0] and all(r["ms"] > 0 for r in got)
    assert evaluate.compare({"avg": 2.0, "bytes": 10.0}, {"avg": 1.0, "bytes": 25.0})["bytes_ratio"] == 2.5
