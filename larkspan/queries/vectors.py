"""Kernels, exact and approximate search, quantization and evaluation over ``embeddings``.

Rows are scaled by 1 + label where a metric would otherwise see unit vectors only.  Scores are rounded to six places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import vectors as V
from larkspan.operators import evaluate, hnsw, knn, quantized
from larkspan.queries import query, table
from larkspan.sources.folders import kept

#: q is vector 0, v the scaled rows
SQL = """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, label, [x * (1 + label) FOR x IN embedding::DOUBLE[]] AS e FROM embeddings)
"""
DIM = "range(1, 65)"
NORM = "sqrt(list_sum([x * x FOR x IN v.e]))"


def scaled(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("label"))).alias("e"))


def first(spark, d):
    return knn.vector_of(table(spark, d, "embeddings"), 0)


def _kernel(name, sql, build):
    @query(name, f"{SQL} SELECT v.vec_id, round({sql}, 6) AS value FROM v, q")
    def run(spark, d):
        q = V.vector(first(spark, d))
        return scaled(spark, d).select("vec_id", F.round(build(F.col("e"), q), 6).alias("value"))

    return run


_kernel("vec_magnitude", f"{NORM} + 0 * len(q.e)", lambda a, q: V.magnitude(a))
_kernel("vec_dot", "list_inner_product(v.e, q.e)", V.dot)
_kernel("vec_cosine", "list_cosine_similarity(v.e, q.e)", V.cosine)
_kernel("vec_cosine_normalized", f"list_inner_product([x / {NORM} FOR x IN v.e], q.e)", lambda a, q: V.cosine_normalized(V.normalize(a), q))
_kernel("vec_euclidean", "list_distance(v.e, q.e)", V.euclidean)
_kernel("vec_euclidean_sq", f"list_sum([(v.e[i] - q.e[i]) ** 2 FOR i IN {DIM}])", V.euclidean_sq)
_kernel("vec_manhattan", f"list_sum([abs(v.e[i] - q.e[i]) FOR i IN {DIM}])", V.manhattan)
_kernel("vec_minkowski", f"pow(list_sum([pow(abs(v.e[i] - q.e[i]), 3) FOR i IN {DIM}]), 1.0 / 3)", lambda a, q: V.minkowski(a, q, 3))
_kernel(
    "vec_weighted_euclidean",
    f"sqrt(list_sum([(v.e[i] - q.e[i]) ** 2 / i FOR i IN {DIM}]))",
    lambda a, q: V.weighted_euclidean(a, q, F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.lit(1.0) / i)),
)
_kernel("vec_cosine_distance", "1 - greatest(-1, least(1, list_cosine_similarity(v.e, q.e)))", V.cosine_distance)
_kernel("distance_to_score", "1 - least(greatest(1 - list_cosine_similarity(v.e, q.e), 0), 2) / 2", lambda a, q: V.distance_to_score(V.cosine_distance(a, q)))


@query(
    "vec_all_metrics",
    f"{SQL} SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS cosine, round(list_distance(v.e, q.e), 6) AS euclidean, round(list_inner_product(v.e, q.e), 6) AS dot FROM v, q",
)
def vec_all_metrics(spark, d):
    q = V.vector(first(spark, d))
    return scaled(spark, d).select("vec_id", *[F.round(V.score(m, F.col("e"), q), 6).alias(m.value) for m in V.Metric])


@query("vec_normalize", f"{SQL} SELECT v.vec_id, i - 1 AS place, round(v.e[i] / {NORM}, 6) AS value, round({NORM}, 6) AS magnitude FROM v, range(1, 65) AS r(i)")
def vec_normalize(spark, d):
    v = scaled(spark, d)
    return v.select("vec_id", F.round(V.magnitude(F.col("e")), 6).alias("magnitude"), F.posexplode(V.normalize(F.col("e"))).alias("place", "x")).select(
        "vec_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("value"), "magnitude"
    )


@query("vec_is_normalized", f"{SQL} SELECT vec_id, abs({NORM} - 1) < 1e-6 AS normalized FROM v")
def vec_is_normalized(spark, d):
    return scaled(spark, d).select("vec_id", V.is_normalized(F.col("e")).alias("normalized"))


@query("vec_dimension", "SELECT vec_id, len(embedding)::INT AS dimension FROM embeddings")
def vec_dimension(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.dimension(F.col("embedding")).alias("dimension"))


@query(
    "vec_angle",
    f"{SQL}, p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1) SELECT v.vec_id, round(list_cosine_similarity([v.e[i] - q.e[i] FOR i IN {DIM}], [p.e[i] - q.e[i] FOR i IN {DIM}]), 6) AS value FROM v, q, p WHERE v.vec_id > 1",
)
def vec_angle(spark, d):
    p = V.vector(knn.vector_of(table(spark, d, "embeddings"), 1))
    return scaled(spark, d).filter("vec_id > 1").select("vec_id", F.round(V.angle_from(F.col("e"), p, V.vector(first(spark, d))), 6).alias("value"))


@query(
    "similarity_bands",
    f"""{SQL}, s AS (SELECT round(list_cosine_similarity(v.e, q.e), 6) AS s FROM v, q)
SELECT CASE WHEN s >= 0.95 THEN 'Duplicate' WHEN s >= 0.85 THEN 'Very similar' WHEN s >= 0.7 THEN 'Similar' WHEN s >= 0.5 THEN 'Somewhat related' WHEN s >= 0.2 THEN 'Different' ELSE 'Unrelated' END AS band, count(*) AS n FROM s GROUP BY 1""",
)
def similarity_bands(spark, d):
    s = F.round(V.cosine(F.col("e"), V.vector(first(spark, d))), 6)
    return scaled(spark, d).select(V.band(s).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query(
    "distance_concentration",
    """WITH p AS (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT count(*) AS pairs, round(avg(x), 6) AS avg_distance, round(stddev_pop(x), 6) AS std_distance, round(stddev_pop(x) / avg(x), 6) AS ratio FROM p""",
)
def distance_concentration(spark, d):
    got = knn.concentration(table(spark, d, "embeddings"))
    return got.select("pairs", *[F.round(c, 6).alias(c) for c in ("avg_distance", "std_distance", "ratio")])


# -- exact search ----------------------------------------------------------------------------------


def _top(name, score, order, metric):
    @query(name, f"{SQL} SELECT v.vec_id, round({score}, 6) AS score FROM v, q ORDER BY {score} {order}, v.vec_id LIMIT 10")
    def run(spark, d):
        return knn.nearest(scaled(spark, d), first(spark, d), 10, metric, vec="e").select("vec_id", F.round("score", 6).alias("score"))


_top("knn_exact_cosine", "list_cosine_similarity(v.e, q.e)", "DESC", V.Metric.COSINE)
_top("knn_exact_euclidean", "list_distance(v.e, q.e)", "ASC", V.Metric.EUCLIDEAN)
_top("knn_exact_dot", "list_inner_product(v.e, q.e)", "DESC", V.Metric.DOT)


@query("knn_exact_normalized", f"{SQL} SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id LIMIT 10")
def knn_exact_normalized(spark, d):
    unit = scaled(spark, d).select("vec_id", V.normalize(F.col("e")).alias("unit"))
    return knn.nearest_normalized(unit, first(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("closest_point", f"{SQL} SELECT v.vec_id, round(list_distance(v.e, q.e), 6) AS distance FROM v, q WHERE v.vec_id <> 0 ORDER BY list_distance(v.e, q.e), v.vec_id LIMIT 1")
def closest_point(spark, d):
    return knn.closest(scaled(spark, d).filter("vec_id <> 0"), first(spark, d), vec="e").select("vec_id", F.round("distance", 6).alias("distance"))


@query("point_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 7").select("vec_id", "label")


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(
    "knn_batch",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 10""",
)
def knn_batch(spark, d):
    got = knn.batch(table(spark, d, "embeddings"), _queries(spark, d), 10, others=True)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


GRAPH_SQL = """WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT src, dst FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY s, dst) <= 5),
g AS (SELECT src, dst FROM r UNION SELECT dst, src FROM r)
"""


@query("knn_graph", GRAPH_SQL + "SELECT src, dst FROM g")
def knn_graph(spark, d):
    return knn.graph(table(spark, d, "embeddings"), 5)


@query("graph_stats", GRAPH_SQL + ", n AS (SELECT src, count(*) AS c FROM g GROUP BY src) SELECT count(*) AS nodes, sum(c)::BIGINT AS links, round(avg(c), 6) AS avg_degree, max(c) AS max_degree FROM n")
def graph_stats(spark, d):
    return knn.degree_stats(knn.graph(table(spark, d, "embeddings"), 5)).withColumn("avg_degree", F.round("avg_degree", 6))


@query(
    "neighbors_naive",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) <= 8""",
)
def neighbors_naive(spark, d):
    return knn.batch(table(spark, d, "embeddings"), _queries(spark, d), 8, V.Metric.EUCLIDEAN, others=True).select("query_id", "vec_id")


# -- graphs ----------------------------------------------------------------------------------------


@query("hnsw_levels", "SELECT vec_id, least(16, floor(-ln(((((vec_id + 1) % 2147483648) * 2654435761) % 4294967296 + 0.5) / 4294967296) / ln(16)))::INT AS level FROM embeddings")
def hnsw_levels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", hnsw.level(F.col("vec_id")).alias("level"))


def _some(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def graphs(spark, d):
    """The graphs of the embeddings, written once per session and read from their files."""
    path = kept(spark, "hnsw", [f"{d}/embeddings.parquet"], lambda p: hnsw.save(hnsw.build(table(spark, d, "embeddings")), p))
    return hnsw.load(spark, path)


@query("hnsw_knn")
def hnsw_knn(spark, d):
    """Ten nearest by a graph per shard."""
    return hnsw.search(graphs(spark, d), _some(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query("hnsw_filtered")
def hnsw_filtered(spark, d):
    allowed = table(spark, d, "embeddings").filter("label = 3").select("vec_id")
    return hnsw.search(graphs(spark, d), _some(spark, d), 10, allowed=allowed).withColumn("distance", F.round("distance", 6))


#: rows that a mask leaves: all, half, a tenth, a hundredth
MASKS = {"all": "true", "half": "vec_id % 2 = 0", "tenth": "vec_id % 10 = 3", "hundredth": "vec_id % 100 = 7"}


@query("hnsw_recall", "SELECT unnest(['all', 'half', 'tenth', 'hundredth', 'inserted']) AS mask, true AS at_least_09")
def hnsw_recall(spark, d):
    """Whether mean recall at 10 against exact search is 0.9 or more, by the share of allowed rows, and for an index that half of the rows were inserted into."""
    e = table(spark, d, "embeddings")
    some = _some(spark, d)
    grown = hnsw.insert(hnsw.build(e.filter("vec_id % 2 = 0")), e.filter("vec_id % 2 = 1"))
    parts = []
    for mask, condition in {**MASKS, "inserted": "true"}.items():
        allowed = e.filter(condition)
        found = hnsw.search(grown if mask == "inserted" else graphs(spark, d), some, 10, allowed=None if condition == "true" else allowed.select("vec_id")).withColumnRenamed("node_id", "vec_id")
        each = evaluate.recall(found, knn.batch(allowed, some, 10, "euclidean"), 10, of_truth=True)
        parts.append(each.agg((F.avg("recall") >= 0.9).alias("at_least_09")).select(F.lit(mask).alias("mask"), "at_least_09"))
    return reduce(DataFrame.unionByName, parts)


@query("hnsw_stats")
def hnsw_stats(spark, d):
    return hnsw.layer_stats(graphs(spark, d))


# -- quantization ----------------------------------------------------------------------------------

CODES = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings),
c AS (SELECT vec_id, e, lo, hi, [greatest(0, least(255, round((x - lo) * 255 / (hi - lo)))) FOR x IN e] AS codes FROM v)
"""


@query("quantize", CODES + "SELECT vec_id, i - 1 AS place, codes[i]::INT AS code, round(lo, 6) AS vmin, round(hi, 6) AS vmax FROM c, range(1, 65) AS r(i)")
def quantize(spark, d):
    q = quantized.encode(table(spark, d, "embeddings"))
    return q.select("vec_id", F.round("q.vmin", 6).alias("vmin"), F.round("q.vmax", 6).alias("vmax"), F.posexplode("q.codes").alias("place", "c")).select(
        "vec_id", F.col("place").cast("long").alias("place"), F.col("c").cast("int").alias("code"), "vmin", "vmax"
    )


@query("dequantize", CODES + "SELECT vec_id, i - 1 AS place, round(lo + codes[i] * (hi - lo) / 255, 6) AS value FROM c, range(1, 65) AS r(i)")
def dequantize(spark, d):
    q = quantized.encode(table(spark, d, "embeddings"))
    return q.select("vec_id", F.posexplode(V.dequantize(F.col("q"))).alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("value"))


NEAR_CODES = "1 - greatest(-1, least(1, list_cosine_similarity(c.codes, p.codes)))"


@query("quantized_knn", CODES + f", p AS (SELECT codes FROM c WHERE vec_id = 0) SELECT c.vec_id, round({NEAR_CODES}, 6) AS distance FROM c, p ORDER BY {NEAR_CODES}, c.vec_id LIMIT 10")
def quantized_knn(spark, d):
    return quantized.by_codes(quantized.encode(table(spark, d, "embeddings")), first(spark, d), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "quantized_rerank",
    CODES + f""", p AS (SELECT codes, e FROM c WHERE vec_id = 0), s AS (SELECT c.vec_id, c.e, p.e AS pe FROM c, p ORDER BY {NEAR_CODES}, c.vec_id LIMIT 40)
SELECT vec_id, round(1 - greatest(-1, least(1, list_cosine_similarity(e, pe))), 6) AS distance FROM s ORDER BY 1 - greatest(-1, least(1, list_cosine_similarity(e, pe))), vec_id LIMIT 10""",
)
def quantized_rerank(spark, d):
    return quantized.reranked(quantized.encode(table(spark, d, "embeddings")), first(spark, d), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "quantization_stats",
    CODES + """, x AS (SELECT [abs(e[i] - (lo + codes[i] * (hi - lo) / 255)) FOR i IN range(1, 65)] AS err FROM c)
SELECT count(*) AS vectors, (count(*) * 256)::BIGINT AS bytes_before, (count(*) * 80)::BIGINT AS bytes_after, round(256.0::DOUBLE / 80, 6) AS ratio, round(sum(list_sum(err)) / (count(*) * 64), 6) AS avg_error, round(max(list_max(err)), 6) AS max_error FROM x""",
)
def quantization_stats(spark, d):
    got = quantized.stats(quantized.encode(table(spark, d, "embeddings")))
    return got.select("vectors", "bytes_before", "bytes_after", *[F.round(c, 6).alias(c) for c in ("ratio", "avg_error", "max_error")])


# -- evaluation ------------------------------------------------------------------------------------

#: codes as the approximate search, exact cosine as the truth
RECALL = CODES + """, a AS (SELECT p.vec_id AS query_id, c.vec_id, list_cosine_similarity(c.codes, p.codes) AS s, list_cosine_similarity(c.e, p.e) AS t FROM c, c AS p WHERE p.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS f, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, vec_id) AS t FROM a)
"""


def _found_and_truth(spark, d, k):
    e = table(spark, d, "embeddings")
    codes = quantized.encode(e).select("vec_id", F.col("q.codes").cast("array<double>").alias("codes"))
    q = codes.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("codes").alias("query"))
    return knn.batch(codes, q, k, vec="codes"), knn.batch(e, _some(spark, d), k)


@query("recall_at_k", RECALL + "SELECT query_id, round(count(*) FILTER (WHERE f <= 10 AND t <= 10) / 10, 6) AS recall FROM r GROUP BY query_id")
def recall_at_k(spark, d):
    found, truth = _found_and_truth(spark, d, 10)
    return evaluate.recall(found, truth, 10).select("query_id", F.round("recall", 6).alias("recall"))


@query(
    "recall_curve",
    RECALL + ", k AS (SELECT unnest([1, 5, 10, 100]) AS k), x AS (SELECT k, query_id, count(*) FILTER (WHERE f <= k AND t <= k) / k AS r FROM r, k GROUP BY k, query_id) SELECT k::INT AS k, round(avg(r), 6) AS recall FROM x GROUP BY k",
)
def recall_curve(spark, d):
    found, truth = _found_and_truth(spark, d, 100)
    return evaluate.recall_curve(found, truth).select("k", F.round("recall", 6).alias("recall"))


@query(
    "latency_percentiles",
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = least(floor(n * 0.95)::BIGINT, n - 1)) AS p95, max(value) FILTER (WHERE i = least(floor(n * 0.99)::BIGINT, n - 1)) AS p99 FROM r""",
)
def latency_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "events"), "value", "event_id")


@query("generated_vectors", "SELECT s.id, i AS place, round(sin((s.id * 31 + i * 17) * 0.001), 6) AS value FROM range(100) AS s(id), range(16) AS r(i)")
def generated_vectors(spark, d):
    v = evaluate.generated(spark, 100, 16)
    return v.select("id", F.posexplode("vector").alias("place", "x")).select("id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("value"))
