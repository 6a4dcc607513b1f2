"""Metadata filters, planning and filtered search over embeddings joined with documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import filters
from larkspan.operators import hybrid as H
from larkspan.operators import hnsw, inverted, knn
from larkspan.plans import planner
from larkspan.queries import query, table
from larkspan.queries.text import TOKENS, stored
from larkspan.sources.folders import kept

POINTS = """WITH points AS (SELECT e.vec_id AS point_id, e.embedding::DOUBLE[] AS vector, e.label, d.lang, d.source, d.n_chars, d.text FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
q AS (SELECT vector AS e FROM points WHERE point_id = 0),
s AS (SELECT p.*, 1 - greatest(-1, least(1, list_cosine_similarity(p.vector, q.e))) AS distance FROM points p, q)
"""


def joined(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")
    return e.join(table(spark, d, "documents").withColumnRenamed("doc_id", "point_id"), "point_id")


def points(spark, d):
    """point_id, vector and the metadata of its document as JSON."""
    meta = F.to_json(F.struct("lang", "source", "n_chars", "label", F.array("lang", "source").alias("tags"), F.concat_ws(" ", F.lit("from"), "source", F.lit("in"), "lang").alias("title")))
    return joined(spark, d).select("point_id", "vector", meta.alias("metadata"))


def metadata(spark, d):
    """As ``points`` for all documents, without vectors."""
    doc = table(spark, d, "documents")
    meta = F.to_json(F.struct("lang", "source", "n_chars", F.array("lang", "source").alias("tags"), F.concat_ws(" ", F.lit("from"), "source", F.lit("in"), "lang").alias("title")))
    return doc.select(F.col("doc_id").alias("point_id"), meta.alias("metadata"))


def resolve(field):
    return filters.json_field(F.col("metadata"))(field)


def _filter(name, text, sql):
    @query(name, f"SELECT doc_id AS point_id FROM documents WHERE {sql}")
    def run(spark, d):
        return metadata(spark, d).filter(filters.where(text, resolve)).select("point_id")


_filter("filter_term", "lang:EN", "lang = 'en'")
_filter("filter_range", "n_chars:>=1000", "n_chars >= 1000")
_filter("filter_boolean", "(lang:en OR lang:de) AND NOT source:src3 AND n_chars:<2000", "lang IN ('en', 'de') AND source <> 'src3' AND n_chars < 2000")
_filter("filter_tags", "tags:src3", "source = 'src3'")
_filter("filter_phrase", 'title:"src3 in en"', "source = 'src3' AND lang = 'en'")


def _operators(name, spec, sql):
    @query(name, f"SELECT doc_id AS point_id FROM documents WHERE {sql}")
    def run(spark, d):
        return metadata(spark, d).filter(filters.from_operators(spec, resolve)).select("point_id")


_operators("filter_ops_eq", {"lang": {"$eq": "en"}}, "lang = 'en'")
_operators("filter_ops_ne", {"lang": {"$ne": "en"}}, "lang <> 'en'")
_operators("filter_ops_gt", {"n_chars": {"$gt": 1000}}, "n_chars > 1000")
_operators("filter_ops_gte", {"n_chars": {"$gte": 1000}}, "n_chars >= 1000")
_operators("filter_ops_lt", {"n_chars": {"$lt": 1000}}, "n_chars < 1000")
_operators("filter_ops_lte", {"n_chars": {"$lte": 1000}}, "n_chars <= 1000")
_operators("filter_ops_in", {"lang": {"$in": ["en", "fr"]}}, "lang IN ('en', 'fr')")
_operators("filter_ops_nin", {"lang": {"$nin": ["en", "fr"]}}, "lang NOT IN ('en', 'fr')")
_operators("filter_ops_contains", {"tags": {"$contains": "src3"}}, "source = 'src3'")
_operators("filter_ops_and", {"$and": [{"lang": {"$eq": "en"}}, {"n_chars": {"$gt": 500, "$lt": 1500}}]}, "lang = 'en' AND n_chars > 500 AND n_chars < 1500")
_operators("filter_ops_or", {"$or": [{"lang": {"$eq": "de"}}, {"source": {"$eq": "src3"}}]}, "lang = 'de' OR source = 'src3'")


@query("filter_equality_map", "SELECT doc_id AS point_id FROM documents WHERE lang = 'en' AND source = 'src3'")
def filter_equality_map(spark, d):
    return metadata(spark, d).filter(filters.equality({"lang": "en", "source": "src3"}, resolve)).select("point_id")


IDS = "FROM range(0, (SELECT max(doc_id) + 1 FROM documents)) AS r(i) LEFT JOIN documents ON doc_id = i"


@query("filter_bitmask", f"SELECT i AS point_id, coalesce(lang = 'en', false) AS matches {IDS}")
def filter_bitmask(spark, d):
    return H.HybridEngine(metadata(spark, d)).bitmask("lang:en")


@query("mask_algebra", f"SELECT i AS point_id, coalesce(lang = 'en', false) AND NOT (coalesce(source = 'src3', false) OR coalesce(n_chars > 1000, false)) AS matches {IDS}")
def mask_algebra(spark, d):
    e = H.HybridEngine(metadata(spark, d))
    return H.mask_and(e.bitmask("lang:en"), H.mask_not(H.mask_or(e.bitmask("source:src3"), e.bitmask("n_chars:>1000"))))


@query("selectivity", "SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS matches, round(avg((lang = 'en')::INT), 6) AS selectivity FROM documents")
def selectivity(spark, d):
    p = filters.where("lang:en", resolve)
    got = metadata(spark, d).agg(F.count("*").alias("total"), F.count_if(p).alias("matches"))
    return got.withColumn("selectivity", F.round(planner.selectivity(F.col("total"), F.col("matches")), 6))


@query("metadata_lookup", "SELECT doc_id AS point_id, lang, source FROM documents WHERE doc_id = 7")
def metadata_lookup(spark, d):
    m = metadata(spark, d).filter("point_id = 7")
    return m.select("point_id", resolve("lang").alias("lang"), resolve("source").alias("source"))


@query("metadata_delete", "SELECT doc_id AS point_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def metadata_delete(spark, d):
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("point_id"))
    return metadata(spark, d).join(gone, "point_id", "left_anti").select("point_id", resolve("lang").alias("lang"))


# -- search ----------------------------------------------------------------------------------------

TEN = "SELECT point_id, round(distance, 6) AS distance, round(1 - least(greatest(distance, 0), 2) / 2, 6) AS score FROM {source} WHERE {where} ORDER BY s.distance, point_id LIMIT 10"


def _rounded(df):
    return df.select("point_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def _vector(spark, d):
    return tuple(knn.vector_of(table(spark, d, "embeddings"), 0))


def _search(text):
    def run(spark, d):
        return _rounded(H.HybridEngine(points(spark, d)).search(H.HybridQuery(_vector(spark, d), 10, filter=text)))

    return run


query("hybrid_search", POINTS + TEN.format(source="s", where="lang = 'en' AND label = 3"))(_search("lang:en AND label:3"))
query("hybrid_brute_force", POINTS + TEN.format(source="s", where="label = 3 AND source = 'src3'"))(_search("label:3 AND source:src3"))
query("hybrid_filter_first", POINTS + TEN.format(source="s", where="label = 3"))(_search("label:3"))
query("hybrid_unfiltered", POINTS + TEN.format(source="s", where="true"))(_search(None))
query(
    "hybrid_vector_first",
    POINTS + ", k AS (SELECT least(ceil(10 / avg((lang = 'en')::INT) * 1.5), 10000)::BIGINT AS k FROM points), r AS (SELECT *, row_number() OVER (ORDER BY distance, point_id) AS i FROM s)\n"
    + TEN.format(source="(SELECT r.* FROM r, k WHERE i <= k) AS s", where="lang = 'en'"),
)(_search("lang:en"))


def _graph(spark, d):
    path = kept(spark, "unit-graph", [f"{d}/embeddings.parquet", f"{d}/documents.parquet"], lambda p: hnsw.save(H.unit_graph(joined(spark, d)), p))
    return hnsw.load(spark, path)


def _by_graph(text):
    def run(spark, d):
        return _rounded(H.HybridEngine(points(spark, d), graph=_graph(spark, d)).search(H.HybridQuery(_vector(spark, d), 10, filter=text, ef=200)))

    return run


query("hybrid_graph", POINTS + TEN.format(source="s", where="true"))(_by_graph(None))
query("hybrid_graph_filtered", POINTS + TEN.format(source="s", where="label = 3"))(_by_graph("label:3"))


@query("hybrid_fallback", POINTS + TEN.format(source="s", where="lang = 'en' AND label = 3"))
def hybrid_fallback(spark, d):
    """Vector first with far too small an expansion finds too few, so the scan of the matches answers."""
    p, q = points(spark, d), _vector(spark, d)
    predicate = filters.where("lang:en AND label:3", resolve)
    found = H.vector_first(p, predicate, q, 10, 12)
    return _rounded(H.brute_force(p, predicate, q, 10) if planner.needs_fallback(found.count(), 10) else found)


@query("hybrid_with_metadata", POINTS + "SELECT point_id, lang, source, round(distance, 6) AS distance FROM s WHERE label = 3 ORDER BY s.distance, point_id LIMIT 10")
def hybrid_with_metadata(spark, d):
    e = H.HybridEngine(points(spark, d))
    got = e.with_metadata(e.search(H.HybridQuery(_vector(spark, d), 10, filter="label:3")))
    return got.select("point_id", resolve("lang").alias("lang"), resolve("source").alias("source"), F.round("distance", 6).alias("distance"))


@query(
    "hybrid_bm25",
    TOKENS + """, len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), whole AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT w AS term, doc_id, count(*) AS tf FROM tok WHERE w IN ('that', 'this') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM tf JOIN df USING (term) JOIN len USING (doc_id), whole GROUP BY doc_id),
m AS (SELECT e.vec_id AS point_id, 0.7 * list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 0.3 * coalesce(bm25, 0) AS s FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN bm ON bm.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT point_id, round(s, 6) AS score FROM m ORDER BY s DESC, point_id LIMIT 10""",
)
def hybrid_bm25(spark, d):
    index = stored(spark, d)
    bm = inverted.bm25(index.postings().select("term", "doc_id", "tf"), index.lengths().filter("n > 0"), ["that", "this"])
    return H.weighted(points(spark, d), bm, _vector(spark, d), 10).withColumn("score", F.round("score", 6))


# -- planning --------------------------------------------------------------------------------------

#: one planned query for each source: k = 10, its rows, and its rows of each language
CASES = """WITH c AS (SELECT source, (SELECT count(*) FROM documents) AS total, count(*) AS matches FROM documents GROUP BY source UNION ALL SELECT lang, (SELECT count(*) FROM documents), count(*) FROM documents GROUP BY lang
UNION ALL SELECT source || lang, (SELECT count(*) FROM documents), count(*) FROM documents GROUP BY source, lang),
s AS (SELECT source AS name, total, matches, matches / total AS s FROM c)
"""


def cases(spark, d):
    doc = table(spark, d, "documents")
    parts = [doc.groupBy(F.expr(name).alias("name")).agg(F.count("*").alias("matches")) for name in ("source", "lang", "concat(source, lang)")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    one = doc.agg(F.count("*").alias("total"))
    return every.crossJoin(F.broadcast(one)).withColumn("s", planner.selectivity(F.col("total"), F.col("matches")))  # one row


@query("plan_choice", CASES + "SELECT name, CASE WHEN s < 0.01 THEN 'BruteForce' WHEN s > 0.5 THEN 'VectorFirst' ELSE 'FilterFirst' END AS strategy FROM s")
def plan_choice(spark, d):
    return cases(spark, d).select("name", planner.choice(F.col("s")).alias("strategy"))


@query("plan_expansion", CASES + "SELECT name, CASE WHEN s < 0.001 THEN 10000 ELSE least(ceil(10 / s * 1.5), 10000) END::BIGINT AS expansion FROM s")
def plan_expansion(spark, d):
    return cases(spark, d).select("name", planner.expansion(F.lit(10), F.col("s")).alias("expansion"))


@query(
    "plan_costs",
    CASES + """SELECT name, round(s * total, 6) AS brute, round(1 + 2 * CASE WHEN s < 0.05 THEN 3 WHEN s < 0.2 THEN 1.5::DOUBLE ELSE 1 END + 0.01::DOUBLE * total, 6) AS filter_first,
round(2 + 0.01::DOUBLE * CASE WHEN s < 0.001 THEN 10000 ELSE least(ceil(10 / s * 1.5), 10000) END, 6) AS vector_first FROM s""",
)
def plan_costs(spark, d):
    c = cases(spark, d)
    s, n = F.col("s"), F.col("total")
    return c.select("name", F.round(planner.cost_brute(s, n), 6).alias("brute"), F.round(planner.cost_filter_first(s, n), 6).alias("filter_first"), F.round(planner.cost_vector_first(F.lit(10), s), 6).alias("vector_first"))


#: events stand for query statistics: value as latency, a selectivity from user and event
STATS = """WITH x AS (SELECT event_id AS seq, value AS latency_ms, (user_id % 100) / 100.0::DOUBLE AS selectivity, (event_id % 10) / 10.0::DOUBLE AS recall FROM events),
st AS (SELECT *, CASE WHEN selectivity < 0.01 THEN 'BruteForce' WHEN selectivity > 0.5 THEN 'VectorFirst' ELSE 'FilterFirst' END AS strategy FROM x)
"""


def stats(spark, d):
    e = table(spark, d, "events")
    s = (F.col("user_id") % 100) / F.lit(100.0)
    return e.select(F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"), s.alias("selectivity"), ((F.col("event_id") % 10) / F.lit(10.0)).alias("recall"), planner.choice(s).alias("strategy"))


@query("query_stats_summary", STATS + "SELECT strategy, count(*) AS queries, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(recall), 6) AS avg_recall FROM st GROUP BY strategy")
def query_stats_summary(spark, d):
    return planner.summary(stats(spark, d)).select("strategy", "queries", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("avg_recall", 6).alias("avg_recall"))


@query(
    "recommend_thresholds",
    STATS + """, recent AS (SELECT * FROM st ORDER BY seq DESC LIMIT 1000), r AS (SELECT strategy, selectivity, row_number() OVER (PARTITION BY strategy ORDER BY selectivity) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM recent),
m AS (SELECT max(selectivity) FILTER (WHERE strategy = 'BruteForce') AS b, max(selectivity) FILTER (WHERE strategy = 'FilterFirst') AS f, max(selectivity) FILTER (WHERE strategy = 'VectorFirst') AS v FROM r WHERE i = n // 2)
SELECT round(coalesce((b + f) / 2, 0.01), 6) AS low, round(coalesce((f + v) / 2, 0.5), 6) AS high FROM m""",
)
def recommend_thresholds(spark, d):
    return planner.recommend(stats(spark, d), 1000).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("optimal_strategy", STATS + "SELECT round(selectivity, 4) AS selectivity, arg_min(strategy, (latency_ms, strategy)) AS strategy, min(latency_ms) AS latency_ms FROM st GROUP BY 1")
def optimal_strategy(spark, d):
    return planner.best_by_selectivity(stats(spark, d))
