"""Filtered vector search: the planner picks a strategy, each strategy is one lazy plan."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import vectors as V
from larkspan.functions.filters import json_field, where
from larkspan.operators import hnsw, knn
from larkspan.plans.planner import Planner, SearchLog, Strategy, needs_fallback
from larkspan.types import check_k


@dataclass(frozen=True)
class HybridQuery:
    vector: tuple[float, ...]
    k: int = 10
    ef: int = 100
    filter: str | None = None

    def with_filter(self, query: str) -> HybridQuery:
        return replace(self, filter=query)

    def with_ef(self, ef: int) -> HybridQuery:
        return replace(self, ef=ef)


def scored(rows: DataFrame, query, key: str = "point_id", vec: str = "vector") -> DataFrame:
    """key, cosine distance and score of each row; rows without a number take no part."""
    d = V.cosine_distance(V.vector(F.col(vec)), V.vector(list(query)))
    return rows.select(key, d.alias("distance")).filter(~F.isnan("distance") & F.col("distance").isNotNull()).withColumn("score", V.distance_to_score(F.col("distance")))


def brute_force(points: DataFrame, predicate: Column, query, k: int) -> DataFrame:
    """Exact over the matches; the filter is below the distance, so only matches are computed."""
    return scored(points.filter(predicate), query).orderBy("distance", "point_id").limit(check_k(k))


def by_graph(graph: DataFrame, query, k: int, ef: int, allowed: DataFrame | None = None) -> DataFrame:
    """point_id, distance and score by a graph over unit vectors, whose squared distance is twice the cosine distance.

    With allowed ids the graph is walked under that mask, or its allowed rows are scanned where they are few.
    """
    norm = sum(x * x for x in query) ** 0.5
    one = graph.sparkSession.createDataFrame([(0, [x / norm if norm else 0.0 for x in query])], "query_id long, query array<double>")
    found = hnsw.search(graph, one, check_k(k), ef, allowed=allowed)
    distance = F.col("distance") * F.col("distance") / 2
    return found.select(F.col("node_id").alias("point_id"), distance.alias("distance")).withColumn("score", V.distance_to_score(F.col("distance"))).orderBy("distance", "point_id")


def filter_first(points: DataFrame, predicate: Column, query, k: int, graph: DataFrame | None = None, ef: int = 100) -> DataFrame:
    """The matches first, then the nearest of them: under a mask in the graph, or by a scan of the matches where there is no graph."""
    if graph is None:
        return brute_force(points, predicate, query, k)
    return by_graph(graph, query, k, ef, points.filter(predicate).select("point_id"))


def vector_first(points: DataFrame, predicate: Column, query, k: int, expansion: int) -> DataFrame:
    """The nearest ``expansion`` rows, of these the matches, of these k: the order of limit and filter is meant, and may give fewer than k."""
    d = V.cosine_distance(V.vector(F.col("vector")), V.vector(list(query)))
    near = points.withColumn("distance", d).filter(~F.isnan("distance") & F.col("distance").isNotNull()).orderBy("distance", "point_id").limit(expansion)
    kept = near.filter(predicate).select("point_id", "distance", V.distance_to_score(F.col("distance")).alias("score"))
    return kept.orderBy("distance", "point_id").limit(check_k(k))


def unit_graph(points: DataFrame, **how) -> DataFrame:
    """The graph that ``HybridEngine`` takes: an index of the points' unit vectors."""
    unit = points.select("point_id", V.normalize(V.vector(F.col("vector"))).alias("vector"))
    return hnsw.build(unit, "point_id", "vector", **how)


class HybridEngine:
    """Points are (point_id, vector, metadata) with metadata as JSON text; a graph of ``unit_graph`` makes searches approximate."""

    def __init__(self, points: DataFrame, planner: Planner | None = None, resolve=None, graph: DataFrame | None = None):
        self.points, self.planner, self.graph = points, planner or Planner(), graph
        self.resolve = resolve or json_field(F.col("metadata"))

    def counts(self, predicate: Column) -> tuple[int, int]:
        """Rows and matches, in one aggregate that reads no vectors."""
        row = self.points.agg(F.count("*").alias("n"), F.count_if(predicate).alias("m")).first()
        return row["n"], row["m"]

    def selectivity(self, query: str) -> float:
        n, m = self.counts(where(query, self.resolve))
        return m / n if n else 0.0

    def ids(self, query: str) -> DataFrame:
        return self.points.filter(where(query, self.resolve)).select("point_id")

    def bitmask(self, query: str, max_id: int | None = None) -> DataFrame:
        """A boolean for each id below the bound, the largest id and one if none is given; false for ids without a point."""
        if max_id is None:
            top = self.points.agg(F.max("point_id")).first()[0]
            max_id = 0 if top is None else top + 1
        hits = self.points.select("point_id", where(query, self.resolve).alias("matches"))
        return self.points.sparkSession.range(max_id).withColumnRenamed("id", "point_id").join(hits, "point_id", "left").select("point_id", F.coalesce("matches", F.lit(False)).alias("matches"))

    def plan(self, query: HybridQuery):
        n, m = self.counts(where(query.filter, self.resolve))
        return self.planner.plan(n, m, query.k), m

    def search(self, query: HybridQuery) -> DataFrame:
        check_k(query.k)
        if not query.filter:
            if self.graph is not None:
                return by_graph(self.graph, query.vector, query.k, query.ef)
            return scored(self.points, query.vector).orderBy("distance", "point_id").limit(query.k)
        predicate = where(query.filter, self.resolve)
        plan, matches = self.plan(query)
        if plan.strategy is Strategy.FILTER_FIRST:
            return filter_first(self.points, predicate, query.vector, query.k, self.graph, query.ef)
        if plan.strategy is not Strategy.VECTOR_FIRST:
            return brute_force(self.points, predicate, query.vector, query.k)
        found = vector_first(self.points, predicate, query.vector, query.k, plan.expansion)
        rows = found.collect()  # k rows at most, looked at once
        if needs_fallback(len(rows), query.k) and matches > len(rows):
            return brute_force(self.points, predicate, query.vector, query.k)
        return self.points.sparkSession.createDataFrame(rows, found.schema)

    def logged(self, query: HybridQuery, log: SearchLog) -> list:
        """The rows of a search, whose strategy, selectivity and time go into the log."""
        at = time.perf_counter()
        n, m = self.counts(where(query.filter, self.resolve)) if query.filter else (0, 0)
        strategy = self.planner.plan(n, m, query.k).strategy if query.filter else Strategy.VECTOR_FIRST
        rows = self.search(query).collect()  # k rows at most
        log.record(strategy, m / n if n else 1.0, (time.perf_counter() - at) * 1000)
        return rows

    def with_metadata(self, results: DataFrame) -> DataFrame:
        """The JSON of the final rows only: the results are k rows, so they are the broadcast side."""
        return self.points.select("point_id", "metadata").join(F.broadcast(results), "point_id")


# -- masks: (point_id, matches) tables ------------------------------------------------------------


def mask_of(both: DataFrame, other: DataFrame, mix) -> DataFrame:
    """Two masks put together id by id; an id that one lacks is false there."""
    b = other.select("point_id", F.col("matches").alias("other"))
    value = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.join(b, "point_id", "full").select("point_id", mix(value("matches"), value("other")).alias("matches"))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return mask_of(a, b, lambda x, y: x & y)


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return mask_of(a, b, lambda x, y: x | y)


def mask_not(a: DataFrame) -> DataFrame:
    return a.select("point_id", (~F.col("matches")).alias("matches"))


def mask_ids(a: DataFrame) -> DataFrame:
    return a.filter("matches").select("point_id")


def mask_stats(a: DataFrame) -> DataFrame:
    """total, matches and selectivity of a mask."""
    got = a.agg(F.count("*").alias("total"), F.count_if("matches").alias("matches"))
    return got.withColumn("selectivity", F.when(F.col("total") > 0, F.col("matches") / F.col("total")).otherwise(0.0))


def weighted(points: DataFrame, bm25: DataFrame, query, k: int, vector_weight: float = 0.7) -> DataFrame:
    """The k best by a mix of cosine similarity and BM25 (0 where no term occurs)."""
    s = V.cosine(V.vector(F.col("vector")), V.vector(list(query)))
    both = points.select("point_id", s.alias("cosine")).join(bm25, F.col("point_id") == F.col("doc_id"), "left")
    mix = vector_weight * F.col("cosine") + (1 - vector_weight) * F.coalesce("bm25", F.lit(0.0))
    return both.select("point_id", mix.alias("score")).orderBy(F.desc("score"), "point_id").limit(check_k(k))


__all__ = ["HybridEngine", "HybridQuery", "brute_force", "by_graph", "filter_first", "knn", "scored", "vector_first", "weighted"]
