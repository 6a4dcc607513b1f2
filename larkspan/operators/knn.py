"""Exact nearest neighbours: one query as a sort with a limit, many as block products, and their variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.functions import vectors as V
from larkspan.types import InvalidParameter, NotFound, check_k

BROADCAST_QUERIES = 20_000
#: queries and rows of a matrix product, and pairs that are computed at once
TILE, PAIRS = (512, 2048), 16_384


def vector_of(df: DataFrame, id_: int, key: str = "vec_id", vec: str = "embedding") -> list[float]:
    """One row's vector; a literal in the plan of a search, where a subquery would be a join."""
    row = df.filter(F.col(key) == id_).select(vec).first()
    if row is None:
        raise NotFound(f"{key} {id_}")
    return [float(x) for x in row[0]]


def nearest(df: DataFrame, query: list[float], k: int, metric: str | V.Metric = V.Metric.COSINE, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """key, distance and score of the k nearest rows; ties to the smaller key; rows whose score is not a number take no part.

    The plan is a scan of two columns and TakeOrderedAndProject: each task keeps k rows and no shuffle moves more.
    """
    check_k(k)
    m = V.Metric.of(metric)
    q, v = V.vector(query), V.vector(F.col(vec))
    s = V.score(m, v, q)
    out = df.select(key, s.alias("score")).filter(~F.isnan("score") & F.col("score").isNotNull())
    best = F.asc("score") if m is V.Metric.EUCLIDEAN else F.desc("score")
    return out.orderBy(best, key).limit(k)


def nearest_normalized(df: DataFrame, query: list[float], k: int, key: str = "vec_id", vec: str = "unit") -> DataFrame:
    """As ``nearest`` by cosine over a column of unit vectors: only the product is computed."""
    check_k(k)
    norm = sum(x * x for x in query) ** 0.5
    unit = [x / norm for x in query] if norm else list(query)
    return df.select(key, V.dot(V.vector(F.col(vec)), V.vector(unit)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def filtered(df: DataFrame, allowed: Column | DataFrame, query: list[float], k: int, **how) -> DataFrame:
    """The k nearest of the rows that a condition, or a table of keys, allows."""
    key = how.get("key", "vec_id")
    rows = df.filter(allowed) if isinstance(allowed, Column) else df.join(allowed.select(key), key, "left_semi")
    return nearest(rows, query, k, **how)


def closest(df: DataFrame, query: list[float], key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The one nearest row by Euclidean distance: a single aggregate."""
    d = V.euclidean(V.vector(F.col(vec)), V.vector(query))
    best = df.select(F.min(F.struct(d.alias("distance"), F.col(key))).alias("m"))
    return best.select(F.col(f"m.{key}").alias(key), F.col("m.distance").alias("distance"))


def batch(df: DataFrame, queries: DataFrame, k: int, metric: str | V.Metric = V.Metric.COSINE, key: str = "vec_id", vec: str = "embedding", others: bool = False) -> DataFrame:
    """query_id, rank, key and score of the k nearest rows of each query (query_id, query).

    Up to ``BROADCAST_QUERIES`` queries are sent to every task, which multiplies matrices by tiles and keeps k rows a
    query; more go in blocks of that many, each a pass over the data.  A query's own row is a candidate
    unless only others are asked for; null vectors and scores that are not a number take no part.
    """
    check_k(k)
    m = V.Metric.of(metric)
    queries = queries.filter("query IS NOT NULL")
    rows = queries.count()
    if rows == 0:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    blocks = -(-rows // BROADCAST_QUERIES)
    parts = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.toPandas()
        if len(got):
            parts.append(_block(df, np.array(got["query_id"]), np.array(got["query"].tolist(), float), k, m, key, vec, others))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = F.asc("score") if m is V.Metric.EUCLIDEAN else F.desc("score")
    w = Window.partitionBy("query_id").orderBy(order, key)
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _block(df: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, m: V.Metric, key: str, vec: str, others: bool) -> DataFrame:
    """What each task finds for the queries of one block.

    Matrix products of ``TILE`` queries and rows, never of a whole block, say which pairs may be among the k nearest; these are
    computed one by one, so that equal vectors have equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, best = _sides(q, m)[0], _Best(len(q), k)
        for b in batches:
            keep = b.column(1).is_valid()
            column, keys = b.column(1).filter(keep), b.column(0).filter(keep).to_numpy()
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            if flat.size != len(keys) * q.shape[1]:
                raise InvalidParameter("vectors differ in dimension")
            for at in range(0, len(keys), TILE[1]):
                some = keys[at : at + TILE[1]]
                x = flat[at * q.shape[1] :][: len(some) * q.shape[1]].reshape(len(some), -1)
                right = _sides(x, m)[1]
                for i in range(0, len(q), TILE[0]):
                    _tile(best, i, ids[i : i + TILE[0]], q[i : i + TILE[0]], left[i : i + TILE[0]], some, x, right, m, others)
        for i in range(0, len(q), TILE[1]):
            cost, at = best.cost[i : i + TILE[1]].ravel(), best.key[i : i + TILE[1]].ravel()
            real = ~np.isnan(cost)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + TILE[1]], k)[real]), pa.array(at[real]), pa.array(cost[real] if m is V.Metric.EUCLIDEAN else -cost[real])], ["query_id", key, "score"])

    return df.select(F.col(key).cast("long"), vec).mapInArrow(run, f"query_id long, {key} long, score double")


class _Best:
    """The k least costs of each query and their keys, in order; NaN where there are fewer."""

    def __init__(self, n: int, k: int):
        self.k, self.cost, self.key = k, np.full((n, k), np.nan), np.zeros((n, k), np.int64)

    def add(self, row: np.ndarray, cost: np.ndarray, key: np.ndarray) -> None:
        rows = np.unique(row)
        every = np.concatenate([np.repeat(rows, self.k), row])
        costs, keys = np.concatenate([self.cost[rows].ravel(), cost]), np.concatenate([self.key[rows].ravel(), key])
        by = np.lexsort((keys, costs, every))
        first = np.searchsorted(every[by], rows)
        by = by[first[:, None] + np.arange(self.k)]
        self.cost[rows], self.key[rows] = costs[by], keys[by]


def _sides(x: np.ndarray, m: V.Metric) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as the left and the right of a product that is about their cost, squared if Euclidean."""
    if m is V.Metric.EUCLIDEAN:
        square, one = (x**2).sum(1)[:, None], np.ones((len(x), 1))
        return np.hstack([x, square, one]), np.hstack([-2 * x, one, square])
    if m is V.Metric.COSINE:
        norm = np.sqrt((x**2).sum(1))[:, None]
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return x, -x


def _costs(a: np.ndarray, b: np.ndarray, m: V.Metric) -> np.ndarray:
    """The cost of each pair of rows: the distance, or the similarity's opposite."""
    if m is V.Metric.EUCLIDEAN:
        return np.sqrt(((a - b) ** 2).sum(1))
    dot = (a * b).sum(1)
    if m is V.Metric.COSINE:
        norms = np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1))
        dot = np.divide(dot, norms, out=np.where(np.isnan(norms), np.nan, 0.0), where=norms > 0)
    return -dot


def _tile(best: _Best, at: int, ids: np.ndarray, q: np.ndarray, left: np.ndarray, keys: np.ndarray, x: np.ndarray, right: np.ndarray, m: V.Metric, others: bool) -> None:
    """Adds the pairs of some queries, which begin at a place of the block, and some rows."""
    near = left @ right.T
    # what rounding can make of a product
    slack = 1e-12 * (1 + np.abs(left).max(initial=0, where=np.isfinite(left))) * (1 + np.abs(right).max(initial=0, where=np.isfinite(right))) * left.shape[1]
    if others:
        own = np.flatnonzero(np.isin(keys, ids))
        if len(own):
            near[:, own] = np.where(ids[:, None] == keys[own], np.inf, near[:, own])
    bound = best.cost[at : at + len(ids), -1]
    bound = (bound**2 if m is V.Metric.EUCLIDEAN else bound) + slack
    if np.isnan(bound).any() and len(keys) > best.k:
        here = np.partition(near, best.k - 1, axis=1)[:, best.k - 1] + 2 * slack
        bound = np.fmin(bound, here)
    rows, places = np.nonzero(~(near > bound[:, None]))
    for i in range(0, len(rows), PAIRS):
        r, p = rows[i : i + PAIRS], places[i : i + PAIRS]
        cost = _costs(q[r], x[p], m)
        real = ~np.isnan(cost) & ~((ids[r] == keys[p]) & others)
        if real.any():
            best.add(at + r[real], cost[real], keys[p][real])


def graph(df: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Undirected edges (src, dst), each both ways, between rows and their k nearest others by Euclidean distance."""
    queries = df.select(F.col(key).cast("long").alias("query_id"), F.col(vec).alias("query"))
    kept = batch(df, queries, k, V.Metric.EUCLIDEAN, key, vec, others=True).select(F.col("query_id").alias("src"), F.col(key).alias("dst"))
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def greedy_walk(edges: dict[int, list[int]], points: dict[int, np.ndarray], entry: int, query: np.ndarray) -> list[int]:
    """The path from an entry to ever nearer neighbours until none is nearer."""
    path, at = [entry], entry
    far = lambda n: float(((points[n] - query) ** 2).sum())
    while True:
        near = min(edges.get(at, []), key=lambda n: (far(n), n), default=at)
        if far(near) >= far(at):
            return path
        path.append(near)
        at = near


def degree_stats(edges: DataFrame) -> DataFrame:
    """Nodes, links and degrees of an edge table held both ways."""
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    return degree.agg(F.count("*").alias("nodes"), F.sum("d").alias("links"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"))


def concentration(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """pairs, mean, population deviation and their ratio of the distances of all i < j.

    For a stated sample: it compares all pairs by its nature, block by block, and only sums leave a task.
    """
    got = df.select(F.col(key).cast("long"), vec).toPandas()
    ids, x = got[key].to_numpy(), np.array(got[vec].tolist(), float)
    norm = (x**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for b in batches:
            a = np.array(b.column(1).to_pylist(), float)
            if len(a):
                mine = b.column(0).to_numpy()
                for at in range(0, len(a), 256):
                    part = a[at : at + 256]
                    d = (part**2).sum(1)[:, None] + norm[None] - 2 * part @ x.T
                    d = np.sqrt(np.maximum(d, 0))[mine[at : at + 256, None] < ids[None]]
                    n, total, square = n + d.size, total + d.sum(), square + (d**2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([square])], ["n", "s", "q"])

    sums = df.select(F.col(key).cast("long"), vec).mapInArrow(run, "n long, s double, q double").agg(F.sum("n").alias("pairs"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("pairs")
    dev = F.sqrt(F.col("q") / F.col("pairs") - mean * mean)
    return sums.select("pairs", mean.alias("avg_distance"), dev.alias("std_distance"), (dev / mean).alias("ratio"))
