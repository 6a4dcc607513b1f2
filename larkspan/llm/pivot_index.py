"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it and the table is sorted by that key, so a
block of neighbouring rows is an annulus around one pivot.  A block knows its pivot, inner and outer radius
and largest norm.  For a query q, a vector x at distance r from pivot p is at least |d(q, p) - r| away, so

    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 <= (|q|^2 + max |x|^2 - gap^2) / 2

bounds every score in a block, gap being how far d(q, p) lies outside the block's radii.  A query's blocks are
sorted by their bounds and read in growing steps: the first ``FIRST``, then four times as many each time; its k-th score so far
stops it at the first block whose bound is lower.  A bound that only ties is read, as ties go to the smaller id.

Queries and vectors are packed into rows of many, and a pair of packs is one matrix product; the table of
blocks is broadcast and has ``MAX_BLOCKS`` rows at most.  Pivots are fitted on the ``SAMPLE`` rows with the
smallest hash of their id; they affect speed alone.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a null
id; scores are exact whatever the size of components, and those beyond a long count as its greatest or least value;
vectors of different length are compared as if the shorter ended in zeros; equal vectors and repeated rows
are separate candidates; a query's own id never is one; with fewer than k candidates all are given; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm._common import place, table, unnamed, written

SAMPLE, PIVOTS, BLOCK, MAX_BLOCKS, CHUNK, FIRST = 4096, 64, 2048, 1 << 16, 1024, 2
_EXACT, _MOST = float(1 << 53), np.finfo(np.float64).max.item()


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Far apart rows of the sample, moved to the mean of what is nearest to them a few times."""
    if not len(sample):
        return np.zeros((1, 1))
    with np.errstate(over="ignore"):
        at, far = [0], ((sample - sample[0]) ** 2).sum(1)
        while len(at) < min(pivots, len(sample)) and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    centres = sample[at]
    for _ in range(4):
        near = distances(sample, centres).argmin(1)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = sample[near == i].mean(0)
    return centres


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, the shorter vectors as if ending in zeros."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n] @ b[:, :n].T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * products(a, b), 0))


def integer_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, exact; those beyond a long are cut to it."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = products(queries, vectors)
        most = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((vectors**2).sum(1))[None]
        large = ~(most < _EXACT)
        out = np.where(large, 0, scores).astype(np.int64)
    n = min(queries.shape[1], vectors.shape[1])
    for i in np.flatnonzero(large.any(1)):
        at = np.flatnonzero(large[i])
        if most[i, at].max() < 2.0**62 and np.abs(queries[i]).max() < 2.0**62 and np.abs(vectors[at]).max() < 2.0**62:
            out[i, at] = vectors[at, :n].astype(np.int64) @ queries[i, :n].astype(np.int64)
        else:
            q = [int(x) for x in queries[i, :n]]
            exact = [sum(x * int(y) for x, y in zip(q, v[:n], strict=True) if x) for v in vectors[at]]
            out[i, at] = [min(max(x, -(1 << 63) + 1), (1 << 63) - 1) for x in exact]
    return out


def top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, id, score) of the k best for each query; ids ascending, ties to the smaller one."""
    scores = integer_scores(queries, vectors)
    low = np.iinfo(np.int64).min
    scores[query_ids[:, None] == ids[None]] = low
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > low))
    else:
        row, col = np.nonzero(scores > low)
    score = scores[row, col]
    by = np.lexsort((col, -score, row))
    row, col, score = row[by], col[by], score[by]
    starts = np.searchsorted(row, np.arange(len(queries)))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], ids[col[keep]], score[keep]


def scaled(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id and the vector's components times scale, floored."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, finite)
    plain, names = unnamed(vectors)
    rows = plain.select(plain[f"_{place(names, key)}"].cast("long").alias("id"), plain[f"_{place(names, vector)}"].cast("array<double>").alias("v")).filter(good)
    # from 2 ** 52 on doubles are integers, and floor() ends at the longs
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(_MOST)), F.lit(-_MOST)))
    return rows.select("id", F.transform("v", lambda x: whole(x * scale)).alias("v"))


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, matrix) of neighbouring rows of one length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    at = 0
    for i, j in zip(edges, edges[1:], strict=False):
        if i < j:
            n = (j - i) * int(sizes[i])
            yield i, j, flat[at : at + n].reshape(j - i, int(sizes[i]))
            at += n


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """Rows sorted by pivot, length and distance, packed by at most ``size`` of one pivot and length; in a pack, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal n
            ids, dist, vecs = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            by = np.argsort(ids, kind="stable")
            with np.errstate(over="ignore"):
                norm2 = (vecs**2).sum(1).max()
            b = pa.RecordBatch.from_arrays(
                [pa.array([part + n], pa.int64()), pa.array([held[0][0]], pa.int32()), pa.array([vecs.shape[1]], pa.int32()), pa.array([dist.min()]), pa.array([dist.max()]), pa.array([norm2]), pa.array([ids[by].tobytes()], pa.binary()), pa.array([vecs[by].tobytes()], pa.binary())],
                ["pack", "pivot", "dim", "inner", "outer", "norm2", "ids", "vectors"],
            )
            n += 1
            held.clear()
            return b

        for batch in batches:
            pivots, dists = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            every = batch.column(0).to_numpy()
            for i, j, vecs in _runs(batch.column(3)):
                pivot, dist, ids, at = pivots[i:j], dists[i:j], every[i:j], 0
                while at < len(ids):
                    if held and (held[0][0] != pivot[at] or held[0][3].shape[1] != vecs.shape[1] or sum(len(h[1]) for h in held) >= size):
                        yield out()
                    room = size - sum(len(h[1]) for h in held)
                    to = min(len(ids), at + room, at + int(np.argmax(np.append(pivot[at:] != pivot[at], True))))
                    held.append((int(pivot[at]), ids[at:to], dist[at:to], vecs[at:to]))
                    at = to
        if held:
            yield out()

    by = ["pivot", F.size("v"), "dist", "id"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.mapInArrow(run, "pack long, pivot int, dim int, inner double, outer double, norm2 double, ids binary, vectors binary"), "packs")


def search(vectors: DataFrame, query_condition: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row that satisfies the condition on ``id``."""
    spark = vectors.sparkSession
    rows = written(scaled(vectors, key, vector, scale), "scaled")
    size = max(BLOCK, -(-rows.count() // MAX_BLOCKS))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"].tolist()
    # pivots have the length that most of the sample has, so that one long vector costs nothing
    lengths = np.bincount([len(x) for x in sample]) if sample else np.array([0])
    usual = [x for x in sample if len(x) == lengths.argmax()]
    centres = fit_pivots(np.array(usual, float).reshape(len(usual), int(lengths.argmax())))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, vecs in _runs(batch.column(1)):
                d = distances(vecs, centres)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(near, pa.int32()), pa.array(d[np.arange(j - i), near]), batch.column(1).slice(i, j - i)], ["id", "pivot", "dist", "v"])

    keyed = written(rows.mapInArrow(assign, "id long, pivot int, dist double, v array<double>"), "keyed")
    blocks = _packs(keyed, size)
    chunks = _packs(keyed.filter(query_condition), CHUNK)
    # MAX_BLOCKS blocks and one more for each pivot, length and range at most, 44 bytes each
    known = blocks.select("pack", "pivot", "inner", "outer", "norm2").toPandas()
    block, pivot, inner, outer, norm2 = (known[c].to_numpy() for c in known.columns)

    def bounds(queries: np.ndarray) -> np.ndarray:
        """Bounds of all blocks for each query; where doubles can't tell, infinite, so that the block is read."""
        with np.errstate(over="ignore", invalid="ignore"):
            d, q2 = distances(queries, centres)[:, pivot], (queries**2).sum(1)[:, None]
            # rounding in a distance grows with the vectors it is between
            blur = 1e-6 * (1 + d + np.sqrt(q2) + np.sqrt(norm2)[None])
            gap = np.maximum(np.maximum(inner[None] - d, d - outer[None]) - blur, 0)
            u = (q2 + norm2[None] - gap**2) / 2 + 1e-3 + 1e-9 * (q2 + norm2[None])
        return np.where(np.isfinite(u), u, np.inf)

    def units(begin: int, end: int):
        """(chunk, block, queries that read it): the blocks from place begin to end of a query that its k-th score so far leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    dim = batch.column(2)[row].as_py()
                    queries = np.frombuffer(batch.column(1)[row].as_py()).reshape(-1, dim) if dim else np.zeros((batch.column(3)[row].as_py(), 0))
                    u = bounds(queries)
                    least = np.full(len(queries), -np.inf)
                    for s in batch.column(4)[row].as_py() or ():
                        least[s["at"]] = s["kth"]
                    next_ = np.zeros(u.shape, bool)
                    np.put_along_axis(next_, np.argsort(-u, axis=1, kind="stable")[:, begin:end], True, axis=1)
                    want = next_ & (u >= least[:, None])
                    for b in np.flatnonzero(want.any(0)):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([block[b]], pa.int64()), pa.array([np.flatnonzero(want[:, b]).tolist()], pa.list_(pa.int32()))], ["chunk", "pack", "at"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, at, q_dim, q_ids, q, dim, ids, v = (batch.column(i)[row].as_py() for i in range(8))
                at, q_ids, ids = np.array(at, np.int64), np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, v = np.frombuffer(q).reshape(len(q_ids), q_dim), np.frombuffer(v).reshape(len(ids), dim)
                i, found, scores = top(q[at], q_ids[at], v, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(i), pa.int64()), pa.array(at[i], pa.int32()), pa.array(q_ids[at][i]), pa.array(found), pa.array(scores)], ["chunk", "at", "query_id", "vec_id", "score"])

    def scored(work: DataFrame) -> DataFrame:
        packs = chunks.select(F.col("pack").alias("chunk"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
        # spread first, so that a chunk's or a block's units are computed by many tasks
        joined = work.join(packs, "chunk").join(blocks.select("pack", "dim", "ids", "vectors"), "pack")
        return joined.select("chunk", "at", "q_dim", "q_ids", "q", "dim", "ids", "vectors").mapInArrow(score, "chunk long, at int, query_id long, vec_id long, score long")

    by_rank = Window.partitionBy("chunk", "at").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    source = chunks.select(F.col("pack").alias("chunk"), "vectors", "dim", F.expr("cast(length(ids) / 8 as int)").alias("n"))
    found = spark.createDataFrame([], "chunk long, at int, query_id long, vec_id long, score long, rank int")
    begin, end = 0, FIRST
    while begin < len(block):
        kth = found.groupBy("chunk", "at").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
        kth = kth.groupBy("chunk").agg(F.collect_list(F.struct("at", "kth")).alias("kth"))  # CHUNK entries at most
        work = written(source.join(kth, "chunk", "left").mapInArrow(units(begin, end), "chunk long, pack long, at array<int>"), "units")
        if work.isEmpty():
            break
        found = written(best(found.drop("rank").unionByName(scored(work))), "found")
        begin, end = end, end + 4 * (end - begin)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "id % 50 = 0")
