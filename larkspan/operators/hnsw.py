"""Hierarchical small-world graphs, one per shard, each kept as one packed row.

Shards are cut by a hash of the id, so a search asks every shard and keeps the best k of all.  A shard has a
bounded size (``rows_per_shard``), which is what a task holds.  A packed row has ids, vectors and links as flat
arrays: an index is written once (``save``) and a search maps over its rows without a shuffle.  Distances
are Euclidean; for cosine, index unit vectors.  Levels come from a hash of the id, so a rebuild gives the same graph.

``build`` links all rows of a shard at once: the candidates of a row are its exact nearest among the rows before it,
found by blocks of matrix products, which is what inserting one by one looks for.  ``insert`` adds rows to
a stored index one by one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.types import check_k

MAX_LEVEL = 16
BLOCK_QUERIES, BROADCAST_IDS = 10_000, 2_000_000
PACKED = "shard int, nodes int, ids binary, vectors binary, base binary, upper binary"
#: below this share of allowed rows a shard's allowed rows are scanned; a walk would mostly meet others
SCAN_BELOW = 0.1


def uniform(node: Column) -> Column:
    """A number in (0, 1) from an id."""
    return (F.pmod(F.pmod(node + 1, F.lit(1 << 31)) * 2654435761, F.lit(1 << 32)).cast("double") + 0.5) / float(1 << 32)


def level(node: Column, m: int = 16) -> Column:
    return F.least(F.lit(MAX_LEVEL), F.floor(-F.ln(uniform(node)) / math.log(m))).cast("int")


def _level(node: int, m: int) -> int:
    u = (((node + 1) % (1 << 31)) * 2654435761 % (1 << 32) + 0.5) / (1 << 32)
    return min(MAX_LEVEL, int(-math.log(u) / math.log(m)))


class Graph:
    """One shard's graph over its own row numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = 16, ef_construction: int = 100):
        self.ids, self.x, self.m, self.ef = ids, vectors, m, ef_construction
        self.levels = [_level(int(i), m) for i in ids]
        self.links: list[list[list[int]]] = []
        self.entry, self.visited, self.computed = -1, 0, 0

    def distances(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        self.computed += len(nodes)
        d = self.x[nodes] - q
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def layer(self, q: np.ndarray, entries: list[int], at: int, ef: int, allowed=None) -> list[tuple[float, int]]:
        """The ef nearest found from the entries on one layer, ascending; best-first, ending when the nearest open node is farther than all of a full result.

        With a mask, the walk goes through all nodes and only allowed ones are results.
        """
        seen = set(entries)
        first = list(zip(self.distances(q, entries).tolist(), entries, strict=True))
        open_, best = list(first), [(-d, n) for d, n in first if allowed is None or allowed[n]]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, n = heapq.heappop(open_)
            if len(best) >= ef and d > -best[0][0]:
                break
            self.visited += 1
            fresh = [x for x in self.links[n][at] if x not in seen] if at < len(self.links[n]) else []
            if not fresh:
                continue
            seen.update(fresh)
            for e, x in zip(self.distances(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(open_, (e, x))
                    if allowed is None or allowed[x]:
                        heapq.heappush(best, (-e, x))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def select(self, candidates: list[tuple[float, int]], m: int) -> list[int]:
        """Diverse neighbours: a candidate counts if it is no nearer to a chosen one than to the query; the nearest others fill up to m."""
        chosen: list[int] = []
        for d, n in candidates:
            if len(chosen) == m:
                break
            if not chosen or (self.distances(self.x[n], chosen) >= d).all():
                chosen.append(n)
        for _, n in candidates:
            if len(chosen) >= m:
                break
            if n not in chosen:
                chosen.append(n)
        return chosen

    def nearest(self, candidates: list[tuple[float, int]], m: int) -> list[int]:
        return [n for _, n in sorted(candidates)[:m]]

    def angular(self, q: np.ndarray, candidates: list[tuple[float, int]], m: int, most: float = 0.9) -> list[int]:
        """As ``select``, but a candidate is left out if it lies in the direction of a chosen one."""
        chosen: list[int] = []
        for _, n in candidates:
            v = self.x[n] - q
            lengths = np.linalg.norm(self.x[chosen] - q, axis=1) * np.linalg.norm(v) if chosen else np.ones(0)
            cos = np.divide((self.x[chosen] - q) @ v, lengths, out=np.zeros(len(chosen)), where=lengths > 0) if chosen else lengths[:0]
            if len(chosen) < m and not (cos > most).any():
                chosen.append(n)
        return (chosen + [n for _, n in candidates if n not in chosen])[:m]

    def descend(self, q: np.ndarray, top: int, to: int) -> int:
        """Hill climbing from the entry point through the layers above ``to``."""
        at = self.entry
        d = float(self.distances(q, [at])[0])
        for lay in range(top, to, -1):
            while lay < len(self.links[at]) and self.links[at][lay]:
                near = self.distances(q, self.links[at][lay])
                i = int(near.argmin())
                if near[i] >= d:
                    break
                at, d = self.links[at][lay][i], float(near[i])
        return at

    def build(self) -> Graph:
        """All links at once, layer by layer."""
        levels = np.array(self.levels, int)
        self.links = [[[] for _ in range(x + 1)] for x in self.levels]
        self.entry = int(levels.argmax()) if len(levels) else -1
        for lay in range(levels.max(initial=-1) + 1):
            nodes = np.flatnonzero(levels >= lay)
            for n, links in zip(nodes.tolist(), self._layer_links(nodes, 2 * self.m if lay == 0 else self.m), strict=True):
                self.links[n][lay] = links
        return self

    def _layer_links(self, nodes: np.ndarray, most: int, block: int = 512) -> list[list[int]]:
        """Links of one layer: each node's diverse choice among its nearest before it, and back, at most ``most`` each."""
        x = self.x[nodes]
        norm = (x**2).sum(1)
        links: list[list[int]] = [[] for _ in nodes]
        for at in range(0, len(nodes), block):
            end = min(at + block, len(nodes))
            d = norm[at:end, None] + norm[None, :end] - 2 * x[at:end] @ x[:end].T
            d[np.arange(end)[None] >= np.arange(at, end)[:, None]] = np.inf
            k = min(self.ef, end)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            d = np.take_along_axis(d, near, 1)
            by = np.argsort(d, axis=1, kind="stable")
            chosen = self._diverse(x, np.take_along_axis(near, by, 1), np.take_along_axis(d, by, 1), self.m)
            for i, row in enumerate(chosen):
                links[at + i] = row
        back: list[list[int]] = [[] for _ in nodes]
        for n, row in enumerate(links):
            for o in row:
                back[o].append(n)
        links = [a + b for a, b in zip(links, back, strict=True)]
        full = [n for n, row in enumerate(links) if len(row) > most]
        for at in range(0, len(full), block):
            some = full[at : at + block]
            width = max(len(links[n]) for n in some)
            near = np.array([links[n] + [-1] * (width - len(links[n])) for n in some])
            d = np.where(near < 0, np.inf, ((x[near] - x[some][:, None]) ** 2).sum(2))
            by = np.argsort(d, axis=1, kind="stable")
            for n, row in zip(some, self._diverse(x, np.take_along_axis(near, by, 1), np.take_along_axis(d, by, 1), most), strict=True):
                links[n] = row
        return [nodes[row].tolist() if row else [] for row in links]

    @staticmethod
    def _diverse(x: np.ndarray, near: np.ndarray, d: np.ndarray, m: int, share: int = 64) -> list[list[int]]:
        """``select`` for many rows: near are candidates by ascending squared distance d, infinite where there is none."""
        out: list[list[int]] = []
        for at in range(0, len(near), share):
            n, e = near[at : at + share], d[at : at + share]
            v = x[n]
            norm = (v**2).sum(2)
            between = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
            real, chosen = np.isfinite(e), np.zeros(n.shape, bool)
            for c in range(n.shape[1]):
                apart = ~(chosen & (between[:, c] < e[:, c : c + 1])).any(1)
                chosen[:, c] = real[:, c] & apart & (chosen.sum(1) < m)
            # the nearest others fill up
            room = m - chosen.sum(1)
            others = real & ~chosen
            chosen |= others & (np.cumsum(others, 1) <= room[:, None])
            out += [row[keep].tolist() for row, keep in zip(n, chosen, strict=True)]
        return out

    def insert(self, n: int) -> None:
        top = self.levels[n]
        self.links.append([[] for _ in range(top + 1)])
        if self.entry < 0:
            self.entry = n
            return
        q, highest = self.x[n], self.levels[self.entry]
        entries = [self.descend(q, highest, top)]
        for lay in range(min(top, highest), -1, -1):
            found = self.layer(q, entries, lay, self.ef)
            mine = self.select(found, self.m)
            self.links[n][lay] = mine
            most = 2 * self.m if lay == 0 else self.m
            for other in mine:
                theirs = self.links[other][lay]
                theirs.append(n)
                if len(theirs) > most:
                    d = self.distances(self.x[other], theirs)
                    self.links[other][lay] = self.select(sorted(zip(d.tolist(), theirs, strict=True)), most)
            entries = [x for _, x in found]
        if top > highest:
            self.entry = n

    def search(self, q: np.ndarray, k: int, ef: int, allowed=None) -> list[tuple[float, int]]:
        """(distance, row) ascending, of allowed rows only.  Few allowed rows are scanned; otherwise more of the graph is walked the fewer are allowed."""
        if self.entry < 0:
            return []
        ef = max(ef, k)
        if allowed is not None:
            rows = np.flatnonzero(allowed)
            if len(rows) < max(SCAN_BELOW * len(allowed), 4 * ef):
                d = self.distances(q, rows)
                by = np.lexsort((self.ids[rows], d))[:k]
                return list(zip(d[by].tolist(), rows[by].tolist(), strict=True))
        start = self.descend(q, self.levels[self.entry], 0)
        return self.layer(q, [start], 0, ef, allowed)[:k]

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """ids, vectors, links of the lowest layer in rows of 2 m, and (node, layer, links) of the others in rows of 2 + m; -1 is no link."""
        row = lambda links, n: [*links, *[-1] * (n - len(links))]
        base = np.array([row(x[0], 2 * self.m) for x in self.links], np.int32)
        upper = np.array([[n, lay, *row(x[lay], self.m)] for n, x in enumerate(self.links) for lay in range(1, len(x))], np.int32)
        return self.ids.astype("<i8").tobytes(), self.x.astype("<f8").tobytes(), base.tobytes(), upper.tobytes()

    @classmethod
    def load(cls, ids: bytes, vectors: bytes, base: bytes, upper: bytes, m: int, ef_construction: int = 100) -> Graph:
        i = np.frombuffer(ids, "<i8")
        g = cls(i, np.frombuffer(vectors, "<f8").reshape(len(i), -1) if len(i) else np.zeros((0, 0)), m, ef_construction)
        g.links = [[[x for x in row if x >= 0]] for row in np.frombuffer(base, np.int32).reshape(len(i), 2 * m).tolist()]
        for n, _, *row in np.frombuffer(upper, np.int32).reshape(-1, 2 + m).tolist():
            g.links[n].append([x for x in row if x >= 0])
        g.entry = int(np.argmax(g.levels)) if len(i) else -1
        return g


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _pack(shard: int, g: Graph) -> pd.DataFrame:
    return pd.DataFrame([(shard, len(g.ids), *g.packed())], columns=[c.split(" ")[0] for c in PACKED.split(", ")])


def build(df: DataFrame, key: str = "vec_id", vec: str = "embedding", m: int = 16, ef_construction: int = 100, rows_per_shard: int = 50_000) -> DataFrame:
    """The index: a packed row per shard.  ``save`` keeps it."""
    shards = max(1, -(-df.count() // rows_per_shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", ignore_index=True)
        g = Graph(pdf["node_id"].to_numpy(), np.array(pdf["vector"].tolist(), float), m, ef_construction).build()
        return _pack(pdf["shard"][0], g)

    rows = df.select(shard_of(F.col(key).cast("long"), shards).alias("shard"), F.col(key).cast("long").alias("node_id"), F.col(vec).cast("array<double>").alias("vector"))
    return rows.filter("node_id IS NOT NULL AND vector IS NOT NULL").groupBy("shard").applyInPandas(run, PACKED)


def save(index: DataFrame, path: str) -> DataFrame:
    """The index written to a folder, and read from there."""
    index.write.mode("overwrite").parquet(path)
    return load(index.sparkSession, path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def insert(index: DataFrame, rows: DataFrame, key: str = "vec_id", vec: str = "embedding", m: int = 16, ef_construction: int = 100) -> DataFrame:
    """The index with more rows, each added to its shard's graph; an id that the index has is not added again.

    Only shards that get rows are unpacked.
    """
    shards = index.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    fresh = rows.select(shard_of(F.col(key).cast("long"), shards).alias("shard"), F.col(key).cast("long").alias("node_id"), F.col(vec).cast("array<double>").alias("vector"))

    def run(group: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return old
        o = old.iloc[0] if len(old) else None
        g = Graph.load(o["ids"], o["vectors"], o["base"], o["upper"], m, ef_construction) if o is not None else Graph(np.zeros(0, np.int64), np.zeros((0, len(new["vector"][0]))), m, ef_construction)
        new = new[~new["node_id"].isin(g.ids)].drop_duplicates("node_id").sort_values("node_id")
        if len(new):
            at = len(g.ids)
            more = np.array(new["vector"].tolist(), float)
            g.ids, g.x = np.concatenate([g.ids, new["node_id"].to_numpy()]), np.concatenate([g.x, more]) if at else more
            g.levels += [_level(int(i), m) for i in new["node_id"]]
            for n in range(at, len(g.ids)):
                g.insert(n)
        return _pack(group[0], g)

    return index.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInPandas(run, PACKED)


def _block(marked: DataFrame, qids: list[int], q: np.ndarray, k: int, ef: int, m: int, masked: bool) -> DataFrame:
    """What each shard finds for the queries of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g = Graph.load(*(batch.column(c)[row].as_py() for c in ("ids", "vectors", "base", "upper")), m)
                mask = np.isin(g.ids, np.array(batch.column("ok")[row].as_py() or [], np.int64)) if masked else None
                out = []
                for i, v in zip(qids, q, strict=True):
                    g.visited = g.computed = 0
                    out += [(i, int(g.ids[n]), d, g.visited, g.computed, g.levels[g.entry] + 1) for d, n in g.search(v, k, ef, mask)]
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "node_id", "distance", "visited", "computed", "layers"])

    return marked.mapInArrow(run, "query_id long, node_id long, distance double, visited long, computed long, layers long")


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 100, m: int = 16, allowed: DataFrame | None = None, with_stats: bool = False) -> DataFrame:
    """query_id, rank, node_id and distance; queries are (query_id, query).

    Up to ``BLOCK_QUERIES`` queries are sent to every task; more go in blocks of about that many, each a pass over the index.  Each shard
    answers all queries; the k best of all shards are ranked, ties to the smaller id.  Allowed ids meet the index as one list a shard.
    """
    check_k(k)
    rows = queries.count()
    blocks = max(1, -(-rows // BLOCK_QUERIES))
    marked = index
    if allowed is not None:
        shards = index.agg(F.max("shard")).first()[0]
        ids = allowed.select(F.col(allowed.columns[0]).cast("long").alias("id")).distinct()
        lists = ids.groupBy(shard_of(F.col("id"), (shards or 0) + 1).alias("shard")).agg(F.collect_list("id").alias("ok"))  # rows_per_shard at most
        small = ids.count() <= BROADCAST_IDS
        marked = index.join(F.broadcast(lists) if small else lists, "shard", "left")
    parts = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.toPandas()
        parts.append(_block(marked, got["query_id"].tolist(), np.array(got["query"].tolist(), float), k, ef, m, allowed is not None))
    each = reduce(DataFrame.unionByName, parts)
    if with_stats:
        return each.groupBy("query_id").agg(F.count("*").alias("results"), F.max("visited").alias("visited"), F.max("computed").alias("distances"), F.max("layers").alias("layers"))
    w = Window.partitionBy("query_id").orderBy("distance", "node_id")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "node_id", "distance")


def nodes(index: DataFrame, m: int = 16) -> DataFrame:
    """A row per node and layer: shard, node_id, layer and the ids of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g = Graph.load(*(batch.column(c)[row].as_py() for c in ("ids", "vectors", "base", "upper")), m)
                out = [(int(g.ids[n]), lay, g.ids[x].tolist()) for n, layers in enumerate(g.links) for lay, x in enumerate(layers)]
                ids, lays, links = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[row].as_py()] * len(out), pa.int32()), pa.array(ids, pa.int64()), pa.array(lays, pa.int32()), pa.array(links, pa.list_(pa.int64()))], ["shard", "node_id", "layer", "links"])

    return index.mapInArrow(run, "shard int, node_id long, layer int, links array<long>")


def layer_stats(index: DataFrame) -> DataFrame:
    """Nodes, links and degrees of each layer."""
    each = nodes(index).select("layer", F.size("links").alias("d"))
    return each.groupBy("layer").agg(F.count("*").alias("nodes"), F.sum("d").alias("links"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"))


def strategy_for(rows: int) -> tuple[str, int | None]:
    """Brute force below 50 000 rows; a graph with ef 50 below 200 000, else with ef 100."""
    return ("brute", None) if rows < 50_000 else ("hnsw", 50) if rows < 200_000 else ("hnsw", 100)
