"""Consistent-hash ring with virtual nodes and bounded loads.

Shards own virtual nodes on a ring of ``CELLS`` cells; a row's cell is the head of its key's hash, and its
owner the shard of the first virtual node clockwise from there.  A shard takes no more rows than its
capacity; rows that reach a full shard go on clockwise to the next virtual node whose shard has room.
Capacities add up to the number of rows and differ by one at most, so counts do too; what a new shard
changes is its own share and the overflow near it (``moved_share`` measures it).

The driver plans with one count per cell, so what it holds is bounded by CELLS and the shards, not by the
input.  The rows of a cell are ordered by hash and key, and the plan deals them out by their place.

Defined results: a null text has size 1 and the checksum of no bytes; null and repeated keys are placed by
the hash of key, size and checksum together; rows equal in all three are interchangeable, are counted
before any shuffle and dealt out one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm._common import table, written

CELL_BITS, RUN = 16, 4096
CELLS = 1 << CELL_BITS
PLAN_SCHEMA = "cell int, first long, until long, shard int, slot_base long"


def virtual_nodes(shards: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the virtual nodes in ring order, and the shard of each."""
    at = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()), s) for s in range(shards) for v in range(each)]
    at.sort()
    return np.array([p >> (64 - CELL_BITS) for p, _ in at]), np.array([s for _, s in at])


def plan(counts: np.ndarray, shards: int, each: int = 128) -> list[tuple[int, int, int, int, int]]:
    """(cell, first row, row after the last, shard, slot of the first row) for counts per cell, in ring order."""
    nodes, owner = virtual_nodes(shards, each)
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    # the next virtual node clockwise whose shard may have room; full ones are skipped once and for all
    after = list(range(len(owner)))

    def open_node(n: int) -> int:
        path = []
        while used[owner[n]] >= room[owner[n]]:
            path.append(n)
            step = after[n] if after[n] != n else (n + 1) % len(owner)
            n = step
        for p in path:
            after[p] = n
        return n

    out = []
    starts = np.searchsorted(nodes, np.arange(CELLS)) % len(owner)
    for cell in np.flatnonzero(counts).tolist():
        done, left, n = 0, int(counts[cell]), int(starts[cell])
        while left:
            n = open_node(n)
            s = int(owner[n])
            take = min(left, room[s] - used[s])
            out.append((cell, done, done + take, s, used[s]))
            used[s] += take
            done += take
            left -= take
    return out


def moved_share(counts: np.ndarray, shards: int, each: int = 128) -> float:
    """Share of rows that change their shard when one more is added."""
    a, b = ({(c, i): s for c, f, u, s, _ in plan(counts, k, each) for i in range(f, u)} for k in (shards, shards + 1))
    return sum(a[k] != b[k] for k in a) / max(1, len(a))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, checksum and ring position of each distinct triple, with the number of its rows."""
    rows = docs.select(
        docs[key].alias("key"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(docs[text]), F.lit(0)).cast("long").alias("crc"),
    )
    return rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n")).withColumn("ring", F.xxhash64("key", "size", "crc"))


def ring_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", each: int = 128) -> DataFrame:
    """key, size, crc, shard and slot (gapless from 0 in its shard) of every row."""
    spark = docs.sparkSession
    rows = written(keyed(docs, key, text), "ring").withColumn("cell", F.shiftrightunsigned("ring", 64 - CELL_BITS).cast("int"))
    counts = np.zeros(CELLS, np.int64)
    for cell, n in rows.groupBy("cell").agg(F.sum("n")).collect():  # CELLS rows at most
        counts[cell] = n
    parts = plan(counts, shards, each)
    dealt = spark.createDataFrame(parts, PLAN_SCHEMA) if parts else spark.createDataFrame([], PLAN_SCHEMA)
    before = Window.partitionBy("cell").orderBy("ring", "key", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # very many equal rows are first cut into runs, which go to many tasks
    run = lambda first, until, step: F.explode(F.sequence(first, until - 1, F.lit(step).cast("long")))
    some, many = placed.filter(F.col("n") <= RUN), placed.filter(F.col("n") > RUN)
    many = many.withColumn("from", run(F.col("place"), F.col("place") + F.col("n"), RUN)).withColumn("until", F.least(F.col("from") + RUN, F.col("place") + F.col("n")))
    many = many.select("key", "size", "crc", "cell", F.col("from").alias("place"), (F.col("until") - F.col("from")).alias("n")).repartition("cell", "place")
    runs = some.select("key", "size", "crc", "cell", "place", "n").unionByName(many)
    single = runs.select("key", "size", "crc", "cell", run(F.col("place"), F.col("place") + F.col("n"), 1).alias("place"))
    # the plan has CELLS + shards * each rows at most, about 3 MB
    found = single.join(F.broadcast(dealt), (single.cell == dealt.cell) & (single.place >= dealt["first"]) & (single.place < dealt.until))
    return found.select(F.col("key").alias(key), "size", "crc", "shard", (F.col("slot_base") + F.col("place") - F.col("first")).alias("slot"))


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ring_shards(table(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
