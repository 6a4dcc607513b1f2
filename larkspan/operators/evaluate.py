"""Recall, latency percentiles, comparisons with a baseline, and deterministic test vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.sources.folders import fresh


def recall(found: DataFrame, truth: DataFrame, k: int, by: str = "query_id", key: str = "vec_id", of_truth: bool = False) -> DataFrame:
    """query and share of its true k that were found; over k, or over min(k, truth) with 1 for no truth."""
    hits = truth.select(by, key).join(found.select(by, key).distinct().withColumn("hit", F.lit(1)), [by, key], "left")
    each = hits.groupBy(by).agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    out_of = F.least(F.lit(k), F.col("n")) if of_truth else F.lit(k)
    return each.select(by, (F.col("hits") / out_of).alias("recall"))


def recall_curve(found: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 5, 10, 100), by: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Mean recall at several k of ranked results: one join, the cuts being exploded."""
    f = found.select(by, key, F.col("rank").alias("f_rank"))
    both = truth.select(by, key, F.col("rank").alias("t_rank")).join(f, [by, key], "left")
    cut = both.withColumn("k", F.explode(F.array(*[F.lit(k) for k in at]))).filter("t_rank <= k")
    each = cut.groupBy("k", by).agg((F.count_if(F.col("f_rank") <= F.col("k")) / F.col("k")).alias("r"))
    return each.groupBy("k").agg(F.avg("r").alias("recall"))


def percentiles(df: DataFrame, value: str, tie: str) -> DataFrame:
    """p50, p95 and p99 as the values at places n/2, 0.95 n and 0.99 n (whole part) of the sorted rows, from 0.

    Values are counted, the counts written in ranges of values, and a place is looked up in the range that holds
    it: the driver sees one sum a range, and a task one range.
    """
    spark = df.sparkSession
    path = fresh(spark, "value-counts")
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).repartitionByRange("v")
    counts.withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    sums = ranges.groupBy("part").agg(F.sum("c").alias("c"), F.min("v").alias("low")).orderBy("low").collect()
    n = sum(r["c"] for r in sums)
    out = spark.range(1)
    for name, place in {"p50": n // 2, "p95": min(int(n * 0.95), n - 1), "p99": min(int(n * 0.99), n - 1)}.items():
        before, part = 0, -1
        for r in sums:
            if before + r["c"] > place >= 0:
                part = r["part"]
                break
            before += r["c"]
        one = ranges.filter(F.col("part") == part).select("v", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        out = out.crossJoin(F.broadcast(one.agg(F.min(F.when(F.col("upto") > place - before, F.col("v"))).alias(name))))  # one row each
    return out.drop("id")


def measure(run: Callable[[], object], times: int = 10, warm_up: int = 3) -> dict[str, float]:
    """Milliseconds of repeated runs."""
    for _ in range(warm_up):
        run()
    took = []
    for _ in range(times):
        at = time.perf_counter()
        run()
        took.append((time.perf_counter() - at) * 1000)
    took.sort()
    at = lambda p: took[min(int(len(took) * p), len(took) - 1)]
    return {"avg": sum(took) / len(took), "p50": took[len(took) // 2], "p95": at(0.95), "p99": at(0.99), "min": took[0], "max": took[-1], "qps": 1000 * len(took) / sum(took)}


def compare(base: Mapping[str, float], other: Mapping[str, float]) -> dict[str, float]:
    """Times as fast, and recall lost; with build seconds and bytes (``cost``) on both sides also how many times those."""
    out = {"speed_up": base["avg"] / other["avg"], "recall_loss": base.get("recall", 1.0) - other.get("recall", 1.0)}
    return out | {f"{k}_ratio": other[k] / base[k] for k in ("build_seconds", "bytes") if base.get(k) and k in other}


def cost(spark: SparkSession, build: Callable[[], object], path: str) -> dict[str, float]:
    """Seconds that a build takes which writes to a folder, and the folder's bytes."""
    at = time.perf_counter()
    build()
    took = time.perf_counter() - at
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return {"build_seconds": took, "bytes": float(root.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(root).getLength())}


def sweep(run: Callable[[int], DataFrame], values: list[int], truth: DataFrame, k: int, by: str = "query_id", key: str = "vec_id") -> list[dict[str, float]]:
    """For each value of a parameter (such as ef): value, recall at k and the milliseconds of one run for all queries."""
    out = []
    for v in values:
        at = time.perf_counter()
        found = run(v).select(by, key).collect()
        took = (time.perf_counter() - at) * 1000
        rows = truth.sparkSession.createDataFrame(found, truth.select(by, key).schema) if found else truth.select(by, key).limit(0)
        mean = recall(rows, truth, k, by, key, of_truth=True).agg(F.avg("recall").alias("r")).first()["r"]
        out.append({"value": v, "recall": mean, "ms": took})
    return out


def regressions(base: Mapping[str, float], now: Mapping[str, float], limit: float = 0.10) -> dict[str, float]:
    """What grew by more than the limit, as a share."""
    return {k: (now[k] - v) / v for k, v in base.items() if k in now and v > 0 and (now[k] - v) / v > limit}


def wave(seed: Column, i: Column) -> Column:
    return F.sin((seed * 31 + i * 17) * 0.001)


def generated(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """id and a vector with sin((31 id + 17 i) / 1000) at place i."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: wave(F.col("id"), i)).alias("vector"))


def products(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """id and a vector with sin(id i / 1000) at place i."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sin(F.col("id") * i * 0.001)).alias("vector"))


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 7) -> DataFrame:
    """id and a vector with values in [-1, 1) from hashes."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 29) - 1).alias("vector"))
