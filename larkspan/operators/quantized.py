"""Search over scalar-quantized vectors with exact re-ranking, and what quantization costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import vectors as V
from larkspan.types import check_k


def encode(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """key, the vector in double precision and its codes with their bounds."""
    v = V.vector(F.col(vec))
    return df.select(key, v.alias("v"), V.quantize(v).alias("q"))


def by_codes(encoded: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    check_k(k)
    q = V.quantize(V.vector(query))
    return encoded.select(key, V.code_distance(F.col("q"), q).alias("distance")).orderBy("distance", key).limit(k)


def reranked(encoded: DataFrame, query: list[float], k: int, oversample: int = 4, key: str = "vec_id") -> DataFrame:
    """The k nearest by exact cosine distance of k * oversample candidates by codes; the candidates keep their vectors, so nothing is joined."""
    check_k(k)
    q = V.quantize(V.vector(query))
    some = encoded.select(key, "v", V.code_distance(F.col("q"), q).alias("d")).orderBy("d", key).limit(k * oversample)
    return some.select(key, V.cosine_distance(F.col("v"), V.vector(query)).alias("distance")).orderBy("distance", key).limit(k)


def stats(encoded: DataFrame) -> DataFrame:
    """Vectors, bytes before and after, their ratio, mean and greatest absolute error of an element."""
    size = F.size("v")
    errors = F.zip_with("v", V.dequantize(F.col("q")), lambda a, b: F.abs(a - b))
    row = encoded.select(size.alias("n"), F.aggregate(errors, F.lit(0.0), lambda acc, x: acc + x).alias("e"), F.array_max(errors).alias("m"))
    got = row.agg(F.count("*").alias("vectors"), F.sum(F.col("n") * 4).alias("bytes_before"), F.sum(F.col("n") + 16).alias("bytes_after"), F.sum("e").alias("e"), F.sum("n").alias("n"), F.max("m").alias("max_error"))
    return got.select("vectors", "bytes_before", "bytes_after", (F.col("bytes_before") / F.col("bytes_after")).alias("ratio"), (F.col("e") / F.col("n")).alias("avg_error"), "max_error")
