"""Distance and similarity of array columns, in double arithmetic and without Python in the plan.

Sums run in element order.  A pair of different length is an error (``DimensionMismatch`` where both are
literals, a failed assertion in the plan otherwise); a vector of norm zero has similarity 0 to anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.types import InvalidParameter


class Metric(Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"

    @classmethod
    def of(cls, name: str | Metric | None) -> Metric:
        """By its lower-case name; cosine if none is given."""
        if isinstance(name, Metric):
            return name
        try:
            return cls(name or "cosine")
        except ValueError:
            raise InvalidParameter(f"unknown metric {name!r}") from None


def vector(values: Column | Sequence[float]) -> Column:
    """A column as doubles, or a literal vector."""
    if isinstance(values, Column):
        return values.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _pairs(a: Column, b: Column, f) -> Column:
    checked = F.when(F.size(a) == F.size(b), b).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("array<double>"))
    return F.zip_with(a, checked, f)


def dimension(v: Column) -> Column:
    return F.size(v)


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    norms = magnitude(a) * magnitude(b)
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosine_normalized(a: Column, b: Column) -> Column:
    """For vectors of norm one."""
    return dot(a, b)


def euclidean_sq(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_sq(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    if p < 1:
        raise InvalidParameter("p must be at least 1")
    return F.pow(_sum(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def weighted_euclidean(a: Column, b: Column, weights: Column) -> Column:
    return F.sqrt(_sum(_pairs(_pairs(a, b, lambda x, y: (x - y) * (x - y)), weights, lambda d, w: d * w)))


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    norm = magnitude(v)
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def is_normalized(v: Column, epsilon: float = 1e-6) -> Column:
    return F.abs(magnitude(v) - 1) < epsilon


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the similarity, which is kept within [-1, 1]; 1 for a zero vector."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def distance_to_score(d: Column) -> Column:
    """1 for distance 0, 0 for distance 2 and more."""
    return 1 - F.least(F.greatest(d, F.lit(0.0)), F.lit(2.0)) / 2


def score(metric: Metric, a: Column, b: Column) -> Column:
    """The metric's own number: higher is better but for Euclidean."""
    return {Metric.COSINE: cosine, Metric.EUCLIDEAN: euclidean, Metric.DOT: dot}[metric](a, b)


#: fixed values: lower bounds of the bands, best first
BANDS = ((0.95, "Duplicate"), (0.85, "Very similar"), (0.70, "Similar"), (0.50, "Somewhat related"), (0.20, "Different"))


def band(similarity: Column) -> Column:
    out = None
    for low, name in BANDS:
        out = F.when(similarity >= low, name) if out is None else out.when(similarity >= low, name)
    return out.otherwise("Unrelated")


def angle_from(a: Column, b: Column, q: Column) -> Column:
    """Cosine of the directions from q to a and to b."""
    return cosine(_pairs(a, q, lambda x, y: x - y), _pairs(b, q, lambda x, y: x - y))


# -- scalar quantization ---------------------------------------------------------------------------


def quantize(v: Column) -> Column:
    """struct(codes, vmin, vmax): codes 0 to 255 between the vector's own bounds, half away from zero; a constant vector has codes 0."""
    low, high = F.array_min(v), F.array_max(v)
    code = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((x - low) * 255 / (high - low)))).cast("smallint")
    codes = F.when(high == low, F.transform(v, lambda x: F.lit(0).cast("smallint"))).otherwise(F.transform(v, code))
    return F.struct(codes.alias("codes"), low.alias("vmin"), high.alias("vmax"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["vmin"] + c.cast("double") * (q["vmax"] - q["vmin"]) / 255)


def code_distance(a: Column, b: Column) -> Column:
    """Cosine distance of raw codes: bounds don't count, so it only ranks candidates."""
    return cosine_distance(a["codes"].cast("array<double>"), b["codes"].cast("array<double>"))
