"""The vector kernels as SQL functions of a session, so that SQL text can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

VECTOR = "ARRAY<DOUBLE>"
_SUM = "aggregate(zip_with(a, b, (x, y) -> {term}), 0D, (s, x) -> s + x)"
_DOT, _SELF_A, _SELF_B = _SUM.format(term="x * y"), "aggregate(a, 0D, (s, x) -> s + x * x)", "aggregate(b, 0D, (s, x) -> s + x * x)"
_COSINE = f"if({_SELF_A} = 0 OR {_SELF_B} = 0, 0D, {_DOT} / sqrt({_SELF_A} * {_SELF_B}))"

#: name, parameters and body
FUNCTIONS = {
    "vec_magnitude": (f"a {VECTOR}", f"sqrt({_SELF_A})"),
    "vec_dot": (f"a {VECTOR}, b {VECTOR}", _DOT),
    "vec_cosine": (f"a {VECTOR}, b {VECTOR}", _COSINE),
    "vec_cosine_distance": (f"a {VECTOR}, b {VECTOR}", f"1D - greatest(-1D, least(1D, {_COSINE}))"),
    "vec_euclidean": (f"a {VECTOR}, b {VECTOR}", f"sqrt({_SUM.format(term='(x - y) * (x - y)')})"),
    "vec_manhattan": (f"a {VECTOR}, b {VECTOR}", _SUM.format(term="abs(x - y)")),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
    return list(FUNCTIONS)
