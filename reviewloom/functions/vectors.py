"""Dense-vector column expressions over ARRAY<FLOAT|DOUBLE> columns.

Higher-order array functions keep the arithmetic in the JVM; Spark 4.1 has no
built-in vector distance for arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squared_l2(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_distance(a, b, check_length: bool = True) -> Column:
    """Euclidean distance; vectors of unequal length raise an error."""
    d = F.sqrt(squared_l2(a, b))
    if check_length:
        d = F.when(F.size(_c(a)) == F.size(_c(b)), d).otherwise(
            F.raise_error(F.lit("Vectors must have the same length")).cast("double"))
    return d


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v) -> Column:
    """Scale to unit length; the zero vector stays zero."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n)) \
            .otherwise(F.transform(_c(v), lambda x: F.lit(0.0).cast("double")))


def is_zero_vector(v) -> Column:
    return F.coalesce(F.forall(_c(v), lambda x: x == 0), F.lit(True))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def sql_l2(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))))")
