"""Join helpers that broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of a side that is broadcast; a side beyond either is joined by shuffle.
DEFAULT_BROADCAST_ROWS = 200_000
MOST_BROADCAST_BYTES = 64 << 20


def _bytes(value, kind: T.DataType):
    """About the bytes that a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return 8 + F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(0).cast("long"),
                                   lambda total, x: total + _bytes(x, kind.elementType))
        return 8 + 8 * F.greatest(F.lit(0), F.coalesce(F.size(value), F.lit(0)))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def bounded_broadcast(small: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Return ``broadcast(small)`` when it has at most ``max_rows`` rows of
    together at most ``max_bytes``, otherwise ``small`` unchanged so the planner
    shuffles (AQE can still split skewed partitions).  The check reads the
    side once, up to the row bound; callers pass aggregated or request-sized frames."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in small.schema.fields), F.lit(0)).cast("long")
    n, used = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(small) if n <= max_rows and used <= max_bytes else small


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    return big.join(bounded_broadcast(small, max_rows), on, how)
