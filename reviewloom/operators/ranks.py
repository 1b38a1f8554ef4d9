"""Row numbers within groups without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A row's place in its partition lies in these low bits of monotonically_increasing_id.
_PLACE_BITS = 33


def ranked(rows: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0, in ``order_cols`` within ``group_cols``.

    Rows are sorted by ranges of group and order, so a group of any size is spread over
    tasks.  A rank is the row's place in its partition, plus what the group has in earlier
    partitions: a window over one count per group and partition.  The sorted rows are written
    once, so ranks hold when executors are lost.  Ties get different ranks; nulls come
    first, null groups are groups."""
    g = list(group_cols)
    placed = materialize(rows.repartitionByRange(*g, *order_cols).sortWithinPartitions(*g, *order_cols)
                         .withColumn("__rank_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("__rank_part", F.shiftright("__rank_place", _PLACE_BITS))
    counts = placed.groupBy("__rank_part", *g).agg(F.min("__rank_place").alias("__rank_first"), F.count(F.lit(1)).alias("__rank_c"))
    before = Window.partitionBy(*g).orderBy("__rank_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__rank_before", F.coalesce(F.sum("__rank_c").over(before), F.lit(0)))
    counts = counts.select(F.col("__rank_part").alias("__rank_p"), "__rank_first", "__rank_before", *[F.col(c).alias(f"__rank_{c}_") for c in g])
    same = F.col("__rank_part") == F.col("__rank_p")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"__rank_{c}_"))
    return placed.join(counts, same).withColumn("rank", F.col("__rank_place") - F.col("__rank_first") + F.col("__rank_before")) \
        .select(*rows.columns, "rank")
