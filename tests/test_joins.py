"""Size-checked broadcast: same join result on both sides of the bound."""

from pyspark.sql import functions as F

from reviewloom.operators.joins import bounded_broadcast, join_small


def _hinted(df) -> bool:
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_bounded_broadcast_switches_on_row_count(spark):
    small = spark.range(10).withColumn("v", F.col("id") * 2)
    assert _hinted(bounded_broadcast(small, max_rows=10))
    assert not _hinted(bounded_broadcast(small, max_rows=9))


def test_join_small_same_result_either_way(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = spark.range(10).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 3)
    a = {tuple(r) for r in join_small(big, small, "k", max_rows=100).collect()}
    b = {tuple(r) for r in join_small(big, small, "k", max_rows=1).collect()}
    assert a == b and len(a) == 1000


def test_broadcast_bound_counts_bytes(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS text", "array(1.0D, 2.0D) AS vec",
                                      "array(named_struct('s', 'abc'), null) AS parts", "cast(null AS string) AS none")

    assert _hinted(bounded_broadcast(wide))
    assert not _hinted(bounded_broadcast(wide, max_bytes=10_000))
    assert _hinted(bounded_broadcast(wide, max_bytes=13_000))
    assert not _hinted(bounded_broadcast(wide, max_rows=9))
