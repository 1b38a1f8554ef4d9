import datetime as dt

from pyspark.sql import functions as F

from reviewloom.functions import weeks


def test_iso_week_keys(spark):
    df = spark.createDataFrame([(dt.date(2027, 1, 2),), (dt.date(2020, 12, 31),), (dt.date(2021, 1, 3),),
                                (dt.date(2026, 6, 1),)], "d date")
    got = [r.k for r in df.select(weeks.iso_week_key("d").alias("k")).collect()]
    assert got == ["2026-W53", "2020-W53", "2020-W53", "2026-W23"]


def test_bounds_round_trip(spark):
    days = spark.range(0, 36 * 366).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    k = days.select(weeks.iso_week_key("d").alias("k"), "d")
    bad = k.filter((weeks.week_start_date("k") > F.col("d")) | (F.date_add(weeks.week_start_date("k"), 7) <= F.col("d"))
                   | (weeks.iso_week_key(weeks.week_start_date("k")) != F.col("k")) | ~weeks.is_valid_week_key("k"))
    assert bad.count() == 0


def test_invalid_keys(spark):
    df = spark.createDataFrame([("2026-W54",), ("2026W10",), ("2020-W53",), ("2021-W53",), ("abcd-W01",)], "k string")
    assert [r.v for r in df.select(weeks.is_valid_week_key("k").alias("v")).collect()] == [False, False, True, False, False]


def test_week_end_and_lookback(spark):
    df = spark.createDataFrame([("2026-W23",)], "k string")
    r = df.select(F.date_format(weeks.week_end_ts("k"), "yyyy-MM-dd HH:mm:ss.SSS").alias("e"),
                  F.date_format(weeks.lookback_lower("k", 1), "yyyy-MM-dd HH:mm:ss.SSS").alias("lo")).first()
    assert r.e == "2026-06-07 23:59:59.999" and r.lo == "2026-05-31 23:59:59.999"


def test_week_keys_match_python_isocalendar(spark):
    start = dt.date(1998, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(0, 40 * 366, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.k for r in df.select(weeks.iso_week_key("d").alias("k")).collect()]
    want = [f"{d.isocalendar()[0]:04d}-W{d.isocalendar()[1]:02d}" for d in days]
    assert got == want
    starts = df.select(weeks.iso_week_key("d").alias("k")).distinct() \
               .select("k", weeks.week_start_date("k").alias("s")).collect()
    for r in starts:
        y, w = int(r.k[:4]), int(r.k[6:])
        assert r.s == dt.date.fromisocalendar(y, w, 1)
