"""Unscheduled closures in the calendar; recursive SQL of the folds against the folds."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlefold.operators import hygiene

SF = "/root/testdata/sf0.001"
MONDAY = dt.date(2024, 6, 3)


def calendar(spark, n=7):
    days = [(MONDAY + dt.timedelta(i), i % 7 < 5, False) for i in range(n)]
    return spark.createDataFrame(days, "date date, trading boolean, half boolean")


def test_closures_end_or_shorten_a_day(spark):
    rows = [(MONDAY + dt.timedelta(1), "full"), (MONDAY + dt.timedelta(1), "half"), (MONDAY + dt.timedelta(2), "half"), (MONDAY + dt.timedelta(3), "odd"), (None, "full"), (MONDAY - dt.timedelta(9), "full")]
    got = hygiene.sessions(hygiene.with_closures(calendar(spark), spark.createDataFrame(rows, "date date, kind string"))).orderBy("date").collect()
    assert [r.trading for r in got] == [True, False, True, True, True, False, False]
    assert [r.close_minute for r in got][:4] == [960, 960, 780, 960]
    assert got[2].prev == MONDAY and got[0].prev is None


def test_no_closures_change_nothing(spark):
    none = spark.createDataFrame([], "date date, kind string")
    assert hygiene.with_closures(calendar(spark), none).orderBy("date").collect() == calendar(spark).orderBy("date").collect()


def test_a_full_week_closed_is_stale(spark):
    shut = spark.createDataFrame([(MONDAY + dt.timedelta(i), "full") for i in range(1, 6)], "date date, kind string")
    got = hygiene.sessions(hygiene.with_closures(calendar(spark, 8), shut)).orderBy("date").collect()
    assert got[7].prev == MONDAY and got[7].stale and not got[2].stale


@pytest.mark.parametrize("name", ["k01_bounce_fold", "s03_keyed_trade_log", "h_text_chunks", "b12_closure_table"])
def test_recursive_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*map(F.col, cols)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
