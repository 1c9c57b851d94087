"""The panel's pass over all lines keeps no line, and its points are those of the total order."""

from pyspark.sql import functions as F

from candlefold.sources import tables
from tests.test_panel import _copy, _direct


def test_lines_are_aggregated_without_a_sort(spark, tmp_path, monkeypatch):
    plans, kept = [], tables.kept

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(tables, "kept", seen)
    folder = str(tmp_path / "tables")
    _copy(spark, "/root/testdata/sf0.001", folder)
    tables.panel(spark, folder).count()
    assert "HashAggregate" in plans[0] and "Sort" not in plans[0]


def test_points_of_null_and_equal_orders(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    _copy(spark, "/root/testdata/sf0.001", folder)
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    order = F.when(F.col("l_orderkey") % 5 != 0, F.floor(F.col("l_orderkey") / 100)).cast("long")  # nulls, and many lines an order
    day = F.when(F.col("l_partkey") % 50 != 0, F.col("l_shipdate"))
    line.withColumns({"l_orderkey": order, "l_shipdate": day}).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    want = _direct(spark, folder, "sym", "sector")
    rows = sorted(map(tuple, want.collect()), key=str)
    assert any(r[2] is None for r in rows)
    for most in (tables.BROADCAST_SESSIONS, 0):
        monkeypatch.setattr(tables, "BROADCAST_SESSIONS", most)
        spark.sparkContext.__dict__.pop("_candlefold_panels", None)
        assert sorted(map(tuple, tables.bars(spark, folder).select(want.columns).collect()), key=str) == rows
