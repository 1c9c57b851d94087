"""The bar panel: lines are scanned once, and again when their files change."""

from candlefold.sources import tables

NAMES = ("lineitem", "supplier", "nation", "region")


def _copy(spark, source, target, where="true"):
    for name in NAMES:
        part = spark.read.parquet(f"{source}/{name}.parquet").where(where if name == "lineitem" else "true")
        part.coalesce(1).write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def _direct(spark, folder, *key):
    """Bars straight from the lines."""
    from pyspark.sql import functions as F

    low, high = F.min_by("price", "k").alias("open"), F.max_by("price", "k").alias("close")
    t = tables._ticks(spark, folder).groupBy(*key, "date").agg(low, F.max("price").alias("high"), F.min("price").alias("low"), high, F.sum("q").alias("volume"))
    return t


def test_panel_is_scanned_once_and_follows_its_files(spark, tmp_path):
    folder = str(tmp_path / "tables")
    _copy(spark, "/root/testdata/sf0.001", folder)
    for make, key in ((tables.bars, ("sym", "sector")), (tables.sector_bars, ("sector",)), (tables.index_bars, ())):
        got, want = make(spark, folder), _direct(spark, folder, *key)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert not any("lineitem" in f for f in got.inputFiles())
    before = tables.panel(spark, folder)
    assert sorted(before.inputFiles()) == sorted(tables.panel(spark, folder).inputFiles())
    _copy(spark, "/root/testdata/sf0.001", folder, "l_orderkey % 2 = 0")
    after = tables.index_bars(spark, folder)
    assert after.agg({"volume": "sum"}).first() == _direct(spark, folder).agg({"volume": "sum"}).first()
    _copy(spark, "/root/testdata/sf0.001", folder, "false")
    assert tables.bars(spark, folder).count() == tables.index_bars(spark, folder).count() == 0
