"""Keyed state across triggers and restarts, timers, and snapshots that a replayed batch leaves alone."""

import datetime as dt
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlefold.operators import trades
from candlefold.sources.shared import ship_package
from candlefold.streaming import state

C = F.col
DAY = dt.date(2020, 1, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def scored_rows(spark, n=120):
    g = random.Random(7)
    rows = [(sym, DAY + dt.timedelta(i), g.choice(["BUY", "SELL", "NEUTRAL", "NEUTRAL", "NEUTRAL", "BLOCKED"]), g.choice([None, *range(0, 15)]), g.randrange(15)) for sym in "ABCD" for i in range(n)]
    return spark.createDataFrame(rows, "sym string, date date, verdict string, buy_score int, sell_score int")


def drain(stream, folder):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return q


def test_sticky_stream_in_three_triggers_with_a_restart_equals_the_batch(spark, folder):
    ship_package(spark)
    rows = scored_rows(spark)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet
    part = lambda i: rows.where(F.floor(F.datediff("date", F.lit(DAY)) / 40) == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    part(0)
    with state.keyed_state(spark):
        drain(state.sticky_stream(source(f"{folder}/in")), folder)
        assert spark.read.parquet(f"{folder}/out").count() == 160
        part(1)
        part(2)
        assert drain(state.sticky_stream(source(f"{folder}/in")), folder).lastProgress["batchId"] >= 2
    got, want = spark.read.parquet(f"{folder}/out"), trades.sticky(rows)
    assert got.count() == want.count() == 480 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_sticky_stream_query_equals_k05(spark):
    q = __spark_entry__.queries()
    got, want = q["s07_sticky_stream"](spark, SF), q["k05_sticky_verdict"](spark, SF)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def regular(ms):
    return "regular"


def late_session(ms):
    return "after_hours"


def live_alerts(spark, folder, session, script, regular_s=2.0, late_s=300.0):
    """Run the live watchdog; ``script`` gets a function that sends a heartbeat now and one that counts the alerts."""
    ship_package(spark)

    def send():
        spark.createDataFrame([("a", dt.datetime.now(dt.timezone.utc))], "source string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    send()
    beats = spark.readStream.schema("source string, ts timestamp").parquet(f"{folder}/in")
    with state.keyed_state(spark):
        q = state.watchdog(beats, "source", regular_s, late_s, session=session).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(processingTime="300 milliseconds").start(f"{folder}/out")

    def count(at_least=0, seconds=40):
        end = time.time() + seconds
        while True:
            try:
                n = spark.read.schema("source string, beat timestamp, due timestamp").parquet(f"{folder}/out").count()
            except Exception:
                n = 0
            if n >= at_least or time.time() > end or q.exception():
                assert not q.exception()
                return n
            time.sleep(0.5)

    try:
        return script(send, count)
    finally:
        q.stop()


def test_watchdog_alerts_once_and_rearms(spark, folder):
    def script(send, count):
        assert count(1) == 1  # silent
        time.sleep(5)
        assert count() == 1  # still the same heartbeat
        send()
        assert count(2) == 2  # silent again after a new one
        beats = [r.beat for r in spark.read.parquet(f"{folder}/out").orderBy("beat").collect()]
        assert len(set(beats)) == 2

    live_alerts(spark, folder, regular, script)


def test_watchdog_waits_longer_after_hours(spark, folder):
    def script(send, count):
        time.sleep(12)
        assert count() == 0

    live_alerts(spark, folder, late_session, script)


def test_replayed_watchdog_equals_its_batch_twin(spark, folder):
    ship_package(spark)
    g, start = random.Random(3), dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    rows = [(g.choice("abc"), start + dt.timedelta(seconds=g.randrange(12 * 3600))) for _ in range(120)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "source string, ts timestamp")
    df.coalesce(1).write.parquet(f"{folder}/in")
    end = max(t for _, t in rows) - dt.timedelta(hours=1)
    with state.keyed_state(spark):
        drain(state.watchdog(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), "source", 600, 1500, by_event=True), folder)
    got, want = spark.read.parquet(f"{folder}/out"), state.silences(df, "source", 600, 1500, F.lit(end))
    assert got.count() == want.count() > 20 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


# ---- hourly summaries ----------------------------------------------------------------------------------------------


HOUR = "start timestamp, sym string, close double, verdict string, index double, vix double, regime string"


def hour(h, closes, index=100.0, vix=20.0, regime="up", verdicts=None):
    at = dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc)
    return [(at, s, c, (verdicts or {}).get(s, "BUY"), index, vix, regime) for s, c in closes.items()]


def test_quiet_needs_a_still_market(spark):
    a = {"x": 100.0, "y": 50.0}
    rows = [*hour(0, a), *hour(1, a), *hour(2, a, index=100.3), *hour(3, a, index=101.0), *hour(4, a, index=101.0, vix=21.5), *hour(5, a, index=101.0, vix=21.5, regime="down")]
    rows += [*hour(6, {"x": 101.5, "z": 1.0}, index=101.0, vix=21.5, regime="down"), *hour(7, {"x": 101.5, "y": 9.0}, index=101.0, vix=21.5, regime="down", verdicts={"x": "SELL"}), *hour(8, {"x": 101.5}, index=None, vix=None, regime="down", verdicts={"x": "SELL"})]
    df = spark.createDataFrame(rows, HOUR)
    market = df.groupBy("start").agg(*[F.first(c).alias(c) for c in ("index", "vix", "regime")])
    got = state.hourly_changes(df, market).orderBy("start").collect()
    assert [r.quiet for r in got] == [False, True, True, False, False, False, False, False, True]
    assert [r.movers for r in got] == [0, 0, 0, 0, 0, 0, 1, 0, 0] and [r.verdict_changes for r in got] == [0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert got[3].index_pct == pytest.approx((101 / 100.3 - 1) * 100) and got[4].vix_delta == pytest.approx(1.5) and got[5].regime_changed


def test_a_replayed_batch_changes_nothing(spark, folder):
    summary = state.HourlySummary(folder)
    batches = [[*hour(0, {"x": 1.0}), *hour(1, {"x": 1.1})], [*hour(2, {"x": 1.1}, index=101.0)], [], [*hour(3, {"x": 2.0}), *hour(4, {"x": 2.0})]]
    for i, rows in enumerate(batches):
        summary(spark.createDataFrame(rows, HOUR), i)
    read = lambda: sorted(tuple(r) for r in summary.summaries(spark).collect())
    first = read()
    assert len(first) == 5 and [r[1] for r in first] == [0, 1, 0, 1, 0]
    for i in (1, 3, 0):
        summary(spark.createDataFrame(batches[i], HOUR), i)
        assert read() == first
    whole = spark.createDataFrame(sum(batches, []), HOUR)
    market = whole.groupBy("start").agg(*[F.first(c).alias(c) for c in ("index", "vix", "regime")])
    assert sorted(tuple(r) for r in state.hourly_changes(whole, market).collect()) == first
