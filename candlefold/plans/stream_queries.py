"""Streaming forms, run over the events table as a stream until its data is used up, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlefold.plans.base import C, bars, bounce, query, r, regime
from candlefold.plans.trade_queries import STICKY, bounce_fold_sql
from candlefold.sources import tables
from candlefold.sources.shared import kept, ship_package
from candlefold.streaming import jobs, state


def events_stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return source.select("event_id", C("event_type").alias("sym"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"), "user_id")


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up, into a Parquet sink in the shared folder; returns what it wrote."""
    s = stream.sparkSession
    base = s.conf.get("spark.checkpoint.dir", None) or kept(s.range(1)).inputFiles()[0].rsplit("/", 2)[0]
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/out")


HOUR = "h AS (SELECT event_type AS sym, time_bucket(INTERVAL {w}, ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY ALL)"


@query("s01_tick_bars_stream", "WITH " + HOUR.format(w="1 HOUR") + " SELECT sym, start, open, high, low, close, n FROM h WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)", views=False)
def s01(s, d):
    """Append mode: only windows that the watermark (two hours late) has closed come out."""
    return run(jobs.tick_bars(events_stream(s, d))).withColumn("start", C("start").cast("timestamp_ntz"))


@query("s01_tick_bars_batch", "WITH " + HOUR.format(w="1 HOUR") + " SELECT sym, start, open, high, low, close, n FROM h", views=False)
def s01b(s, d):
    return jobs.tick_bars(tables.quotes(s, d))


@query("s01_sliding_bars", "WITH o AS (SELECT unnest(generate_series(0, 23)) AS k), x AS (SELECT event_type AS sym, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start, value FROM events, o) SELECT sym, start, max(value) AS high, count(*) AS n FROM x GROUP BY ALL", views=False)
def s01s(s, d):
    return jobs.tick_bars(tables.quotes(s, d), "1 day", "1 hour").select("sym", "start", "high", "n")


@query("s01_sessions", """WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS cut FROM events), k AS (SELECT *, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, k""", views=False)
def s01w(s, d):
    return jobs.sessions(tables.quotes(s, d), "6 hours")


@query("s02_late_data", "WITH g AS (SELECT event_type AS sym, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT sym, day, n FROM g WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)", views=False)
def s02(s, d):
    """Daily counts of closed sessions only."""
    w = events_stream(s, d).withWatermark("ts", "6 hours").groupBy("sym", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return run(w.select("sym", F.to_date("w.start").alias("day"), "n"))


@query("s03_keyed_trade_log", bounce_fold_sql(), views=False)
def s03(s, d):
    """Closed trades per symbol from a stream of scored bars; the same trades as the batch fold (tested)."""
    ship_package(s)
    scored = kept(bounce(s, d).where("rn >= 200").select("sym", "date", "open", "high", "low", "close", "verdict", "atr5"))
    path = scored.inputFiles()[0].rsplit("/", 1)[0]
    rows = s.readStream.schema(scored.schema).parquet(path)
    return run(jobs.keyed_trades(rows)).select("sym", "side", "entry_date", "exit_date", "reason", r("pnl", 2))


@query("s04_silent_sources", """WITH e AS (SELECT user_id, date_trunc('second', ts) AS ts, event_id FROM events), g AS (SELECT user_id, ts, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 60 AS gap FROM e)
SELECT user_id, ts, round(gap, 4)::DOUBLE AS gap_min, gap = max(gap) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS worst_of_day FROM g WHERE gap > 720""", views=False)
def s04(s, d):
    return jobs.silent_gaps(tables.table(s, d, "events").select("user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "event_id"), 720).withColumn("gap_min", F.round("gap_min", 4))


@query("s05_hourly_changes", "WITH " + HOUR.format(w="1 HOUR") + ", w AS (SELECT sym, start, close, lag(close) OVER (PARTITION BY sym ORDER BY start) AS before FROM h) SELECT sym, start, round((close / before - 1) * 100, 4) AS change_pct, coalesce(abs(close / before - 1) < 0.004, false) AS quiet FROM w", views=False)
def s05(s, d):
    x = jobs.snapshot_changes(jobs.tick_bars(tables.quotes(s, d)).select("sym", "start", "close"))
    return x.select("sym", "start", r("change_pct"), F.coalesce(F.abs("change_pct") < 0.4, F.lit(False)).alias("quiet"))


@query("s06_once_a_day", "SELECT DISTINCT event_type AS sym, CAST(ts AS DATE) AS day FROM events", views=False)
def s06(s, d):
    return run(jobs.once_a_day(events_stream(s, d)).select("sym", "day"))


@query("s07_sticky_stream", STICKY)
def s07(s, d):
    """The sticky verdict with the held side in keyed state, a row out for each row in; equals the batch query (tested)."""
    ship_package(s)
    scored = kept(bounce(s, d).select("sym", "date", "verdict", "buy_score", "sell_score"))
    with state.keyed_state(s):
        return run(state.sticky_stream(s.readStream.schema(scored.schema).parquet(scored.inputFiles()[0].rsplit("/", 1)[0])))


@query("s04_watchdog_stream", """WITH e AS (SELECT DISTINCT user_id, date_trunc('millisecond', ts) AS ts FROM events), g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, ts + CASE WHEN hour(ts) BETWEEN 16 AND 19 THEN INTERVAL 32 HOUR ELSE INTERVAL 16 HOUR END AS due FROM e)
SELECT CAST(user_id AS VARCHAR) AS source, ts AS beat, due FROM g WHERE nxt > due OR (nxt IS NULL AND due < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events))""", views=False)
def s04w(s, d):
    """The watchdog replayed on the events' own clock, timers by event time; the tables' sources beat a few times a day, so its limits are hours."""
    ship_package(s)
    beats = events_stream(s, d).select("user_id", F.date_trunc("millisecond", "ts").alias("ts"))
    with state.keyed_state(s):
        found = run(state.watchdog(beats, "user_id", 16 * 3600, 32 * 3600, by_event=True))
    return found.select("source", *[C(c).cast("timestamp_ntz").alias(c) for c in ("beat", "due")])


S05 = "WITH " + HOUR.format(w="1 HOUR") + """, sn AS (SELECT sym, start, close, CASE WHEN close > open * 1.2 THEN 'BUY' WHEN close < open * 0.8 THEN 'SELL' ELSE 'NEUTRAL' END AS verdict FROM h),
mk AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, avg(value) AS idx, stddev_samp(value) AS vix, avg(value) > 50 AS regime FROM events GROUP BY 1),
hr AS (SELECT start, lag(start) OVER w AS p_start, (idx / lag(idx) OVER w - 1) * 100 AS index_pct, vix - lag(vix) OVER w AS vix_delta, lag(start) OVER w IS NOT NULL AND regime IS DISTINCT FROM lag(regime) OVER w AS regime_changed FROM mk WINDOW w AS (ORDER BY start)),
ch AS (SELECT hr.start, count(*) FILTER (abs(a.close / b.close - 1) * 100 >= 1 AND b.close > 0) AS movers, count(*) FILTER (a.verdict IS DISTINCT FROM b.verdict) AS verdict_changes FROM hr JOIN sn a ON a.start = hr.start JOIN sn b ON b.sym = a.sym AND b.start = hr.p_start GROUP BY hr.start)
SELECT hr.start, coalesce(movers, 0) AS movers, coalesce(verdict_changes, 0) AS verdict_changes, regime_changed, round(index_pct, 4) AS index_pct, round(vix_delta, 4) AS vix_delta,
  p_start IS NOT NULL AND coalesce(movers, 0) = 0 AND coalesce(verdict_changes, 0) = 0 AND NOT regime_changed AND coalesce(abs(index_pct) < 0.4, true) AND coalesce(abs(vix_delta) < 1, true) AS quiet FROM hr LEFT JOIN ch USING (start)"""


def hourly_rows(s, d):
    """Hourly snapshot rows with the market's figures: the mean of all prices as index, their spread as volatility index."""
    q = tables.quotes(s, d).withColumn("start", F.date_trunc("hour", "ts"))
    market = q.groupBy("start").agg(F.avg("price").alias("index"), F.stddev_samp("price").alias("vix"), (F.avg("price") > 50).cast("string").alias("regime"))
    h = jobs.tick_bars(tables.quotes(s, d))
    verdict = F.when(C("close") > C("open") * 1.2, "BUY").when(C("close") < C("open") * 0.8, "SELL").otherwise("NEUTRAL")
    return h.select("start", "sym", "close", verdict.alias("verdict")).join(market.hint("merge"), "start")


@query("s05_hourly_summary_stream", S05, views=False)
def s05h(s, d):
    """The hour's changes and the quiet rule in micro-batches against a snapshot table by batch number."""
    rows = kept(hourly_rows(s, d).withColumn("week", F.floor(F.dayofmonth("start") / 8)))
    path = f"{rows.inputFiles()[0].rsplit('/', 1)[0]}-weeks"
    for week in range(4):  # a stream reads files in the order they were written
        rows.where(C("week") == week).drop("week").coalesce(1).write.mode("append").parquet(path)
    rows, summary = rows.drop("week"), state.HourlySummary(f"{path}-summary")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.writeStream.foreachBatch(summary).option("checkpointLocation", f"{path}-summary/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return summary.summaries(s).select("start", "movers", "verdict_changes", "regime_changed", r("index_pct"), r("vix_delta"), "quiet")


@query("s08_stream_static", ", d AS (SELECT event_type AS sym, CAST(ts AS DATE) AS day, DATE '1996-01-01' + (CAST(ts AS DATE) - DATE '2024-01-01')::INT AS ref FROM events) SELECT sym, day, coalesce(favorable, false) AS favorable, count(*) AS n FROM d LEFT JOIN regime ON regime.date = ref GROUP BY ALL")
def s08(s, d):
    """A stream joined to the index regime, computed once; the index's dates are moved onto the events' days."""
    reg = kept(regime(s, d).select("date", "favorable"))
    e = events_stream(s, d).select("sym", F.to_date("ts").alias("day"))
    e = e.withColumn("date", F.date_add(F.lit("1996-01-01").cast("date"), F.datediff("day", F.lit("2024-01-01").cast("date"))))
    joined = e.join(F.broadcast(reg), "date", "left").select("sym", "day", F.coalesce("favorable", F.lit(False)).alias("favorable"))
    return run(joined).groupBy("sym", "day", "favorable").agg(F.count("*").alias("n"))


# ---- A11, A12: sinks -----------------------------------------------------------------------------------------------


def sink(df: DataFrame, fmt: str, partition: str | None = None) -> DataFrame:
    """Replace a table wholesale and read it back with its schema."""
    s = df.sparkSession
    base = kept(s.range(1)).inputFiles()[0].rsplit("/", 2)[0]
    path = f"{base}/sink-{uuid.uuid4().hex}"
    for _ in range(2):  # written twice: the second replaces the first
        w = df.write.mode("overwrite").format(fmt)
        (w.partitionBy(partition) if partition else w).save(path)
    return s.read.schema(df.schema).format(fmt).load(path).select(*df.columns)


@query("a11_replace_picks", "SELECT sym, date, close FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM bars) WHERE k <= 5".replace("SELECT sym", "SELECT sym", 1))
def a11(s, d):
    return sink(tables.last_sessions(bars(s, d), 5).select("sym", "date", "close"), "parquet", "sym")


@query("a12_report_sink", "SELECT sector, count(*) AS n, round(avg(close), 4) AS avg_close FROM bars GROUP BY sector")
def a12(s, d):
    return sink(bars(s, d).groupBy("sector").agg(F.count("*").alias("n"), F.round(F.avg("close"), 4).alias("avg_close")), "json")
