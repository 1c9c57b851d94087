"""Keyed state and timers in streams: sticky verdicts, the silent-source watchdog, and hourly snapshots by version."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

C = F.col
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep state in RocksDB, which typed state and timers need; the setting is put back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Sticky(StatefulProcessor):
    """Remembers a symbol's held side and the date of its newest row."""

    def __init__(self, floor: float):
        self.floor = floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "held string, last date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, last = self.memory.get() if self.memory.exists() else ("NEUTRAL", None)
        for r in sorted(rows, key=lambda r: (r.date, r.verdict or "", r.buy_score or 0, r.sell_score or 0)):
            own, other = (r.buy_score, r.sell_score) if held == "BUY" else (r.sell_score, r.buy_score)
            if r.verdict != "NEUTRAL":
                held = r.verdict
            elif held not in ("BUY", "SELL") or own is None or other is None or own / 24 < self.floor or own < other:
                held = "NEUTRAL"
            last = r.date if last is None else max(last, r.date)
            yield Row(sym=r.sym, date=r.date, held=held)
        self.memory.update((held, last))

    def close(self) -> None:
        pass


def sticky_stream(scored: DataFrame, floor: float = 0.20) -> DataFrame:
    """Verdict memory over a stream of scored rows (sym, date, verdict, buy_score, sell_score): one row out for each row in.

    The state is one side per symbol, checkpointed by the query, so a restarted stream goes on where it stopped. Within a
    trigger rows are taken by date; a symbol's rows must not come in a later trigger than a later date's.
    """
    return scored.groupBy("sym").transformWithState(_Sticky(floor), "sym string, date date, held string", "append", "None")


class _Watchdog(StatefulProcessor):
    """One source's newest heartbeat, whether its silence was told, and the first check of the day.

    In event time the clock is the rows' own: a gap shows when the next heartbeat comes, the last silence when the
    watermark passes its limit. In processing time the clock is the cluster's, and a timer looks after the limit.
    """

    def __init__(self, regular_s: float, late_s: float, by_event: bool, session=None):
        self.regular_s, self.late_s, self.by_event, self.session = regular_s, late_s, by_event, session or exchange_session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "beat long, told boolean, day string, since long, armed long")

    def limit(self, ms: int) -> int:
        return round(1000 * (self.late_s if self.session(ms) == "after_hours" else self.regular_s))

    def arm(self, at: int, armed: int | None) -> int:
        if armed is not None and armed != at:
            self.handle.deleteTimer(armed)
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        beat, told, day, since, armed = self.memory.get() if self.memory.exists() else (None, False, None, None, None)
        now = None if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        for ts in sorted(round(r.ts.replace(tzinfo=r.ts.tzinfo or dt.timezone.utc).timestamp() * 1000) for r in rows):
            if beat is not None and ts <= beat:
                continue  # late or repeated
            if self.by_event and beat is not None and not told and ts - beat > self.limit(beat):
                yield _alert(key, beat, beat + self.limit(beat))
            beat, told = ts, False
        if now is not None and day != _day(now):
            day, since = _day(now), now
        if beat is None:
            return
        due = beat + self.limit(beat) + 1
        armed = self.arm(due if self.by_event else max(due, since + self.limit(now) + 1, now + 1), armed)
        self.memory.update((beat, told, day, since, armed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        beat, told, day, since, armed = self.memory.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if told or armed != at:
            return
        if self.by_event:
            limit, stale, now = self.limit(beat), True, at
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            if day != _day(now):  # the first check of a day starts the grace period anew
                day, since = _day(now), now
            limit = self.limit(now)
            stale = now - beat > limit and now - since > limit
        if stale:
            self.memory.update((beat, True, day, since, None))
            yield _alert(key, beat, beat + limit)
        else:
            armed = max(beat, since) + limit + 1
            self.handle.registerTimer(armed)
            self.memory.update((beat, False, day, since, armed))

    def close(self) -> None:
        pass


def _alert(key, beat: int, due: int) -> Row:
    utc = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)
    return Row(source=str(key[0]), beat=utc(beat), due=utc(due))


def _day(ms: int) -> str:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).date().isoformat()


def exchange_session(ms: int) -> str:
    """Session by the clock: after hours from 16:00 to 20:00, else regular. Times are the tables' own zone (UTC)."""
    return "after_hours" if 16 <= dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).hour < 20 else "regular"


def watchdog(beats: DataFrame, source: str, regular_s: float = 16 * 60, late_s: float = 32 * 60, by_event: bool = False, late: str = "1 hour", session=None) -> DataFrame:
    """Alerts (``source``, ``beat``: its last heartbeat, ``due``: when it should have been followed), one for each stuck heartbeat.

    ``beats`` needs ``source`` and ``ts``. A source is silent after ``regular_s`` seconds, ``late_s`` after hours; a new
    heartbeat arms it again. In processing time (the live form) silence counts from the later of the heartbeat and the
    day's first check, so that a day does not begin with an alarm; with ``by_event`` a recorded stream is replayed on its own clock.
    """
    d = beats.select(C(source).cast("string").alias("source"), "ts")
    if by_event:
        d = d.withWatermark("ts", late)
    mode = "eventTime" if by_event else "processingTime"
    return d.groupBy("source").transformWithState(_Watchdog(regular_s, late_s, by_event, session), "source string, beat timestamp, due timestamp", "append", mode)


def silences(beats: DataFrame, source: str, regular_s: float, late_s: float, end: Column) -> DataFrame:
    """Batch twin of ``watchdog`` by event time: ``end`` is how far the watermark has come."""
    w = Window.partitionBy("source").orderBy("ts")
    d = beats.select(C(source).cast("string").alias("source"), F.date_trunc("millisecond", "ts").alias("ts")).distinct()
    limit = F.when(F.hour("ts").between(16, 19), late_s).otherwise(regular_s)
    due = F.timestamp_millis(F.unix_millis("ts") + F.round(limit * 1000).cast("long"))
    d = d.select("source", C("ts").alias("beat"), F.lead("ts").over(w).alias("next"), due.alias("due"))
    return d.where((C("next") > C("due")) | (C("next").isNull() & (C("due") < end))).select("source", "beat", "due")


# ---- hourly summaries ----------------------------------------------------------------------------------------------


def hourly_changes(snaps: DataFrame, market: DataFrame, mover_pct: float = 1.0, index_pct: float = 0.4, vix_points: float = 1.0) -> DataFrame:
    """What each hour's snapshot (``start``, ``sym``, ``close``, ``verdict``) changed against the hour before it, one row an hour.

    ``market``: ``start``, ``index``, ``vix``, ``regime``. Quiet is an hour with an hour before it, without verdict changes,
    movers or a change of regime, in which index and volatility index barely moved (or are unknown). The hours are
    numbered over the market's rows (one an hour), symbols meet their hour before by an equi join.
    """
    steps = Window.orderBy("start")
    m = market.select("start", *[F.lag(c).over(steps).alias(f"p_{c}") for c in ("start", "index", "vix", "regime")], "index", "vix", "regime")
    hours = m.select(
        "start", "p_start", F.when(C("p_index") > 0, (C("index") / C("p_index") - 1) * 100).alias("index_pct"), (C("vix") - C("p_vix")).alias("vix_delta"),
        (C("p_start").isNotNull() & ~C("regime").eqNullSafe(C("p_regime"))).alias("regime_changed"),
    )
    was = snaps.select("sym", C("start").alias("p_start"), C("close").alias("p_close"), C("verdict").alias("p_verdict"))
    met = snaps.join(F.broadcast(hours.select("start", "p_start")), "start").hint("merge").join(was.hint("merge"), ["sym", "p_start"])  # one row an hour
    moved = F.when(C("p_close") > 0, F.abs(C("close") / C("p_close") - 1) * 100 >= mover_pct)
    changes = met.groupBy("start").agg(F.count_if(moved).alias("movers"), F.count_if(~C("verdict").eqNullSafe(C("p_verdict"))).alias("verdict_changes"))
    x = hours.join(changes.hint("merge"), "start", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("movers", "verdict_changes")})
    still = lambda c, most: C(c).isNull() | (F.abs(c) < most)
    quiet = C("p_start").isNotNull() & (C("movers") == 0) & (C("verdict_changes") == 0) & ~C("regime_changed") & still("index_pct", index_pct) & still("vix_delta", vix_points)
    return x.select("start", "movers", "verdict_changes", "regime_changed", "index_pct", "vix_delta", quiet.alias("quiet"))


class HourlySummary:
    """For ``foreachBatch``: diffs a batch of hourly rows (``start``, ``sym``, ``close``, ``verdict``, ``index``, ``vix``, ``regime``)
    against the newest snapshot before it.

    Batch n writes the summaries of its hours to ``summaries/batch=n`` and its last hour as snapshot ``snapshots/batch=n``;
    it reads the newest snapshot of a smaller number. Both are overwritten as a whole, so a batch that is replayed after
    a failure, however far it had come, leaves the same tables. The hours of a batch must follow those of earlier batches.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def before(self, spark: SparkSession, batch: int) -> DataFrame | None:
        try:
            kept = spark.read.parquet(f"{self.path}/snapshots")
        except AnalysisException:  # no snapshot yet
            return None
        newest = kept.where(C("batch") < batch).agg(F.max("batch")).first()[0]
        return None if newest is None else kept.where(C("batch") == newest).drop("batch")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, out = rows.sparkSession, f"{self.path}/summaries/batch={batch}"
        rows = rows.persist()
        try:
            if rows.isEmpty():
                return
            before = self.before(spark, batch)
            both = rows if before is None else rows.unionByName(before)
            market = both.groupBy("start").agg(*[F.first(c).alias(c) for c in ("index", "vix", "regime")])
            found = hourly_changes(both, market).join(F.broadcast(rows.select("start").distinct()), "start", "left_semi")  # one row an hour
            found.write.mode("overwrite").parquet(out)
            last = rows.agg(F.max("start").alias("start"))
            rows.join(F.broadcast(last), "start").select(*rows.columns).write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={batch}")
        finally:
            rows.unpersist()

    def summaries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/summaries").drop("batch")
