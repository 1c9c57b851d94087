"""Structured Streaming forms: bars from ticks, daily marks, watchdog, keyed trade log, snapshot differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def tick_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """Bars of tumbling (or sliding) windows; with a watermark a stream emits only closed windows and drops later ticks.

    Works on streams and tables alike. Open and close follow time, then event id."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = ticks.withWatermark("ts", late) if late and ticks.isStreaming else ticks
    order = F.struct("ts", "event_id")
    g = d.groupBy("sym", window.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n")
    )
    return g.select("sym", C("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(beats: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    d = beats.withWatermark("ts", late) if late and beats.isStreaming else beats
    return d.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", C("w.start").alias("start"), C("w.end").alias("end"), "n")


def once_a_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each (sym, day): on streams within the watermark."""
    d = events.withColumn("day", F.to_date("ts"))
    return d.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sym", "day"]) if d.isStreaming else d.dropDuplicates(["sym", "day"])


def silent_gaps(beats: DataFrame, minutes: int) -> DataFrame:
    """Batch twin of the watchdog: gaps of a source over ``minutes``, and whether the gap is the day's worst."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = beats.select("user_id", "ts", F.lag("ts").over(w).alias("before"))
    gap = (F.unix_timestamp("ts") - F.unix_timestamp("before")) / 60
    late = d.select("user_id", "ts", gap.alias("gap_min")).where(C("gap_min") > minutes)
    day = Window.partitionBy("user_id", F.to_date("ts"))
    return late.select("*", (C("gap_min") == F.max("gap_min").over(day)).alias("worst_of_day"))




def keyed_trades(rows: DataFrame, time_stop: int = 3) -> DataFrame:
    """Closed bounce trades per symbol from a stream of scored rows (sym, date, open, high, low, close, verdict, atr5).

    Keeps the open position of each symbol in state. Rows of a date that was counted already don't count as a session."""
    state = "side string, entry double, stop double, entry_date date, held int, last date"
    out = "sym string, side string, entry_date date, exit_date date, reason string, pnl double"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state_) -> Iterator[pd.DataFrame]:
        position = state_.get if state_.exists else None
        done = []
        rows = pd.concat(list(batches)).sort_values("date")
        for r in rows.itertuples():
            position, closed = next_position(position, r, time_stop)
            if closed:
                done.append((key[0], *closed))
        if position:
            state_.update(position)
        elif state_.exists:
            state_.remove()
        yield pd.DataFrame(done, columns=["sym", "side", "entry_date", "exit_date", "reason", "pnl"])

    return rows.groupBy("sym").applyInPandasWithState(run, out, state, "append", "NoTimeout")


def next_position(position: tuple | None, r, time_stop: int, mult: float = 2.5) -> tuple[tuple | None, tuple | None]:
    """One session's transition: the new position and the trade it closes. The row form of ``trades.bounce_trades``."""

    def enter(side: str) -> tuple:
        sign = -1 if side == "long" else 1
        stop = round(r.close + sign * mult * r.atr5, 2) if r.atr5 and r.atr5 > 0 else None
        return (side, r.close, stop, r.date, 0, r.date)

    if position is None:
        return ({"BUY": enter("long"), "SELL": enter("short")}.get(r.verdict)), None
    side, entry, stop, since, held, last = position
    long, held = side == "long", held + (r.date > last)
    reason, price = None, r.close
    if stop is not None and (r.low <= stop if long else r.high >= stop):
        reason, price = "STOP", (r.open if (r.open <= stop if long else r.open >= stop) else stop)
    elif r.close > entry if long else r.close < entry:
        reason = "TARGET"
    elif r.verdict == ("SELL" if long else "BUY"):
        reason = r.verdict
    elif held >= time_stop:
        reason = "TIME"
    if reason is None:
        return (side, entry, stop, since, held, max(last, r.date)), None
    pnl = ((price - entry) if long else (entry - price)) / entry * 100
    return (enter("short" if long else "long") if reason in ("BUY", "SELL") else None), (side, since, r.date, reason, pnl)


def snapshot_changes(snaps: DataFrame, hour: Column | None = None) -> DataFrame:
    """Hour over hour per symbol: previous price and change in percent, for tables and inside ``foreachBatch``."""
    from pyspark.sql import Window

    w = Window.partitionBy("sym").orderBy("start")
    return snaps.select("sym", "start", "close", F.lag("close").over(w).alias("before")).withColumn("change_pct", (C("close") / C("before") - 1) * 100)
