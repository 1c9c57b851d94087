"""As-of, range and point-in-time joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, value: str, on: tuple[str, ...] = (), date: str = "date", name: str | None = None) -> DataFrame:
    """Adds the right side's last ``value`` at or before each left row's date, per key: a union and one window.

    Left rows may repeat; right rows with a null value don't count. Without keys the right side is one series: it is
    turned into intervals and joined by date order, for calendar-sized series.
    """
    name = name or value
    if not on:
        steps = Window.orderBy(date)
        spans = right.where(F.col(value).isNotNull()).select(F.col(date).alias("_from"), F.lead(date).over(steps).alias("_to"), F.col(value).alias(name))
        inside = (F.col(date) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(date) < F.col("_to")))
        return left.join(F.broadcast(spans), inside, "left").drop("_from", "_to")
    l = left.select(*on, date, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*on, date, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*on).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", name)


def forward(left: DataFrame, right: DataFrame, on: tuple[str, ...], date: str = "date", name: str = "next_date") -> DataFrame:
    """Adds the right side's first date after each left row's date, per key."""
    l = left.select(*on, date, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    r = right.select(*on, date, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    later = Window.partitionBy(*on).orderBy(F.col(date).cast("timestamp").cast("long")).rangeBetween(1, Window.unboundedFollowing)
    both = l.unionByName(r).withColumn(name, F.min(F.when(F.col("_side") == 0, F.col(date))).over(later)).where("_side = 1")
    return both.select("_row.*", name)


def forward_bars(entries: DataFrame, bars: DataFrame, horizon: int, columns: tuple[str, ...] = ("date", "open", "high", "low", "close")) -> DataFrame:
    """Each entry (``sym``, ``rn``) with its next bars 1..horizon as rows: ``day`` and ``f_`` columns. Equi join on (sym, rn)."""
    steps = entries.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_rn", F.col("rn") + F.col("day"))
    b = bars.select(F.col("sym").alias("_s"), F.col("rn").alias("_r"), *[F.col(c).alias(f"f_{c}") for c in columns])
    return steps.join(b.hint("merge"), (F.col("sym") == F.col("_s")) & (F.col("_rn") == F.col("_r"))).drop("_s", "_r", "_rn")


def point_in_time(checks: DataFrame, statements: DataFrame, k: int = 4) -> DataFrame:
    """For each (sym, date): the newest ``k`` statements (by ``period_end``) published by then, as (``nth``, statement columns) rows.

    Checks and statements are sorted by symbol and date once; a pass over a symbol keeps the newest ``k`` statements seen so
    far and nothing else, so no check meets all statements before it, and a late statement of an old period finds its place.
    """
    names = [c for c in statements.columns if c != "sym"]
    s = statements.select("sym", F.col("accepted_date").alias("date"), F.lit(0).alias("_side"), F.struct(*names).alias("_s"))
    c = checks.select("sym", "date").distinct().select("sym", "date", F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"))
    kind = s.schema["_s"].dataType
    period = names.index("period_end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sym, newest = None, []
        for batch in batches:
            out = []
            for key, date, side, row in zip(batch["sym"], batch["date"], batch["_side"], batch["_s"]):
                if key != sym:
                    sym, newest = key, []
                if side:
                    out += [(key, date, nth, x) for nth, (_, x) in enumerate(newest, 1)]
                else:
                    values = tuple(row.values()) if isinstance(row, dict) else tuple(row)
                    newest = sorted([*newest, (values[period], row)], key=lambda x: x[0], reverse=True)[:k]
            yield pd.DataFrame(out, columns=["sym", "date", "nth", "_s"])

    both = s.unionByName(c).repartition("sym").sortWithinPartitions("sym", "date", "_side")
    found = both.mapInPandas(run, f"sym {checks.schema['sym'].dataType.simpleString()}, date date, nth int, _s {kind.simpleString()}")
    return found.select("sym", "date", "nth", "_s.*")


def back_or_oldest(checks: DataFrame, snaps: DataFrame, value: str, days: int = 60) -> DataFrame:
    """For each (sym, date): the value ``days`` back, else the oldest, of at least two snapshots at or before the date.

    Range frames over the union of checks and snapshots, one order per symbol.
    """
    s = snaps.select("sym", "date", F.lit(0).alias("_side"), F.struct(F.col("date").alias("d"), F.col(value).alias("v")).alias("_s"))
    c = checks.select("sym", "date").distinct().select("sym", "date", F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"))
    order = Window.partitionBy("sym").orderBy(F.unix_date("date"))
    past, far = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -days)
    both = s.unionByName(c).select(
        "sym", "date", "_side", F.max("_s").over(past).alias("now"), F.min("_s").over(past).alias("oldest"), F.count("_s").over(past).alias("n"), F.max("_s").over(far).alias("back")
    )
    then = F.when(F.col("n") >= 2, F.coalesce(F.col("back.v"), F.col("oldest.v")))
    return both.where("_side = 1 and n > 0").select("sym", "date", F.col("now.v").alias("now"), then.alias("then"))


def series_at(df: DataFrame, series: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Adds ``value`` of one series without key, as of each row's date: carried forward over the calendar of both sides (one
    row a day, so the window without key and the broadcast stay small), then met by date."""
    days = df.select(F.col(date).alias("_day")).distinct().select("_day", F.lit(None).cast(series.schema[value].dataType).alias(value))
    both = days.unionByName(series.where(F.col(value).isNotNull()).select(F.col("date").alias("_day"), value)).groupBy("_day").agg(F.max(value).alias(value))
    filled = both.select("_day", F.last(value, ignorenulls=True).over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)).alias(value))
    return df.join(F.broadcast(filled), F.col(date) == F.col("_day"), "left").drop("_day")


def named_interval(df: DataFrame, intervals: DataFrame, date: str = "date") -> DataFrame:
    """Adds ``period``: the first (by ``ordinal``) of a fixed list of intervals that holds the date, else null."""
    hit = df.join(F.broadcast(intervals), F.col(date).between(F.col("from"), F.col("to")), "left")
    first = hit.groupBy(*df.columns).agg(F.min_by("period", "ordinal").alias("period"))
    return first


def benchmark_return(trades: DataFrame, index: DataFrame, entry: str = "entry_date", exit: str = "exit_date") -> DataFrame:
    """Adds ``bench_pct``: the index's change between the two dates as of each, rounded to 2; null unless both closes are positive."""
    one = backward(trades.withColumnRenamed(entry, "date"), index.select("date", F.col("close").alias("_e")), "_e").withColumnRenamed("date", entry)
    two = backward(one.withColumnRenamed(exit, "date"), index.select("date", F.col("close").alias("_x")), "_x").withColumnRenamed("date", exit)
    e, x = F.col("_e"), F.col("_x")
    return two.withColumn("bench_pct", F.when((e > 0) & (x > 0), F.floor((x - e) / e * 10000 + F.lit(0.5)) / 100)).drop("_e", "_x")


def first_after(df: DataFrame, events: DataFrame, start: Column, stop: Column, name: str) -> DataFrame:
    """Adds the first event date (a short list) after ``start`` and up to ``stop``."""
    e = events.select(F.col("date").alias("_ev"))
    hit = df.join(F.broadcast(e), (F.col("_ev") > start) & (F.col("_ev") <= stop), "left")
    return hit.groupBy(*df.columns).agg(F.min("_ev").alias(name))
