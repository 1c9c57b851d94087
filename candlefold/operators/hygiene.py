"""Bars and stored rows: cleaning, splits, live bars, quarantine, merging, retention, eligibility, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlefold.functions.scalars import CLOSE, HALF_CLOSE, is_weekend, name_mismatch

C = F.col
#: Characters of lists that one task of ``row_warnings`` writes.
TASK_CHARS = 256 << 20


def clean_bars(raw: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows with an ISO date and a finite positive close; the first arrival of a (sym, date) wins; other prices default to close."""
    date = F.try_to_date(C("date").cast("string"), "yyyy-MM-dd")
    good = raw.withColumn("date", date).where(C("date").isNotNull() & ~F.isnan("close") & (C("close") > 0) & (C("close") < float("inf")))
    first = Window.partitionBy("sym", "date").orderBy(arrival)
    one = good.withColumn("_k", F.row_number().over(first)).where(C("_k") == 1)
    return one.select("sym", "date", *[F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")], "close", "volume")


def adjust_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices before a split are multiplied by numerator / denominator of all later splits, volumes divided (rounded)."""
    real = splits.where((C("numerator") > 0) & (C("denominator") > 0) & (C("numerator") != C("denominator")))
    s = real.select(C("sym").alias("_s"), C("date").alias("_d"), (C("numerator") / C("denominator")).alias("_f"))
    hit = bars.join(s, (C("sym") == C("_s")) & (C("_d") > C("date")), "left")
    factor = hit.groupBy(*bars.columns).agg(F.coalesce(F.product("_f"), F.lit(1.0)).alias("factor"))
    prices = [(C(c) * C("factor")).alias(c) for c in ("open", "high", "low", "close")]
    return factor.select("sym", "date", *prices, F.when(C("factor") == 1, C("volume")).otherwise(F.floor(C("volume") / C("factor") + 0.5).cast("double")).alias("volume"), "factor")


def upsert_live(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """A quote (sym, date, price) older than the last bar is ignored, one of its date replaces the close, a newer one on a
    weekday appends a bar at that price. Adds ``live``."""
    newest = Window.partitionBy("sym")
    q = quotes.select(C("sym").alias("_s"), C("date").alias("_d"), C("price").alias("_p"))
    both = bars.withColumn("_last", F.max("date").over(newest)).join(q, C("sym") == C("_s"), "left")
    same = (C("date") == C("_last")) & (C("_d") == C("date"))
    kept = both.select("sym", "date", "open", "high", "low", F.when(same, C("_p")).otherwise(C("close")).alias("close"), "volume", F.coalesce(same, F.lit(False)).alias("live"))
    fresh = both.where((C("date") == C("_last")) & (C("_d") > C("_last")) & ~is_weekend(C("_d")))
    return kept.unionByName(fresh.select("sym", C("_d").alias("date"), *[C("_p").alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("double").alias("volume"), F.lit(True).alias("live")))


def quarantine(rows: DataFrame, key: str, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, typed defaults filled in; and those without one, as they came."""
    blank = C(key).isNull() | (F.trim(C(key).cast("string")) == "")
    good = rows.where(~blank).select(*[F.coalesce(C(c), F.lit(defaults[c])).alias(c) if c in defaults else C(c) for c in rows.columns])
    return good, rows.where(blank)


def merge_history(old: DataFrame, new: DataFrame, cap: int = 50) -> DataFrame:
    """Newest score of each (sym, day), new scans before old ones, the last ``cap`` days of each symbol."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    day = Window.partitionBy("sym", "day").orderBy(F.desc("_p"), F.desc("ts"), F.desc("score"))
    last = Window.partitionBy("sym").orderBy(F.desc("day"))
    one = both.withColumn("_k", F.row_number().over(day)).where(C("_k") == 1)
    return one.withColumn("_k", F.row_number().over(last)).where(C("_k") <= cap).drop("_k", "_p")


def cap_history(df: DataFrame, key: str, order: tuple[str, ...], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_k", F.row_number().over(w)).where(C("_k") <= n).drop("_k")


def patch_prices(rows: DataFrame, quotes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields of stored rows are replaced where the quote has a value."""
    q = quotes.select(C("sym").alias("_s"), *[C(f).alias(f"_{f}") for f in fields])
    return rows.join(q, C("sym") == C("_s"), "left").select(*[F.coalesce(C(f"_{c}"), C(c)).alias(c) if c in fields else C(c) for c in rows.columns])


def fresh_rows(df: DataFrame, ts: str, as_of: Column, hours: int, day: str | None = None) -> DataFrame:
    ok = C(ts) >= as_of - F.make_interval(hours=F.lit(hours))
    return df.where(ok & (F.to_date(C(ts)) == F.lit(day).cast("date")) if day else ok)


def eligibility(bars: DataFrame, least_bars: int = 205, floor: float = 10e6, window: int = 60) -> DataFrame:
    """``sym``, ``reason``: short history, bad bar, thin trading (upper median of the last money volumes), else null."""
    newest = Window.partitionBy("sym").orderBy(F.desc("date"))
    d = bars.select("*", F.row_number().over(newest).alias("_k"), (C("close") * C("volume")).alias("_m"))
    recent = F.array_sort(F.collect_list(F.when(C("_k") <= window, C("_m"))))
    g = d.groupBy("sym").agg(F.count("*").alias("n"), F.bool_or((C("close") <= 0) | (C("high") < C("low"))).alias("bad"), recent.alias("m"))
    median = F.try_element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int"))
    return g.select("sym", "n", median.alias("median_money"), F.when(C("n") < least_bars, "short_history").when(C("bad"), "bad_bar").when(F.coalesce(median, F.lit(0.0)) < floor, "thin").alias("reason"))


def screen(universe: DataFrame, price: float, cap: float, beta: float, volume: float, exchanges: tuple[str, ...], pattern: str = "^[A-Z]{1,5}$") -> DataFrame:
    return universe.where((C("price") > price) & (C("cap") > cap) & (C("beta") > beta) & (C("volume") > volume) & ~C("is_fund") & C("exchange").isin(*exchanges) & C("ticker").rlike(pattern))


def validate_feeds(profile: DataFrame, quote: DataFrame, newest: DataFrame, as_of: Column, tolerance: float = 0.06, days: int = 6) -> DataFrame:
    """``id``, ``warnings``: symbols agree across feeds, prices agree within the tolerance, the newest bar is recent."""
    j = profile.alias("p").join(quote.alias("q"), "id").join(newest.alias("n"), "id", "left")
    gap = F.abs(C("p.price") / C("q.price") - 1)
    age = F.datediff(as_of, C("n.date"))
    return j.select("id", F.array_compact(F.array(
        F.when(C("p.sym") != C("q.sym"), "symbol"), F.when((C("q.price") > 0) & (gap > tolerance), "price"), F.when(age.isNull() | (age > days), "stale"),
    )).alias("warnings"))


def mismatch_blank(rows: DataFrame, lo: float = 0.7, hi: float = 1.43) -> DataFrame:
    """Fields of rows whose profile and quote prices are far apart are blanked; adds ``mismatch``."""
    ratio = C("profile_price") / C("quote_price")
    bad = F.coalesce((ratio < lo) | (ratio > hi), F.lit(False))
    return rows.select("id", F.when(~bad, C("profile_price")).alias("profile_price"), F.when(~bad, C("name")).alias("name"), bad.alias("mismatch"))


def flipped_names(rows: DataFrame) -> DataFrame:
    """Adds ``flipped``: the same name on several symbols of a batch. Counted per name first, then joined."""
    n = rows.groupBy("name").agg((F.count_distinct("sym") > 1).alias("flipped"))
    return rows.join(n, "name", "left")


def _cuts(chars: int | None) -> int:
    return min(-(-(chars or 1) // TASK_CHARS), 100_000)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_warnings(old: DataFrame, new: DataFrame, move: float = 0.3, swing: int = 4) -> DataFrame:
    """``sym``, ``warnings``: name now used by other symbols, price moved over ``move``, score moved at least ``swing``.

    Each row of a shared name lists all its symbols, so the output is larger than the input by the size of the groups. The
    list is written out once a name, and rows are dealt to as many tasks as their output needs (``TASK_CHARS``), rows of one
    name to several; only the sums of the sizes reach the driver.
    """
    syms = F.array_sort(F.collect_set("sym"))
    names = new.groupBy("name").agg(F.count("*").alias("_n"), F.when(F.size(syms) > 1, F.concat(F.lit("name:"), F.array_join(syms, ","))).alias("_named"))
    size = C("_n") * F.coalesce(F.length("_named"), F.lit(0))
    whole, most = names.agg(F.sum(size), F.max(size)).first()
    cuts = _cuts(most)
    deal = lambda x, salt: x.withColumn("_salt", salt).repartition(max(_cuts(whole), _tasks(new)), "name", "_salt").hint("merge")
    o = old.select(C("sym").alias("_s"), C("price").alias("_p"), C("score").alias("_c"))
    j = new.join(o.hint("merge"), C("sym") == C("_s"), "left")
    j = deal(j, F.pmod(F.xxhash64("sym"), F.lit(cuts)).cast("int")).join(deal(names, F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))), ["name", "_salt"])
    return j.select("sym", F.array_compact(F.array(
        "_named", F.when(F.abs(C("price") / C("_p") - 1) > move, "price"),
        F.when(F.abs(C("score") - C("_c")) >= swing, "score"),
    )).alias("warnings"))


def fallback_rows(new: DataFrame, old: DataFrame, bad: Column) -> DataFrame:
    """Rows that are bad keep the last good stored values, where there are any."""
    cols = [c for c in new.columns if c != "sym"]
    o = old.select(C("sym").alias("_s"), F.struct(*cols).alias("_old"))
    j = new.withColumn("_bad", bad).join(o, C("sym") == C("_s"), "left")
    pick = F.when(C("_bad") & C("_old").isNotNull(), C("_old")).otherwise(F.struct(*cols))
    return j.select("sym", pick.alias("r"), "_bad").select("sym", "r.*", C("_bad").alias("fell_back"))


def rescan_set(rows: DataFrame, as_of: Column, days: int = 2, poisoned: DataFrame | None = None) -> DataFrame:
    """Symbols never scored, scored over ``days`` ago or without average volume; with those of poisoned names."""
    stale = rows.where(C("scored_at").isNull() | (C("scored_at") < as_of - F.make_interval(days=F.lit(days))) | C("avg_volume").isNull()).select("sym")
    return (stale.unionByName(poisoned.select("sym")) if poisoned is not None else stale).distinct()


def known_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name_mismatch", name_mismatch(C("known"), C("fresh")))


def with_closures(calendar: DataFrame, closures: DataFrame) -> DataFrame:
    """A calendar (``date``, ``trading``, ``half``, ...) under unscheduled closures (``date``, ``kind``: full or half).

    A full closure ends trading on its day, a half one makes it a half day; of several entries of a day full wins. Null
    dates, other kinds and days outside the calendar change nothing. Both sides have a row a day.
    """
    c = closures.where(C("kind").isin("full", "half") & C("date").isNotNull()).groupBy("date").agg(F.min("kind").alias("_kind"))
    x = calendar.hint("merge").join(c.hint("merge"), "date", "left")
    on = lambda kind: C("_kind").eqNullSafe(kind)
    return x.withColumns({"trading": C("trading") & ~on("full"), "half": C("half") | on("half")}).drop("_kind")


def sessions(calendar: DataFrame) -> DataFrame:
    """``date``, ``trading``, ``prev`` (the trading day before), ``close_minute``, ``stale`` (that day is over three days back)."""
    prev = F.max(F.when(C("trading"), C("date"))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))  # one row a day
    close = F.when(C("half"), HALF_CLOSE).otherwise(CLOSE).alias("close_minute")
    return calendar.withColumn("prev", prev).select("date", "trading", "prev", close, F.coalesce(F.datediff("date", "prev") > 3, F.lit(False)).alias("stale"))
