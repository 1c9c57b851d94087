"""Entries, barrier exits over forward bars, rule grids, and path-dependent trade folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlefold.operators.asof import backward, forward_bars

C = F.col
REASONS = ("STOP", "TRAIL", "TARGET", "FLIP", "TIME", "EOD")
RULE_SCHEMA = "label string, target string, pct_x double, time_stop int, init_stop_atr double, hard_stop_pct double, trail_atr double, use_flip boolean"


def fresh(df: DataFrame, side: str = "side") -> DataFrame:
    """Rows whose side is set and differs from the session before: entries."""
    w = Window.partitionBy("sym").orderBy("date")
    return df.withColumn("_before", F.lag(side).over(w)).where(C(side).isNotNull() & ~C(side).eqNullSafe(C("_before"))).drop("_before")


def bounce_rule_rows() -> list[tuple]:
    targets, times = ("none", "firstUp", "rsi65", "rsi70", "close5sma", "pctB50"), (None, 2, 3, 4)
    return [(f"{t}+{d}d" if d else t, t, None, d, 2.5, None, None, True) for t in targets for d in times]


def swing_rule_rows(horizon: int = 63) -> list[tuple]:
    """Named exit rules: fixed holds, trend exits, ATR stops, chandelier trails, percentage targets and caps."""
    rows = [(f"hold{n}", "none", None, n, None, None, None, False) for n in (horizon, 40, 20)]
    for target, name in (("trendBreak", "tb"), ("maCross", "cross")):
        rows += [(f"{name}{f'_atr{s:g}' if s else ''}", target, None, horizon, s, None, None, False) for s in (None, 3.0, 4.0)]
    rows += [(f"chand{t:g}", "none", None, horizon, None, None, t, False) for t in (3.0, 4.0)] + [("chand3_tb", "trendBreak", None, horizon, None, None, 3.0, False)]
    rows += [(f"pct{int(100 * p)}_atr3", "pct", p, horizon, 3.0, None, None, False) for p in (0.15, 0.20)]
    rows += [("atr3", "none", None, horizon, 3.0, None, None, False), ("chand4_t40", "none", None, 40, None, None, 4.0, False)]
    rows += [("flip_atr3", "none", None, horizon, 3.0, None, None, True), ("flip_chand3", "none", None, horizon, None, None, 3.0, True)]
    rows += [(f"{n}_cap{int(100 * c)}", t, None, horizon, s, c, None, False) for c in (0.15, 0.20) for n, t, s in (("cross_atr4", "maCross", 4.0), ("hold", "none", None))]
    return rows


def extended_rule_rows(horizon: int = 63) -> list[tuple]:
    """The named rules, then death-cross exits with finer ATR stops and shorter and longer backstops around the shipped rule."""
    rows = swing_rule_rows(horizon)
    rows += [(f"cross_atr{a:g}", "maCross", None, horizon, a, None, None, False) for a in (3.0, 3.5, 4.0, 4.5, 5.0)]
    rows += [(f"cross_t{n}", "maCross", None, n, 4.0, None, None, False) for n in (40, 63, 84)]
    first: dict[str, tuple] = {}
    for row in rows:
        first.setdefault(row[0], row)
    return list(first.values())


def rule_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE_SCHEMA)


def exits(entries: DataFrame, bars: DataFrame, rules: DataFrame, horizon: int, atr: str = "atr14", bar_atr: str = "atr14") -> DataFrame:
    """One row per entry and rule: ``label``, ``reason``, ``hold``, ``pnl`` (percent), ``exit_date``.

    Per forward bar the first that holds: stop inside the bar (the tightest of initial ATR, fixed percentage and trail; a gap
    fills at the open), target at the close, flip of the side, time stop. Bars run out: the last close, ``EOD``.
    ``entries``: sym, rn, date, close, side (long or short), and the ATR column. ``bars`` needs what targets and the flip read.
    """
    cols = [c for c in ("date", "open", "high", "low", "close", "sma5", "sma50", "sma200", "rsi2", "pctb", bar_atr, "side") if c in bars.columns]
    e = entries.select("sym", "rn", C("date").alias("entry_date"), C("close").alias("entry"), "side", C(atr).alias("entry_atr"))
    fwd = forward_bars(e, bars, horizon, tuple(cols))
    key = ("sym", "rn")
    long = C("side") == "long"
    s = F.when(long, 1.0).otherwise(-1.0)
    seen = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    has = lambda c: f"f_{c}" in fwd.columns
    hit = {"firstUp": s * (C("f_close") - C("entry")) > 0}
    if has("rsi2"):
        hit |= {f"rsi{v}": F.when(long, C("f_rsi2") >= v).otherwise(C("f_rsi2") <= 100 - v) for v in (65, 70)}
        hit |= {"pctB50": F.when(long, C("f_pctb") >= 0.5).otherwise(C("f_pctb") <= 0.5), "close5sma": s * (C("f_close") - C("f_sma5")) >= 0}
    if has("sma200"):
        hit |= {"trendBreak": s * (C("f_close") - C("f_sma50")) < 0, "maCross": s * (C("f_sma50") - C("f_sma200")) < 0}
    yes = lambda c: F.coalesce(c, F.lit(False))
    # what no rule changes is computed once a bar, in prices that rise in the trade's favour: shorts are mirrored
    bar = fwd.select(
        *key, "entry_date", "side", "entry", "day", C("f_date").alias("exit_date"), s.alias("s"), (s * C("entry")).alias("e0"), (s * C("f_open")).alias("op"), (s * C("f_close")).alias("cl"),
        F.when(long, F.when(C("f_low") > 0, C("f_low"))).otherwise(F.when(C("f_high") > 0, -C("f_high"))).alias("worst"),
        F.when(long, F.greatest(F.max("f_high").over(seen), C("entry"))).otherwise(-F.coalesce(F.min("f_low").over(seen), C("entry"))).alias("extreme"),
        F.when(C("entry_atr") > 0, C("entry_atr")).alias("a0"),
        (F.when(C(f"f_{bar_atr}") > 0, C(f"f_{bar_atr}")).otherwise(C("entry_atr")) if has(bar_atr) else C("entry_atr")).alias("a1"),
        (F.max("day").over(Window.partitionBy(*key)) == C("day")).alias("is_last"), (yes(C("f_side") != C("side")) if has("side") else F.lit(False)).alias("flipped"),
        F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in hit.items()])).alias("hits"),
    )
    x = bar.crossJoin(F.broadcast(rules))  # rules are a fixed, short list
    stop = F.greatest(
        F.when(C("init_stop_atr") > 0, C("e0") - C("init_stop_atr") * C("a0")), F.when((C("trail_atr") > 0) & (C("a1") > 0), C("extreme") - C("trail_atr") * C("a1")),
        F.when(C("hard_stop_pct") > 0, C("e0") - C("hard_stop_pct") * C("entry")),
    )
    x = x.select("*", stop.alias("stop"))
    stopped = yes(C("worst") <= C("stop"))
    target = F.array_contains("hits", C("target")) | (C("target").isin("pct", "pctX") & yes((C("cl") - C("e0")) / C("entry") >= C("pct_x")))
    code = (
        F.when(stopped, F.when(C("trail_atr") > 0, 1).otherwise(0)).when(target, 2).when(C("use_flip") & C("flipped"), 3).when(yes(C("day") >= C("time_stop")), 4).when(C("is_last"), 5)
    )
    fill = F.when(stopped, F.least("op", "stop")).otherwise(C("cl"))
    done = x.select(*key, "entry_date", "side", "label", "day", code.alias("code"), ((fill - C("e0")) / C("entry") * 100).alias("pnl"), "exit_date").where("code is not null")
    # numbers only, so that the aggregation hashes instead of sorting
    first = done.groupBy(*key, "entry_date", "side", "label").agg(
        F.min_by("code", "day").alias("code"), F.min("day").alias("hold"), F.min_by("pnl", "day").alias("pnl"), F.min_by("exit_date", "day").alias("exit_date")
    )
    return first.select(*key, "entry_date", "side", "label", F.array(*map(F.lit, REASONS))[C("code")].alias("reason"), "hold", "pnl", "exit_date")


#: Deep exit rules: label, trail in ATRs, whether a close below the 50-bar average or a death cross ends the trade, time stop.
DEEP_RULES = (
    ("hold63", None, False, False, 63), ("hold126", None, False, False, 126), ("hold252", None, False, False, 252), ("trend_break", None, True, False, 252), ("ma_cross", None, False, True, 252),
    ("ma_cross189", None, False, True, 189), ("chand3", 3.0, False, False, 252), ("chand4", 4.0, False, False, 252), ("chand4_tb", 4.0, True, False, 252),
)


def deep_exits(entries: DataFrame, bars: DataFrame, runway: int = 504, hard_stop: float = 0.40, rules: tuple = DEEP_RULES) -> DataFrame:
    """One row per long entry and rule: ``label``, ``reason``, ``hold``, ``pnl`` (percent), ``exit_date``, ``n_ahead`` (bars within the runway).

    Per bar in this order: the hard stop, the trail (both inside the bar; a gap fills at the open), a close below the 50-bar
    average, the death cross, time. The trail hangs from the highest high from the entry bar on, which a bar joins only
    after its own checks; its ATR is the bar's or, where that is missing, the bar's before. Bars or runway run out: ``EOD``.
    Missing highs, lows and opens are the close. An entry without a bar ahead has no row.

    Every condition's first bar is found once per entry (one aggregation over the runway); the rules then choose among
    these few days, so their number multiplies entries, not bars. ``bars``: sym, rn, date, OHLC, sma50, sma200, ``atr``.
    """
    order = Window.partitionBy("sym").orderBy("rn")
    ready = bars.select(
        "sym", "rn", "date", "close", F.coalesce("open", "close").alias("open"), F.coalesce("high", "close").alias("high"), F.coalesce("low", "close").alias("low"), "sma50", "sma200",
        F.coalesce(C("atr"), F.lag("atr").over(order)).alias("atr"),
    )
    e = entries.select("sym", "rn", C("date").alias("entry_date"), C("close").alias("entry"), F.coalesce("high", "close").alias("high0"))
    fwd = forward_bars(e, ready, runway, ("date", "open", "high", "low", "close", "sma50", "sma200", "atr"))
    seen = Window.partitionBy("sym", "rn").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    x = fwd.withColumn("top", F.greatest("high0", F.max("f_high").over(seen)))
    trails = sorted({t for _, t, *_ in rules if t})
    times = sorted({t for *_, t in rules})
    lines = {"stop": C("entry") * (1 - hard_stop)} | {f"trail{t:g}": F.when(C("f_atr") > 0, C("top") - t * C("f_atr")) for t in trails}
    hits = {k: C("f_low") <= line for k, line in lines.items()}
    prices = {k: F.least("f_open", line) for k, line in lines.items()}
    hits |= {"trend": C("f_close") < C("f_sma50"), "cross": C("f_sma50") < C("f_sma200")} | {f"time{t}": C("day") >= t for t in times} | {"end": F.lit(True)}
    facts = lambda k: F.struct(C("day"), prices.get(k, C("f_close")).alias("price"), C("f_date").alias("date"))
    firsts = [(F.max if k == "end" else F.min)(F.when(hit, facts(k))).alias(k) for k, hit in hits.items()]
    per_entry = x.groupBy("sym", "rn", "entry_date", "entry").agg(*firsts, F.count("*").alias("n_ahead"))

    def outcome(label: str, trail: float | None, trend: bool, cross: bool, time: int) -> Column:
        ways = [("stop", "STOP")] + ([(f"trail{trail:g}", "TRAIL")] if trail else []) + [("trend", "TREND")] * trend + [("cross", "MACROSS")] * cross + [(f"time{time}", "TIME"), ("end", "EOD")]
        days = [F.when(C(k).isNotNull(), F.struct(C(f"{k}.day").alias("hold"), F.lit(i).alias("i"), F.lit(reason).alias("reason"), C(f"{k}.price").alias("price"), C(f"{k}.date").alias("exit_date"))) for i, (k, reason) in enumerate(ways)]
        return F.struct(F.lit(label).alias("label"), F.array_min(F.array_compact(F.array(*days))).alias("x"))

    each = per_entry.select("sym", "rn", "entry_date", "entry", "n_ahead", F.explode(F.array(*[outcome(*r) for r in rules])).alias("o"))
    return each.select("sym", "rn", "entry_date", "o.label", "o.x.reason", "o.x.hold", ((C("o.x.price") - C("entry")) / C("entry") * 100).alias("pnl"), "o.x.exit_date", "n_ahead")


def with_index(done: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``index_pnl``: the return of the index (``date``, ``close``; one row a day) in percent from the close of the entry
    to that of the exit, whatever the side; null where either day has none."""
    at = lambda day, name: F.broadcast(index.select(C("date").alias(day), C("close").alias(name)))
    x = done.join(at("entry_date", "_i0"), "entry_date", "left").join(at("exit_date", "_i1"), "exit_date", "left")
    return x.withColumn("index_pnl", F.when(C("_i0") > 0, (C("_i1") / C("_i0") - 1) * 100)).drop("_i0", "_i1")


def rule_report(done: DataFrame, *by: str) -> DataFrame:
    """Per rule: n, expectancy, win rate, profit factor, holds, extremes, per-day expectancy; with a column ``index_pnl``
    (the index over the same days, see ``with_index``) also its average and the edge over it."""
    win, loss = F.sum(F.when(C("pnl") > 0, C("pnl"))), F.sum(F.when(C("pnl") <= 0, -C("pnl")))
    beside = [F.avg("index_pnl").alias("avg_index"), (F.avg("pnl") - F.avg("index_pnl")).alias("edge")] if "index_pnl" in done.columns else []
    return done.groupBy("label", *by).agg(
        *beside, F.count("*").alias("n"), F.avg("pnl").alias("expectancy"), F.avg((C("pnl") > 0).cast("double")).alias("win_rate"),
        F.when(loss > 0, F.coalesce(win, F.lit(0.0)) / loss).alias("profit_factor"), F.avg("hold").alias("avg_hold"),
        F.expr("percentile_disc(0.5) within group (order by hold)").alias("med_hold"), F.min("pnl").alias("worst"), F.max("pnl").alias("best"),
        (F.avg("pnl") / F.avg("hold")).alias("exp_per_day"), F.count_if(C("reason").isin("STOP", "TRAIL")).alias("n_stop"), F.count_if(C("reason") == "TARGET").alias("n_target"),
        F.count_if(C("reason") == "FLIP").alias("n_flip"), F.count_if(C("reason") == "TIME").alias("n_time"), F.count_if(C("reason") == "EOD").alias("n_eod"),
    )


_TRADE = "struct<side:string,entry_date:date,entry:double,stop:double,exit_date:date,exit:double,reason:string,pnl:double>"
_OPEN = "struct<side:string,date:date,entry:double,stop:double,held:int,last:date>"


def _fold(bars: DataFrame, fields: list[Column], step) -> DataFrame:
    """Fold each symbol's bars in date order with a state of the open position and the closed trades."""
    rows = bars.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct("date", *fields))).alias("rows"))
    start = F.struct(F.lit(None).cast(_OPEN).alias("open"), F.array().cast(f"array<{_TRADE}>").alias("closed"))
    return rows.select("sym", F.aggregate("rows", start, step).alias("s"))


def _opened(side: Column, b: Column, stop: Column) -> Column:
    return F.struct(side.alias("side"), b["date"].alias("date"), b["close"].alias("entry"), stop.alias("stop"), F.lit(0).alias("held"), b["date"].alias("last")).cast(_OPEN)


def _transition(b: Column, acc: Column, long: Column, fill_stop: Column, stopped: Column, rules: list[tuple[Column, str | Column, Column]], enter: Column, reverse: Column) -> Column:
    """One session: count it, test the stop and the rules in order, book the exit, open or reverse."""
    o = acc["open"]
    held = o["held"] + F.when(b["date"] > o["last"], 1).otherwise(0)
    reason = F.when(stopped, "STOP")
    for hit, name, _ in rules:
        reason = reason.when(hit(held), name)
    reason = F.when(o.isNotNull(), reason)
    price = F.when(stopped, fill_stop).otherwise(b["close"])
    pnl = F.floor(F.when(long, price - o["entry"]).otherwise(o["entry"] - price) / o["entry"] * 10000 + F.lit(0.5)) / 100
    trade = F.struct(o["side"].alias("side"), o["date"].alias("entry_date"), o["entry"].alias("entry"), o["stop"].alias("stop"), b["date"].alias("exit_date"), price.alias("exit"), reason.alias("reason"), pnl.alias("pnl")).cast(_TRADE)
    kept = F.struct(o["side"].alias("side"), o["date"].alias("date"), o["entry"].alias("entry"), o["stop"].alias("stop"), held.alias("held"), F.greatest(b["date"], o["last"]).alias("last")).cast(_OPEN)
    none = F.lit(None).cast(_OPEN)
    now = F.when(o.isNull(), enter).when(reason.isNull(), kept).when(reason.isin("SELL", "BUY"), reverse).otherwise(none)
    return F.struct(now.alias("open"), F.when(reason.isNull(), acc["closed"]).otherwise(F.concat(acc["closed"], F.array(trade))).alias("closed"))


def bounce_trades(scored: DataFrame, time_stop: int = 3, mult: float = 2.5) -> DataFrame:
    """Two-sided paper trades from verdicts: stop, first favourable close, flip with reversal at the same price, time stop.

    Returns ``sym``, struct ``open`` (null if flat) and array ``closed`` in order of exit.
    """

    def step(acc: Column, b: Column) -> Column:
        o = acc["open"]
        long = o["side"] == "long"
        atr = F.when(b["atr5"] > 0, b["atr5"])
        start = lambda side, sign: _opened(F.lit(side), b, F.round(b["close"] + sign * mult * atr, 2))
        low, high = F.when(b["low"] > 0, b["low"]), F.when(b["high"] > 0, b["high"])
        stopped = F.coalesce(F.when(long, F.coalesce(low, b["close"]) <= o["stop"]).otherwise(F.coalesce(high, b["close"]) >= o["stop"]), F.lit(False))
        gapped = (b["open"] > 0) & F.when(long, b["open"] <= o["stop"]).otherwise(b["open"] >= o["stop"])
        touch = F.when(long, F.when(low.isNotNull(), o["stop"]).otherwise(F.least(b["close"], o["stop"]))).otherwise(F.when(high.isNotNull(), o["stop"]).otherwise(F.greatest(b["close"], o["stop"])))
        against = F.when(long, b["verdict"] == "SELL").otherwise(b["verdict"] == "BUY")
        better = F.when(long, b["close"] > o["entry"]).otherwise(b["close"] < o["entry"])
        rules = [(lambda held: better, "TARGET", None), (lambda held: against & long, "SELL", None), (lambda held: against & ~long, "BUY", None), (lambda held: held >= time_stop, "TIME", None)]
        enter = F.when(b["verdict"] == "BUY", start("long", -1)).when(b["verdict"] == "SELL", start("short", 1))
        return _transition(b, acc, long, F.when(gapped, b["open"]).otherwise(touch), stopped, rules, enter, F.when(long, start("short", 1)).otherwise(start("long", -1)))

    fields = [C(c) for c in ("open", "high", "low", "close", "verdict", "atr5")]
    return _fold(scored.where("close > 0"), fields, step).select("sym", "s.open", "s.closed")


def swing_trades(signals: DataFrame, hard_stop: float = 0.40, time_stop: int = 189) -> DataFrame:
    """Long-only paper trades from ``enter`` and ``death_cross``: stop, cross, time. Returns as ``bounce_trades``."""

    def step(acc: Column, b: Column) -> Column:
        o = acc["open"]
        low = F.when(b["low"] > 0, b["low"])
        stopped = F.coalesce(F.coalesce(low, b["close"]) <= o["stop"], F.lit(False))
        fill = F.when((b["open"] > 0) & (b["open"] <= o["stop"]), b["open"]).when(low.isNotNull(), o["stop"]).otherwise(F.least(b["close"], o["stop"]))
        rules = [(lambda held: b["death_cross"], "CROSS", None), (lambda held: held >= time_stop, "TIME", None)]
        enter = F.when(b["enter"], _opened(F.lit("long"), b, F.round(b["close"] * (1 - hard_stop), 2)))
        return _transition(b, acc, F.lit(True), fill, stopped, rules, enter, F.lit(None).cast(_OPEN))

    fields = [C(c) for c in ("open", "high", "low", "close", "enter", "death_cross")]
    return _fold(signals.where("close > 0"), fields, step).select("sym", "s.open", "s.closed")


def closed_trades(folded: DataFrame) -> DataFrame:
    return folded.select("sym", F.explode("closed").alias("t")).select("sym", "t.*")


def sticky(scored: DataFrame, floor: float = 0.20) -> DataFrame:
    """Verdict memory: a NEUTRAL read keeps the held side while its score share is at least ``floor`` and not below the other's.

    A verdict other than NEUTRAL begins a segment; its side is held up to the segment's first row that fails. Two windows
    of one order, so time is linear in a symbol's rows.
    """
    w = Window.partitionBy("sym").orderBy("date", "verdict", "buy_score", "sell_score").rowsBetween(Window.unboundedPreceding, 0)
    called = ~C("verdict").eqNullSafe("NEUTRAL")
    d = scored.select("sym", "date", "verdict", "buy_score", "sell_score", F.sum(called.cast("int")).over(w).alias("_segment"), called.alias("_called"))
    w = Window.partitionBy("sym", "_segment").orderBy(F.desc("_called"), "date", "verdict", "buy_score", "sell_score").rowsBetween(Window.unboundedPreceding, 0)
    side, buy, sell = F.first("verdict").over(w), C("buy_score") / 24, C("sell_score") / 24
    d = d.withColumn("_side", F.when(C("_segment") > 0, side))
    stays = F.when(C("_side") == "BUY", (buy >= floor) & (buy >= sell)).when(C("_side") == "SELL", (sell >= floor) & (sell >= buy))
    d = d.withColumn("_lost", F.max((~C("_called") & ~F.coalesce(stays, F.lit(False))).cast("int")).over(w))
    return d.select("sym", "date", F.when(C("_called"), C("verdict")).when(C("_lost") == 0, C("_side")).otherwise("NEUTRAL").alias("held"))


def daily_log(signals: DataFrame, trades: DataFrame, open_: DataFrame, last: int = 15) -> DataFrame:
    """Action of each of a symbol's last sessions: BUY, SELL (with reason), HOLD, WATCH (strong but not entered), FLAT.

    A symbol's trades do not overlap, so the trade that holds a session is the last one entered by then: a sweep over days
    and entries in one order. A trade that ends at a session meets it by date, beside one that begins there.
    """
    t = trades.select("sym", "entry_date", "exit_date", "reason").unionByName(
        open_.where("open is not null").select("sym", C("open.date").alias("entry_date"), F.lit(None).cast("date").alias("exit_date"), F.lit(None).cast("string").alias("reason"))
    )
    newest = Window.partitionBy("sym").orderBy(F.desc("date"))
    days = signals.withColumn("_k", F.row_number().over(newest)).where(C("_k") <= last).select("sym", "date", "watch")
    entered = t.select("sym", C("entry_date").alias("date"), F.struct("entry_date", "exit_date").alias("held"))
    inside = backward(days, entered, "held", ("sym",))
    inside = inside.withColumn("held", F.when(C("held.exit_date").isNull() | (C("date") < C("held.exit_date")), C("held")))
    sold = t.where("exit_date is not null").select(C("sym").alias("_s"), C("exit_date").alias("_d"), F.struct("reason").alias("sold"))
    x = inside.hint("merge").join(sold.hint("merge"), (C("sym") == C("_s")) & (C("date") == C("_d")), "left")
    free = F.when(C("watch"), "WATCH").otherwise("FLAT")
    in_trade = F.when(C("date") == C("held.entry_date"), "BUY").otherwise("HOLD")
    row = lambda action, reason: F.struct(action.alias("action"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    rows = F.array_compact(F.array(F.when(C("sold").isNotNull(), row(F.lit("SELL"), C("sold.reason"))), F.when(C("held").isNotNull(), row(in_trade, none)), F.when(C("sold").isNull() & C("held").isNull(), row(free, none))))
    return x.select("sym", "date", F.explode(rows).alias("r")).select("sym", "date", "r.action", "r.reason")
