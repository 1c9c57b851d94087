"""Entry labels, barrier exits over rule grids, trade folds and what follows from their trades."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlefold.operators import asof, checklist, indicators, scoring, trades
from candlefold.plans.base import VIEWS, C, bars, bounce, index_ind, ladder_sql, query, r, regime, swing
from candlefold.sources import tables

BOUNCE_RULES, SWING_RULES = trades.bounce_rule_rows(), trades.swing_rule_rows(63)
FIELDS = ("label", "target", "pct_x", "time_stop", "init_stop_atr", "hard_stop_pct", "trail_atr", "use_flip")


def lit(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def rules_sql(rows) -> str:
    return f"rules AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(FIELDS)}))"


def exits_sql(view: str, entries: str, rows, horizon: int, atr: str) -> str:
    """Exits as SQL: ``entries`` selects sym, rn, entry_date, entry, side, ea; ``view`` has side besides the bars."""
    return f""", {rules_sql(rows)}, ent AS ({entries}),
fw AS (SELECT e.*, f.rn - e.rn AS day, f.date AS fdate, f.open AS fo, f.high AS fh, f.low AS fl, f.close AS fc, f.sma5 AS f5, f.sma50 AS f50, f.sma200 AS f200, f.rsi2 AS frsi, f.pctb AS fpb, f.{atr} AS fatr, f.side AS fside,
  CASE e.side WHEN 'long' THEN greatest(e.entry, max(f.high) OVER w) ELSE coalesce(min(f.low) OVER w, e.entry) END AS ext, max(f.rn - e.rn) OVER (PARTITION BY e.sym, e.rn) AS nf
  FROM ent e JOIN {view} f ON f.sym = e.sym AND f.rn BETWEEN e.rn + 1 AND e.rn + {horizon} WINDOW w AS (PARTITION BY e.sym, e.rn ORDER BY f.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END AS s, coalesce(CASE WHEN fatr > 0 THEN fatr END, ea) AS ta FROM fw, rules),
lv AS (SELECT *, CASE WHEN init_stop_atr > 0 AND ea > 0 THEN entry - s * init_stop_atr * ea END AS l1, CASE WHEN trail_atr > 0 AND ta > 0 THEN ext - s * trail_atr * ta END AS l2, CASE WHEN hard_stop_pct > 0 THEN entry * (1 - s * hard_stop_pct) END AS l3 FROM st),
sp AS (SELECT *, CASE WHEN s > 0 THEN greatest(l1, l2, l3) ELSE least(l1, l2, l3) END AS stop FROM lv),
hit AS (SELECT *, coalesce(CASE WHEN s > 0 THEN fl <= stop ELSE fh >= stop END, false) AS stopped, coalesce(CASE WHEN s > 0 THEN fo <= stop ELSE fo >= stop END, false) AS gapped,
  coalesce(CASE target WHEN 'firstUp' THEN s * (fc - entry) > 0 WHEN 'pct' THEN s * (fc - entry) / entry >= pct_x WHEN 'rsi65' THEN CASE WHEN s > 0 THEN frsi >= 65 ELSE frsi <= 35 END WHEN 'rsi70' THEN CASE WHEN s > 0 THEN frsi >= 70 ELSE frsi <= 30 END
    WHEN 'pctB50' THEN CASE WHEN s > 0 THEN fpb >= 0.5 ELSE fpb <= 0.5 END WHEN 'close5sma' THEN s * (fc - f5) >= 0 WHEN 'trendBreak' THEN s * (fc - f50) < 0 WHEN 'maCross' THEN s * (f50 - f200) < 0 ELSE false END, false) AS tgt,
  coalesce(use_flip AND fside <> side, false) AS flip FROM sp),
ex AS (SELECT sym, rn, entry_date, side, label, day, fdate, CASE WHEN stopped THEN CASE WHEN trail_atr > 0 THEN 'TRAIL' ELSE 'STOP' END WHEN tgt THEN 'TARGET' WHEN flip THEN 'FLIP' WHEN day >= time_stop THEN 'TIME' WHEN day = nf THEN 'EOD' END AS reason,
  s * ((CASE WHEN stopped THEN CASE WHEN gapped THEN fo ELSE stop END ELSE fc END) - entry) / entry * 100 AS pnl, entry, fo, stopped, gapped FROM hit),
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym, rn, label ORDER BY day) AS k FROM ex WHERE reason IS NOT NULL) WHERE k = 1)"""


REPORT = """label, count(*) AS n, round(avg(pnl), 4) AS expectancy, round(avg((pnl > 0)::INT), 4) AS win_rate, round(CASE WHEN sum(CASE WHEN pnl <= 0 THEN -pnl END) > 0 THEN coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) / sum(CASE WHEN pnl <= 0 THEN -pnl END) END, 4) AS profit_factor,
round(avg(day), 4) AS avg_hold, quantile_disc(day, 0.5)::DOUBLE AS med_hold, round(min(pnl), 4) AS worst, round(max(pnl), 4) AS best, round(avg(pnl) / avg(day), 4) AS exp_per_day, count(*) FILTER (reason IN ('STOP', 'TRAIL')) AS n_stop, count(*) FILTER (reason = 'TARGET') AS n_target,
count(*) FILTER (reason = 'FLIP') AS n_flip, count(*) FILTER (reason = 'TIME') AS n_time, count(*) FILTER (reason = 'EOD') AS n_eod"""
FLOATS = ("expectancy", "win_rate", "profit_factor", "avg_hold", "worst", "best", "exp_per_day", "avg_index", "edge")
EDGE = "round(avg((z.close / a.close - 1) * 100), 4) AS avg_index, round(avg(pnl) - avg((z.close / a.close - 1) * 100), 4) AS edge"
WITH_INDEX = "done LEFT JOIN index_bars a ON a.date = done.entry_date LEFT JOIN index_bars z ON z.date = done.fdate"

BV = ", bside AS (SELECT *, CASE verdict WHEN 'BUY' THEN 'long' WHEN 'SELL' THEN 'short' END AS side FROM bv WHERE rn >= 200)"
B_ENTRIES = "SELECT sym, rn, date AS entry_date, close AS entry, side, atr5 AS ea FROM (SELECT *, lag(side) OVER (PARTITION BY sym ORDER BY date) AS before FROM bside) WHERE side IS NOT NULL AND side IS DISTINCT FROM before"
SW = ", sside AS (SELECT *, CASE WHEN liq_buy < 1 THEN NULL WHEN core >= 8 AND core > core_short THEN 'long' WHEN core_short >= 8 AND core_short > core THEN 'short' END AS side FROM sw)"
S_ENTRIES = "SELECT sym, rn, date AS entry_date, close AS entry, side, atr14 AS ea FROM (SELECT *, lag(side) OVER (PARTITION BY sym ORDER BY date) AS before FROM sside) WHERE side IS NOT NULL AND side IS DISTINCT FROM before"


def bounce_sides(s, d):
    return bounce(s, d).where("rn >= 200").withColumn("side", F.when(C("verdict") == "BUY", "long").when(C("verdict") == "SELL", "short"))


def swing_sides(s, d, bar=8):
    side = F.when(C("liq_buy") >= 1, F.when((C("core") >= bar) & (C("core") > C("core_short")), "long").when((C("core_short") >= bar) & (C("core_short") > C("core")), "short"))
    return swing(s, d).where("rn >= 200").withColumn("side", side)


def bounce_exits(s, d):
    from candlefold.sources.shared import kept

    x = kept(bounce_sides(s, d).select("sym", "rn", "date", "open", "high", "low", "close", "sma5", "sma50", "sma200", "rsi2", "pctb", "atr5", "side"))
    return trades.exits(trades.fresh(x), x, trades.rule_table(s, BOUNCE_RULES), 10, "atr5", "atr5")


def swing_bars(s, d):
    from candlefold.sources.shared import kept

    return kept(swing_sides(s, d).select("sym", "sector", "rn", "date", "open", "high", "low", "close", "sma50", "sma200", "atr14", "side", "core", "adv", "clean_uptrend"))


def swing_exits(s, d, rows=SWING_RULES, horizon=63):
    x = swing_bars(s, d)
    return trades.exits(trades.fresh(x), x, trades.rule_table(s, rows), horizon)


def rounded_report(df):
    return df.select(*[F.round(c, 4).alias(c) if c in FLOATS else C(c) for c in df.columns])


@query("i01_bounce_entries", BV + f", e AS ({B_ENTRIES}) SELECT sym, entry_date AS date, side, (SELECT count(*) FROM bside f WHERE f.sym = e.sym AND f.rn BETWEEN e.rn + 1 AND e.rn + 10)::INT AS n_fwd FROM e")
def i01(s, d):
    x = bounce_sides(s, d)
    last = x.groupBy("sym").agg(F.max("rn").alias("m"))
    return trades.fresh(x.select("sym", "date", "rn", "side")).join(last, "sym").select("sym", "date", "side", F.least(F.lit(10), C("m") - C("rn")).alias("n_fwd"))


@query("i02_swing_entries", SW + f", e AS ({S_ENTRIES}) SELECT sym, entry_date AS date, side, round(entry, 8) AS entry FROM e")
def i02(s, d):
    return trades.fresh(swing_sides(s, d)).select("sym", "date", "side", r("close", 8, "entry"))


@query("i03_universe_labels", SW + f", e AS ({S_ENTRIES}), m AS (SELECT sym, count(*) AS nb FROM bars GROUP BY sym HAVING count(*) >= 1200) SELECT any_value(n.r_name) AS sector, e.sym, count(*) AS n FROM e JOIN m USING (sym) JOIN (SELECT n_name AS sym, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) n USING (sym) GROUP BY e.sym")
def i03(s, d):
    from candlefold.operators.hygiene import eligibility

    ok = eligibility(bars(s, d), 1200, 0).where("reason is null").select("sym")
    return trades.fresh(swing_sides(s, d)).join(ok, "sym", "left_semi").groupBy("sym").agg(F.first("sector").alias("sector"), F.count("*").alias("n"))


@query("i04_i09_bounce_exit_grid", BV + exits_sql("bside", B_ENTRIES, BOUNCE_RULES, 10, "atr5") + f" SELECT {REPORT} FROM done GROUP BY label")
def i04(s, d):
    return rounded_report(trades.rule_report(bounce_exits(s, d)))


@query("i05_f08_swing_exit_grid", SW + exits_sql("sside", S_ENTRIES, SWING_RULES, 63, "atr14") + f" SELECT {REPORT}, {EDGE} FROM {WITH_INDEX} GROUP BY label")
def i05(s, d):
    return rounded_report(trades.rule_report(trades.with_index(swing_exits(s, d), tables.index_bars(s, d))))


@query("i04_bounce_grid_edge", BV + exits_sql("bside", B_ENTRIES, BOUNCE_RULES, 10, "atr5") + f" SELECT {REPORT}, {EDGE} FROM {WITH_INDEX} GROUP BY label")
def i04e(s, d):
    """The bounce grid's rules against the index over the same sessions."""
    return rounded_report(trades.rule_report(trades.with_index(bounce_exits(s, d), tables.index_bars(s, d))))


EXTENDED = trades.extended_rule_rows(63)


@query("i09_extended_grid", SW + exits_sql("sside", S_ENTRIES, EXTENDED, 84, "atr14") + f" SELECT {REPORT}, {EDGE} FROM {WITH_INDEX} GROUP BY label")
def i09(s, d):
    """The named rules and the neighbours of the shipped one, over up to 84 sessions."""
    return rounded_report(trades.rule_report(trades.with_index(swing_exits(s, d, EXTENDED, 84), tables.index_bars(s, d))))


@query("i06_deep_exits", SW + f""", dr AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in trades.DEEP_RULES)}) t(label, trail, trend, cross_, time)),
t AS (SELECT sym, date, tr, row_number() OVER (PARTITION BY sym ORDER BY date) AS k FROM ind WHERE tr IS NOT NULL), seed AS (SELECT sym, avg(tr) AS v FROM t WHERE k <= 14 GROUP BY sym HAVING count(*) = 14),
wa AS (SELECT t.sym, t.date, t.k, power(13/14.0, t.k - 14) * (seed.v + coalesce(sum(CASE WHEN t.k >= 15 THEN t.tr * power(14/13.0, t.k - 14) END) OVER (PARTITION BY t.sym ORDER BY t.k), 0) / 14) AS atr FROM t JOIN seed USING (sym)),
ba AS (SELECT ind.*, wa.atr FROM ind LEFT JOIN wa ON wa.sym = ind.sym AND wa.date = ind.date AND wa.k >= 14),
en AS (SELECT sym, rn, date AS entry_date, close AS entry, high AS high0 FROM (SELECT *, lag(side) OVER (PARTITION BY sym ORDER BY date) AS before FROM sside) WHERE side = 'long' AND side IS DISTINCT FROM before),
fw AS (SELECT e.*, f.rn - e.rn AS day, f.date AS fdate, f.open AS fo, f.low AS fl, f.close AS fc, f.sma50, f.sma200, f.atr, greatest(e.high0, max(f.high) OVER w) AS top, max(f.rn - e.rn) OVER (PARTITION BY e.sym, e.rn) AS nf
  FROM en e JOIN ba f ON f.sym = e.sym AND f.rn BETWEEN e.rn + 1 AND e.rn + 504 WINDOW w AS (PARTITION BY e.sym, e.rn ORDER BY f.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ex AS (SELECT sym, rn, label, day, fdate, nf, entry, fo, fc, top - trail * atr AS line, CASE WHEN fl <= entry * 0.6 THEN 'STOP' WHEN fl <= coalesce(top, high0) - trail * atr THEN 'TRAIL' WHEN trend AND fc < sma50 THEN 'TREND' WHEN cross_ AND sma50 < sma200 THEN 'MACROSS' WHEN day >= time THEN 'TIME' WHEN day = nf THEN 'EOD' END AS reason FROM fw, dr),
done AS (SELECT *, (CASE reason WHEN 'STOP' THEN least(fo, entry * 0.6) WHEN 'TRAIL' THEN least(fo, line) ELSE fc END / entry - 1) * 100 AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY sym, rn, label ORDER BY day) AS k FROM ex WHERE reason IS NOT NULL) WHERE k = 1)
SELECT label, nf >= 252 AS full_year, count(*) AS n, round(avg(pnl), 4) AS expectancy, round(avg((pnl > 0)::INT), 4) AS win_rate, round(avg(day), 4) AS avg_hold, round(min(pnl), 4) AS worst, count(*) FILTER (reason = 'STOP') AS n_stop, count(*) FILTER (reason = 'TRAIL') AS n_trail,
  count(*) FILTER (reason IN ('TREND', 'MACROSS')) AS n_trend, count(*) FILTER (reason = 'TIME') AS n_time, count(*) FILTER (reason = 'EOD') AS n_eod FROM done GROUP BY ALL""")
def i06(s, d):
    """Nine deep exit rules on long entries, for those with a year of sessions ahead and for the others; trails by smoothed ATR."""
    from candlefold.sources.shared import kept

    atr = indicators.wilder(bars(s, d)).select("sym", "date", "atr")
    x = kept(swing_sides(s, d).select("sym", "rn", "date", "open", "high", "low", "close", "sma50", "sma200", "side").hint("merge").join(atr.hint("merge"), ["sym", "date"], "left"))
    done = trades.deep_exits(trades.fresh(x).where("side = 'long'"), x)
    share = lambda *names: F.count_if(C("reason").isin(*names))
    g = done.groupBy("label", (C("n_ahead") >= 252).alias("full_year")).agg(
        F.count("*").alias("n"), r(F.avg("pnl"), 4, "expectancy"), r(F.avg((C("pnl") > 0).cast("double")), 4, "win_rate"), r(F.avg("hold"), 4, "avg_hold"), r(F.min("pnl"), 4, "worst"),
        share("STOP").alias("n_stop"), share("TRAIL").alias("n_trail"), share("TREND", "MACROSS").alias("n_trend"), share("TIME").alias("n_time"), share("EOD").alias("n_eod"),
    )
    return g


@query("i04_bounce_exits_rows", BV + exits_sql("bside", B_ENTRIES, BOUNCE_RULES[:6], 10, "atr5") + " SELECT sym, entry_date, label, reason, day::INT AS hold, round(pnl, 4) AS pnl FROM done")
def i04r(s, d):
    x = bounce_sides(s, d).select("sym", "rn", "date", "open", "high", "low", "close", "sma5", "rsi2", "pctb", "atr5", "side")
    done = trades.exits(trades.fresh(x), x, trades.rule_table(s, BOUNCE_RULES[:6]), 10, "atr5", "atr5")
    return done.select("sym", "entry_date", "label", "reason", "hold", r("pnl"))


HOLDS = [(f"hold{n}", "none", None, n, None, None, None, False) for n in range(63, 253, 21)]


@query("i07_hold_sweep", SW + exits_sql("sside", S_ENTRIES, HOLDS, 252, "atr14") + " SELECT label, nf >= 252 AS full_runway, count(*) AS n, round(avg(pnl), 4) AS expectancy FROM done JOIN (SELECT DISTINCT sym, rn, nf FROM fw) USING (sym, rn) GROUP BY ALL")
def i07(s, d):
    """Hold times against each other, for entries with the whole runway and for the others."""
    x = swing_bars(s, d)
    e = trades.fresh(x)
    last = x.groupBy("sym").agg(F.max("rn").alias("m"))
    done = trades.exits(e, x, trades.rule_table(s, HOLDS), 252).hint("merge").join(last, "sym")
    g = done.groupBy("label", (C("m") - C("rn") >= 252).alias("full_runway")).agg(F.count("*").alias("n"), F.avg("pnl").alias("expectancy"))
    return g.select("label", "full_runway", "n", r("expectancy"))


FILTERS = {"all": "true", "core9": "core >= 9", "core10": "core >= 10", "mom3": "mom_buy >= 3", "trend3": "trend_buy >= 3", "sector2": "sec_buy >= 2", "volume2": "vol_buy >= 2", "liquid": "adv >= 120000", "leader": "trend_buy >= 3 AND mom_buy >= 2 AND sec_buy >= 2"}
_F42 = " UNION ALL ".join(f"SELECT '{k}' AS filter, * FROM ed WHERE {v}" for k, v in FILTERS.items())


@query("f42_entry_filters", SW + f""", le AS (SELECT *, lag(side) OVER w AS before, lead(close, 63) OVER w AS ahead63, lead(close, 126) OVER w AS ahead126, lead(date, 63) OVER w AS d63, lead(date, 126) OVER w AS d126 FROM sside WINDOW w AS (PARTITION BY sym ORDER BY date)),
ed AS (SELECT le.*, (ahead126 / le.close - 1) * 100 AS p126, (ahead63 / le.close - 1) * 100 - (y.close / x.close - 1) * 100 AS e63, (ahead126 / le.close - 1) * 100 - (z.close / x.close - 1) * 100 AS e126
  FROM le LEFT JOIN index_bars x ON x.date = le.date LEFT JOIN index_bars y ON y.date = d63 LEFT JOIN index_bars z ON z.date = d126 WHERE side = 'long' AND side IS DISTINCT FROM before AND ahead126 IS NOT NULL), al AS ({_F42})
SELECT filter, count(*) AS n, round(avg(e63), 4) AS edge63, round(avg(e126), 4) AS edge126, round(avg(p126), 4) AS avg126, round(avg((p126 > 0)::INT), 4) AS win126, round(avg((e126 > 0)::INT), 4) AS beats,
  round(avg(e126) FILTER (date < DATE '1997-01-01'), 4) AS in_edge, round(avg(e126) FILTER (date >= DATE '1997-01-01'), 4) AS out_edge FROM al GROUP BY filter""")
def f42(s, d):
    """Filters of long entries that have 126 sessions ahead: edge over the index after 63 and 126, share beating it, in and out of sample."""
    w, ix = Window.partitionBy("sym").orderBy("date"), tables.index_bars(s, d)
    ahead = [F.lead(c, n).over(w).alias(f"{c[0]}{n}") for c in ("close", "date") for n in (63, 126)]
    e = swing_sides(s, d).select("*", F.lag("side").over(w).alias("before"), *ahead).where("side = 'long' and not (side <=> before) and c126 is not null")
    for day, name in (("date", "x"), ("d63", "y"), ("d126", "z")):  # one row a day
        e = e.join(F.broadcast(ix.select(C("date").alias(day), C("close").alias(name))), day, "left")
    back = lambda n, to: (C(f"c{n}") / C("close") - 1) * 100 - (C(to) / C("x") - 1) * 100
    named = F.explode(F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in FILTERS.items()])))
    e = e.select("date", ((C("c126") / C("close") - 1) * 100).alias("p126"), back(63, "y").alias("e63"), back(126, "z").alias("e126"), named.alias("filter"))
    early = C("date") < F.lit("1997-01-01").cast("date")
    return e.groupBy("filter").agg(
        F.count("*").alias("n"), r(F.avg("e63"), 4, "edge63"), r(F.avg("e126"), 4, "edge126"), r(F.avg("p126"), 4, "avg126"), r(F.avg((C("p126") > 0).cast("double")), 4, "win126"),
        r(F.avg((C("e126") > 0).cast("double")), 4, "beats"), r(F.avg(F.when(early, C("e126"))), 4, "in_edge"), r(F.avg(F.when(~early, C("e126"))), 4, "out_edge"),
    )


_PTS = " + ".join("coalesce(" + ladder_sql(k, cuts, ">=") + ", 0)" for k, cuts in checklist.BLOCK.items())
_HAVE = " + ".join(f"({k} IS NOT NULL)::INT" for k in checklist.BLOCK)


@query("f29_fundamental_block", SW + f""", le AS (SELECT *, lag(side) OVER w AS before, (lead(close, 21) OVER w / close - 1) * 100 AS fwd FROM sside WINDOW w AS (PARTITION BY sym ORDER BY date)),
s1 AS (SELECT *, CASE WHEN count(*) OVER q = 4 THEN sum(revenue) OVER q END AS ttm, CASE WHEN count(*) OVER q = 4 THEN sum(n_orders) OVER q END AS orders, lag(revenue, 4) OVER (PARTITION BY sym ORDER BY period_end) AS y_ago FROM statements WINDOW q AS (PARTITION BY sym ORDER BY period_end ROWS 3 PRECEDING)),
s2 AS (SELECT sym, accepted_date, revenue / y_ago - 1 AS growth_q, ttm / lag(ttm, 4) OVER (PARTITION BY sym ORDER BY period_end) - 1 AS growth_ttm, revenue * 4 / ttm AS pace, (revenue / n_orders) / (ttm / orders) AS order_value FROM s1),
en AS (SELECT le.sym, le.sector, le.date, le.fwd, le.core, {_PTS} AS points FROM le ASOF JOIN s2 ON s2.sym = le.sym AND le.date >= s2.accepted_date WHERE le.side = 'long' AND le.side IS DISTINCT FROM le.before AND le.fwd IS NOT NULL AND {_HAVE} >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY points, sym, date) AS k, count(*) OVER (PARTITION BY sector) AS m FROM en)
SELECT sector, count(*) AS n, round(avg(fwd) FILTER (k <= m // 2), 4) AS low_avg, round(avg(fwd) FILTER (k > m // 2), 4) AS high_avg, round(avg(fwd) FILTER (k > m // 2) - avg(fwd) FILTER (k <= m // 2), 4) AS lift, round(corr(points, fwd), 4) AS ic, round(corr(points, core), 4) AS corr_core FROM k GROUP BY sector""")
def f29b(s, d):
    """Long entries by the summed points of the statements published by then: the lower and the upper half of each universe (sector).

    An entry takes part if at least three of the four statement factors are known."""
    w = Window.partitionBy("sym").orderBy("date")
    ahead = ((F.lead("close", 21).over(w) / C("close") - 1) * 100).alias("fwd")
    e = swing_sides(s, d).select("sym", "sector", "date", "core", "side", F.lag("side").over(w).alias("before"), ahead)
    e = e.where("side = 'long' and not (side <=> before) and fwd is not null").drop("side", "before")
    facts = checklist.block_inputs(tables.statements(s, d)).select("sym", C("accepted_date").alias("date"), F.struct(*checklist.BLOCK).alias("facts"))
    x = checklist.block_points(asof.backward(e, facts, "facts", ("sym",)).select("sym", "sector", "date", "core", "fwd", "facts.*")).where("points is not null")
    half = Window.partitionBy("sector")
    x = x.select("*", (F.row_number().over(half.orderBy("points", "sym", "date")) > F.floor(F.count("*").over(half) / 2)).alias("high"))
    low, high = F.avg(F.when(~C("high"), C("fwd"))), F.avg(F.when(C("high"), C("fwd")))
    return x.groupBy("sector").agg(F.count("*").alias("n"), r(low, 4, "low_avg"), r(high, 4, "high_avg"), r(high - low, 4, "lift"), r(F.corr("points", "fwd"), 4, "ic"), r(F.corr("points", "core"), 4, "corr_core"))


BACKSTOP = [(f"cross_{n}", "maCross", None, n, None, 0.4, None, False) for n in range(63, 505, 63)]


@query("i08_backstop_sweep", SW + exits_sql("sside", S_ENTRIES, BACKSTOP, 504, "atr14") + f" SELECT {REPORT} FROM done JOIN (SELECT DISTINCT sym, rn FROM fw WHERE nf >= 504) USING (sym, rn) GROUP BY label")
def i08(s, d):
    """Backstops of 63 to 504 sessions, for the entries that have all of 504 sessions ahead."""
    x = swing_bars(s, d)
    last = x.groupBy("sym").agg(F.max("rn").alias("m"))
    full = trades.fresh(x).hint("merge").join(last, "sym").where("m - rn >= 504").drop("m")
    return rounded_report(trades.rule_report(trades.exits(full, x, trades.rule_table(s, BACKSTOP), 504)))


@query("i10_f25_gap_through", SW + exits_sql("sside", S_ENTRIES, SWING_RULES[7:9] + SWING_RULES[-4:], 63, "atr14") + " SELECT label, count(*) FILTER (reason IN ('STOP', 'TRAIL')) AS stops, count(*) FILTER (stopped AND gapped) AS gaps, count(*) FILTER (pnl < -25) AS tail FROM done GROUP BY label")
def i10(s, d):
    """A stop filled at the open rather than at its level is a gap: the exit price equals the bar's open."""
    rows = SWING_RULES[7:9] + SWING_RULES[-4:]
    x = swing_bars(s, d)
    done = trades.exits(trades.fresh(x), x, trades.rule_table(s, rows), 63)
    e = x.select("sym", C("rn").alias("_r"), C("close").alias("entry"))
    o = x.select("sym", C("date").alias("_d"), C("open").alias("fo"))
    j = done.join(e.hint("merge"), (done.sym == e.sym) & (C("rn") == C("_r"))).drop(e.sym).alias("a").join(o.hint("merge").alias("b"), (C("a.sym") == C("b.sym")) & (C("exit_date") == C("_d")))
    sign = F.when(C("side") == "long", 1.0).otherwise(-1.0)
    stop = C("reason").isin("STOP", "TRAIL")
    gap = stop & (F.abs(C("pnl") - sign * (C("fo") - C("entry")) / C("entry") * 100) < 1e-9)
    return j.groupBy("label").agg(F.count_if(stop).alias("stops"), F.count_if(gap).alias("gaps"), F.count_if(C("pnl") < -25).alias("tail"))


@query("i11_sides_compared", SW + exits_sql("sside", S_ENTRIES, SWING_RULES[:1], 63, "atr14") + " SELECT side, count(*) AS n, round(avg(pnl), 4) AS expectancy FROM done GROUP BY ROLLUP (side)")
def i11(s, d):
    g = swing_exits(s, d, SWING_RULES[:1]).rollup("side").agg(F.count("*").alias("n"), F.avg("pnl").alias("expectancy"))
    return g.select("side", "n", r("expectancy"))


@query("i12_i15_gate_counts", SW + ", t AS (SELECT unnest([6, 8, 10]) AS bar) SELECT bar::INT AS bar, count(*) FILTER (core >= bar) AS ungated, count(*) FILTER (core >= bar AND clean_uptrend AND rs126 >= 0.3) AS gated, count(*) FILTER (core >= bar AND clean_uptrend AND rs126 >= 0.3) < count(*) FILTER (core >= bar) AS binds FROM sside, t GROUP BY bar")
def i12(s, d):
    bar = s.createDataFrame([(b,) for b in (6, 8, 10)], "bar int")
    x = swing_sides(s, d).select("core", "clean_uptrend", "rs126").crossJoin(F.broadcast(bar))
    on = C("core") >= C("bar")
    gate = on & C("clean_uptrend") & (C("rs126") >= 0.3)
    g = x.groupBy("bar").agg(F.count_if(on).alias("ungated"), F.count_if(gate).alias("gated"))
    return g.select("*", (C("gated") < C("ungated")).alias("binds"))


@query("i13_market_overlay", SW + exits_sql("sside", S_ENTRIES, SWING_RULES[:1], 63, "atr14") + " SELECT coalesce(ix.close > ix.sma200, false) AS above, count(*) AS n, round(avg(pnl), 4) AS expectancy, round(avg((pnl > 0)::INT), 4) AS win FROM done LEFT JOIN ix ON ix.date = entry_date GROUP BY 1")
def i13(s, d):
    i = index_ind(s, d).select(C("date").alias("entry_date"), (C("close") > C("sma200")).alias("up"))
    g = swing_exits(s, d, SWING_RULES[:1]).join(F.broadcast(i), "entry_date", "left").groupBy(F.coalesce("up", F.lit(False)).alias("above")).agg(F.count("*").alias("n"), F.avg("pnl").alias("expectancy"), F.avg((C("pnl") > 0).cast("double")).alias("win"))
    return g.select("above", "n", r("expectancy"), r("win"))


@query("i14_survivorship", SW + exits_sql("sside", S_ENTRIES, SWING_RULES[:1], 63, "atr14") + " SELECT m.last < (SELECT max(date) FROM bars) - 2 AS ended, count(*) AS n, round(avg(pnl), 4) AS expectancy, count(*) FILTER (reason = 'EOD') AS eod FROM done JOIN (SELECT sym, max(date) AS last FROM bars GROUP BY sym) m USING (sym) GROUP BY 1")
def i14(s, d):
    """Names whose bars end early count as delisted; their open trades end at the last bar."""
    m = bars(s, d).groupBy("sym").agg(F.max("date").alias("last"))
    end = m.agg(F.date_sub(F.max("last"), 2).alias("cut"))
    m = m.crossJoin(F.broadcast(end)).select("sym", (C("last") < C("cut")).alias("ended"))
    g = swing_exits(s, d, SWING_RULES[:1]).hint("merge").join(m.hint("merge"), "sym").groupBy("ended").agg(F.count("*").alias("n"), F.avg("pnl").alias("expectancy"), F.count_if(C("reason") == "EOD").alias("eod"))
    return g.select("ended", "n", r("expectancy"), "eod")


@query("g05_rank_rules", BV + exits_sql("bside", B_ENTRIES, BOUNCE_RULES, 10, "atr5") + ", rep AS (SELECT label, avg(pnl) / avg(day) AS e FROM done GROUP BY label) SELECT label, (row_number() OVER (ORDER BY e DESC NULLS LAST, label))::INT AS rank FROM rep")
def g05(s, d):
    rep = trades.rule_report(bounce_exits(s, d))
    return rep.select("label", F.row_number().over(Window.orderBy(F.desc_nulls_last("exp_per_day"), "label")).alias("rank"))  # one row a rule


@query("f40_cap_exit_grid", SW + exits_sql("sside", S_ENTRIES + " AND clean_uptrend", SWING_RULES[:1] + SWING_RULES[-4:], 63, "atr14") + ", t AS (SELECT d.*, s.adv >= 80000 AS large FROM done d JOIN sside s USING (sym, rn)) SELECT label, large, count(*) AS n, round(avg(pnl), 4) AS expectancy, round(min(pnl), 4) AS worst FROM t GROUP BY ALL")
def f40(s, d):
    x = swing_bars(s, d)
    e = trades.fresh(x).where("clean_uptrend")
    done = trades.exits(e, x, trades.rule_table(s, SWING_RULES[:1] + SWING_RULES[-4:]), 63)
    g = done.hint("merge").join(e.select("sym", "rn", (C("adv") >= 80000).alias("large")).hint("merge"), ["sym", "rn"]).groupBy("label", "large").agg(F.count("*").alias("n"), F.avg("pnl").alias("expectancy"), F.min("pnl").alias("worst"))
    return g.select("label", "large", "n", r("expectancy"), r("worst"))


# ---- K: folds ------------------------------------------------------------------------------------------------------


def bounce_fold_sql(time_stop: int = 3, mult: float = 2.5) -> str:
    """The fold as a recursion: a step is the next session of every symbol."""
    level = "round(close + CASE WHEN {t} = 'long' THEN -1 ELSE 1 END * " + f"{mult} * atr, 2)"
    turned = "CASE WHEN side IS NULL THEN CASE verdict WHEN 'BUY' THEN 'long' WHEN 'SELL' THEN 'short' END WHEN reason IS NULL THEN side WHEN reason = 'SELL' THEN 'short' WHEN reason = 'BUY' THEN 'long' END"
    return f"""WITH RECURSIVE {VIEWS}, q AS MATERIALIZED (SELECT sym, date, open, CASE WHEN high > 0 THEN high END AS high, CASE WHEN low > 0 THEN low END AS low, close, verdict, CASE WHEN atr5 > 0 THEN atr5 END AS atr,
  row_number() OVER (PARTITION BY sym ORDER BY date) AS k FROM bv WHERE rn >= 200 AND close > 0),
fold AS (SELECT sym, 0::BIGINT AS k, NULL::VARCHAR AS side, NULL::DATE AS since, NULL::DOUBLE AS entry, NULL::DOUBLE AS stop, 0 AS held, NULL::VARCHAR AS was, NULL::DATE AS opened, NULL::DATE AS date, NULL::VARCHAR AS reason, NULL::DOUBLE AS pnl FROM q WHERE k = 1
UNION ALL
SELECT sym, k, t, CASE WHEN t IS NULL THEN NULL WHEN kept THEN since ELSE date END, CASE WHEN t IS NULL THEN NULL WHEN kept THEN entry ELSE close END, CASE WHEN t IS NULL THEN NULL WHEN kept THEN stop ELSE {level.format(t='t')} END,
  CASE WHEN kept THEN held ELSE 0 END, side, since, date, reason, floor(CASE WHEN side = 'long' THEN px - entry ELSE entry - px END / entry * 10000 + 0.5) / 100
FROM (SELECT *, {turned} AS t, side IS NOT NULL AND reason IS NULL AS kept,
    CASE WHEN reason <> 'STOP' THEN close WHEN open > 0 AND CASE WHEN side = 'long' THEN open <= stop ELSE open >= stop END THEN open
      WHEN side = 'long' THEN CASE WHEN low IS NULL THEN least(close, stop) ELSE stop END ELSE CASE WHEN high IS NULL THEN greatest(close, stop) ELSE stop END END AS px
  FROM (SELECT *, CASE WHEN side IS NULL THEN NULL WHEN CASE WHEN side = 'long' THEN coalesce(low, close) <= stop ELSE coalesce(high, close) >= stop END THEN 'STOP'
      WHEN CASE WHEN side = 'long' THEN close > entry ELSE close < entry END THEN 'TARGET' WHEN side = 'long' AND verdict = 'SELL' OR side = 'short' AND verdict = 'BUY' THEN verdict WHEN held >= {time_stop} THEN 'TIME' END AS reason
    FROM (SELECT q.*, side, since, entry, stop, held + 1 AS held FROM fold JOIN q ON q.sym = fold.sym AND q.k = fold.k + 1))))
SELECT sym, was AS side, opened AS entry_date, date AS exit_date, reason, round(pnl, 2) AS pnl FROM fold WHERE reason IS NOT NULL"""


@query("k01_bounce_fold", bounce_fold_sql(), views=False)
def k01(s, d):
    """Two-sided paper trades; also tested against a loop over the rows."""
    return trades.closed_trades(trades.bounce_trades(bounce(s, d).where("rn >= 200"))).select("sym", "side", "entry_date", "exit_date", "reason", r("pnl", 2))


def swing_signals(s, d):
    x = swing(s, d).where("rn >= 200")
    return x.select("sym", "date", "open", "high", "low", "close", "core", "clean_uptrend", (C("clean_uptrend") & (C("core") >= 9)).alias("enter"), "death_cross")


K2 = """, sig AS (SELECT sym, date, rn, open, low, close, clean_uptrend AND core >= 9 AS enter, death_cross, core, clean_uptrend FROM sw),
e AS (SELECT sym, rn, date, close, round(close * 0.6, 2) AS stop FROM sig WHERE enter),
x AS (SELECT e.sym, e.rn, e.date, e.close AS entry, e.stop, f.rn AS xrn, f.date AS xdate, CASE WHEN f.low <= e.stop THEN 'STOP' WHEN f.death_cross THEN 'CROSS' ELSE 'TIME' END AS reason, CASE WHEN f.low <= e.stop THEN CASE WHEN f.open <= e.stop THEN f.open ELSE e.stop END ELSE f.close END AS px
  FROM e JOIN sig f ON f.sym = e.sym AND f.rn > e.rn WHERE f.low <= e.stop OR f.death_cross OR f.rn - e.rn >= 189),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym, rn ORDER BY xrn) AS k FROM x) WHERE k = 1),
allx AS (SELECT e.sym, e.rn, e.date, e.close AS entry, f.xrn, f.xdate, f.reason, f.px FROM e LEFT JOIN first f ON f.sym = e.sym AND f.rn = e.rn)"""


def k2_sql(tail: str) -> str:
    from candlefold.plans.base import VIEWS

    return f"""WITH RECURSIVE {VIEWS}{K2}, t AS (SELECT a.* FROM allx a WHERE rn = (SELECT min(rn) FROM e WHERE e.sym = a.sym)
UNION ALL SELECT a.* FROM t JOIN allx a ON a.sym = t.sym AND a.rn = (SELECT min(b.rn) FROM e b WHERE b.sym = t.sym AND b.rn > t.xrn))
{tail}"""


def _k(name: str, tail: str):
    return query(name, k2_sql(tail), views=False)


@_k("k02_swing_fold", "SELECT sym, date AS entry_date, xdate AS exit_date, reason, floor((px - entry) / entry * 10000 + 0.5) / 100 AS pnl FROM t WHERE xrn IS NOT NULL")
def k02(s, d):
    return trades.closed_trades(trades.swing_trades(swing_signals(s, d))).select("sym", "entry_date", "exit_date", "reason", "pnl")


@_k("k03_replay_benchmark", "SELECT t.sym, t.date AS entry_date, floor((px - entry) / entry * 10000 + 0.5) / 100 AS pnl, floor((b.close - a.close) / a.close * 10000 + 0.5) / 100 AS bench_pct FROM t JOIN index_bars a ON a.date = t.date JOIN index_bars b ON b.date = t.xdate WHERE xrn IS NOT NULL")
def k03(s, d):
    t = trades.closed_trades(trades.swing_trades(swing_signals(s, d))).select("sym", "entry_date", "exit_date", "pnl")
    return asof.benchmark_return(t, tables.index_bars(s, d)).select("sym", "entry_date", "pnl", "bench_pct")


@_k("k04_daily_log", """, ds AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM sig)
SELECT ds.sym, ds.date, CASE WHEN ds.date = t.xdate THEN 'SELL' WHEN ds.date = t.date THEN 'BUY' WHEN t.date IS NOT NULL THEN 'HOLD' WHEN core >= 7 AND clean_uptrend THEN 'WATCH' ELSE 'FLAT' END AS action, CASE WHEN ds.date = t.xdate THEN reason END AS reason
FROM ds LEFT JOIN t ON t.sym = ds.sym AND ds.date >= t.date AND (t.xdate IS NULL OR ds.date <= t.xdate) WHERE k <= 240""")
def k04(s, d):
    from candlefold.sources.shared import kept

    sig = kept(swing_signals(s, d))
    folded = kept(trades.swing_trades(sig))
    days = sig.select("sym", "date", ((C("core") >= 7) & C("clean_uptrend")).alias("watch"))
    return trades.daily_log(days, trades.closed_trades(folded), folded, 240)


STICKY = """, c AS (SELECT sym, date, verdict, buy_score / 24.0 AS b, sell_score / 24.0 AS q, sum((verdict <> 'NEUTRAL')::INT) OVER (PARTITION BY sym ORDER BY date) AS seg FROM bv),
d AS (SELECT *, CASE WHEN seg > 0 THEN first_value(verdict) OVER (PARTITION BY sym, seg ORDER BY date) END AS side FROM c),
e AS (SELECT *, max((verdict = 'NEUTRAL' AND NOT coalesce(CASE side WHEN 'BUY' THEN b >= 0.2 AND b >= q WHEN 'SELL' THEN q >= 0.2 AND q >= b END, false))::INT) OVER (PARTITION BY sym, seg ORDER BY date) AS lost FROM d)
SELECT sym, date, CASE WHEN verdict <> 'NEUTRAL' THEN verdict WHEN lost = 0 THEN side ELSE 'NEUTRAL' END AS held FROM e"""


@query("k05_sticky_verdict", STICKY)
def k05(s, d):
    x = bounce(s, d).select("sym", "date", "verdict", "buy_score", "sell_score")
    return trades.sticky(x)


LOGS = "WITH seed AS (SELECT user_id AS sym, CAST(ts AS DATE) AS entry, value AS pnl, ts, event_id FROM events WHERE event_id % 3 <> 0), fwd AS (SELECT user_id AS sym, CAST(ts AS DATE) AS entry, -value AS pnl, ts, event_id FROM events WHERE event_id % 3 = 0)"


@query("k06_seed_merge", LOGS + ", u AS (SELECT *, 0 AS p FROM fwd UNION ALL SELECT *, 1 FROM seed), k AS (SELECT *, row_number() OVER (PARTITION BY sym, entry ORDER BY p, ts, event_id) AS k FROM u) SELECT sym, entry, round(pnl, 6) AS pnl FROM k WHERE k = 1 AND NOT (p = 1 AND sym % 10 = 0)", views=False)
def k06(s, d):
    """Forward records win over seeded ones of the same entry; seeded copies of still open keys go (every tenth is open)."""
    e = tables.table(s, d, "events").select(C("user_id").alias("sym"), F.to_date("ts").alias("entry"), "value", "ts", "event_id")
    f = e.where("event_id % 3 = 0").select("*", (-C("value")).alias("pnl"), F.lit(0).alias("p"))
    seed = e.where("event_id % 3 <> 0").select("*", C("value").alias("pnl"), F.lit(1).alias("p"))
    w = Window.partitionBy("sym", "entry").orderBy("p", "ts", "event_id")
    one = f.unionByName(seed).withColumn("k", F.row_number().over(w)).where("k = 1 and not (p = 1 and sym % 10 = 0)")
    return one.select("sym", "entry", r("pnl", 6))


@query("k07_prune", "SELECT sym, event_id FROM (SELECT user_id AS sym, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 15) WHERE k <= 20", views=False)
def k07(s, d):
    from candlefold.operators.hygiene import cap_history

    e = tables.table(s, d, "events").where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-30").cast("date"), 15))
    return cap_history(e.select(C("user_id").alias("sym"), "event_id", "ts"), "sym", ("ts", "event_id"), 20).select("sym", "event_id")


@query("k08_reseed", "SELECT user_id AS sym, max((event_id % 7)::INT) AS version FROM events GROUP BY user_id HAVING max(event_id % 7) < 6 OR count(*) < 60", views=False)
def k08(s, d):
    g = tables.table(s, d, "events").groupBy(C("user_id").alias("sym")).agg(F.max((C("event_id") % 7).cast("int")).alias("version"), F.count("*").alias("n"))
    return g.where("version < 6 or n < 60").select("sym", "version")


@query("k09_alert_transitions", ", v AS (SELECT sym, date, verdict, lag(verdict) OVER (PARTITION BY sym ORDER BY date) AS was FROM bv) SELECT sym, date, CASE WHEN verdict = 'NEUTRAL' THEN 'exit' ELSE 'entry' END AS event, verdict FROM v WHERE was IS NOT NULL AND was <> verdict")
def k09(s, d):
    w = Window.partitionBy("sym").orderBy("date")
    v = bounce(s, d).select("sym", "date", "verdict", F.lag("verdict").over(w).alias("was")).where("was <> verdict")
    return v.select("sym", "date", F.when(C("verdict") == "NEUTRAL", "exit").otherwise("entry").alias("event"), "verdict")


PULSE = ", p AS (SELECT sym, date, close AS entry, verdict, atr5, lead(close, 2) OVER w AS px, lead(verdict, 2) OVER w AS v2, CASE verdict WHEN 'BUY' THEN 1 ELSE -1 END AS s FROM bv WINDOW w AS (PARTITION BY sym ORDER BY date)), o AS (SELECT *, round(entry - s * 2.5 * atr5, 2) AS stop FROM p WHERE verdict <> 'NEUTRAL' AND atr5 > 0 AND px IS NOT NULL)"


def positions(s, d):
    w = Window.partitionBy("sym").orderBy("date")
    p = bounce(s, d).select("sym", "date", C("close").alias("entry"), "verdict", "atr5", F.lead("close", 2).over(w).alias("px"), F.lead("verdict", 2).over(w).alias("v2"))
    return p.where("verdict <> 'NEUTRAL' and atr5 > 0 and px is not null").select("*", F.when(C("verdict") == "BUY", 1.0).otherwise(-1.0).alias("s"), scoring.stop_price(C("verdict"), C("entry"), C("atr5")).alias("stop"))


@query("k10_live_exit", PULSE + " SELECT sym, date, CASE WHEN s * (px - stop) <= 0 THEN 'STOP' WHEN s * (px - entry) > 0 THEN 'TARGET' WHEN v2 = CASE verdict WHEN 'BUY' THEN 'SELL' ELSE 'BUY' END THEN 'FLIP' ELSE 'HOLD' END AS decision FROM o")
def k10(s, d):
    against = C("v2") == F.when(C("verdict") == "BUY", "SELL").otherwise("BUY")
    dec = F.when(C("s") * (C("px") - C("stop")) <= 0, "STOP").when(C("s") * (C("px") - C("entry")) > 0, "TARGET").when(against, "FLIP").otherwise("HOLD")
    return positions(s, d).select("sym", "date", dec.alias("decision"))


@query("k11_k12_position_pulse", PULSE + " SELECT sym, date, round(s * (px - entry) / entry * 100, 3) AS pnl_pct, round(CASE WHEN abs(entry - stop) > 0 THEN s * (px - stop) / abs(entry - stop) END, 3) AS r_left, coalesce(CASE WHEN abs(entry - stop) > 0 THEN s * (px - stop) / abs(entry - stop) END BETWEEN 0 AND 0.3, false) AS near_stop, v2 = 'NEUTRAL' AS cooling FROM o")
def k11(s, d):
    risk = F.abs(C("entry") - C("stop"))
    left = F.when(risk > 0, C("s") * (C("px") - C("stop")) / risk)
    return positions(s, d).select("sym", "date", r(C("s") * (C("px") - C("entry")) / C("entry") * 100, 3, "pnl_pct"), r(left, 3, "r_left"), F.coalesce(left.between(0, 0.3), F.lit(False)).alias("near_stop"), (C("v2") == "NEUTRAL").alias("cooling"))


@_k("k13_k14_hold_vs_rebuy", """, g AS (SELECT t.sym, t.rn, t.xrn, t.entry, t.px, s.rn AS r, s.close, s.core >= 7 AND s.clean_uptrend AS gate FROM t JOIN sig s ON s.sym = t.sym AND s.rn BETWEEN t.rn AND t.xrn),
i AS (SELECT *, lag(gate) OVER (PARTITION BY sym, rn ORDER BY r) AS pg FROM g), j AS (SELECT *, sum(CASE WHEN gate AND NOT coalesce(pg, false) THEN 1 ELSE 0 END) OVER (PARTITION BY sym, rn ORDER BY r) AS isl FROM i),
k AS (SELECT sym, rn, isl, arg_max(close, r) / arg_min(close, r) AS f FROM j WHERE gate GROUP BY ALL)
SELECT t.sym, t.date AS entry_date, round((t.px / t.entry - 1) * 100, 3) AS hold_pct, round((product(k.f) - 1) * 100, 3) AS rebuy_pct, count(*) AS parts FROM t JOIN k USING (sym, rn) WHERE t.xrn IS NOT NULL GROUP BY t.sym, t.date, t.px, t.entry""")
def k13(s, d):
    """Within each trade: the compounded parts while the gate held, against holding to the end."""
    from candlefold.sources.shared import kept

    sig = kept(swing_signals(s, d))
    t = trades.closed_trades(trades.swing_trades(sig)).select("sym", "entry_date", "exit_date", "entry", "exit")
    b = sig.select(C("sym").alias("_s"), "date", "close", ((C("core") >= 7) & C("clean_uptrend")).alias("gate"))
    g = t.join(b.hint("merge"), (C("sym") == C("_s")) & C("date").between(C("entry_date"), C("exit_date")))
    w = Window.partitionBy("sym", "entry_date").orderBy("date")
    new = C("gate") & ~F.coalesce(F.lag("gate").over(w), F.lit(False))
    j = g.withColumn("isl", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("gate")
    k = j.groupBy("sym", "entry_date", "entry", "exit", "isl").agg((F.max_by("close", "date") / F.min_by("close", "date")).alias("f"))
    return k.groupBy("sym", "entry_date", "entry", "exit").agg(F.product("f").alias("p"), F.count("*").alias("parts")).select("sym", "entry_date", r((C("exit") / C("entry") - 1) * 100, 3, "hold_pct"), r((C("p") - 1) * 100, 3, "rebuy_pct"), "parts")
