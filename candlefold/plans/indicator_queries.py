"""Indicators (one query each), on every bar of every symbol."""

from pyspark.sql import functions as F

from candlefold.operators import asof, indicators, trades
from candlefold.plans.base import C, bars, ind, index_ind, query, r, with_market
from candlefold.sources import tables


def simple(name: str, *cols: str, where: str | None = None, digits: int = 4) -> None:
    """An indicator query: (sym, date, cols) rounded; the oracle reads the same columns of the SQL views."""
    listed = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)

    @query(name, f"SELECT sym, date, {listed} FROM ind" + (f" WHERE {where}" if where else ""))
    def run(s, d):
        df = ind(s, d)
        return (df.where(where) if where else df).select("sym", "date", *[r(c, digits) for c in cols])


simple("d01_true_range", "tr", digits=8)
simple("d02_atr_partial", "atr5", "atr14", "atr20", digits=8)
simple("d04_sma_strict", "sma5", "sma20", "sma50", "sma200", digits=8)
simple("d06_rsi2", "rsi2")
simple("d08_bollinger_pctb", "pctb")
simple("d09_relative_volume", "rv")
simple("d10_close_position", "pos")
simple("d11_weighted_strength", "strength")
simple("d14_volume_dryup", "dryup")
simple("d15_atr_expansion", "expansion")
simple("d16_gap_profile", "gap_avg", "gap_share")
simple("d17_adr_pct", "adr")
simple("d18_avg_dollar_volume", "adv", digits=8)
simple("d21_ret63", "ret63", where="rn >= 63")
simple("d23_off_high_low", "off_high", "off_low")
simple("d24_money_flow", "flow10")


@query("d03_wilder_atr", """, t AS (SELECT sym, date, tr, row_number() OVER (PARTITION BY sym ORDER BY date) AS k FROM ind WHERE tr IS NOT NULL),
seed AS (SELECT sym, avg(tr) AS v FROM t WHERE k <= 14 GROUP BY sym HAVING count(*) = 14),
w AS (SELECT t.sym, t.date, t.k, power(13/14.0, t.k - 14) * (seed.v + coalesce(sum(CASE WHEN t.k >= 15 THEN t.tr * power(14/13.0, t.k - 14) END) OVER (PARTITION BY t.sym ORDER BY t.k), 0) / 14) AS atr FROM t JOIN seed USING (sym))
SELECT sym, date, round(atr, 4) AS atr FROM w WHERE k >= 14""")
def d03(s, d):
    """All sessions; the SQL holds the closed form of the recursion, whose powers stay in range for some 12,000 sessions."""
    return indicators.wilder(bars(s, d)).select("sym", "date", r("atr"))


@query("d05_chart_curves", """, l AS (SELECT sym, date, round(avg(close) OVER (PARTITION BY sym ORDER BY date ROWS 49 PRECEDING), 2) AS sma50, round(avg(close) OVER (PARTITION BY sym ORDER BY date ROWS 199 PRECEDING), 2) AS sma200,
  round(max(high) OVER (PARTITION BY sym ORDER BY date ROWS 251 PRECEDING), 2) AS high252, round(avg(tr) OVER (PARTITION BY sym ORDER BY date ROWS 13 PRECEDING), 2) AS atr14, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM ind)
SELECT sym, date, sma50, sma200, high252, atr14 FROM l WHERE k <= 50""")
def d05(s, d):
    b = indicators.Bars()
    curves = indicators.with_ranges(bars(s, d)).select("sym", "date", r(F.avg("close").over(b.last(50)), 2, "sma50"), r(F.avg("close").over(b.last(200)), 2, "sma200"), r(F.max("high").over(b.last(252)), 2, "high252"), r(F.avg("tr").over(b.last(14)), 2, "atr14"))
    return tables.last_sessions(curves, 50)


@query("d07_rsi2_smoothed", """, g AS (SELECT sym, date, gain, loss, rn - 1 AS k FROM ind WHERE pc IS NOT NULL),
s AS (SELECT sym, avg(gain) AS ga, avg(loss) AS la FROM g WHERE k <= 2 GROUP BY sym HAVING count(*) = 2),
w AS (SELECT g.sym, g.date, s.ga * power(0.5, g.k - 2) + coalesce((SELECT sum(u.gain * power(0.5, g.k - u.k)) FROM g u WHERE u.sym = g.sym AND u.k BETWEEN greatest(3, g.k - 60) AND g.k), 0) / 2 AS a,
  s.la * power(0.5, g.k - 2) + coalesce((SELECT sum(u.loss * power(0.5, g.k - u.k)) FROM g u WHERE u.sym = g.sym AND u.k BETWEEN greatest(3, g.k - 60) AND g.k), 0) / 2 AS b FROM g JOIN s USING (sym) WHERE g.k >= 2)
SELECT sym, date, round(CASE WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END, 4) AS rsi FROM w""")
def d07(s, d):
    """Smoothed RSI(2): average gain and loss are halved and half of the new one added. All sessions; in the SQL's closed form terms older than 60
    bars, of weight 2^-60, are left out."""
    g = indicators.with_ranges(bars(s, d)).where("pc is not null")
    gain = indicators.wilder_of(g, "gain", 2).withColumnRenamed("v", "a")
    loss = indicators.wilder_of(g, "loss", 2).withColumnRenamed("v", "b")
    return gain.join(loss.hint("merge"), ["sym", "date"]).select("sym", "date", r(F.when(C("b") == 0, 100.0).otherwise(100 - 100 / (1 + C("a") / C("b"))), 4, "rsi"))


@query("d12_relative_strength", "SELECT sym, date, round(rs_delta, 4) AS rs_delta, round(sec_delta, 4) AS sec_delta FROM market WHERE rs_delta IS NOT NULL")
def d12(s, d):
    return with_market(s, d).where("rs_delta is not null").select("sym", "date", r("rs_delta"), r("sec_delta"))


@query("d13_after_hours_move", """, q AS (SELECT event_type AS sym, date_trunc('hour', ts) AS h, max(value) AS ask, min(value) AS bid, max(ts) AS seen FROM events GROUP BY ALL),
m AS (SELECT sym, h, ((ask + bid) / 2) / lag((ask + bid) / 2) OVER (PARTITION BY sym ORDER BY h) - 1 AS move, epoch(seen) - epoch(lag(seen) OVER (PARTITION BY sym ORDER BY h)) AS age FROM q)
SELECT sym, h, round(move, 4) AS move FROM m WHERE age < 18 * 3600 + 1""")
def d13(s, d):
    """Mid of bid and ask against the quote before, unless that is over 18 hours old."""
    from pyspark.sql import Window

    q = tables.quotes(s, d).groupBy("sym", F.date_trunc("hour", "ts").alias("h")).agg(F.max("price").alias("ask"), F.min("price").alias("bid"), F.max("ts").alias("at"))
    w = Window.partitionBy("sym").orderBy("h")
    mid = (C("ask") + C("bid")) / 2
    m = q.select("sym", "h", (mid / F.lag(mid).over(w) - 1).alias("move"), (F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))).alias("age"))
    return m.where("age <= 18 * 3600").select("sym", "h", r("move"))


@query("d19_median_dollar_volume", """, m AS (SELECT sym, list_sort(list(money)) AS l FROM (SELECT sym, money, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM ind) WHERE k <= 60 GROUP BY sym)
SELECT sym, round(l[len(l) // 2 + 1], 2) AS median_money FROM m""")
def d19(s, d):
    from candlefold.operators.hygiene import eligibility

    return eligibility(bars(s, d), floor=0).select("sym", r("median_money", 2))


@query("d20_distribution_days", "SELECT date, dist_days::INT AS dist_days FROM ix")
def d20(s, d):
    return indicators.distribution_days(tables.index_bars(s, d), ()).select("date", "dist_days")


@query("d22_rs126", "SELECT sym, date, round(rs126, 4) AS rs126 FROM market WHERE rs126 IS NOT NULL")
def d22(s, d):
    return with_market(s, d).where("rs126 is not null").select("sym", "date", r("rs126"))


@query("d25_beta", """, p AS (SELECT ind.sym, ind.date, ind.close / ind.pc - 1 AS y, ix.close / ix.pc - 1 AS x FROM ind JOIN ix USING (date)),
b AS (SELECT sym, date, CASE WHEN count(x * y) OVER w >= 100 THEN regr_slope(y, x) OVER w END AS beta,
  CASE WHEN count(x * y) OVER v > 30 THEN sum(ln(1 + x) * ln(1 + y)) OVER v / sum(CASE WHEN y IS NOT NULL THEN ln(1 + x) * ln(1 + x) END) OVER v END AS beta0 FROM p
  WINDOW w AS (PARTITION BY sym ORDER BY date ROWS 251 PRECEDING), v AS (PARTITION BY sym ORDER BY date ROWS 119 PRECEDING))
SELECT sym, date, round(beta, 3) AS beta, round(beta0, 3) AS beta0 FROM b""")
def d25(s, d):
    i = index_ind(s, d).select("date", (C("close") / C("pc") - 1).alias("ri"))
    j = indicators.with_ranges(bars(s, d)).select("sym", "date", (C("close") / C("pc") - 1).alias("r")).join(F.broadcast(i), "date")
    return indicators.beta(j).select("sym", "date", r("beta", 3), r("beta0", 3))


@query("d26_cross_age", """, f AS (SELECT sym, date, rn, coalesce(sma50 > sma200, false) AS up FROM ind), g AS (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY sym ORDER BY date) AS island FROM f)
SELECT sym, date, CASE WHEN up THEN rn - min(CASE WHEN up THEN rn END) OVER (PARTITION BY sym, island) END::INT AS cross_age FROM g WHERE rn >= 200""")
def d26(s, d):
    return indicators.cross_age(ind(s, d)).where("rn >= 200").select("sym", "date", "cross_age")


@query("d27_trend_cleanliness", "SELECT sym, date, round(avg((close > sma50)::INT) OVER (PARTITION BY sym ORDER BY date ROWS 62 PRECEDING) * 100, 3) AS clean_pct FROM ind WHERE rn >= 50")
def d27(s, d):
    b = indicators.Bars()
    on = ind(s, d).where("rn >= 50")
    return on.select("sym", "date", r(F.avg((C("close") > C("sma50")).cast("double")).over(b.last(63)) * 100, 3, "clean_pct"))


@query("d28_extension", "SELECT sym, date, round(close / sma50 - 1, 4) AS ext50, round(sma50 / sma200 - 1, 4) AS spread, round(atr14 / close * 100, 4) AS atr_pct, round(ret63 / (atr14 / close), 3) AS vol_adj, round(ret252, 4) AS ret252 FROM ind WHERE rn >= 200")
def d28(s, d):
    x = ind(s, d).where("rn >= 200")
    return x.select("sym", "date", r(C("close") / C("sma50") - 1, 4, "ext50"), r(C("sma50") / C("sma200") - 1, 4, "spread"), r(C("atr14") / C("close") * 100, 4, "atr_pct"), r(C("ret63") / (C("atr14") / C("close")), 3, "vol_adj"), r("ret252"))


@query("d29_realised_vol", "SELECT date, round(sd20 * sqrt(252) * 100, 3) AS realised_vol FROM ix WHERE rn >= 21")
def d29(s, d):
    return index_ind(s, d).where("rn >= 21").select("date", r(C("sd20") * F.sqrt(F.lit(252.0)) * 100, 3, "realised_vol"))


@query("d30_zscore", """, z AS (SELECT sym, date, rn, close / lag(close, 3) OVER (PARTITION BY sym ORDER BY date) - 1 AS r3, close, sma20, atr14, pc FROM ind),
y AS (SELECT *, avg(r3) OVER w AS m, stddev_samp(r3) OVER w AS sd, count(r3) OVER w AS n FROM z WINDOW w AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
SELECT sym, date, round((r3 - m) / sd, 3) AS z, round(close / sma20 - 1, 4) AS below20, round((close - pc) / atr14, 3) AS atr_move FROM y WHERE n >= 100""")
def d30(s, d):
    b = indicators.Bars()
    z = ind(s, d).select("sym", "date", "close", "sma20", "atr14", "pc", b.ret(3).alias("r3"))
    w = b.over(-252, -1)
    y = z.select("*", F.avg("r3").over(w).alias("m"), F.stddev_samp("r3").over(w).alias("sd"), F.count("r3").over(w).alias("n")).where("n >= 100")
    return y.select("sym", "date", r((C("r3") - C("m")) / C("sd"), 3, "z"), r(C("close") / C("sma20") - 1, 4, "below20"), r((C("close") - C("pc")) / C("atr14"), 3, "atr_move"))


@query("d31_above_200", "SELECT sym, date, round((close / sma200 - 1) * 100, 3) AS above200 FROM ind WHERE sma200 IS NOT NULL")
def d31(s, d):
    return ind(s, d).where("sma200 is not null").select("sym", "date", r((C("close") / C("sma200") - 1) * 100, 3, "above200"))


@query("d32_fresh_transition", """, x AS (SELECT sym, date, CASE WHEN pctb <= 0.1 THEN 'long' WHEN pctb >= 0.9 THEN 'short' END AS side FROM ind),
y AS (SELECT *, lag(side) OVER (PARTITION BY sym ORDER BY date) AS before FROM x) SELECT sym, date, side FROM y WHERE side IS NOT NULL AND side IS DISTINCT FROM before""")
def d32(s, d):
    side = F.when(C("pctb") <= 0.1, "long").when(C("pctb") >= 0.9, "short")
    return trades.fresh(ind(s, d).select("sym", "date", side.alias("side")))


@query("d33_forward_return", """SELECT sym, date, round((coalesce(lead(close, 10) OVER w, last_value(close) OVER (PARTITION BY sym ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / close - 1) * 100, 4) AS fwd10
FROM bars WINDOW w AS (PARTITION BY sym ORDER BY date)""")
def d33(s, d):
    """Truncated at the end of the data: the last close stands for the tenth."""
    from pyspark.sql import Window

    w = Window.partitionBy("sym").orderBy("date")
    last = F.last("close").over(w.rowsBetween(0, 10))
    return bars(s, d).select("sym", "date", r((last / C("close") - 1) * 100, 4, "fwd10"))


@query("d34_strength_series", "SELECT sector, date, round(strength, 4) AS strength FROM sx WHERE strength IS NOT NULL")
def d34(s, d):
    from candlefold.plans.base import sector_ind

    return sector_ind(s, d).where("strength is not null").select("sector", "date", r("strength"))


@query("d35_stride_sample", """, k AS (SELECT sym, date, row_number() OVER (PARTITION BY sym ORDER BY date DESC) - 1 AS age, row_number() OVER (PARTITION BY sym ORDER BY date) AS rn FROM bars)
SELECT sym, date FROM k WHERE age >= 21 AND (age - 21) % 5 = 0 AND rn > 260""")
def d35(s, d):
    """Every fifth bar, the newest 21 left out, with 260 bars before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("sym")
    k = bars(s, d).select("sym", "date", (F.row_number().over(w.orderBy(F.desc("date"))) - 1).alias("age"), F.row_number().over(w.orderBy("date")).alias("rn"))
    return k.where("age >= 21 and (age - 21) % 5 = 0 and rn > 260").select("sym", "date")
