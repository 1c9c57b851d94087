"""Scoring ladders, verdicts, swing core, checklist and fundamental points."""

from pyspark.sql import functions as F

from candlefold.functions import scalars
from candlefold.operators import asof, checklist, scoring
from candlefold.plans.base import C, FIXTURE, bounce, bounce_factors, ind, ladder_sql, query, r, regime, swing, vix_series, with_market
from candlefold.sources import tables


def points(name: str, source, view: str, *cols: str, where: str = "rn >= 21") -> None:
    listed = ", ".join(cols)

    @query(name, f"SELECT sym, date, {listed} FROM {view} WHERE {where}")
    def run(s, d):
        return source(s, d).where(where).select("sym", "date", *cols)


points("e01_rsi_points", bounce, "bv", "rsi_buy", "rsi_sell")
points("e02_pctb_points", bounce, "bv", "pctb_buy", "pctb_sell")
points("e03_volume_climax", bounce, "bv", "clx_buy", "clx_sell")
points("e04_reversal_candle", bounce, "bv", "rev_buy", "rev_sell")
points("e05_rs_points", bounce, "bv", "rs_buy", "rs_sell")
points("e07_dryup_expansion", bounce, "bv", "dry_pts", "exp_pts")
points("e13_bounce_composite", bounce, "bv", "buy_score", "sell_score")
points("e14_bounce_verdict", bounce, "bv", "verdict", "tier")
points("e18_swing_trend", swing, "sw", "trend_buy", where="rn >= 200")
points("e19_swing_momentum", swing, "sw", "mom_buy", where="rn >= 200")
points("e20_near_high", swing, "sw", "near_buy", where="rn >= 200")
points("e21_liquidity_points", swing, "sw", "liq_buy", where="rn >= 200")
points("e27_volume_surge", swing, "sw", "vol_buy", "vol_sell", where="rn >= 200")
points("e28_sector_rs_points", swing, "sw", "sec_buy", where="rn >= 200")
points("e30_two_sided_core", swing, "sw", "core", "core_short", where="rn >= 200")

_RAW = lambda side, key: " + ".join(f"CASE WHEN list_contains(factors, '{k}') THEN 0 ELSE coalesce({c[0 if side == 'buy' else 1]}, 0) END" for k, c in scoring.BOUNCE_FACTORS.items())
_SCORE = lambda side, tilt: f"least(24, floor(({_RAW(side, 0)}) * liq_mult * adr_mult * (CASE WHEN NOT favorable THEN {tilt} ELSE 1.0 END) * vix_mult * gap_mult + 0.5))::INT"
_VIX = """, vs AS (SELECT date, sd20 * sqrt(252) * 20 AS vix FROM ix WHERE rn % 3 = 0 AND sd20 IS NOT NULL), vb AS (SELECT bf.*, vs.vix, CASE WHEN vs.vix IS NULL THEN 1.0 WHEN vs.vix < 15 THEN 0.85 WHEN vs.vix < 20 THEN 1.0 WHEN vs.vix < 30 THEN 1.15 ELSE 1.3 END AS vix_mult FROM bf ASOF LEFT JOIN vs ON bf.date >= vs.date)"""
MASKS = [("none", [])] + [(f"no_{k}", [k]) for k in scoring.BOUNCE_FACTORS] + [("price_only", ["clx", "dry", "exp"])]
_MASKS = "ma AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {f}::VARCHAR[])" for m, f in MASKS) + ") t(mask, factors))"


@query("e13_vix_composite", _VIX + f", ma AS (SELECT []::VARCHAR[] AS factors) SELECT sym, date, vix_mult::DOUBLE AS vix_mult, {_SCORE('buy', 0.85)} AS buy_score, {_SCORE('sell', 1.15)} AS sell_score FROM vb, ma WHERE rn >= 21")
def e13v(s, d):
    """The composite with the class of a volatility series as of each session."""
    return bounce(s, d, vix_series(s, d)).where("rn >= 21").select("sym", "date", "vix_mult", "buy_score", "sell_score")


@query("e13_masked_composites", _VIX + f", {_MASKS}, sc AS (SELECT mask, {_SCORE('buy', 0.85)} AS b, {_SCORE('sell', 1.15)} AS q FROM vb, ma WHERE rn >= 200) SELECT mask, count(*) AS n, round(avg(b), 4) AS avg_buy, round(avg(q), 4) AS avg_sell, count(*) FILTER (b / 24.0 >= 0.55) AS strong_buys, count(*) FILTER (q / 24.0 >= 0.55) AS strong_sells FROM sc GROUP BY mask")
def e13m(s, d):
    """Ablation: the composite with each factor, and with all volume and range factors, masked."""
    masks = s.createDataFrame(MASKS, "mask string, factors array<string>")
    x = scoring.masked_scores(bounce_factors(s, d, vix_series(s, d)).where("rn >= 200"), masks)
    high = lambda c: F.count_if(C(c) / 24 >= 0.55)
    return x.groupBy("mask").agg(F.count("*").alias("n"), r(F.avg("buy_score"), 4, "avg_buy"), r(F.avg("sell_score"), 4, "avg_sell"), high("buy_score").alias("strong_buys"), high("sell_score").alias("strong_sells"))


MULT = ("liq_mult", "adr_mult", "gap_mult")


@query("e08_e10_multipliers", "SELECT sym, date, liq_mult::DOUBLE AS liq_mult, adr_mult::DOUBLE AS adr_mult, gap_mult::DOUBLE AS gap_mult FROM bf")
def e08(s, d):
    return scoring.bounce_factors(with_market(s, d), FIXTURE).select("sym", "date", *MULT)


@query("e09_vix_class", "SELECT date, (CASE WHEN sd20 IS NULL THEN 1.0 WHEN sd20 * sqrt(252) * 20 < 15 THEN 0.85 WHEN sd20 * sqrt(252) * 20 < 20 THEN 1.0 WHEN sd20 * sqrt(252) * 20 < 30 THEN 1.15 ELSE 1.3 END)::DOUBLE AS vix_mult FROM ix")
def e09(s, d):
    """Realised volatility of the index, scaled to the tables, stands for the volatility index."""
    from candlefold.plans.base import index_ind

    return index_ind(s, d).select("date", scoring.vix_class(C("sd20") * F.sqrt(F.lit(252.0)) * 20).alias("vix_mult"))


@query("e11_market_regime", "SELECT date, uptrend, favorable, label FROM regime")
def e11(s, d):
    return regime(s, d).select("date", "uptrend", "favorable", "label")


@query("e12_earnings_blackout", """, n AS (SELECT b.sym, b.date, (SELECT min(e.date) FROM earnings e WHERE e.sym = b.sym AND e.date > b.date) AS nxt FROM bars b)
SELECT sym, date, coalesce(nxt - date <= 5, false) AS blocked FROM n""")
def e12(s, d):
    n = asof.forward(tables.bars(s, d).select("sym", "date"), tables.earnings(s, d), ("sym",))
    return n.select("sym", "date", F.coalesce(F.datediff("next_date", "date") <= 5, F.lit(False)).alias("blocked"))


@query("e06_after_hours_points", f""", h AS (SELECT event_type AS sym, date_trunc('hour', ts) AS h, avg(value) AS mid FROM events GROUP BY ALL),
m AS (SELECT sym, h, round(mid / lag(mid) OVER (PARTITION BY sym ORDER BY h) - 1, 6) AS mv FROM h)
SELECT sym, h, {ladder_sql('mv', (0.015, 0.03, 0.05), '>=')} AS ah_buy, {ladder_sql('mv', (-0.015, -0.03, -0.05), '<=')} AS ah_sell FROM m WHERE mv IS NOT NULL""")
def e06(s, d):
    from pyspark.sql import Window

    h = tables.quotes(s, d).groupBy("sym", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("price").alias("mid"))
    mv = F.round(C("mid") / F.lag("mid").over(Window.partitionBy("sym").orderBy("h")) - 1, 6)
    return h.select("sym", "h", mv.alias("mv")).where("mv is not null").select("sym", "h", scalars.up(C("mv"), 0.015, 0.03, 0.05).alias("ah_buy"), scalars.down(C("mv"), -0.015, -0.03, -0.05).alias("ah_sell"))


GATED = "(verdict = 'BUY' OR verdict = 'SELL')"


@query("e15_conviction_gates", "SELECT split_part(call, '.', 1) AS raw, verdict, count(*) AS n FROM bv GROUP BY ALL")
def e15(s, d):
    reg = regime(s, d).select("date", "favorable")
    f = scoring.bounce_factors(with_market(s, d), FIXTURE).join(F.broadcast(reg), "date", "left").withColumn("vix_mult", F.lit(1.0))
    scored = scoring.bounce_score(f)
    ungated = scoring.bounce_verdict(scored.withColumn("_d", C("rs_delta")).withColumn("rs_delta", F.lit(0.0))).select("*", C("verdict").alias("raw")).drop("verdict", "tier")
    return scoring.bounce_verdict(ungated.withColumn("rs_delta", C("_d"))).groupBy("raw", "verdict").agg(F.count("*").alias("n"))


@query("e16_stop_price", """SELECT sym, date, round((CASE verdict WHEN 'BUY' THEN close - 2.5 * atr5 ELSE close + 2.5 * atr5 END), 2) AS stop,
round((round((CASE verdict WHEN 'BUY' THEN close - 2.5 * atr5 ELSE close + 2.5 * atr5 END), 2) - close) / close * 100, 3) AS pct FROM bv WHERE verdict <> 'NEUTRAL' AND atr5 > 0""")
def e16(s, d):
    x = bounce(s, d).where("verdict <> 'NEUTRAL' and atr5 > 0").withColumn("stop", scoring.stop_price(C("verdict"), C("close"), C("atr5")))
    return x.select("sym", "date", "stop", r((C("stop") - C("close")) / C("close") * 100, 3, "pct"))


VOTES = {s: " + ".join(f"(coalesce({k}_buy, 0) {o} coalesce({k}_sell, 0))::INT" for k in ("rsi", "pctb", "clx", "rev", "rs")) for s, o in (("BUY", ">"), ("SELL", "<"))}


@query("e17_agreement", f"SELECT sym, date, CASE verdict WHEN 'BUY' THEN {VOTES['BUY']} WHEN 'SELL' THEN {VOTES['SELL']} ELSE 0 END AS agree FROM bv")
def e17(s, d):
    return bounce(s, d).select("sym", "date", scoring.agreement(C("verdict")).alias("agree"))


@query("e29_swing_signal", """SELECT sym, date, core, clean_uptrend, death_cross, round(atr14, 6) AS atr14,
coalesce(clean_uptrend AND core >= 9 AND adv >= 60000 AND sec_buy >= 1 AND rs126 >= 0.3, false) AS entry FROM sw""")
def e29(s, d):
    x = swing(s, d).where("rn >= 200")
    return x.select("sym", "date", "core", "clean_uptrend", "death_cross", r("atr14", 6), scoring.entry_strong(9, 60e3, 1, 0.3).alias("entry"))


@query("e31_weighted_core", "SELECT sym, date, (trend_buy * 1.5 + mom_buy + near_buy * 0.5 + liq_buy + vol_buy * 2 + sec_buy)::DOUBLE AS weighted FROM sw")
def e31(s, d):
    return swing(s, d).where("rn >= 200").select("sym", "date", r(scoring.weighted_core({"trend": 1.5, "near": 0.5, "vol": 2.0}), 3, "weighted"))


# ---- fundamentals over the statements view -------------------------------------------------------------------------

TTM = """, st AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY period_end) AS k, sum(revenue) OVER w AS ttm, count(*) OVER w AS nq, lag(revenue, 4) OVER (PARTITION BY sym ORDER BY period_end) AS y_ago,
  sum(n_orders) OVER w AS orders_ttm FROM statements WINDOW w AS (PARTITION BY sym ORDER BY period_end ROWS 3 PRECEDING)),
t2 AS (SELECT *, lag(ttm, 4) OVER (PARTITION BY sym ORDER BY period_end) AS ttm_ago FROM st)"""


@query("e34_checklist_inputs", TTM + """
SELECT sym, period_end, round(ttm, 2) AS ttm, round(CASE WHEN revenue / y_ago - 1 BETWEEN -0.99 AND 49 THEN revenue / y_ago - 1 END, 5) AS growth_q, round(CASE WHEN nq = 4 AND ttm / ttm_ago - 1 BETWEEN -0.99 AND 49 THEN ttm / ttm_ago - 1 END, 5) AS growth_ttm,
coalesce(abs((revenue / y_ago - 1) - (ttm / ttm_ago - 1)) > 0.5, false) AS diverges FROM t2 WHERE k >= 4""")
def e34(s, d):
    return checklist.inputs(tables.statements(s, d)).select("sym", "period_end", r("ttm", 2), r("growth_q", 5), r("growth_ttm", 5), "diverges")


LEVER = TTM + """, lv AS (SELECT sym, period_end, ttm * 0.1 - 3000 * orders_ttm AS net_debt, ttm * 0.08 - 60000 AS ebitda FROM t2 WHERE k >= 4)"""


@query("e25_leverage", LEVER + """
SELECT sym, period_end, CASE WHEN ebitda <= 0 THEN CASE WHEN net_debt > 0 THEN 0 ELSE 3 END WHEN net_debt / ebitda < 1 THEN 3 WHEN net_debt / ebitda < 3 THEN 2 WHEN net_debt / ebitda < 5 THEN 1 ELSE 0 END AS points FROM lv""")
def e25(s, d):
    """Net debt and EBITDA are stand-ins computed from the orders of four quarters."""
    x = checklist.inputs(tables.statements(s, d))
    lv = x.select("sym", "period_end", (C("ttm") * 0.1 - C("orders_ttm") * 3000).alias("net_debt"), (C("ttm") * 0.08 - 60000).alias("ebitda"))
    return lv.select("sym", "period_end", checklist.leverage(C("net_debt"), C("ebitda")).alias("points"))


@query("e23_e24_valuation_quality", TTM + """, f AS (SELECT sym, period_end, ttm, ttm_ago, 40.0 * ttm / nullif(ttm_ago, 0) AS pe, (ttm - ttm_ago) / ttm_ago AS roe, ttm - 1.02 * ttm_ago AS fcf FROM t2 WHERE k >= 8),
th AS (SELECT period_end, quantile_disc(pe, 0.75) AS p75, quantile_disc(roe, 0.5) AS med FROM f GROUP BY period_end)
SELECT sym, period_end, CASE WHEN pe <= p75 * 0.75 THEN 3 WHEN pe <= p75 THEN 2 WHEN pe <= p75 * 1.5 THEN 1 ELSE 0 END AS valuation,
CASE WHEN fcf > 0 AND roe > med * 1.5 THEN 3 WHEN fcf > 0 AND roe > med THEN 2 WHEN fcf > 0 OR roe > med THEN 1 ELSE 0 END AS quality FROM f JOIN th USING (period_end)""")
def e23(s, d):
    """Price-earnings and return on equity are stand-ins from growth; the sector's quantiles are the quarter's."""
    x = checklist.inputs(tables.statements(s, d)).where("k >= 8")
    f = x.select("sym", "period_end", (40.0 * C("ttm") / F.nullif("ttm_ago", F.lit(0.0))).alias("pe"), ((C("ttm") - C("ttm_ago")) / C("ttm_ago")).alias("roe"), (C("ttm") - 1.02 * C("ttm_ago")).alias("fcf"))
    th = f.groupBy("period_end").agg(F.expr("percentile_disc(0.75) within group (order by pe)").alias("p75"), F.expr("percentile_disc(0.5) within group (order by roe)").alias("med"))
    j = f.join(th, "period_end")
    return j.select("sym", "period_end", checklist.valuation(C("pe"), C("p75")).alias("valuation"), checklist.quality(C("fcf"), C("roe"), C("med")).alias("quality"))


@query("e22_analyst_revisions", """, g AS (SELECT sym, date, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) * 1.0 / count(*) AS ratio, avg(o_totalprice) AS pt FROM ord GROUP BY ALL),
c AS (SELECT sym, max(date) AS date FROM ord GROUP BY sym), j AS (SELECT c.sym, c.date, g.date AS gd, g.ratio, g.pt FROM c JOIN g ON g.sym = c.sym AND g.date <= c.date),
x AS (SELECT sym, date, arg_max(ratio, gd) AS br_now, coalesce(arg_max(ratio, gd) FILTER (gd <= date - 60), arg_min(ratio, gd)) AS br_then, arg_max(pt, gd) AS pt_now, coalesce(arg_max(pt, gd) FILTER (gd <= date - 60), arg_min(pt, gd)) AS pt_then FROM j GROUP BY sym, date),
y AS (SELECT sym, ((pt_now - pt_then) / pt_then + (br_now - br_then)) / 2 AS comp FROM x)
SELECT sym, round(comp, 5) AS composite, CASE WHEN comp >= 0.05 THEN 3 WHEN comp >= 0 THEN 2 WHEN comp >= -0.05 THEN 1 ELSE 0 END AS points FROM y""")
def e22(s, d):
    """Share of urgent and high orders stands for the buy ratio, the day's mean order value for the price target."""
    o = tables._orders(s, d).select("sym", F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_totalprice")
    g = o.groupBy("sym", "date").agg(F.avg(C("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")).alias("ratio"), F.avg("o_totalprice").alias("pt"))
    c = o.groupBy("sym").agg(F.max("date").alias("date"))
    a = asof.back_or_oldest(c, g, "ratio").select("sym", (C("now") - C("then")).alias("br"))
    b = asof.back_or_oldest(c, g, "pt").select("sym", ((C("now") - C("then")) / C("then")).alias("ptd"))
    comp = (C("br") + C("ptd")) / 2
    return a.join(b, "sym").select("sym", r(comp, 5, "composite"), checklist.revisions(comp).alias("points"))


@query("e26_catalyst", """, c AS (SELECT sym, max(date) - 120 AS date FROM ord GROUP BY sym), n AS (SELECT c.sym, c.date, min(e.date) AS nxt FROM c LEFT JOIN earnings e ON e.sym = c.sym AND e.date > c.date GROUP BY ALL),
h AS (SELECT c.sym, st.revenue > lag(st.revenue, 4) OVER (PARTITION BY c.sym ORDER BY st.period_end) AS beat, row_number() OVER (PARTITION BY c.sym ORDER BY st.period_end DESC) AS k FROM c JOIN statements st ON st.sym = c.sym AND st.accepted_date <= c.date),
b AS (SELECT sym, count(*) FILTER (beat) AS beats FROM h WHERE k <= 4 GROUP BY sym)
SELECT sym, (nxt - n.date)::INT AS days, beats, CASE WHEN nxt IS NULL THEN NULL WHEN nxt - n.date < 1 OR nxt - n.date > 90 THEN 0 WHEN beats >= 3 THEN 3 WHEN beats >= 1 THEN 2 ELSE 1 END AS points FROM n JOIN b USING (sym)""")
def e26(s, d):
    """A quarter beats if it outgrew the one a year before; the window starts at 1 day in the fixtures, at 7 by default."""
    from pyspark.sql import Window

    o = tables._orders(s, d).groupBy("sym").agg(F.date_sub(F.max(F.to_date("o_orderdate")), 120).alias("date"))
    n = asof.forward(o, tables.earnings(s, d), ("sym",))
    q = tables.statements(s, d)
    y = q.select("sym", "period_end", "accepted_date", (C("revenue") > F.lag("revenue", 4).over(Window.partitionBy("sym").orderBy("period_end"))).alias("beat"))
    b = asof.point_in_time(o, y, 4).groupBy("sym").agg(F.count_if("beat").alias("beats"))
    j = n.join(b, "sym").withColumn("days", F.datediff("next_date", "date"))
    return j.select("sym", "days", "beats", checklist.catalyst(C("days"), C("beats"), 1).alias("points"))


CHECK = TTM + """, ins AS (SELECT sym, max(date) FILTER (l_returnflag = 'A') AS buy_at, max(date) FILTER (l_returnflag = 'R') AS sell_at, sum(CASE l_returnflag WHEN 'R' THEN l_extendedprice WHEN 'A' THEN -l_extendedprice ELSE 0 END) FILTER (date > (SELECT max(date) FROM ticks) - 2200) AS net FROM ticks GROUP BY sym),
lab AS (SELECT n_name AS sym, n_nationkey % 3 <> 0 AS contract_ok, n_nationkey % 4 <> 0 AS departures_ok, n_nationkey % 5 <> 0 AS disruption_ok FROM nation),
c0 AS (SELECT DISTINCT ON (sym) * FROM t2 WHERE k >= 8 ORDER BY sym, period_end DESC),
c AS (SELECT c0.sym, revenue > y_ago AS revenue_ok, ttm > ttm_ago AS margin_ok, contract_ok, ttm * 0.1 < 3000 * orders_ttm AS debt_ok, departures_ok, revenue > 0.9 * ttm / 4 AS forecast_ok, disruption_ok,
  NOT coalesce(sell_at >= DATE '2001-10-01' OR net > 0, false) AS insider_ok, coalesce(buy_at >= DATE '2001-11-01', false) AS insider_buy FROM c0 JOIN ins USING (sym) JOIN lab USING (sym)),
s AS (SELECT *, revenue_ok::INT + margin_ok::INT + contract_ok::INT + debt_ok::INT + departures_ok::INT + forecast_ok::INT + disruption_ok::INT + insider_ok::INT AS good FROM c)"""


@query("e33_e35_checklist", CHECK + """ SELECT sym, good, CASE WHEN insider_buy THEN -least(8, good + 1) ELSE good END AS signed_score,
CASE WHEN least(8, good + insider_buy::INT) >= 7 THEN 'green' WHEN least(8, good + insider_buy::INT) >= 5 THEN 'yellow' ELSE 'red' END AS colour FROM s""")
def e33(s, d):
    return checklist.fixture_checklist(s, d).select("sym", "good", "signed_score", "colour")


@query("e38_insider_rules", CHECK + " SELECT sym, insider_ok, insider_buy FROM s")
def e38(s, d):
    return checklist.fixture_checklist(s, d).select("sym", "insider_ok", "insider_buy")


@query("e36_e37_labels", TTM + """, v AS (SELECT sym, period_end, ttm / ttm_ago AS a, revenue / y_ago AS b, avg(ttm / ttm_ago) OVER (PARTITION BY period_end) AS m FROM t2 WHERE k >= 8)
SELECT sym, period_end, round((a / m - 1) * 100, 2) AS vs_sector_pct, CASE WHEN a / m - 1 <= -0.1 THEN 'green' WHEN a / m - 1 <= 0.1 THEN 'yellow' ELSE 'red' END AS colour,
CASE WHEN b < a * 0.95 THEN 'improving' WHEN b > a * 1.05 THEN 'worsening' ELSE 'flat' END AS forward_vs_ttm, CASE WHEN b > 1.05 THEN 'up' WHEN b < 0.95 THEN 'down' ELSE 'side' END AS arrow,
strftime(period_end, '%b %Y') AS catalyst_month FROM v""")
def e36(s, d):
    return checklist.labels(checklist.inputs(tables.statements(s, d)).where("k >= 8")).select("sym", "period_end", r("vs_sector_pct", 2), "colour", "forward_vs_ttm", "arrow", "catalyst_month")


@query("e32_swing_total", """SELECT sym, date, (core + coalesce(rsi_buy, 0) + coalesce(pctb_buy, 0) + coalesce(rs_buy, 0))::INT AS total, sw.trend_buy >= 2 AS trend_ok, sw.vol_buy >= 2 AS vol_ok
FROM sw JOIN bv USING (sym, date)""")
def e32(s, d):
    """Sum of all factors, those not available counting 0; a factor holds from 2 points on."""
    x = scoring.swing_core(scoring.bounce_factors(with_market(s, d), FIXTURE), FIXTURE).where("rn >= 200")
    extra = sum((F.coalesce(C(f"{k}_buy"), F.lit(0)) for k in ("rsi", "pctb", "rs")), F.lit(0))
    return x.select("sym", "date", (C("core") + extra).alias("total"), (C("trend_buy") >= 2).alias("trend_ok"), (C("vol_buy") >= 2).alias("vol_ok"))


@query("e39_e40_debt_and_sources", TTM + """ SELECT sym, period_end, CASE WHEN n_orders % 5 = 0 THEN true WHEN n_orders % 3 = 0 THEN orders_ttm / (ttm / 1e5) < 1.5 AND ttm > 0 ELSE orders_ttm / (ttm / 1e5) < 1.0 END AS debt_ok,
coalesce(abs(revenue / y_ago - 1) > 0.05, false) AS differs FROM t2 WHERE k >= 4""")
def e39(s, d):
    """Documented debt exceptions (capital-intensive up to 1.5 with cash flow, regulated waived) and the 5 % source check."""
    x = checklist.inputs(tables.statements(s, d))
    de = C("orders_ttm") / (C("ttm") / 1e5)
    return x.select("sym", "period_end", checklist.debt_ok(de, C("n_orders") % 3 == 0, C("n_orders") % 5 == 0, C("ttm") > 0).alias("debt_ok"), checklist.differs(C("revenue"), C("y_ago")).alias("differs"))


@query("bounce_verdict_counts", "SELECT sym, verdict, count(*) AS n FROM bv GROUP BY ALL")
def verdict_counts(s, d):
    """Flagship: bars to indicators to score to verdict, counted."""
    return bounce(s, d).groupBy("sym", "verdict").agg(F.count("*").alias("n"))
