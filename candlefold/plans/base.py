"""Registry of queries and the SQL views that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlefold.operators import asof, indicators, scoring
from candlefold.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col
#: Money floors scaled to the tables' prices, so that every rung of the liquidity ladder occurs.
FIXTURE = scoring.Scale(best=200e3, good=120e3, least=60e3)
FLOORS = {"best": 200e3, "good": 120e3, "least": 60e3}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a query; ``sql`` is its oracle's final SELECT over the shared views."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {VIEWS}\n{sql}" if views else sql
        return f

    return put


def r(c: str | Column, n: int = 4, name: str | None = None) -> Column:
    """Rounded for comparison; named as the column."""
    return F.round(C(c) if isinstance(c, str) else c, n).alias(name or (c if isinstance(c, str) else "x"))


def bars(s: SparkSession, d: str) -> DataFrame:
    return tables.bars(s, d)


def ind(s: SparkSession, d: str) -> DataFrame:
    return indicators.indicators(tables.bars(s, d))


def index_ind(s: SparkSession, d: str) -> DataFrame:
    return indicators.indicators(tables.index_bars(s, d).withColumn("sym", F.lit("INDEX")))


def sector_ind(s: SparkSession, d: str) -> DataFrame:
    return indicators.indicators(tables.sector_bars(s, d), ("sector",))


def with_market(s: SparkSession, d: str) -> DataFrame:
    """Indicators with the index's strength and 126-bar return as of the date, the sector's strength, and the differences."""
    idx = index_ind(s, d).select("date", C("strength").alias("i_strength"), C("ret126_index").alias("i_ret126"))
    sec = sector_ind(s, d).select("sector", "date", C("strength").alias("s_strength"))
    j = ind(s, d).join(F.broadcast(idx), "date", "left").join(sec, ["sector", "date"], "left")  # calendar-sized
    return j.select(
        "*", (C("strength") - C("i_strength")).alias("rs_delta"), (C("s_strength") - C("i_strength")).alias("sec_delta"), (C("ret126") - C("i_ret126")).alias("rs126")
    )


def regime(s: SparkSession, d: str) -> DataFrame:
    return scoring.regime(indicators.distribution_days(index_ind(s, d).drop("rn", "pc", "pv")).select("*"))


def bounce_factors(s: SparkSession, d: str, vix: DataFrame | None = None) -> DataFrame:
    """Bars with the bounce factors under the index regime of the date and, as of it, the class of ``vix`` (``date``, ``vix``); without the series its class is 1."""
    reg = regime(s, d).select("date", "favorable")
    f = scoring.bounce_factors(with_market(s, d), FIXTURE).join(F.broadcast(reg), "date", "left")
    if vix is None:
        return f.withColumn("vix_mult", F.lit(1.0))
    return asof.series_at(f, vix, "vix").withColumn("vix_mult", scoring.vix_class(C("vix")))


def bounce(s: SparkSession, d: str, vix: DataFrame | None = None) -> DataFrame:
    """Bars with the bounce score and verdict (see ``bounce_factors``)."""
    return scoring.bounce_verdict(scoring.bounce_score(bounce_factors(s, d, vix)))


def vix_series(s: SparkSession, d: str) -> DataFrame:
    """Realised volatility of the index, scaled to the tables, stands for the volatility index; known every third session only, so that it has to be taken as of a date."""
    return index_ind(s, d).where("rn % 3 = 0 and sd20 is not null").select("date", (C("sd20") * F.sqrt(F.lit(252.0)) * 20).alias("vix"))


def swing(s: SparkSession, d: str, checked: bool = False) -> DataFrame:
    return scoring.swing_core(with_market(s, d), FIXTURE, checked)


def ladder_sql(x: str, cuts: tuple[float, ...], op: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN " + " + ".join(f"({x} {op} {c})::INT" for c in cuts) + " END"


def _ind_sql(name: str, src: str, key: str) -> str:
    """Indicator views over ``src``, with frames written out."""
    w = f"PARTITION BY {key} ORDER BY date"

    def fr(a: int, b: int = 0) -> str:
        end = "CURRENT ROW" if b == 0 else f"{-b} PRECEDING"
        return f"OVER ({w} ROWS BETWEEN {a} PRECEDING AND {end})"

    legs = "".join(f", lag(close, {n}) OVER ({w}) AS c{n}" for n in (62, 63, 125, 126, 189, 252))
    rets = {n: f"CASE WHEN c{n} > 0 THEN close / c{n} - 1 END" for n in (62, 63, 125, 126, 189, 252)}
    num = " + ".join(f"coalesce(({rets[n]}) * {x}, 0)" for n, x in indicators.STRENGTH_LEGS)
    den = " + ".join(f"CASE WHEN ({rets[n]}) IS NOT NULL THEN {x} ELSE 0 END" for n, x in indicators.STRENGTH_LEGS)
    return f"""
{name}0 AS (SELECT *, row_number() OVER ({w}) AS rn, lag(close) OVER ({w}) AS pc, lag(close, 2) OVER ({w}) AS pc2, lag(volume) OVER ({w}) AS pv{legs} FROM {src}),
{name}1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, close * volume AS money, (high - low) / close AS range_pct,
  CASE WHEN abs(open / pc - 1) BETWEEN -0.9 AND 9 THEN abs(open / pc - 1) END AS gap,
  CASE WHEN pc IS NOT NULL AND volume > 0 THEN CASE WHEN close > pc THEN close * volume WHEN close < pc THEN -close * volume ELSE 0 END END AS flow1 FROM {name}0),
{name}2 AS (SELECT *, avg(tr) {fr(4)} AS atr5, avg(tr) {fr(13)} AS atr14, avg(tr) {fr(19)} AS atr20,
  CASE WHEN rn >= 5 THEN avg(close) {fr(4)} END AS sma5, CASE WHEN rn >= 20 THEN avg(close) {fr(19)} END AS sma20,
  CASE WHEN rn >= 50 THEN avg(close) {fr(49)} END AS sma50, CASE WHEN rn >= 200 THEN avg(close) {fr(199)} END AS sma200,
  sum(gain) {fr(1)} AS g2, sum(loss) {fr(1)} AS l2, avg(close) {fr(19)} AS mid, stddev_pop(close) {fr(19)} AS sdp,
  avg(volume) {fr(20, -1)} AS v20, count(volume) {fr(20, -1)} AS nv20, avg(volume) {fr(4)} AS v5, count(volume) {fr(4)} AS nv5, avg(volume) {fr(24, -5)} AS vfar, count(volume) {fr(24, -5)} AS nvfar,
  count(gap) {fr(59)} AS ngap, avg(gap) {fr(59)} AS gap60, avg((gap >= 0.03)::INT) {fr(59)} AS gshare60, avg(range_pct) {fr(19)} AS adr20, count(range_pct) {fr(19)} AS nadr,
  avg(CASE WHEN money > 0 THEN money END) {fr(19)} AS adv, max(close) {fr(259)} AS high260, min(close) {fr(259)} AS low260,
  coalesce(sum(CASE WHEN flow1 > 0 THEN flow1 END) {fr(9)}, 0) AS up10, coalesce(sum(CASE WHEN flow1 < 0 THEN -flow1 END) {fr(9)}, 0) AS dn10, count(flow1) {fr(9)} AS nflow,
  stddev_samp(ln(close / pc)) {fr(19)} AS sd20, list(CASE WHEN close / pc - 1 <= -0.002 AND volume > pv THEN close END) {fr(24)} AS falls FROM {name}1),
{name} AS (SELECT *, CASE WHEN rn >= 3 THEN CASE WHEN l2 = 0 THEN 100.0 ELSE 100 - 100 / (1 + g2 / l2) END END AS rsi2,
  CASE WHEN rn >= 20 THEN CASE WHEN sdp = 0 THEN 0.5 ELSE (close - (mid - 2 * sdp)) / (4 * sdp) END END AS pctb,
  CASE WHEN rn >= 21 AND nv20 >= 15 THEN volume / v20 END AS rv, CASE WHEN high > low THEN (close - low) / (high - low) END AS pos,
  CASE WHEN rn >= 64 THEN ({num}) / ({den}) END AS strength,
  CASE WHEN rn >= 26 AND nv5 >= 4 AND nvfar >= 15 AND v5 / vfar BETWEEN 0 AND 20 THEN v5 / vfar END AS dryup,
  CASE WHEN atr5 / atr20 BETWEEN 0 AND 20 THEN atr5 / atr20 END AS expansion,
  CASE WHEN rn >= 21 AND ngap >= 15 THEN gap60 END AS gap_avg, CASE WHEN rn >= 21 AND ngap >= 15 THEN gshare60 END AS gap_share,
  CASE WHEN nadr >= 15 THEN adr20 * 100 END AS adr, {rets[62]} AS ret63, {rets[125]} AS ret126, {rets[126]} AS ret126_index, {rets[252]} AS ret252,
  (high260 - close) / high260 AS off_high, (close - low260) / low260 AS off_low,
  CASE WHEN nflow >= 6 AND up10 + dn10 > 0 THEN (up10 - dn10) / (up10 + dn10) END AS flow10,
  CASE WHEN rn >= 26 THEN len(list_filter(falls, lambda x: x IS NOT NULL AND close <= x * 1.05)) END AS dist_days FROM {name}2)"""


def _bounce_sql() -> str:
    up, down = (lambda x, *c: ladder_sql(x, c, ">=")), (lambda x, *c: ladder_sql(x, c, "<="))
    raw = lambda s: "coalesce(rsi_{0},0)+coalesce(pctb_{0},0)+coalesce(clx_{0},0)+coalesce(rs_{0},0)+coalesce(dry_pts,0)+coalesce(exp_pts,0)".format(s)
    tilt = lambda x: f"(CASE WHEN NOT favorable THEN {x} ELSE 1.0 END)"
    score = lambda s, x: f"least(24, floor(({raw(s)}) * liq_mult * adr_mult * {tilt(x)} * gap_mult + 0.5))::INT"
    rv = "CASE WHEN rv BETWEEN 0 AND 50 THEN rv END"
    return f"""
market AS (SELECT ind.*, ix.strength AS i_strength, ix.ret126_index AS i_ret126, sx.strength AS s_strength, ind.strength - ix.strength AS rs_delta,
  sx.strength - ix.strength AS sec_delta, ind.ret126 - ix.ret126_index AS rs126 FROM ind LEFT JOIN ix USING (date) LEFT JOIN sx ON sx.sector = ind.sector AND sx.date = ind.date),
regime AS (SELECT date, close, rn, sma50, sma200, dist_days, CASE WHEN rn >= 200 THEN close > sma50 AND sma50 > sma200 END AS uptrend,
  CASE WHEN rn >= 200 THEN close > sma50 AND sma50 > sma200 AND dist_days <= 5 END AS favorable,
  CASE WHEN rn >= 200 THEN CASE WHEN close > sma50 AND sma50 > sma200 AND dist_days <= 5 THEN 'confirmed uptrend' WHEN close > sma50 AND sma50 > sma200 THEN 'uptrend under pressure'
    WHEN close > sma200 THEN 'mixed' ELSE 'downtrend' END END AS label FROM ix),
bf AS (SELECT market.*, favorable, {down('rsi2', 20, 10, 5)} AS rsi_buy, {up('rsi2', 80, 90, 95)} AS rsi_sell, {down('pctb', 0.25, 0.1, 0)} AS pctb_buy, {up('pctb', 0.75, 0.9, 1.0)} AS pctb_sell,
  CASE WHEN ({rv}) IS NOT NULL AND pv IS NOT NULL THEN CASE WHEN rv >= 2.5 AND market.close < pc THEN 3 WHEN rv >= 1.5 AND market.close < pc THEN 2 WHEN rv >= 1.5 AND market.close > pc THEN 1 ELSE 0 END END AS clx_buy,
  CASE WHEN ({rv}) IS NOT NULL AND pv IS NOT NULL THEN CASE WHEN rv >= 2.5 AND market.close > pc THEN 3 WHEN rv >= 1.5 AND market.close > pc THEN 2 WHEN rv >= 1.5 AND market.close < pc THEN 1 ELSE 0 END END AS clx_sell,
  CASE WHEN pos IS NOT NULL AND pc IS NOT NULL THEN CASE WHEN pos >= 0.8 AND coalesce(pc < pc2, false) THEN 3 WHEN pos >= 0.6 AND coalesce(pc < pc2, false) THEN 2 WHEN pos >= 0.8 THEN 1 ELSE 0 END END AS rev_buy,
  CASE WHEN pos IS NOT NULL AND pc IS NOT NULL THEN CASE WHEN pos <= 0.2 AND coalesce(pc > pc2, false) THEN 3 WHEN pos <= 0.4 AND coalesce(pc > pc2, false) THEN 2 WHEN pos <= 0.2 THEN 1 ELSE 0 END END AS rev_sell,
  {up('rs_delta', -0.05, 0.05, 0.15)} AS rs_buy, {down('rs_delta', 0.05, -0.05, -0.15)} AS rs_sell, {down('dryup', 0.9, 0.7, 0.5)} AS dry_pts, {up('expansion', 1.0, 1.2, 1.5)} AS exp_pts,
  CASE WHEN adv IS NULL OR adv >= {FLOORS['best']} THEN 1.0 WHEN adv >= {FLOORS['good']} THEN 0.85 WHEN adv >= {FLOORS['least']} THEN 0.6 ELSE 0.35 END AS liq_mult,
  CASE WHEN adr IS NULL OR adr BETWEEN 3 AND 8 THEN 1.0 WHEN adr BETWEEN 2 AND 12 THEN 0.7 ELSE 0.4 END AS adr_mult,
  CASE WHEN gap_avg IS NULL OR gap_avg <= 0.015 THEN 1.0 WHEN gap_avg <= 0.022 THEN 0.9 WHEN gap_avg <= 0.03 THEN 0.78 ELSE 0.65 END AS gap_mult FROM market LEFT JOIN regime USING (date)),
bs AS (SELECT *, {score('buy', 0.85)} AS buy_score, {score('sell', 1.15)} AS sell_score FROM bf),
bv0 AS (SELECT *, CASE WHEN buy_score / 24.0 >= 0.75 THEN 'BUY.strong' WHEN buy_score / 24.0 >= 0.55 THEN 'BUY.moderate' WHEN sell_score / 24.0 >= 0.75 THEN 'SELL.strong'
  WHEN sell_score / 24.0 >= 0.55 THEN 'SELL.moderate' WHEN greatest(buy_score, sell_score) / 24.0 >= 0.30 THEN CASE WHEN buy_score = sell_score THEN 'NEUTRAL.' WHEN buy_score > sell_score THEN 'BUY.weak' ELSE 'SELL.weak' END
  WHEN (coalesce(rsi2 <= 5, false) OR coalesce(pctb <= 0, false)) AND buy_score >= sell_score THEN 'BUY.weak'
  WHEN (coalesce(rsi2 >= 95, false) OR coalesce(pctb >= 1, false)) AND sell_score >= buy_score THEN 'SELL.weak' ELSE 'NEUTRAL.' END AS call FROM bs),
bv AS (SELECT *, CASE WHEN (call LIKE 'BUY%' AND NOT coalesce(rs_delta >= 0, false)) OR (call LIKE 'SELL%' AND NOT coalesce(rs_delta <= 0, false)) THEN 'NEUTRAL' ELSE split_part(call, '.', 1) END AS verdict,
  CASE WHEN (call LIKE 'BUY%' AND NOT coalesce(rs_delta >= 0, false)) OR (call LIKE 'SELL%' AND NOT coalesce(rs_delta <= 0, false)) THEN NULL ELSE nullif(split_part(call, '.', 2), '') END AS tier FROM bv0)"""


def _swing_sql() -> str:
    up, down = (lambda x, *c: f"coalesce({ladder_sql(x, c, '>=')}, 0)"), (lambda x, *c: f"coalesce({ladder_sql(x, c, '<=')}, 0)")
    f = "coalesce(flow10, 0)"

    def surge(s: int) -> str:
        with_day, against = ("close > pc", "close < pc") if s > 0 else ("close < pc", "close > pc")
        g = f if s > 0 else f"-{f}"
        return f"""CASE WHEN rv IS NULL THEN 0 WHEN (rv >= 1.5 AND {against}) OR {g} <= -0.3 THEN 0 WHEN {with_day} AND (rv >= 2.5 OR (rv >= 1.5 AND {g} >= 0.3)) THEN 3
  WHEN ({with_day} AND rv >= 1.5) OR ({g} >= 0.3 AND rv >= 0.8) THEN 2 WHEN rv >= 0.8 THEN 1 ELSE 0 END"""

    floors = (FLOORS["least"], FLOORS["good"], FLOORS["best"])
    return f"""
sw0 AS (SELECT *, CASE WHEN close > sma50 AND sma50 > sma200 AND (close - sma50) / sma50 >= 0.08 THEN 3 WHEN close > sma50 AND sma50 > sma200 THEN 2 WHEN close > sma50 THEN 1 ELSE 0 END AS trend_buy,
  CASE WHEN close < sma50 AND sma50 < sma200 AND (sma50 - close) / sma50 >= 0.08 THEN 3 WHEN close < sma50 AND sma50 < sma200 THEN 2 WHEN close < sma50 THEN 1 ELSE 0 END AS trend_sell,
  {up('ret63', 0.0, 0.05, 0.15)} AS mom_buy, {down('ret63', 0.0, -0.05, -0.15)} AS mom_sell,
  CASE WHEN off_high > 0.05 AND off_high <= 0.18 THEN 3 WHEN off_high <= 0.05 THEN 2 WHEN off_high <= 0.30 THEN 1 ELSE 0 END AS near_buy, {down('off_low', 0.30, 0.15, 0.05)} AS near_sell,
  {up('adv', *floors)} AS liq_buy, {up('adv', *floors)} AS liq_sell, {surge(1)} AS vol_buy, {surge(-1)} AS vol_sell,
  {up('sec_delta', -0.03, 0.08, 0.15)} AS sec_buy, {down('sec_delta', 0.03, -0.08, -0.15)} AS sec_sell FROM market),
sw AS (SELECT *, trend_buy + mom_buy + near_buy + liq_buy + vol_buy + sec_buy AS core, trend_sell + mom_sell + near_sell + liq_sell + vol_sell + sec_sell AS core_short,
  close > sma50 AND sma50 > sma200 AS clean_uptrend, sma50 < sma200 AS death_cross FROM sw0 WHERE rn >= 200)"""


VIEWS = (
    """ticks AS (SELECT n_name AS sym, r_name AS sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS q, l_returnflag, l_extendedprice,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bars AS (SELECT sym, any_value(sector) AS sector, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q) AS volume FROM ticks GROUP BY sym, date),
sector_bars AS (SELECT sector, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q) AS volume FROM ticks GROUP BY sector, date),
index_bars AS (SELECT 'INDEX' AS sym, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q) AS volume FROM ticks GROUP BY date),
ord AS (SELECT o.*, n_name AS sym, CAST(o_orderdate AS DATE) AS date FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
earnings AS (SELECT DISTINCT sym, date FROM ord WHERE o_orderpriority = '1-URGENT'),
statements AS (SELECT sym, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS period_end, sum(o_totalprice) AS revenue, count(*) AS n_orders,
  CAST(last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) + 45 AS DATE) AS accepted_date FROM ord GROUP BY ALL),"""
    + _ind_sql("ind", "bars", "sym") + "," + _ind_sql("ix", "index_bars", "sym") + "," + _ind_sql("sx", "sector_bars", "sector") + "," + _bounce_sql() + "," + _swing_sql()
)
