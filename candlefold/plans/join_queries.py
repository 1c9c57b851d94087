"""As-of and range joins, forward bars, snapshot differences, set membership."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlefold.operators import asof, indicators, stats, trades
from candlefold.plans.base import C, bars, index_ind, query, r, regime, swing, with_market
from candlefold.sources import tables

# ---- C -------------------------------------------------------------------------------------------------------------


@query("c01_sector_lookup", """, ov AS (SELECT * FROM (VALUES ('NATION_1', 'X'), ('NATION_2', 'Y')) t(sym, sec)), p AS (SELECT n_name AS sym, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT b.sym, count(*) AS n, any_value(coalesce(ov.sec, p.sector)) AS series FROM bars b LEFT JOIN ov USING (sym) LEFT JOIN p USING (sym) GROUP BY b.sym""")
def c01(s, d):
    over = s.createDataFrame([("NATION_1", "X"), ("NATION_2", "Y")], "sym string, sec string")
    place = tables.places_of(s, d).select("sym", C("sector").alias("place"))
    j = bars(s, d).select("sym").join(F.broadcast(over), "sym", "left").join(F.broadcast(place), "sym", "left")
    return j.groupBy("sym").agg(F.count("*").alias("n"), F.first(F.coalesce("sec", "place")).alias("series"))


@query("c02_backward_asof", "SELECT b.sym, b.date, e.date AS last_earnings FROM bars b ASOF LEFT JOIN earnings e ON b.sym = e.sym AND b.date >= e.date")
def c02(s, d):
    e = tables.earnings(s, d).select("sym", "date", C("date").alias("last_earnings"))
    return asof.backward(bars(s, d).select("sym", "date"), e, "last_earnings", ("sym",))


@query("c03_benchmark_return", """, t AS (SELECT sym, date AS entry_date, lead(date, 10) OVER (PARTITION BY sym ORDER BY date) AS exit_date FROM bars),
x AS (SELECT t.sym, t.entry_date, t.exit_date, a.close AS e FROM t ASOF LEFT JOIN index_bars a ON t.entry_date >= a.date WHERE t.exit_date IS NOT NULL)
SELECT x.sym, x.entry_date, floor((b.close - e) / e * 10000 + 0.5) / 100 AS bench_pct FROM x ASOF LEFT JOIN index_bars b ON x.exit_date >= b.date""")
def c03(s, d):
    w = Window.partitionBy("sym").orderBy("date")
    t = bars(s, d).select("sym", C("date").alias("entry_date"), F.lead("date", 10).over(w).alias("exit_date")).where("exit_date is not null")
    return asof.benchmark_return(t, tables.index_bars(s, d)).select("sym", "entry_date", "bench_pct")


@query("c04_forward_asof", "SELECT b.sym, b.date, (e.date - b.date)::INT AS days FROM bars b ASOF LEFT JOIN earnings e ON b.sym = e.sym AND b.date < e.date")
def c04(s, d):
    n = asof.forward(bars(s, d).select("sym", "date"), tables.earnings(s, d), ("sym",))
    return n.select("sym", "date", F.datediff("next_date", "date").alias("days"))


@query("c05_history_as_of", "SELECT sym, count(*) AS n, max(date) AS last, round(sum(volume), 2) AS volume FROM bars WHERE date <= DATE '1997-06-30' GROUP BY sym")
def c05(s, d):
    h = bars(s, d).where("date <= date'1997-06-30'")
    return h.groupBy("sym").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.round(F.sum("volume"), 2).alias("volume"))


@query("c06_forward_bars", """, e AS (SELECT sym, rn::INT AS rn, close AS entry FROM ind WHERE pctb <= 0.15)
SELECT e.sym, e.rn, (f.rn - e.rn)::INT AS day, round(f.close / entry - 1, 5) AS ret FROM e JOIN ind f ON f.sym = e.sym AND f.rn BETWEEN e.rn + 1 AND e.rn + 10""")
def c06(s, d):
    x = indicators.indicators(bars(s, d))
    e = x.where("pctb <= 0.15").select("sym", "rn", C("close").alias("entry"))
    return asof.forward_bars(e, x, 10, ("close",)).select("sym", "rn", "day", r(C("f_close") / C("entry") - 1, 5, "ret"))


@query("c07_point_in_time", """, c AS (SELECT DISTINCT sym, last_day(date) AS date FROM bars), j AS (SELECT c.sym, c.date, st.revenue, row_number() OVER (PARTITION BY c.sym, c.date ORDER BY st.period_end DESC) AS k FROM c JOIN statements st ON st.sym = c.sym AND st.accepted_date <= c.date)
SELECT sym, date, count(*) AS n, round(sum(revenue), 2) AS ttm FROM j WHERE k <= 4 GROUP BY sym, date""")
def c07(s, d):
    c = bars(s, d).select("sym", F.last_day("date").alias("date")).distinct()
    return asof.point_in_time(c, tables.statements(s, d), 4).groupBy("sym", "date").agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 2).alias("ttm"))


@query("c08_snapshot_60_days", """, c AS (SELECT DISTINCT sym, last_day(date) AS date FROM bars), j AS (SELECT c.sym, c.date, st.accepted_date AS d, st.revenue AS v FROM c JOIN statements st ON st.sym = c.sym AND st.accepted_date <= c.date)
SELECT sym, date, arg_max(v, d) AS now, CASE WHEN count(*) >= 2 THEN coalesce(arg_max(v, d) FILTER (d <= date - 60), arg_min(v, d)) END AS then FROM j GROUP BY sym, date""")
def c08(s, d):
    c = bars(s, d).select("sym", F.last_day("date").alias("date")).distinct()
    return asof.back_or_oldest(c, tables.statements(s, d).select("sym", C("accepted_date").alias("date"), "revenue"), "revenue")


@query("c09_snapshot_diff", """, w AS (SELECT sym, date, verdict, close, lag(verdict) OVER (PARTITION BY sym ORDER BY date) AS was, lag(close) OVER (PARTITION BY sym ORDER BY date) AS before FROM bv)
SELECT sym, date, was, verdict, round((close / before - 1) * 100, 3) AS move_pct FROM w WHERE was IS NOT NULL AND (was <> verdict) AND abs(close / before - 1) >= 0.01""")
def c09(s, d):
    from candlefold.plans.base import bounce

    w = Window.partitionBy("sym").orderBy("date")
    x = bounce(s, d).select("sym", "date", "verdict", F.lag("verdict").over(w).alias("was"), (C("close") / F.lag("close").over(w) - 1).alias("m"))
    return x.where((C("was") != C("verdict")) & (F.abs("m") >= 0.01)).select("sym", "date", "was", "verdict", r(C("m") * 100, 3, "move_pct"))


@query("c10_side_changes", """, a AS (SELECT sym, CASE WHEN verdict IN ('BUY', 'SELL') THEN verdict ELSE 'FLAT' END AS side FROM bv WHERE date = (SELECT max(date) FROM bars WHERE date < (SELECT max(date) - 30 FROM bars))),
b AS (SELECT sym, CASE WHEN verdict IN ('BUY', 'SELL') THEN verdict ELSE 'FLAT' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM bv) WHERE k = 1)
SELECT b.sym, coalesce(a.side, 'FLAT') AS was, b.side AS now FROM b LEFT JOIN a USING (sym)""")
def c10(s, d):
    from candlefold.plans.base import bounce

    v = bounce(s, d).select("sym", "date", F.when(C("verdict").isin("BUY", "SELL"), C("verdict")).otherwise("FLAT").alias("side"))
    ends = bars(s, d).agg(F.date_sub(F.max("date"), 30).alias("cut"))
    day = bars(s, d).select("date").join(F.broadcast(ends), C("date") < C("cut")).agg(F.max("date").alias("date"))
    a = v.join(F.broadcast(day), "date").select("sym", C("side").alias("was"))
    b = tables.last_sessions(v, 1).select("sym", C("side").alias("now"))
    return b.join(a, "sym", "left").select("sym", F.coalesce("was", F.lit("FLAT")).alias("was"), "now")


ANTI = "tracked AS (SELECT DISTINCT sym FROM ord WHERE o_orderpriority = '5-LOW' AND date >= DATE '1998-07-15' AND o_totalprice > 440000), cooling AS (SELECT DISTINCT sym FROM ind WHERE date >= (SELECT max(date) FROM bars) - 10 AND close / pc < 0.1)"


@query("c11_exclude_tracked", ", " + ANTI + " SELECT DISTINCT sym FROM bars WHERE sym NOT IN (SELECT sym FROM tracked) AND sym NOT IN (SELECT sym FROM cooling)")
def c11(s, d):
    o = tables._orders(s, d)
    tracked = o.where("o_orderpriority = '5-LOW' and to_date(o_orderdate) >= date'1998-07-15' and o_totalprice > 440000").select("sym").distinct()
    x = indicators.with_ranges(bars(s, d))
    end = x.agg(F.date_sub(F.max("date"), 10).alias("cut"))
    cooling = x.join(F.broadcast(end), C("date") >= C("cut")).where("close / pc < 0.1").select("sym").distinct()
    return bars(s, d).select("sym").distinct().join(tracked, "sym", "left_anti").join(cooling, "sym", "left_anti")


@query("c12_losers_in_quality", "SELECT DISTINCT sym FROM ind WHERE date >= DATE '1998-07-01' AND close / pc < 0.2 AND sym IN (SELECT sym FROM ord GROUP BY sym HAVING sum(o_totalprice) > (SELECT sum(o_totalprice) / 30 FROM ord))")
def c12(s, d):
    o = tables._orders(s, d)
    total = o.agg((F.sum("o_totalprice") / 30).alias("t"))
    good = o.groupBy("sym").agg(F.sum("o_totalprice").alias("v")).join(F.broadcast(total), C("v") > C("t")).select("sym")
    losers = indicators.with_ranges(bars(s, d)).where("date >= date'1998-07-01' and close / pc < 0.2").select("sym").distinct()
    return losers.join(good, "sym", "left_semi")


@query("c13_first_cross_after_entry", """, e AS (SELECT sym, date AS entry_date, date + 120 AS stop_date FROM ind WHERE pctb <= 0.15),
x AS (SELECT date FROM (SELECT date, close < sma200 AS below, lag(close < sma200) OVER (ORDER BY date) AS was FROM ix WHERE rn >= 200) WHERE below AND was IS NOT NULL AND NOT was)
SELECT e.sym, entry_date, min(x.date) AS cross_date, (SELECT min(b.date) FROM bars b WHERE b.sym = e.sym AND b.date >= min(x.date)) AS exit_bar FROM e LEFT JOIN x ON x.date > entry_date AND x.date <= stop_date GROUP BY e.sym, entry_date""")
def c13(s, d):
    x = indicators.indicators(bars(s, d))
    e = x.where("pctb <= 0.15").select("sym", C("date").alias("entry_date"), F.date_add("date", 120).alias("stop_date"))
    i = index_ind(s, d).where("rn >= 200").select("date", (C("close") < C("sma200")).alias("below"))
    cross = i.withColumn("was", F.lag("below").over(Window.orderBy("date"))).where("below and not was").select("date")  # one series
    first = asof.first_after(e, cross, C("entry_date"), C("stop_date"), "cross_date")
    hit = asof.forward(first.withColumn("date", F.date_sub("cross_date", 1)), bars(s, d).select("sym", "date"), ("sym",), name="exit_bar")
    return hit.select("sym", "entry_date", "cross_date", F.when(C("cross_date").isNotNull(), C("exit_bar")).alias("exit_bar"))


CRISES = [("A", 1, "1994-01-01", "1994-12-31"), ("B", 2, "1994-06-01", "1995-12-31"), ("C", 3, "1997-06-01", "1998-01-31")]
CRISES_SQL = "crises AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {o}, DATE '{a}', DATE '{b}')" for n, o, a, b in CRISES) + ") t(period, ordinal, a, b))"


@query("c14_named_interval", f", {CRISES_SQL} SELECT i.date, (SELECT arg_min(period, ordinal) FROM crises WHERE i.date BETWEEN a AND b) AS period FROM index_bars i")
def c14(s, d):
    iv = s.createDataFrame(CRISES, "period string, ordinal int, `from` string, `to` string").select("period", "ordinal", C("from").cast("date"), C("to").cast("date"))
    return asof.named_interval(tables.index_bars(s, d).select("date"), iv)


@query("c15_rules_by_entries", ", ru AS (SELECT * FROM (VALUES ('a', 0.15), ('b', 0.2), ('c', 0.25)) t(label, cut)) SELECT label, count(*) AS n FROM ind, ru WHERE pctb <= cut GROUP BY label")
def c15(s, d):
    rules = s.createDataFrame([("a", 0.15), ("b", 0.2), ("c", 0.25)], "label string, cut double")
    return indicators.indicators(bars(s, d)).crossJoin(F.broadcast(rules)).where("pctb <= cut").groupBy("label").agg(F.count("*").alias("n"))


PAIRS = ("trend", "mom", "near", "vol", "sec")


@query("c16_factor_pairs", ", l AS (" + " UNION ALL ".join(f"SELECT sym, date, '{k}' AS key, {k}_buy AS p FROM sw" for k in PAIRS) + ") SELECT a.key AS a, b.key AS b, round(corr(a.p, b.p), 4) AS corr FROM l a JOIN l b USING (sym, date) WHERE a.key < b.key GROUP BY a.key, b.key")
def c16(s, d):
    """Five factors make ten pairs: columns of one pass rather than a self join."""
    x = swing(s, d).where("rn >= 200")
    pairs = [(a, b) for a in PAIRS for b in PAIRS if a < b]
    one = x.agg(*[F.round(stats.corr(C(f"{a}_buy"), C(f"{b}_buy")), 4).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return one.select(F.explode(rows).alias("p")).select("p.*")


@query("c17_two_arms", ", a AS (SELECT sym, count(*) FILTER (verdict = 'BUY') AS n FROM bv GROUP BY sym), b AS (SELECT sym, count(*) FILTER (core >= 8) AS n FROM sw GROUP BY sym) SELECT sym, a.n AS bounce, b.n AS swing FROM a FULL JOIN b USING (sym)")
def c17(s, d):
    from candlefold.plans.base import bounce

    a = bounce(s, d).select("sym", F.lit("bounce").alias("arm"), (C("verdict") == "BUY").alias("hit"))
    b = swing(s, d).where("rn >= 200").select("sym", F.lit("swing").alias("arm"), (C("core") >= 8).alias("hit"))
    return a.unionByName(b).groupBy("sym").pivot("arm", ["bounce", "swing"]).agg(F.count_if("hit"))


@query("c18_beta_join", ", p AS (SELECT ind.sym, ind.close / ind.pc - 1 AS y, ix.close / ix.pc - 1 AS x FROM ind JOIN ix USING (date)) SELECT sym, count(*) FILTER (y IS NOT NULL AND x IS NOT NULL) AS n, round(regr_slope(y, x), 4) AS beta FROM p GROUP BY sym")
def c18(s, d):
    i = index_ind(s, d).select("date", (C("close") / C("pc") - 1).alias("x"))
    j = indicators.with_ranges(bars(s, d)).select("sym", "date", (C("close") / C("pc") - 1).alias("y")).join(F.broadcast(i), "date")
    return j.groupBy("sym").agg(F.count_if(C("y").isNotNull() & C("x").isNotNull()).alias("n"), F.round(F.regr_slope("y", "x"), 4).alias("beta"))


@query("c19_check_dates", """, ch AS (SELECT sym, dt AS date FROM (SELECT DISTINCT sym FROM bars), (VALUES (DATE '1995-06-30'), (DATE '1996-12-31'), (DATE '1998-03-31')) t(dt))
SELECT ch.sym, ch.date, round(m.strength, 4) AS strength, round(m.sec_delta, 4) AS sec_delta FROM ch ASOF LEFT JOIN market m ON ch.sym = m.sym AND ch.date >= m.date""")
def c19(s, d):
    dates = s.createDataFrame([("1995-06-30",), ("1996-12-31",), ("1998-03-31",)], "date string").select(C("date").cast("date"))
    checks = tables.places_of(s, d).select("sym").join(bars(s, d).select("sym").distinct(), "sym", "left_semi").crossJoin(F.broadcast(dates))
    m = with_market(s, d).select("sym", "date", F.struct("strength", "sec_delta").alias("v"))
    j = asof.backward(checks, m, "v", ("sym",))
    return j.select("sym", "date", r("v.strength", 4, "strength"), r("v.sec_delta", 4, "sec_delta"))


# ---- G: ranking and sets -------------------------------------------------------------------------------------------

from candlefold.operators import ranking  # noqa: E402

LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS age FROM bv) WHERE age = 1)"


def last_rows(s, d):
    from candlefold.plans.base import bounce

    return tables.last_sessions(bounce(s, d), 1)


@query("g01_diversified_top", f""", {LAST}, k AS (SELECT sym, sector, buy_score, sell_score, row_number() OVER (PARTITION BY sector ORDER BY buy_score DESC, sell_score, sym) AS r FROM last)
SELECT sym, sector, buy_score FROM k ORDER BY (r > 2)::INT, buy_score DESC, sell_score, sym LIMIT 12""")
def g01(s, d):
    order = (F.desc("buy_score"), F.asc("sell_score"), F.asc("sym"))
    return ranking.diversified(last_rows(s, d).select("sym", "sector", "buy_score", "sell_score"), order, 12, 2).select("sym", "sector", "buy_score")


@query("g02_universe_top", f""", {LAST}, a AS (SELECT sym, row_number() OVER (ORDER BY close / pc, sym) AS o FROM last WHERE close < pc), u AS (SELECT sym, 0 AS p, o::DOUBLE AS o FROM a UNION ALL SELECT sym, 1, -money FROM last),
m AS (SELECT sym, p, o, row_number() OVER (PARTITION BY sym ORDER BY p, o) AS k FROM u) SELECT sym, (row_number() OVER (ORDER BY p, o, sym))::INT AS rank FROM m WHERE k = 1 ORDER BY p, o, sym LIMIT 15""")
def g02(s, d):
    x = last_rows(s, d)
    losers = x.where("close < pc").select("sym", F.row_number().over(Window.orderBy(C("close") / C("pc"), "sym")).alias("feed_order"))
    return ranking.universe_top(losers, x.select("sym", "money"), 15)


@query("g03_movers", f", {LAST} SELECT sym, round((close / pc - 1) * 100, 3) AS move FROM last ORDER BY abs(close / pc - 1) DESC, sym LIMIT 10")
def g03(s, d):
    m = C("close") / C("pc") - 1
    return last_rows(s, d).orderBy(F.desc(F.abs(m)), "sym").limit(10).select("sym", r(m * 100, 3, "move"))


@query("g04_entry_digest", """, x AS (SELECT sym, date, verdict AS side, CASE verdict WHEN 'BUY' THEN buy_score ELSE sell_score END AS score FROM bv WHERE verdict <> 'NEUTRAL'),
k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score DESC, date, sym) AS rank, count(*) OVER (PARTITION BY side) AS n FROM x) SELECT sym, date, side, score, rank::INT AS rank, greatest(n - 8, 0) AS overflow FROM k WHERE rank <= 8""")
def g04(s, d):
    from candlefold.plans.base import bounce

    x = bounce(s, d).where("verdict <> 'NEUTRAL'").select("sym", "date", C("verdict").alias("side"), F.when(C("verdict") == "BUY", C("buy_score")).otherwise(C("sell_score")).alias("score"))
    return ranking.digest(x, "side", (F.desc("score"), F.asc("date"), F.asc("sym")))


@query("g06_last_sessions", ", k AS (SELECT sym, date, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM bars) SELECT sym, date FROM k WHERE k <= 15")
def g06(s, d):
    return tables.last_sessions(bars(s, d).select("sym", "date"), 15)


SETS = f", {LAST}, a AS (SELECT sym FROM last WHERE buy_score >= 2), b AS (SELECT sym FROM last WHERE sell_score >= 2)"


def sets(s, d):
    x = last_rows(s, d)
    return x.where("buy_score >= 2").select("sym"), x.where("sell_score >= 2").select("sym")


@query("g07_union_distinct", SETS + " SELECT sym FROM a UNION SELECT sym FROM b")
def g07(s, d):
    a, b = sets(s, d)
    return a.union(b).distinct()


@query("g08_intersect", SETS + " SELECT sym FROM a INTERSECT SELECT sym FROM b")
def g08(s, d):
    a, b = sets(s, d)
    return a.intersect(b)


@query("g09_except", SETS + " SELECT sym FROM b EXCEPT SELECT sym FROM a")
def g09(s, d):
    a, b = sets(s, d)
    return b.subtract(a)


@query("g10_first_rule_wins", ", ru AS (SELECT o_orderpriority AS label, o_orderkey AS id, o_totalprice AS v FROM orders) SELECT label, arg_min(v, id) AS v, count(*) AS n FROM ru GROUP BY label")
def g10(s, d):
    o = tables.table(s, d, "orders")
    return o.groupBy(C("o_orderpriority").alias("label")).agg(F.min_by("o_totalprice", "o_orderkey").alias("v"), F.count("*").alias("n"))
