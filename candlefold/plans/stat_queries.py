"""Statistics over swing bars and exits: attribution, splits, regimes, resampling, sweeps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlefold.operators import indicators, scoring, stats
from candlefold.plans.base import C, bars, index_ind, query, r, regime, swing
from candlefold.sources import tables
from candlefold.sources.shared import kept

#: Every swing bar with its truncated 21-bar forward return in percent and the index's.
FWD = """, f AS (SELECT sw.*, fw.fwd, fw.edge, year(sw.date) AS yr, hash_id FROM sw JOIN (SELECT sym, date, rn || '' AS hash_id, (lead(close, 21) OVER w / close - 1) * 100 AS fwd,
  (lead(close, 21) OVER w / close - 1) * 100 - coalesce((SELECT 0), 0) AS edge FROM ind WINDOW w AS (PARTITION BY sym ORDER BY date)) fw USING (sym, date) WHERE fw.fwd IS NOT NULL)"""
KEYS = ("trend", "mom", "near", "liq", "vol", "sec")


def fwd(s, d):
    x = swing(s, d)
    w = Window.partitionBy("sym").orderBy("date")
    return x.withColumn("fwd", (F.lead("close", 21).over(w) / C("close") - 1) * 100).where("rn >= 200 and fwd is not null").withColumn("yr", F.year("date"))


def rounded(df, *keys, n=4, ints=()):
    return df.select(*keys, *[C(c) if c in ints else F.round(c, n).alias(c) for c in df.columns if c not in keys])


SUMMARY = """count(fwd) AS n, round(avg(fwd), 4) AS mean, round(avg((fwd > 0)::INT), 4) AS win_rate, round(CASE WHEN sum(CASE WHEN fwd <= 0 THEN -fwd END) > 0 THEN coalesce(sum(CASE WHEN fwd > 0 THEN fwd END), 0) / sum(CASE WHEN fwd <= 0 THEN -fwd END) END, 4) AS profit_factor,
round(stddev_samp(fwd), 4) AS sd, round(avg(fwd) / stddev_samp(fwd), 4) AS sharpe, round(avg(fwd) / sqrt(sum(CASE WHEN fwd < 0 THEN fwd * fwd END) / count(*) FILTER (fwd < 0)), 4) AS sortino, round(quantile_disc(fwd, 0.5), 4) AS median_low"""


@query("f01_f02_f06_summary", FWD + f" SELECT core, {SUMMARY} FROM f GROUP BY core")
def f01(s, d):
    return rounded(stats.summary(fwd(s, d), "fwd", "core"), "core", ints=("n",))


@query("f03_pearson_ic", FWD + " SELECT yr::INT AS yr, count(*) AS n, round(corr(core, fwd), 4) AS ic FROM f GROUP BY yr")
def f03(s, d):
    return rounded(stats.pearson(fwd(s, d), "core", "fwd", "yr"), "yr", ints=("n",))


@query("f04_spearman", FWD + """, rk AS (SELECT sym, rank() OVER (PARTITION BY sym ORDER BY core) + (count(*) OVER (PARTITION BY sym, core) - 1) / 2.0 AS a, rank() OVER (PARTITION BY sym ORDER BY fwd) + (count(*) OVER (PARTITION BY sym, fwd) - 1) / 2.0 AS b FROM f)
SELECT sym, count(*) AS n, round(corr(a, b), 4) AS ic FROM rk GROUP BY sym""")
def f04(s, d):
    return rounded(stats.spearman(fwd(s, d), "core", "fwd", "sym"), "sym", ints=("n",))


@query("f05_percentiles", FWD + """, k AS (SELECT sym, fwd, row_number() OVER (PARTITION BY sym ORDER BY fwd) AS k, count(*) OVER (PARTITION BY sym) AS n FROM f)
SELECT sym, round(max(fwd) FILTER (k = (n - 1) // 2 + 1), 4) AS lower_median, round(max(fwd) FILTER (k = floor(0.9 * n) + 1), 4) AS p90 FROM k GROUP BY sym""")
def f05(s, d):
    w = Window.partitionBy("sym")
    k = fwd(s, d).select("sym", "fwd", F.row_number().over(w.orderBy("fwd")).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda pos: F.round(F.max(F.when(C("k") == pos, C("fwd"))), 4)
    return k.groupBy("sym").agg(at(F.floor((C("n") - 1) / 2) + 1).alias("lower_median"), at(F.floor(C("n") * 0.9) + 1).alias("p90"))


@query("f07_max_drawdown", """, c AS (SELECT sym, date, exp(sum(ln(1 + (close / pc - 1) / 100)) OVER (PARTITION BY sym ORDER BY date)) AS v FROM ind WHERE pc IS NOT NULL),
p AS (SELECT sym, v, greatest(1, max(v) OVER (PARTITION BY sym ORDER BY date)) AS p FROM c) SELECT sym, round(min((v / p - 1) * 100), 4) AS max_drawdown FROM p GROUP BY sym""")
def f07(s, d):
    x = indicators.with_ranges(bars(s, d)).where("pc is not null").select("sym", "date", (C("close") / C("pc") - 1).alias("pct"))
    return rounded(stats.max_drawdown(x, "pct", "date", "sym"), "sym")


LONG = FWD + ", lf AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, {k}_buy AS points, fwd FROM f" for k in KEYS) + ")"


@query("f09_attribution", LONG + """ SELECT key, points, count(*) AS n, round(avg(fwd), 4) AS avg_ret, round(avg((fwd > 0)::INT), 4) AS win_rate,
round(CASE WHEN grouping(points) = 1 THEN corr(points_, fwd) END, 4) AS ic FROM (SELECT *, points AS points_ FROM lf) GROUP BY GROUPING SETS ((key, points), (key))""")
def f09(s, d):
    long = stats.unpivot_factors(fwd(s, d), KEYS, ("fwd",))
    by = long.groupBy("key", "points").agg(F.count("*").alias("n"), F.avg("fwd").alias("avg_ret"), F.avg((C("fwd") > 0).cast("double")).alias("win_rate"), F.lit(None).cast("double").alias("ic"))
    whole = long.groupBy("key").agg(F.lit(None).cast("int").alias("points"), F.count("*").alias("n"), F.avg("fwd").alias("avg_ret"), F.avg((C("fwd") > 0).cast("double")).alias("win_rate"), stats.corr(C("points"), C("fwd")).alias("ic"))
    return rounded(by.unionByName(whole), "key", "points", ints=("n",))


@query("f10_top_minus_bottom", LONG + """, m AS (SELECT key, avg(fwd) FILTER (points = 0) AS p0, avg(fwd) FILTER (points = 1) AS p1, avg(fwd) FILTER (points = 2) AS p2, avg(fwd) FILTER (points = 3) AS p3 FROM lf GROUP BY key)
SELECT key, round(p3 - p0, 4) AS spread, p0 <= p1 AND p1 <= p2 AND p2 <= p3 AS monotone FROM m""")
def f10(s, d):
    m = stats.unpivot_factors(fwd(s, d), KEYS, ("fwd",)).groupBy("key").pivot("points", [0, 1, 2, 3]).agg(F.avg("fwd"))
    p = [C(f"`{i}`") for i in range(4)]
    return m.select("key", r(p[3] - p[0], 4, "spread"), ((p[0] <= p[1]) & (p[1] <= p[2]) & (p[2] <= p[3])).alias("monotone"))


@query("f11_score_sweep", FWD + """, t AS (SELECT unnest(generate_series(2, 10)) AS bar), u AS (SELECT bar, avg(fwd) FILTER (core >= bar) AS strong, avg(fwd) FILTER (core < bar) AS weak, count(*) FILTER (core >= bar) AS n FROM f, t GROUP BY bar)
SELECT bar::INT AS bar, n, round(strong - weak, 4) AS lift FROM u WHERE n > 0""")
def f11(s, d):
    """Bars are a fixed list: conditional sums per score first, then over the nine thresholds."""
    by = fwd(s, d).groupBy("core").agg(F.sum("fwd").alias("x"), F.count("*").alias("k"))
    t = by.crossJoin(F.broadcast(s.range(2, 11).select(C("id").cast("int").alias("bar"))))  # nine rows
    on = C("core") >= C("bar")
    u = t.groupBy("bar").agg(F.sum(F.when(on, C("k")).otherwise(0)).alias("n"), (F.sum(F.when(on, C("x"))) / F.sum(F.when(on, C("k")))).alias("a"), (F.sum(F.when(~on, C("x"))) / F.sum(F.when(~on, C("k")))).alias("b"))
    return u.where("n > 0").select("bar", "n", r(C("a") - C("b"), 4, "lift"))


@query("f12_quintiles", FWD + """, k AS (SELECT sym, fwd, ceil((row_number() OVER (PARTITION BY sym ORDER BY ret63, date)) * 5 / (count(*) OVER (PARTITION BY sym))::DOUBLE)::BIGINT AS slice FROM f)
SELECT sym, slice, count(*) AS n, round(avg(fwd), 4) AS avg_fwd FROM k GROUP BY sym, slice""")
def f12(s, d):
    k = stats.slices(fwd(s, d), "ret63", 5, ("sym",), ("date",))
    return rounded(k.groupBy("sym", "slice").agg(F.count("*").alias("n"), F.avg("fwd").alias("avg_fwd")), "sym", "slice", ints=("n",))


@query("f13_auc", FWD + """, rk AS (SELECT sym, (fwd > 5)::INT AS y, rank() OVER (PARTITION BY sym ORDER BY core) + (count(*) OVER (PARTITION BY sym, core) - 1) / 2.0 AS a FROM f)
SELECT sym, count(*) AS n, round((sum(a * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 4) AS auc FROM rk GROUP BY sym""")
def f13(s, d):
    return rounded(stats.auc(fwd(s, d), "core", C("fwd") > 5, "sym"), "sym", ints=("n",))


GATES = {"trend": "trend_buy >= 2", "mom": "ret63 >= 0.1", "near": "off_high <= 0.3", "rs": "coalesce(rs126, -9) >= 0", "trend_mom": "trend_buy >= 2 AND ret63 >= 0.1"}
GATE_SQL = FWD + ", g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS gate, ({v}) AS hit, fwd FROM f" for k, v in GATES.items()) + ")"


@query("f14_gate_report", GATE_SQL + " SELECT gate, count(*) FILTER (hit) AS n, round(avg(hit::INT), 4) AS keep, round(avg((fwd > 20)::INT) FILTER (hit), 4) AS big, round(avg((fwd < 0)::INT) FILTER (hit), 4) AS loss, round(count(*) FILTER (hit AND fwd > 20) / count(*) FILTER (fwd > 20)::DOUBLE, 4) AS recall, round(avg(fwd) FILTER (hit), 4) AS avg_fwd, round(min(fwd) FILTER (hit), 4) AS worst FROM g GROUP BY gate")
def f14(s, d):
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), F.expr(v).alias("hit")) for k, v in GATES.items()])
    g = fwd(s, d).select("fwd", F.explode(rows).alias("g")).select("fwd", "g.*")
    hit, big = C("hit"), C("fwd") > 20
    share = lambda c: F.avg(F.when(hit, c.cast("double")))
    rep = g.groupBy("gate").agg(F.count_if(hit).alias("n"), F.avg(hit.cast("double")).alias("keep"), share(big).alias("big"), share(C("fwd") < 0).alias("loss"), (F.count_if(hit & big) / F.count_if(big)).alias("recall"), F.avg(F.when(hit, C("fwd"))).alias("avg_fwd"), F.min(F.when(hit, C("fwd"))).alias("worst"))
    return rounded(rep, "gate", ints=("n",))


@query("f15_chronological_split", FWD + """, k AS (SELECT sym, fwd, row_number() OVER (PARTITION BY sym ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY sym) AS n FROM f), l AS (SELECT sym, fwd, pos < floor(n * 0.7) AS in_sample, (pos * 5 // n)::INT AS fold FROM k)
SELECT sym, in_sample, fold, count(*) AS n, round(avg(fwd), 4) AS avg_fwd FROM l GROUP BY ALL""")
def f15(s, d):
    k = stats.split_chronological(fwd(s, d), "date", ("sym",), ())
    return rounded(k.groupBy("sym", "in_sample", "fold").agg(F.count("*").alias("n"), F.avg("fwd").alias("avg_fwd")), "sym", "in_sample", "fold", ints=("n",))


#: Market crises within the years of the bars, as named windows (first and last day).
CRISES = (("tequila", "1994-12-20", "1995-03-31"), ("asia", "1997-07-02", "1997-12-31"), ("russia", "1998-07-20", "1998-10-08"))
CRISIS_SQL = " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{z}' THEN '{k}'" for k, a, z in CRISES)


@query("f16_splits", FWD + f", x AS (SELECT *, CASE {CRISIS_SQL} END AS crisis FROM f) SELECT yr::INT AS yr, sector, favorable, crisis, count(*) AS n, round(avg(fwd), 4) AS avg_fwd FROM x LEFT JOIN (SELECT date, favorable FROM regime) USING (date) GROUP BY GROUPING SETS ((yr), (sector), (favorable), (crisis), ())")
def f16(s, d):
    x = fwd(s, d).join(F.broadcast(regime(s, d).select("date", "favorable")), "date", "left")
    crisis = F.coalesce(*[F.when(C("date").between(F.lit(a).cast("date"), F.lit(z).cast("date")), k) for k, a, z in CRISES])
    keys = [C("yr"), C("sector"), C("favorable"), C("crisis")]
    g = x.withColumn("crisis", crisis).groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count("*").alias("n"), F.avg("fwd").alias("avg_fwd"))
    return rounded(g, "yr", "sector", "favorable", "crisis", ints=("n",))


@query("f17_regime_classes", """, v AS (SELECT date, close >= sma200 AS bull, sd20 FROM ix WHERE rn >= 200), c AS (SELECT list_sort(list(sd20)) AS l FROM v)
SELECT date, CASE WHEN bull THEN 'bull' ELSE 'bear' END AS trend, CASE WHEN sd20 < l[len(l) // 3 + 1] THEN 'calm' WHEN sd20 < l[2 * len(l) // 3 + 1] THEN 'normal' ELSE 'stress' END AS vol FROM v, c""")
def f17(s, d):
    """Terciles of a calendar-sized series: its sorted values make one array."""
    v = index_ind(s, d).where("rn >= 200").select("date", "close", "sma200", "sd20")
    cuts = v.agg(F.array_sort(F.collect_list("sd20")).alias("l")).select(F.element_at("l", (F.floor(F.size("l") / 3) + 1).cast("int")).alias("a"), F.element_at("l", (F.floor(F.size("l") * 2 / 3) + 1).cast("int")).alias("b"))
    x = v.crossJoin(F.broadcast(cuts))
    return x.select("date", F.when(C("close") >= C("sma200"), "bull").otherwise("bear").alias("trend"), F.when(C("sd20") < C("a"), "calm").when(C("sd20") < C("b"), "normal").otherwise("stress").alias("vol"))


@query("f18_cost_sweep", FWD + " SELECT bps::INT AS bps, round(avg(fwd - 2 * bps / 100.0), 4) AS net, round(avg((fwd - 2 * bps / 100.0 > 0)::INT), 4) AS win FROM f, (SELECT unnest([0, 5, 10, 20, 40]) AS bps) WHERE core >= 6 GROUP BY bps")
def f18(s, d):
    band = s.createDataFrame([(b,) for b in (0, 5, 10, 20, 40)], "bps int")
    net = C("fwd") - C("bps") * 2 / 100
    return rounded(fwd(s, d).where("core >= 6").crossJoin(F.broadcast(band)).groupBy("bps").agg(F.avg(net).alias("net"), F.avg((net > 0).cast("double")).alias("win")), "bps")


UNIFORM = "(('0x' || substr(md5('7_' || rep || '_' || id), 1, 8))::BIGINT / 4294967296.0)"
BOOT = FWD + f""", b AS (SELECT sym || '_' || rn AS id, fwd, unnest(generate_series(1, 2000)) AS rep FROM f WHERE core >= 8), w AS (SELECT rep, fwd, {UNIFORM} AS u FROM b),
m AS (SELECT rep, sum(fwd * k) / sum(k) AS mean FROM (SELECT rep, fwd, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS k FROM w) GROUP BY rep)"""


@query("f19_bootstrap_ci", BOOT + " SELECT count(*) AS reps, round(quantile_disc(mean, 0.025), 4) AS lo, round(avg(mean), 4) AS mid, round(quantile_disc(mean, 0.975), 4) AS hi FROM m")
def f19(s, d):
    x = fwd(s, d).where("core >= 8").select(F.concat_ws("_", "sym", "rn").alias("id"), "fwd")
    m = stats.bootstrap_means(x, "fwd", "id", 2000)
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by mean)")
    return m.agg(F.count("*").alias("reps"), F.round(q(0.025), 4).alias("lo"), F.round(F.avg("mean"), 4).alias("mid"), F.round(q(0.975), 4).alias("hi"))


@query("f20_random_baskets", FWD + """, p AS (SELECT fwd, row_number() OVER (ORDER BY sym, date) - 1 AS i, count(*) OVER () AS n FROM f),
g AS (SELECT rep, slot, ('0x' || substr(md5('7_' || rep || '_' || slot), 1, 8))::BIGINT AS h FROM (SELECT unnest(generate_series(1, 100)) AS rep), (SELECT unnest(generate_series(1, 20)) AS slot)),
b AS (SELECT rep, avg(fwd) AS m FROM g JOIN p ON p.i = g.h % p.n GROUP BY rep) SELECT count(*) AS reps, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, round(((SELECT avg(fwd) FROM f WHERE core >= 8) - avg(m)) / stddev_samp(m), 4) AS z FROM b""")
def f20(s, d):
    """Baskets of 20 bars; positions count on from symbol to symbol, so only the list of symbols is numbered in one pass."""
    x = kept(fwd(s, d).select("sym", "date", "fwd", "core"))
    sizes = x.groupBy("sym").agg(F.count("*").alias("n"))
    order = Window.orderBy("sym")
    starts = sizes.select("sym", (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - C("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("sym").orderBy("date")) - 1
    p = x.withColumn("k", within).hint("merge").join(starts, "sym").select("fwd", (C("start") + C("k")).alias("i"))
    g = s.range(1, 101).select(C("id").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("slot")).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("n"))))
    h = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit("7"), C("rep").cast("string"), C("slot").cast("string"))), 1, 8), 16, 10).cast("long") % C("n")
    b = g.select("rep", h.alias("i")).hint("merge").join(p.hint("merge"), "i").groupBy("rep").agg(F.avg("fwd").alias("m"))
    seen = x.where("core >= 8").agg(F.avg("fwd").alias("o"))
    a = b.agg(F.count("*").alias("reps"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")).crossJoin(F.broadcast(seen))
    return a.select("reps", r("mean"), r("sd"), r((C("o") - C("mean")) / C("sd"), 4, "z"))


@query("f21_significance", FWD + """, a AS (SELECT sym, count(*) AS n, avg(fwd) / (stddev_samp(fwd) / sqrt(count(*))) AS t FROM f WHERE core >= 6 GROUP BY sym), z AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM a),
p AS (SELECT sym, n, t, 2 * (exp(-t * t / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))) AS p FROM z)
SELECT sym, n, round(t, 4) AS t, round(p, 4) AS p, round(least(1, p * 25), 4) AS p_bonferroni, p * 25 < 0.05 AS survives FROM p""")
def f21(s, d):
    return rounded(stats.significance(fwd(s, d).where("core >= 6"), "fwd", F.lit(25), "sym"), "sym", "survives", ints=("n",))


@query("f22_concentration", FWD + """, k AS (SELECT sym, fwd, row_number() OVER (PARTITION BY sym ORDER BY fwd DESC) AS k, count(*) OVER (PARTITION BY sym) AS n, sum(fwd) OVER (PARTITION BY sym) AS total FROM f)
SELECT sym, """ + ", ".join(f"round(sum(fwd) FILTER (k <= n * {p / 100}) / any_value(total), 4) AS top{p}" for p in (1, 5, 10)) + " FROM k GROUP BY sym")
def f22(s, d):
    w = Window.partitionBy("sym")
    k = fwd(s, d).select("sym", "fwd", F.row_number().over(w.orderBy(F.desc("fwd"))).alias("k"), F.count("*").over(w).alias("n"))
    return k.groupBy("sym").agg(*[F.round(F.sum(F.when(C("k") <= C("n") * (p / 100), C("fwd"))) / F.sum("fwd"), 4).alias(f"top{p}") for p in (1, 5, 10)])


@query("f23_overlay", FWD + """, o AS (SELECT fwd, coalesce(uptrend, false) AS bull FROM f LEFT JOIN (SELECT date, uptrend FROM regime) USING (date)), v AS (SELECT 'base' AS variant, fwd, 1.0 AS w FROM o UNION ALL SELECT 'skip_bear', fwd, bull::INT FROM o UNION ALL SELECT 'half_bear', fwd, CASE WHEN bull THEN 1.0 ELSE 0.5 END FROM o)
SELECT variant, round(sum(w)::DOUBLE, 2) AS exposure, round(sum(fwd * w) / nullif(sum(w), 0), 4) AS avg_fwd FROM v GROUP BY variant""")
def f23(s, d):
    x = fwd(s, d).join(F.broadcast(regime(s, d).select("date", "uptrend")), "date", "left")
    bull = F.coalesce(C("uptrend"), F.lit(False))
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), w.cast("double").alias("w")) for n, w in (("base", F.lit(1.0)), ("skip_bear", F.when(bull, 1.0).otherwise(0.0)), ("half_bear", F.when(bull, 1.0).otherwise(0.5)))])
    v = x.select("fwd", F.explode(rows).alias("v")).select("fwd", "v.*")
    return v.groupBy("variant").agg(F.round(F.sum("w"), 2).alias("exposure"), F.round(F.try_divide(F.sum(C("fwd") * C("w")), F.sum("w")), 4).alias("avg_fwd"))


@query("f24_f25_loss_autopsy", FWD + " , g AS (SELECT sector, CASE WHEN fwd < -50 THEN 'a:<-50' WHEN fwd < -25 THEN 'b:<-25' WHEN fwd < 0 THEN 'c:<0' ELSE 'd:gain' END AS bucket, count(*) AS n, avg(fwd) AS a FROM f GROUP BY ALL) SELECT sector, bucket, n, round(a, 4) AS avg_fwd, round(n / sum(n) OVER (PARTITION BY sector), 4) AS share FROM g")
def f24(s, d):
    b = F.when(C("fwd") < -50, "a:<-50").when(C("fwd") < -25, "b:<-25").when(C("fwd") < 0, "c:<0").otherwise("d:gain")
    g = fwd(s, d).groupBy("sector", b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("fwd").alias("avg_fwd"))
    return g.select("sector", "bucket", "n", r("avg_fwd"), r(C("n") / F.sum("n").over(Window.partitionBy("sector")), 4, "share"))


IDX = FWD + """, i AS (SELECT date, (lead(close, 21) OVER (ORDER BY date) / close - 1) * 100 AS ifwd FROM index_bars), e AS (SELECT f.*, i.ifwd FROM f JOIN i USING (date) WHERE ifwd IS NOT NULL)"""


def edge(s, d):
    i = tables.index_bars(s, d)
    ix = i.select("date", ((F.lead("close", 21).over(Window.orderBy("date")) / C("close") - 1) * 100).alias("ifwd"))  # one series
    return fwd(s, d).join(F.broadcast(ix), "date").where("ifwd is not null")


@query("f26_beta_adjusted_edge", IDX + " SELECT yr::INT AS yr, count(*) AS n, round(avg(fwd - ifwd), 4) AS edge, round(avg(fwd - 0.8 * ifwd), 4) AS beta_edge FROM e GROUP BY yr")
def f26(s, d):
    return rounded(edge(s, d).groupBy("yr").agg(F.count("*").alias("n"), F.avg(C("fwd") - C("ifwd")).alias("edge"), F.avg(C("fwd") - 0.8 * C("ifwd")).alias("beta_edge")), "yr", ints=("n",))


@query("f27_f39_ownership_control", IDX + """, a AS (SELECT sym, avg(fwd - ifwd) AS any_edge, avg(fwd - ifwd) FILTER (core >= 8) AS signal_edge, count(*) FILTER (core >= 8) AS k, CASE WHEN avg(adv) >= 120000 THEN 'high' ELSE 'low' END AS tier FROM e GROUP BY sym)
SELECT tier, sum(k)::BIGINT AS n, round(sum((signal_edge - any_edge) * k) / sum(k), 4) AS timing FROM a WHERE k > 0 GROUP BY tier""")
def f27(s, d):
    """Edge of the signal's bars less that of any bar of the name, weighted by the name's signals, per liquidity tier."""
    x, on = edge(s, d), C("core") >= 8
    e = C("fwd") - C("ifwd")
    a = x.groupBy("sym").agg(F.avg(e).alias("any"), F.avg(F.when(on, e)).alias("sig"), F.count_if(on).alias("k"), F.when(F.avg("adv") >= 120000, "high").otherwise("low").alias("tier")).where("k > 0")
    return a.groupBy("tier").agg(F.sum("k").alias("n"), F.round(F.sum((C("sig") - C("any")) * C("k")) / F.sum("k"), 4).alias("timing"))


@query("f28_benchmarks", FWD + """, m AS (SELECT yr, fwd, row_number() OVER (PARTITION BY yr ORDER BY ret63 DESC, sym, date) AS k, count(*) OVER (PARTITION BY yr) AS n FROM f)
SELECT yr::INT AS yr, round(avg(fwd), 4) AS equal_weight, round(avg(fwd) FILTER (k <= n * 0.1), 4) AS top_decile FROM m GROUP BY yr""")
def f28(s, d):
    """The top decile's cut is taken per year: pass one counts, pass two ranks within the year."""
    w = Window.partitionBy("yr")
    m = fwd(s, d).select("yr", "fwd", F.row_number().over(w.orderBy(F.desc("ret63"), "sym", "date")).alias("k"), F.count("*").over(w).alias("n"))
    return m.groupBy("yr").agg(F.round(F.avg("fwd"), 4).alias("equal_weight"), F.round(F.avg(F.when(C("k") <= C("n") * 0.1, C("fwd"))), 4).alias("top_decile"))


@query("f29_half_lift", FWD + """, h AS (SELECT sym, fwd, row_number() OVER (PARTITION BY sym ORDER BY mom_buy + near_buy + vol_buy, date) AS k, count(*) OVER (PARTITION BY sym) AS n FROM f)
SELECT sym, round(avg(fwd) FILTER (k > n // 2) - avg(fwd) FILTER (k <= n // 2), 4) AS lift FROM h GROUP BY sym""")
def f29(s, d):
    w = Window.partitionBy("sym")
    h = fwd(s, d).select("sym", "fwd", F.row_number().over(w.orderBy(C("mom_buy") + C("near_buy") + C("vol_buy"), "date")).alias("k"), F.count("*").over(w).alias("n"))
    top = C("k") > F.floor(C("n") / 2)
    return h.groupBy("sym").agg(F.round(F.avg(F.when(top, C("fwd"))) - F.avg(F.when(~top, C("fwd"))), 4).alias("lift"))


@query("f30_transfer", LONG.replace("points, fwd FROM f", "points, fwd, sector FROM f").replace("_buy AS points, fwd, sector", "_buy AS points, fwd, sector") + """, c AS (SELECT key, sector, CASE WHEN min(points) < max(points) AND min(fwd) < max(fwd) THEN corr(points, fwd) END AS ic FROM lf GROUP BY key, sector)
SELECT key, round(avg(ic), 4) AS mean_ic, count(*) FILTER (ic > 0) AS pos, count(*) FILTER (ic < 0) AS neg FROM c GROUP BY key""")
def f30(s, d):
    """Sign agreement of each factor's correlation across the sectors as universes; a sector without variance has none."""
    c = stats.unpivot_factors(fwd(s, d), KEYS, ("fwd", "sector")).groupBy("key", "sector").agg(stats.corr(C("points"), C("fwd")).alias("ic"))
    return c.groupBy("key").agg(F.round(F.avg(F.when(~F.isnan("ic"), C("ic"))), 4).alias("mean_ic"), F.count_if((C("ic") > 0) & ~F.isnan("ic")).alias("pos"), F.count_if(C("ic") < 0).alias("neg"))


@query("f31_f32_sweep_matched_n", FWD + """, t AS (SELECT unnest([0, 40000, 80000, 120000, 160000, 200000]) AS floor), u AS (SELECT floor, count(*) AS n, avg(fwd) AS a FROM f, t WHERE adv >= floor GROUP BY floor)
SELECT floor::DOUBLE AS floor, n, round(a, 4) AS avg_fwd, floor = (SELECT floor FROM u ORDER BY abs(n - 10000), floor LIMIT 1) AS nearest FROM u""")
def f31(s, d):
    """The floor whose number of bars is nearest to 10,000 is marked; of several the smallest, as the reference takes the first."""
    t = s.createDataFrame([(float(x),) for x in (0, 40000, 80000, 120000, 160000, 200000)], "floor double")
    u = fwd(s, d).select("adv", "fwd").crossJoin(F.broadcast(t)).where("adv >= floor").groupBy("floor").agg(F.count("*").alias("n"), F.avg("fwd").alias("a"))
    best = u.agg(F.min(F.struct(F.abs(C("n") - 10000), "floor"))["floor"].alias("best"))
    return u.crossJoin(F.broadcast(best)).select("floor", "n", r("a", 4, "avg_fwd"), (C("floor") == C("best")).alias("nearest"))


@query("f33_scan_health", ", h AS (SELECT date, count(*) AS usable, count(*) FILTER (rv IS NULL) AS na, count(*) FILTER (volume < 20) AS stale FROM ind GROUP BY date) SELECT date, usable, na, stale, (na + stale) * 2 > usable AS degraded FROM h")
def f33(s, d):
    h = indicators.indicators(bars(s, d)).groupBy("date").agg(F.count("*").alias("usable"), F.count_if(C("rv").isNull()).alias("na"), F.count_if(C("volume") < 20).alias("stale"))
    return h.select("*", ((C("na") + C("stale")) * 2 > C("usable")).alias("degraded"))


@query("f34_event_study", FWD + """, x AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY sym, yr) AS ex FROM f), c AS (SELECT date, avg(fwd) AS m, avg(ex) AS e FROM x WHERE rsi2 <= 10 GROUP BY date)
SELECT count(*) AS dates, round(avg(m), 4) AS mean, round(avg(e), 4) AS excess, round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 4) AS t FROM c""")
def f34(s, d):
    """One observation per date, so names that fall together count once."""
    x = fwd(s, d).withColumn("ex", C("fwd") - F.avg("fwd").over(Window.partitionBy("sym", "yr")))
    c = x.where("rsi2 <= 10").groupBy("date").agg(F.avg("fwd").alias("m"), F.avg("ex").alias("e"))
    return c.agg(F.count("*").alias("dates"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.avg("e"), 4).alias("excess"), F.round(F.avg("e") / (F.stddev_samp("e") / F.sqrt(F.count("*"))), 4).alias("t"))


@query("f35_concurrency", """, tr AS (SELECT date AS a, date + 10 AS b FROM ind WHERE pctb <= 0.15), ev AS (SELECT a AS date, 1 AS d FROM tr UNION ALL SELECT b, -1 FROM tr), da AS (SELECT date, sum(d) AS d FROM ev GROUP BY date)
SELECT date, (sum(d) OVER (ORDER BY date))::BIGINT AS open_trades FROM da""")
def f35(s, d):
    t = indicators.indicators(bars(s, d)).where("pctb <= 0.15").select(C("date").alias("entry_date"), F.date_add("date", 10).alias("exit_date"))
    return stats.concurrency(t)


@query("f36_signal_frequency", ", y AS (SELECT sym, year(date) AS yr, count(*) FILTER (verdict <> 'NEUTRAL') AS k, count(*) AS n FROM bv GROUP BY ALL) SELECT sym, yr::INT AS yr, k, n, round(k * 252.0 / n, 3)::DOUBLE AS per_year FROM y")
def f36(s, d):
    from candlefold.plans.base import bounce

    y = bounce(s, d).groupBy("sym", F.year("date").alias("yr")).agg(F.count_if(C("verdict") != "NEUTRAL").alias("k"), F.count("*").alias("n"))
    return y.select("*", r(C("k") * 252.0 / C("n"), 3, "per_year"))


@query("f37_collinearity", IDX + " SELECT coalesce(uptrend, false) AS bull, count(*) AS n, round(corr(strength, ret63), 4) AS collinear, round(corr(strength, fwd), 4) AS a, round(corr(pos, fwd), 4) AS b, round(avg(fwd) FILTER (pos <= 0.2), 4) AS low_fwd, round(avg(fwd) FILTER (pos > 0.8), 4) AS high_fwd FROM e LEFT JOIN (SELECT date, uptrend FROM regime) USING (date) GROUP BY 1")
def f37(s, d):
    x = edge(s, d).join(F.broadcast(regime(s, d).select("date", "uptrend")), "date", "left")
    ok = C("pos").isNotNull()
    g = x.groupBy(F.coalesce(C("uptrend"), F.lit(False)).alias("bull")).agg(
        F.count("*").alias("n"), stats.corr(C("strength"), C("ret63")).alias("collinear"), stats.corr(C("strength"), C("fwd")).alias("a"), stats.corr(C("pos"), C("fwd")).alias("b"),
        F.avg(F.when(C("pos") <= 0.2, C("fwd"))).alias("low_fwd"), F.avg(F.when(C("pos") > 0.8, C("fwd"))).alias("high_fwd"),
    )
    return rounded(g, "bull", ints=("n",))


@query("f38_f42_robust_combinations", IDX.replace("fwd IS NOT NULL)", "fwd IS NOT NULL)") + ", g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS combo, ({v}) AS hit, fwd - ifwd AS ed, date, uptrend FROM e LEFT JOIN (SELECT date, uptrend FROM regime) USING (date)" for k, v in GATES.items()) + """), c AS (SELECT combo, count(*) FILTER (hit) AS n, avg(ed) FILTER (hit AND date < DATE '1997-01-01') AS i, avg(ed) FILTER (hit AND date >= DATE '1997-01-01') AS o, avg(ed) FILTER (hit AND NOT uptrend) AS b, count(*) FILTER (hit AND NOT uptrend) AS bear_n, quantile_disc(ed, 0.5) FILTER (hit) AS med, avg((ed > 0)::INT) FILTER (hit) AS beats FROM g GROUP BY combo)
SELECT combo, n, bear_n, round(i, 4) AS in_edge, round(o, 4) AS out_edge, round(b, 4) AS bear_edge, round(med, 4) AS med, round(beats, 4) AS beats, round(least(coalesce(o, -99), coalesce(b, -99)), 4) AS robust, coalesce(n >= 300 AND i > 0 AND o > 0 AND b > 0, false) AS strict FROM c""")
def f38(s, d):
    """Combinations by the worse of their edge out of sample and in bear markets; strict ones have 300 rows and no edge below zero."""
    rows = F.array(*[F.struct(F.lit(k).alias("combo"), F.expr(v).alias("hit")) for k, v in GATES.items()])
    x = edge(s, d).join(F.broadcast(regime(s, d).select("date", "uptrend")), "date", "left")  # one row a day
    g = x.select("date", "uptrend", (C("fwd") - C("ifwd")).alias("ed"), F.explode(rows).alias("g")).select("date", "uptrend", "ed", "g.*").where("hit")
    early, bear = C("date") < F.lit("1997-01-01").cast("date"), ~C("uptrend")
    a = g.groupBy("combo").agg(
        F.count("*").alias("n"), F.count_if(bear).alias("bear_n"), F.avg(F.when(early, C("ed"))).alias("in_edge"), F.avg(F.when(~early, C("ed"))).alias("out_edge"), F.avg(F.when(bear, C("ed"))).alias("bear_edge"),
        F.expr("percentile_disc(0.5) within group (order by ed)").alias("med"), F.avg((C("ed") > 0).cast("double")).alias("beats"),
    )
    worse = F.least(F.coalesce("out_edge", F.lit(-99.0)), F.coalesce("bear_edge", F.lit(-99.0)))
    strict = F.coalesce((C("n") >= 300) & (C("in_edge") > 0) & (C("out_edge") > 0) & (C("bear_edge") > 0), F.lit(False))
    return rounded(a.withColumn("robust", worse).withColumn("strict", strict), "combo", "strict", ints=("n", "bear_n"))


@query("f41_sector_report", IDX + ", q AS (SELECT sector, count(*) AS n, avg(fwd - ifwd) AS ed FROM e WHERE core >= 7 GROUP BY sector HAVING count(*) >= 60) SELECT sector, n, round(ed, 4) AS edge, ed > 0 AS kept FROM q")
def f41(s, d):
    q = edge(s, d).where("core >= 7").groupBy("sector").agg(F.count("*").alias("n"), F.avg(C("fwd") - C("ifwd")).alias("ed")).where("n >= 60")
    return q.select("sector", "n", r("ed", 4, "edge"), (C("ed") > 0).alias("kept"))
