"""Cleaning, splits, live bars, stored rows, screens, calendar, text scalars."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlefold.functions import scalars
from candlefold.operators import hygiene, ranking, stats
from candlefold.plans.base import C, bars, query, r
from candlefold.sources import tables

LI = """raw AS (SELECT n_name AS sym, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / l_quantity END AS close, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / l_quantity * 1.01 END AS high, l_quantity AS volume,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS arrival FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query("a01_last_n_bars", ", k AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM bars) SELECT sym, date, close FROM k WHERE k <= 320")
def a01(s, d):
    return tables.last_sessions(bars(s, d), 320).select("sym", "date", "close")


@query("a02_clean_bars", f"""WITH {LI}, k AS (SELECT *, row_number() OVER (PARTITION BY sym, date ORDER BY arrival) AS k FROM raw WHERE close > 0)
SELECT sym, date::DATE AS date, close AS open, coalesce(high, close) AS high, close AS low, close, volume FROM k WHERE k = 1""", views=False)
def a02(s, d):
    t = tables.table(s, d, "lineitem").join(tables.table(s, d, "supplier").select("s_suppkey", "s_nationkey"), C("l_suppkey") == C("s_suppkey"))
    t = t.join(F.broadcast(tables.places_of(s, d)), C("s_nationkey") == C("nationkey"))
    p = C("l_extendedprice") / C("l_quantity")
    raw = t.select(
        "sym", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("double").alias("open"), F.when(C("l_linenumber") % 2 == 0, p * 1.01).alias("high"), F.lit(None).cast("double").alias("low"),
        F.when(C("l_linenumber") != 7, p).alias("close"), C("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate").alias("arrival"),
    )
    return hygiene.clean_bars(raw)


SPLITS = [("NATION_1", "1996-06-03", 2.0, 1.0), ("NATION_1", "1997-06-02", 3.0, 2.0), ("NATION_2", "1995-01-02", 1.0, 10.0), ("NATION_3", "1996-01-01", 1.0, 1.0)]
SPLITS_SQL = "spl AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', DATE '{b}', {c}, {e})" for a, b, c, e in SPLITS) + ") t(sym, date, num, den))"


@query("a03_adjust_splits", f""", {SPLITS_SQL}, f AS (SELECT b.sym, b.date, b.close, b.volume, coalesce((SELECT product(num / den) FROM spl WHERE spl.sym = b.sym AND spl.date > b.date AND num <> den), 1) AS f FROM bars b)
SELECT sym, date, round(close * f, 8) AS close, CASE WHEN f = 1 THEN volume ELSE floor(volume / f + 0.5) END AS volume FROM f""")
def a03(s, d):
    sp = s.createDataFrame(SPLITS, "sym string, date string, numerator double, denominator double").withColumn("date", C("date").cast("date"))
    return hygiene.adjust_splits(bars(s, d).drop("sector"), sp).select("sym", "date", r("close", 8), "volume")


@query("a04_live_bar", """, l AS (SELECT sym, max(date) AS m FROM bars GROUP BY sym), q AS (SELECT sym, m + (length(sym) % 3 * 2 - 1)::INT AS d, 1234.5 AS p, m FROM l)
SELECT b.sym, b.date, CASE WHEN b.date = q.m AND q.d = b.date THEN p ELSE b.close END AS close, coalesce(b.date = q.m AND q.d = b.date, false) AS live FROM bars b JOIN q USING (sym)
UNION ALL SELECT sym, d, p, true FROM q WHERE d > m AND dayofweek(d) NOT IN (0, 6)""")
def a04(s, d):
    b = bars(s, d)
    q = b.groupBy("sym").agg(F.max("date").alias("m")).select("sym", F.date_add("m", F.length("sym") % 3 * 2 - 1).alias("date"), F.lit(1234.5).alias("price"))
    return hygiene.upsert_live(b.drop("sector"), q).select("sym", "date", "close", "live")


@query("a05_universe_document", "SELECT sym, count(*) AS n, round(sum(close), 4) AS total FROM bars GROUP BY sym")
def a05(s, d):
    """Bars to one JSON map per symbol and back through the document reader's schema."""
    each = bars(s, d).select("sym", F.struct(C("date").cast("string").alias("date"), "open", "high", "low", "close", "volume").alias("b"))
    docs = each.groupBy("sym").agg(F.to_json(F.struct(F.create_map(F.first("sym"), F.collect_list("b")).alias("histBySym"))).alias("doc"))
    bar = "struct<date:string,open:double,high:double,low:double,close:double,volume:double>"
    read = docs.select(F.from_json("doc", f"histBySym map<string, array<{bar}>>").alias("d")).select(F.explode("d.histBySym").alias("sym", "bars")).select("sym", F.explode("bars").alias("b"))
    return read.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.sum("b.close"), 4).alias("total"))


@query("a06_quarantine", "SELECT user_id IS NULL OR event_id % 97 = 0 AS bad, count(*) AS n, count(*) FILTER (coalesce(event_type, 'none') = 'view') AS views FROM events GROUP BY 1", views=False)
def a06(s, d):
    e = tables.table(s, d, "events").select(F.when(C("event_id") % 97 != 0, C("user_id").cast("string")).alias("sym"), C("event_type").alias("kind"))
    good, bad = hygiene.quarantine(e, "sym", {"kind": "none"})
    both = good.withColumn("bad", F.lit(False)).unionByName(bad.withColumn("bad", F.lit(True)))
    return both.groupBy("bad").agg(F.count("*").alias("n"), F.count_if(C("kind") == "view").alias("views"))


@query("a07_merge_history", """WITH h AS (SELECT user_id AS sym, CAST(ts AS DATE) AS day, ts, value AS score, (event_id % 2)::INT AS p, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id % 2 DESC, ts DESC, value DESC) AS k FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY day DESC) AS j FROM h WHERE k = 1) SELECT sym, day, round(score, 6) AS score FROM g WHERE j <= 10""", views=False)
def a07(s, d):
    e = tables.table(s, d, "events")
    part = lambda k: e.where(C("event_id") % 2 == k).select(C("user_id").alias("sym"), F.to_date("ts").alias("day"), "ts", C("value").alias("score"))
    return hygiene.merge_history(part(0), part(1), 10).select("sym", "day", r("score", 6))


@query("a08_patch_prices", """WITH st AS (SELECT c_custkey AS sym, c_acctbal AS price, CASE WHEN c_custkey % 2 = 0 THEN 1.0 END AS volume FROM customer), q AS (SELECT o_custkey AS sym, max(o_totalprice) AS price, CASE WHEN o_custkey % 3 = 0 THEN 2.0 END AS volume FROM orders GROUP BY o_custkey)
SELECT st.sym, coalesce(q.price, st.price) AS price, coalesce(q.volume, st.volume)::DOUBLE AS volume FROM st LEFT JOIN q USING (sym)""", views=False)
def a08(s, d):
    st = tables.table(s, d, "customer").select(C("c_custkey").alias("sym"), C("c_acctbal").alias("price"), F.when(C("c_custkey") % 2 == 0, 1.0).alias("volume"))
    q = tables.table(s, d, "orders").groupBy(C("o_custkey").alias("sym")).agg(F.max("o_totalprice").alias("price")).withColumn("volume", F.when(C("sym") % 3 == 0, 2.0))
    return hygiene.patch_prices(st, q, ("price", "volume"))


@query("a09_freshness", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 20 HOUR AND CAST(ts AS DATE) = DATE '2024-01-20'", views=False)
def a09(s, d):
    return hygiene.fresh_rows(tables.table(s, d, "events").select("event_id", "ts"), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"), 20, "2024-01-20")


@query("a10_retention", "SELECT o_custkey AS sym, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 120 DAY GROUP BY ALL", views=False)
def a10(s, d):
    """Kept for 120 days; one value per (sym, day), the last written."""
    o = hygiene.fresh_rows(tables.table(s, d, "orders"), "o_orderdate", F.lit("1998-08-01").cast("timestamp"), 24 * 120)
    return o.groupBy(C("o_custkey").alias("sym"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("v"))


@query("a13_capped_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50", views=False)
def a13(s, d):
    return hygiene.cap_history(tables.table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", ("ts", "event_id"), 50).select("user_id", "event_id")


# ---- B -------------------------------------------------------------------------------------------------------------


@query("b01_sane_ranges", ", x AS (SELECT sym, date, close / lag(close, 62) OVER (PARTITION BY sym ORDER BY date) - 1 AS v FROM bars) SELECT sym, count(v) AS n, count(*) FILTER (v BETWEEN -0.95 AND 10) AS kept FROM x GROUP BY sym")
def b01(s, d):
    v = C("close") / F.lag("close", 62).over(Window.partitionBy("sym").orderBy("date")) - 1
    x = bars(s, d).select("sym", v.alias("v"))
    return x.groupBy("sym").agg(F.count("v").alias("n"), F.count(scalars.in_range(C("v"), "ret3m")).alias("kept"))


@query("b02_verdict_words", "SELECT CASE WHEN o_shippriority IS NULL THEN 'na' WHEN p >= 3 THEN 'good' WHEN p >= 2 THEN 'ok' WHEN p >= 1 THEN 'weak' ELSE 'bad' END AS word, count(*) AS n FROM (SELECT *, (o_orderkey % 5)::INT AS p FROM (SELECT o_orderkey, 1 AS o_shippriority FROM orders)) GROUP BY 1", views=False)
def b02(s, d):
    return tables.table(s, d, "orders").groupBy(scalars.verdict_word(C("o_orderkey") % 5).alias("word")).agg(F.count("*").alias("n"))


@query("b03_eligibility", """, m AS (SELECT sym, count(*) AS n, bool_or(close <= 0 OR high < low) AS bad FROM bars GROUP BY sym), l AS (SELECT sym, list_sort(list(money)) AS l FROM (SELECT sym, money, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k FROM ind) WHERE k <= 60 GROUP BY sym)
SELECT sym, n, CASE WHEN n < 1200 THEN 'short_history' WHEN bad THEN 'bad_bar' WHEN l[len(l) // 2 + 1] < 45000 THEN 'thin' END AS reason FROM m JOIN l USING (sym)""")
def b03(s, d):
    return hygiene.eligibility(bars(s, d), 1200, 45e3).select("sym", "n", "reason")


@query("b04_universe_screen", "SELECT p_partkey FROM (SELECT *, 'T' || chr((65 + p_partkey % 26)::INT) AS ticker, (p_partkey % 200) * 1e8 AS cap, p_size / 10.0 AS beta, p_partkey * 1000.0 AS volume FROM part) WHERE p_retailprice > 10 AND cap > 2e9 AND beta > 1 AND volume > 1e6 AND NOT p_name LIKE 'a%' AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#2', 'Brand#3')", views=False)
def b04(s, d):
    k = C("p_partkey")
    u = tables.table(s, d, "part").select(
        "p_partkey", C("p_retailprice").alias("price"), (k % 200 * 1e8).alias("cap"), (C("p_size") / 10).alias("beta"), (k * 1000.0).alias("volume"), C("p_name").startswith("a").alias("is_fund"),
        C("p_brand").alias("exchange"), F.concat(F.lit("T"), F.chr((k % 26 + 65).cast("int"))).alias("ticker"),
    )
    return hygiene.screen(u, 10, 2e9, 1, 1e6, ("Brand#1", "Brand#11", "Brand#12", "Brand#13", "Brand#2", "Brand#3")).select("p_partkey")


@query("b05_feed_checks", """WITH p AS (SELECT c_custkey AS id, c_nationkey::VARCHAR AS sym, abs(c_acctbal) + 1 AS price FROM customer), q AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'x' ELSE sym END AS sym, price * (1 + (id % 10) / 100.0) AS price FROM p), n AS (SELECT o_custkey AS id, max(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY o_custkey)
SELECT id, array_to_string(list_filter([CASE WHEN p.sym <> q.sym THEN 'symbol' END, CASE WHEN q.price > 0 AND abs(p.price / q.price - 1) > 0.06 THEN 'price' END, CASE WHEN n.date IS NULL OR DATE '1998-08-02' - n.date > 60 THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p JOIN q USING (id) LEFT JOIN n USING (id)""", views=False)
def b05(s, d):
    p = tables.table(s, d, "customer").select(C("c_custkey").alias("id"), C("c_nationkey").cast("string").alias("sym"), (F.abs("c_acctbal") + 1).alias("price"))
    q = p.select("id", F.when(C("id") % 11 == 0, "x").otherwise(C("sym")).alias("sym"), (C("price") * (1 + C("id") % 10 / 100)).alias("price"))
    n = tables.table(s, d, "orders").groupBy(C("o_custkey").alias("id")).agg(F.max(F.to_date("o_orderdate")).alias("date"))
    w = hygiene.validate_feeds(p, q, n, F.lit("1998-08-02").cast("date"), days=60)
    return w.select("id", F.array_join("warnings", ",").alias("warnings"))


@query("b06_price_mismatch", "SELECT p_partkey AS id, CASE WHEN NOT m THEN p_retailprice END AS profile_price, m AS mismatch FROM (SELECT *, p_retailprice / (p_size * 40.0) NOT BETWEEN 0.7 AND 1.43 AS m FROM part)", views=False)
def b06(s, d):
    rows = tables.table(s, d, "part").select(C("p_partkey").alias("id"), C("p_retailprice").alias("profile_price"), (C("p_size") * 40.0).alias("quote_price"), C("p_name").alias("name"))
    return hygiene.mismatch_blank(rows).select("id", "profile_price", "mismatch")


GEN = ", ".join(f"'{w}'" for w in scalars.GENERIC_WORDS)


@query("b07_name_mismatch", f"""WITH w AS (SELECT a.p_partkey AS id, list_filter(string_split_regex(lower(a.p_name || ' Corporation'), '[^a-z]+'), lambda x: length(x) >= 4 AND x NOT IN ({GEN})) AS known,
  list_filter(string_split_regex(lower(b.p_name), '[^a-z]+'), lambda x: length(x) >= 4 AND x NOT IN ({GEN})) AS fresh FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_partkey % 3)
SELECT id, len(known) > 0 AND NOT list_has_any(known, fresh) AS mismatch FROM w""", views=False)
def b07(s, d):
    p = tables.table(s, d, "part").select("p_partkey", "p_name")
    q = p.select(C("p_partkey").alias("k"), C("p_name").alias("fresh"))
    j = p.join(q, C("k") == C("p_partkey") + C("p_partkey") % 3)
    return j.select(C("p_partkey").alias("id"), scalars.name_mismatch(F.concat("p_name", F.lit(" Corporation")), C("fresh")).alias("mismatch"))


@query("b08_flipped_names", "SELECT p_name AS name, count(DISTINCT p_partkey) > 1 AS flipped, count(*) AS n FROM part GROUP BY p_name", views=False)
def b08(s, d):
    rows = tables.table(s, d, "part").select(C("p_partkey").alias("sym"), C("p_name").alias("name"))
    return hygiene.flipped_names(rows).groupBy("name", "flipped").agg(F.count("*").alias("n"))


ROWS = "nw AS (SELECT p_partkey AS sym, p_brand || p_size AS name, p_retailprice AS price, p_size AS score FROM part), od AS (SELECT sym, price * (1 + (sym % 9 - 4) / 10.0) AS price, score + (sym % 11 - 5) AS score, name FROM nw WHERE sym % 7 <> 0)"


def rows_pair(s, d):
    nw = tables.table(s, d, "part").select(C("p_partkey").alias("sym"), F.concat("p_brand", C("p_size").cast("string")).alias("name"), C("p_retailprice").alias("price"), C("p_size").alias("score"))
    od = nw.where("sym % 7 <> 0").select("sym", (C("price") * (1 + (C("sym") % 9 - 4) / 10)).alias("price"), (C("score") + (C("sym") % 11 - 5)).alias("score"), "name")
    return od, nw


@query("b09_row_warnings", f"""WITH {ROWS}, nm AS (SELECT name, array_to_string(list_sort(list_distinct(list(sym))), ',') AS syms, count(DISTINCT sym) AS k FROM nw GROUP BY name)
SELECT nw.sym, array_to_string(list_filter([CASE WHEN k > 1 THEN 'name:' || syms END, CASE WHEN abs(nw.price / od.price - 1) > 0.3 THEN 'price' END, CASE WHEN abs(nw.score - od.score) >= 4 THEN 'score' END], lambda x: x IS NOT NULL), ';') AS warnings FROM nw JOIN nm USING (name) LEFT JOIN od ON od.sym = nw.sym""", views=False)
def b09(s, d):
    od, nw = rows_pair(s, d)
    return hygiene.row_warnings(od, nw).select("sym", F.array_join("warnings", ";").alias("warnings"))


@query("b10_fallback_rows", f"WITH {ROWS} SELECT nw.sym, CASE WHEN nw.sym % 5 = 0 AND od.sym IS NOT NULL THEN od.price ELSE nw.price END AS price, nw.sym % 5 = 0 AS fell_back FROM nw LEFT JOIN od ON od.sym = nw.sym", views=False)
def b10(s, d):
    od, nw = rows_pair(s, d)
    return hygiene.fallback_rows(nw.select("sym", "price"), od.select("sym", "price"), C("sym") % 5 == 0).select("sym", "price", "fell_back")


@query("b11_rescan_set", "WITH r AS (SELECT user_id AS sym, max(ts) AS scored_at, max(CASE WHEN event_type = 'purchase' THEN value END) AS av FROM events GROUP BY user_id) SELECT DISTINCT sym FROM r WHERE scored_at < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 2 DAY OR av IS NULL UNION SELECT DISTINCT user_id FROM events WHERE value < 0.01", views=False)
def b11(s, d):
    e = tables.table(s, d, "events")
    rows = e.groupBy(C("user_id").alias("sym")).agg(F.max("ts").alias("scored_at"), F.max(F.when(C("event_type") == "purchase", C("value"))).alias("avg_volume"))
    return hygiene.rescan_set(rows, F.lit("2024-01-31 12:00:00").cast("timestamp"), 2, e.where("value < 0.01").select(C("user_id").alias("sym")))


DOW, DOM = "dayofweek(date)", "day(date)"  # Sunday is 0
EASTER = "SELECT date, y, d, (2 * (y % 4) + 4 * (y % 7) + 6 * d + 5) % 7 AS e FROM (SELECT date, year(date) AS y, (19 * (year(date) % 19) + 24) % 30 AS d FROM index_bars)"
KEPT = "OR (strftime(date, '%m-%d') = '{0}' AND {d} BETWEEN 1 AND 5) OR (strftime(date, '%m-%d') = '{1}' AND {d} = 5) OR (strftime(date, '%m-%d') = '{2}' AND {d} = 1)"
CAL = f"""gf AS (SELECT date, (make_date(y, 3, 22) + (d + e - CASE WHEN d + e = 35 OR (d = 28 AND e = 6 AND y % 19 > 10) THEN 7 ELSE 0 END)::INT - 2)::DATE AS friday FROM ({EASTER})),
cal AS (SELECT date, {DOW} IN (0, 6) AS weekend, date = friday OR (strftime(date, '%m-%d') = '01-01' AND {DOW} BETWEEN 1 AND 5) OR (strftime(date, '%m-%d') = '01-02' AND {DOW} = 1)
  OR ({DOW} = 1 AND ((month(date) = 1 AND {DOM} BETWEEN 15 AND 21 AND year(date) >= 1998) OR (month(date) = 2 AND {DOM} BETWEEN 15 AND 21) OR (month(date) = 5 AND {DOM} >= 25) OR (month(date) = 9 AND {DOM} <= 7)))
  OR ({DOW} = 4 AND month(date) = 11 AND {DOM} BETWEEN 22 AND 28) {KEPT.format("07-04", "07-03", "07-05", d=DOW)} {KEPT.format("12-25", "12-24", "12-26", d=DOW)} AS holiday,
  (month(date) = 11 AND {DOW} = 5 AND {DOM} BETWEEN 23 AND 29) OR (strftime(date, '%m-%d') IN ('07-03', '12-24') AND {DOW} BETWEEN 1 AND 4) AS half FROM gf),
td AS (SELECT *, NOT weekend AND NOT holiday AS trading FROM cal)"""


def calendar(s, d):
    t = tables.index_bars(s, d).select("date")
    day = C("date")
    return t.select("date", scalars.is_weekend(day).alias("weekend"), scalars.is_market_holiday(day).alias("holiday"), scalars.is_half_day(day).alias("half")).withColumn("trading", ~C("weekend") & ~C("holiday"))


@query("b12_b13_calendar", f""", {CAL}, p AS (SELECT *, max(CASE WHEN trading THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM td)
SELECT date, trading, prev, CASE WHEN half THEN 780 ELSE 960 END AS close_minute, coalesce(date - prev > 3, false) AS stale FROM p""")
def b12(s, d):
    return hygiene.sessions(calendar(s, d))


CLOSURES = "cl AS (SELECT date, CASE WHEN urgent = 0 THEN 'full' ELSE 'half' END AS kind FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) WHERE urgent <= 1)"


@query("b12_closure_table", f""", {CAL}, {CLOSURES}, t2 AS (SELECT date, trading AND coalesce(kind <> 'full', true) AS trading, half OR coalesce(kind = 'half', false) AS half FROM td LEFT JOIN cl USING (date)),
p AS (SELECT *, max(CASE WHEN trading THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t2)
SELECT date, trading, prev, CASE WHEN half THEN 780 ELSE 960 END AS close_minute, coalesce(date - prev > 3, false) AS stale FROM p""")
def b12c(s, d):
    """The calendar under a table of unscheduled closures: days without an urgent order count as closed, those with one as half days."""
    urgent = tables.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count_if(C("o_orderpriority") == "1-URGENT").alias("urgent"))
    closures = urgent.where("urgent <= 1").select("date", F.when(C("urgent") == 0, "full").otherwise("half").alias("kind"))
    return hygiene.sessions(hygiene.with_closures(calendar(s, d), closures))


ET = "timezone('America/New_York', timezone('UTC', ts))"


@query("b14_session_of", """WITH e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS et FROM events WHERE ts < TIMESTAMP '2024-03-01'), m AS (SELECT *, hour(et) * 60 + minute(et) AS m, CAST(et AS DATE) AS d FROM e)
SELECT event_id, CASE WHEN dayofweek(d) IN (0, 6) OR d IN (DATE '2024-01-01', DATE '2024-01-15') THEN 'none' WHEN m >= 570 AND m < 960 THEN 'regular' WHEN m >= 960 AND m < 1200 AND m % 15 = 0 THEN 'after_hours' ELSE 'none' END AS session FROM m""", views=False)
def b14(s, d):
    """January only: New York is five hours behind."""
    e = tables.table(s, d, "events").where("ts < timestamp'2024-03-01'").select("event_id", scalars.eastern(C("ts")).alias("et"))
    day = F.to_date("et")
    return e.select("event_id", scalars.session_of(C("et"), day.isin("2024-01-01", "2024-01-15"), F.lit(False)).alias("session"))


@query("b15_session_complete", "SELECT event_id, CASE WHEN DATE '2024-01-10' + (event_id % 5)::INT < CAST(ts AS DATE) THEN true WHEN DATE '2024-01-10' + (event_id % 5)::INT > CAST(ts AS DATE) THEN false ELSE hour(ts) * 60 + minute(ts) >= CASE WHEN event_id % 2 = 0 THEN 780 ELSE 960 END END AS done FROM events", views=False)
def b15(s, d):
    e = tables.table(s, d, "events")
    day = F.date_add(F.lit("2024-01-10").cast("date"), (C("event_id") % 5).cast("int"))
    return e.select("event_id", scalars.session_complete(day, C("ts"), C("event_id") % 2 == 0).alias("done"))


@query("b16_summary_slot", "SELECT event_id, CASE WHEN minute(ts) = 0 AND hour(ts) >= 10 AND hour(ts) <= 16 THEN hour(ts)::INT END AS slot FROM events", views=False)
def b16(s, d):
    return tables.table(s, d, "events").select("event_id", scalars.summary_slot(C("ts"), F.lit(False)).alias("slot"))


@query("b17_membership_gate", """, m AS (SELECT n_name AS sym, CASE WHEN n_nationkey % 2 = 0 THEN DATE '1993-01-01' END AS a, CASE WHEN n_nationkey % 3 = 0 THEN DATE '1997-01-01' END AS z FROM nation)
SELECT b.sym, count(*) AS n FROM bars b LEFT JOIN m USING (sym) WHERE (a IS NULL OR date >= a) AND (z IS NULL OR date <= z) GROUP BY b.sym""")
def b17(s, d):
    k = C("nationkey")
    m = tables.places_of(s, d).select("sym", F.when(k % 2 == 0, F.lit("1993-01-01").cast("date")).alias("a"), F.when(k % 3 == 0, F.lit("1997-01-01").cast("date")).alias("z"))
    j = bars(s, d).select("sym", "date").join(F.broadcast(m), "sym", "left")
    return j.where((C("a").isNull() | (C("date") >= C("a"))) & (C("z").isNull() | (C("date") <= C("z")))).groupBy("sym").agg(F.count("*").alias("n"))


QS = ("part#1", "SUPPLIER", "customer#00", "a")


@query("b18_symbol_search", "WITH n AS (SELECT DISTINCT 'C' || c_custkey AS ticker, c_name AS name FROM customer), q AS (SELECT * FROM (VALUES ('C1'), ('C12'), ('customer'), ('000000007')) t(query)), h AS (SELECT query, ticker, CASE WHEN upper(ticker) = upper(query) THEN 0 WHEN starts_with(upper(ticker), upper(query)) THEN 1 WHEN starts_with(upper(name), upper(query)) THEN 2 WHEN contains(upper(name), upper(query)) THEN 3 END AS match FROM n, q), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY match, ticker) AS rank FROM h WHERE match IS NOT NULL) SELECT query, ticker, match, rank::INT AS rank FROM k WHERE rank <= 8", views=False)
def b18(s, d):
    names = tables.table(s, d, "customer").select(F.concat(F.lit("C"), C("c_custkey").cast("string")).alias("ticker"), C("c_name").alias("name"))
    q = s.createDataFrame([("C1",), ("C12",), ("customer",), ("000000007",)], "query string")
    return ranking.search(names, q).select("query", "ticker", "match", "rank")


@query("b19_cooldown", f""", {CAL}, t AS (SELECT min(date) AS since FROM (SELECT date FROM td WHERE trading ORDER BY date DESC LIMIT 4)), st AS (SELECT DISTINCT sym FROM ind, t WHERE date >= since AND close / pc < 0.5) SELECT DISTINCT sym FROM bars WHERE sym NOT IN (SELECT sym FROM st)""")
def b19(s, d):
    """Names whose stop fell in the last three trading days sit out."""
    from candlefold.operators import indicators

    since = calendar(s, d).where("trading").orderBy(F.desc("date")).limit(4).agg(F.min("date").alias("since"))
    st = indicators.with_ranges(bars(s, d)).join(F.broadcast(since), C("date") >= C("since")).where("close / pc < 0.5").select("sym").distinct()
    return bars(s, d).select("sym").distinct().join(st, "sym", "left_anti")


# ---- H: scalar functions on the text tables ------------------------------------------------------------------------


@query("h_strip_html", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS plain FROM pages", views=False)
def h1(s, d):
    return tables.table(s, d, "pages").select("page_id", scalars.strip_html(C("html")).alias("plain"))


@query("h_json_extract", "SELECT event_id, props::JSON->>'k' AS k FROM events", views=False)
def h2(s, d):
    return tables.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("h_money_labels", "SELECT o_orderkey, CASE WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END AS label FROM (SELECT o_orderkey, o_totalprice * 10 + 0.0003 AS v FROM orders)", views=False)
def h3(s, d):
    return tables.table(s, d, "orders").select("o_orderkey", scalars.money(C("o_totalprice") * 10 + 0.0003).alias("label"))


@query("h_dates", ", x AS (SELECT sym, date FROM bars) SELECT sym, date, (date + 91)::DATE AS plus91, strftime(date, '%b %Y') AS label, (dayofweek(date) + 1)::INT AS dow, date_diff('day', DATE '1992-01-01', date)::INT AS days FROM x")
def h4(s, d):
    return bars(s, d).select("sym", "date", F.date_add("date", 91).alias("plus91"), F.date_format("date", "MMM yyyy").alias("label"), F.dayofweek("date").alias("dow"), F.datediff("date", F.lit("1992-01-01").cast("date")).alias("days"))


@query("h_rounding", ", x AS (SELECT sym, date, (close - open) / 7 AS v FROM bars) SELECT sym, date, floor(v + 0.5)::DOUBLE AS whole, sign(v)::DOUBLE AS sgn, round(ln(abs(v) + 1), 6) AS logv, split_part(sym || '/24', '/', 1) AS left_part FROM x")
def h5(s, d):
    v = (C("close") - C("open")) / 7
    return bars(s, d).select("sym", "date", scalars.round_half_up(v).alias("whole"), F.sign(v).alias("sgn"), F.round(F.log(F.abs(v) + 1), 6).alias("logv"), F.split_part(F.concat("sym", F.lit("/24")), F.lit("/"), F.lit(1)).alias("left_part"))


CHUNKS = """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
c AS (SELECT *, unnest(generate_series(0, greatest((length(line) - 1) // 3800, 0)))::BIGINT AS cut FROM l),
p AS MATERIALIZED (SELECT doc_id, substring(line, cut * 3800 + 1, 3800) AS t, cut = 0 AS fresh, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, cut) AS k FROM c),
f AS (SELECT doc_id, k, length(t) AS n, 0 AS chunk_no FROM p WHERE k = 1
UNION ALL SELECT p.doc_id, p.k, CASE WHEN fresh AND n + 1 + length(t) <= 3800 THEN n + 1 + length(t) ELSE length(t) END, chunk_no + (NOT (fresh AND n + 1 + length(t) <= 3800))::INT FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1)
SELECT doc_id, chunk_no::INT AS chunk_no, string_agg(t, chr(10) ORDER BY k) AS chunk FROM f JOIN p USING (doc_id, k) GROUP BY doc_id, chunk_no"""


@query("h_text_chunks", CHUNKS, views=False)
def h6(s, d):
    """Texts cut at lines into chunks of at most 3,800 characters; longer lines are cut hard. Chunks joined give the text."""
    from candlefold.operators.text import chunks

    return chunks(tables.table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", 3800)
