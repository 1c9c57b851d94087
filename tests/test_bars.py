"""Rungs, traps, folds against loops, streams against batch, look-ahead, plan shape."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlefold.functions import scalars
from candlefold.operators import hygiene, indicators, ranking, scoring, stats, text, trades
from candlefold.plans import base
from candlefold.streaming.jobs import next_position

C = F.col
DAY = dt.date(2020, 1, 1)
SF = "/root/testdata/sf0.001"


def frame(spark, closes, sym="A", **cols):
    rows = [(sym, DAY + dt.timedelta(i), *(float(cols[k][i]) if k in cols else float(c) for k in ("open", "high", "low")), float(c), float(cols.get("volume", [1000] * len(closes))[i])) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "sym string, date date, open double, high double, low double, close double, volume double")


def last(df):
    return df.orderBy(F.desc("date")).first()


def steps(p, a, b, n=200):
    return [b] * (n - 50) + [a] * 49 + [p]


@pytest.mark.parametrize(("p", "a", "b", "want"), [(120, 110, 90, 3), (115, 110, 90, 2), (115, 110, 130, 1), (100, 110, 90, 0)])
def test_trend_rungs(spark, p, a, b, want):
    ind = indicators.indicators(frame(spark, steps(p, a, b)))
    assert last(ind.select("date", scoring.trend_points().alias("t"))).t == want
    row = last(ind)
    assert row.sma50 == pytest.approx((p + 49 * a) / 50) and row.sma200 == pytest.approx((p + 49 * a + 150 * b) / 200)


def test_trend_needs_200_bars(spark):
    ind = indicators.indicators(frame(spark, steps(120, 110, 90)[1:]))
    assert last(ind.select("date", scoring.trend_points().alias("t"))).t is None and last(ind).sma200 is None


def test_flat_prices_and_partial_ranges(spark):
    row = last(indicators.indicators(frame(spark, [50] * 30)))
    assert row.rsi2 == 100 and row.pctb == 0.5 and row.pos is None
    two = last(indicators.indicators(frame(spark, [10, 12], high=[10, 13], low=[10, 11])))
    assert two.atr14 == 3 and two.sma5 is None and two.rsi2 is None  # the mean of one range is enough, an average of five is not


def test_look_backs_are_62_125_and_126_bars(spark):
    row = last(indicators.indicators(frame(spark, range(1, 301))))
    assert row.ret63 == pytest.approx(300 / 238 - 1) and row.ret126 == pytest.approx(300 / 175 - 1) and row.ret126_index == pytest.approx(300 / 174 - 1)


@pytest.mark.parametrize(("x", "buy", "sell"), [(5.0, 3, 0), (10.0, 2, 0), (20.0, 1, 0), (50.0, 0, 0), (80.0, 0, 1), (90.0, 0, 2), (95.0, 0, 3), (None, None, None)])
def test_rsi_ladder(spark, x, buy, sell):
    df = spark.createDataFrame([(x,)], "x double")
    assert tuple(df.select(scalars.down(C("x"), 20, 10, 5), scalars.up(C("x"), 80, 90, 95)).first()) == (buy, sell)


def test_verdict_tests_buy_before_sell_and_gates(spark):
    rows = [(14, 20, 50.0, 0.5, 0.1), (14, 20, 50.0, 0.5, -0.1), (3, 8, 50.0, 0.5, -0.2), (8, 8, 50.0, 0.5, 0.0), (2, 2, 4.0, 0.5, 0.3), (0, 0, 50.0, 0.5, None), (20, 0, 50.0, 0.5, None)]
    df = spark.createDataFrame(rows, "buy_score int, sell_score int, rsi2 double, pctb double, rs_delta double")
    got = [(r.verdict, r.tier) for r in scoring.bounce_verdict(df).collect()]
    assert got == [("BUY", "moderate"), ("NEUTRAL", None), ("SELL", "weak"), ("NEUTRAL", None), ("BUY", "weak"), ("NEUTRAL", None), ("NEUTRAL", None)]
    assert scoring.bounce_verdict(df, F.lit(True)).select("verdict").distinct().first().verdict == "BLOCKED"


def test_surge_mirror(spark):
    df = spark.createDataFrame([(2.0, 0.5), (2.0, -0.5), (0.5, 0.0), (1.0, 0.2), (2.6, 0.0)], "rv double, flow double")
    up_, down_ = F.lit(True), F.lit(False)
    assert [r[0] for r in df.select(scoring.surge(C("rv"), up_, down_, C("flow"))).collect()] == [3, 0, 0, 1, 3]
    assert [r[0] for r in df.select(scoring.surge(C("rv"), down_, up_, C("flow"), -1)).collect()] == [0, 3, 0, 1, 3]


def test_look_ahead_free(spark):
    g = random.Random(1)
    closes = [100.0]
    for _ in range(320):
        closes.append(closes[-1] * g.uniform(0.95, 1.05))
    cols = ("rsi2", "pctb", "atr14", "rv", "strength", "flow10", "off_high", "gap_avg", "dryup")
    whole = indicators.indicators(frame(spark, closes)).where(C("rn") <= 280).select("rn", *cols)
    cut = indicators.indicators(frame(spark, closes[:280])).select("rn", *cols)
    assert whole.exceptAll(cut).count() == 0


def test_one_exchange_serves_all_indicators(spark):
    plan = indicators.indicators(__import__("candlefold.plans.base", fromlist=["bars"]).bars(spark, SF)).select("sym", "date", "rsi2", "pctb", "rv", "strength", "adr", "gap_avg")
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(sym", tree)) <= 2  # one to make the bars, one for every window
    assert "CartesianProduct" not in tree and "Python" not in tree


# ---- hygiene -------------------------------------------------------------------------------------------------------


def test_clean_bars(spark):
    rows = [("A", "2020-01-02", None, None, None, 5.0, 1.0, 2), ("A", "2020-01-02", 1.0, 1.0, 1.0, 9.0, 1.0, 1), ("A", "bad", 1.0, 1.0, 1.0, 1.0, 1.0, 1), ("A", "2020-01-03", 1.0, 1.0, 1.0, float("nan"), 1.0, 1), ("A", "2020-01-04", 1.0, 1.0, 1.0, 0.0, 1.0, 1), ("A", "2020-01-05", None, 7.0, None, 6.0, None, 1)]
    got = hygiene.clean_bars(spark.createDataFrame(rows, "sym string, date string, open double, high double, low double, close double, volume double, arrival int")).orderBy("date").collect()
    assert [(str(r.date), r.open, r.high, r.close) for r in got] == [("2020-01-02", 1.0, 1.0, 9.0), ("2020-01-05", 6.0, 7.0, 6.0)]


def test_split_before_its_date_only(spark):
    b = frame(spark, [464.42, 232.21]).select("sym", "date", "open", "high", "low", "close", "volume")
    s = spark.createDataFrame([("A", DAY + dt.timedelta(1), 1.0, 2.0), ("A", DAY + dt.timedelta(1), 0.0, 2.0), ("A", DAY, 3.0, 3.0)], "sym string, date date, numerator double, denominator double")
    got = hygiene.adjust_splits(b, s).orderBy("date").collect()
    assert [(r.close, r.volume) for r in got] == [(pytest.approx(232.21), 2000.0), (232.21, 1000.0)]


def test_live_bar(spark):
    b = frame(spark, [10, 11])  # Wednesday, Thursday
    quote = lambda i, p: spark.createDataFrame([("A", DAY + dt.timedelta(i), p)], "sym string, date date, price double")
    live = lambda i: [(r.close, r.live) for r in hygiene.upsert_live(b, quote(i, 12.0)).orderBy("date").collect()]
    assert live(0) == [(10, False), (11, False)]
    assert live(1) == [(10, False), (12, True)]
    assert live(2) == [(10, False), (11, False), (12, True)]
    assert live(3) == [(10, False), (11, False)]  # a Saturday


def test_session_bounds(spark):
    rows = [("2026-11-25 09:29:00", "none"), ("2026-11-25 09:30:00", "regular"), ("2026-11-25 15:59:00", "regular"), ("2026-11-25 16:15:00", "after_hours"), ("2026-11-25 16:16:00", "none"), ("2026-11-28 12:00:00", "none")]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t), w) for t, w in rows], "ts timestamp, want string")
    assert df.where(scalars.session_of(C("ts"), F.lit(False), F.lit(False)) != C("want")).count() == 0
    half = df.select(scalars.session_complete(F.to_date("ts"), C("ts"), F.lit(True)).alias("x"))
    assert [r.x for r in half.collect()] == [False, False, True, True, True, False]


def test_diversified_equals_the_greedy_loop(spark):
    g = random.Random(2)
    rows = [(f"s{i}", g.choice("XXXYZ"), g.randrange(10), g.randrange(3)) for i in range(60)]
    got = [r.sym for r in ranking.diversified(spark.createDataFrame(rows, "sym string, sector string, b int, s int"), (F.desc("b"), F.asc("s"), F.asc("sym"))).collect()]
    order = sorted(rows, key=lambda r: (-r[2], r[3], r[0]))
    taken, late, n = [], [], {}
    for r in order:
        n[r[1]] = n.get(r[1], 0) + 1
        (taken if n[r[1]] <= 4 else late).append(r[0])
    assert got == (taken + late)[:15]


def test_text_chunks_join_to_the_text(spark):
    texts = ["", "one\ntwo\n\nthree", "x" * 95 + "\ny", "a\n" * 50, "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = text.chunks(df, "id", "text", 20).orderBy("id", "chunk_no").collect()
    assert all(len(r.chunk) <= 20 for r in rows)
    for i, t in enumerate(texts):
        parts = [r.chunk for r in rows if r.id == i]
        assert "".join(parts).replace("\n", "") == t.replace("\n", "")


# ---- exits and folds -----------------------------------------------------------------------------------------------


def one_exit(spark, lows, opens, closes, rule, highs=None, side="long"):
    n = len(closes)
    bars = frame(spark, [100, *closes], low=[100, *lows], open=[100, *opens], high=[100, *(highs or closes)])
    ind = indicators.indicators(bars).withColumn("side", F.when(C("rn") == 1, side)).withColumn("atr14", F.lit(10.0))
    rules = trades.rule_table(spark, [rule])
    r = trades.exits(ind.where("rn = 1"), ind, rules, n).first()
    return r.reason, r.hold, round(r.pnl, 4)


def test_stop_fills(spark):
    cap = ("cap", "none", None, 9, None, 0.4, None, False)
    assert one_exit(spark, [58], [63], [62], cap) == ("STOP", 1, -40.0)
    assert one_exit(spark, [50], [55], [56], cap) == ("STOP", 1, -45.0)  # a gap fills at the open
    assert one_exit(spark, [61], [63], [62], cap) == ("EOD", 1, -38.0)


def test_trail_starts_from_the_entry_and_names_its_reason(spark):
    trail = ("trail", "none", None, 9, None, None, 2.0, False)
    assert one_exit(spark, [95, 99], [100, 120], [110, 104], trail, highs=[130, 121]) == ("TRAIL", 2, 10.0)  # 130 - 20
    assert one_exit(spark, [79], [90], [85], trail) == ("TRAIL", 1, -20.0)


def loop_trades(rows):
    position, out = None, []
    for r in rows:
        position, closed = next_position(position, r, 3)
        if closed:
            out.append((r.sym, closed[0], closed[1], closed[2], closed[3], round(closed[4], 1)))
    return out


def random_scored(spark, n=150):
    g, rows = random.Random(4), []
    for sym in ("A", "B"):
        c = 100.0
        for i in range(n):
            o, c = c * g.uniform(0.97, 1.03), c * g.uniform(0.95, 1.05)
            rows.append((sym, DAY + dt.timedelta(i), o, max(o, c) * g.uniform(1, 1.03), min(o, c) * g.uniform(0.97, 1), c, g.choice(["BUY", "SELL", "NEUTRAL", "NEUTRAL"]), g.choice([2.0, 1.0, None])))
    return spark.createDataFrame(rows, "sym string, date date, open double, high double, low double, close double, verdict string, atr5 double")


def test_bounce_fold_equals_the_loop(spark):
    df = random_scored(spark)
    got = sorted((r.sym, r.side, r.entry_date, r.exit_date, r.reason, round(r.pnl, 1)) for r in trades.closed_trades(trades.bounce_trades(df)).collect())
    want = sorted(t for s in ("A", "B") for t in loop_trades(df.where(C("sym") == s).orderBy("date").collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want] and {"STOP", "TARGET", "TIME"} <= {g[4] for g in got}
    assert all(abs(a[5] - b[5]) <= 0.1001 for a, b in zip(got, want))


def test_stream_equals_batch(spark):
    q = __spark_entry__.queries()
    batch = q["k01_bounce_fold"](spark, SF).drop("pnl")
    stream = q["s03_keyed_trade_log"](spark, SF).drop("pnl")
    assert batch.exceptAll(stream).count() == stream.exceptAll(batch).count() == 0


def test_sticky_keeps_and_releases(spark):
    rows = [("A", DAY + dt.timedelta(i), v, b, s) for i, (v, b, s) in enumerate([("BUY", 14, 0), ("NEUTRAL", 6, 2), ("NEUTRAL", 4, 2), ("NEUTRAL", 6, 2), ("SELL", 0, 14), ("NEUTRAL", 6, 5)])]
    df = spark.createDataFrame(rows, "sym string, date date, verdict string, buy_score int, sell_score int")
    assert [r.held for r in trades.sticky(df).orderBy("date").collect()] == ["BUY", "BUY", "NEUTRAL", "NEUTRAL", "SELL", "NEUTRAL"]


# ---- statistics ----------------------------------------------------------------------------------------------------


def test_average_ranks_and_auc(spark):
    df = spark.createDataFrame([("k", 1.0, 0), ("k", 2.0, 0), ("k", 2.0, 1), ("k", 3.0, 1), ("k", None, 1)], "k string, x double, y int")
    assert sorted(r._r for r in stats.average_rank(df, "x", ("k",), "_r").where("x is not null").collect()) == [1.0, 2.5, 2.5, 4.0]
    assert stats.auc(df, "x", C("y") == 1, "k").first().auc == pytest.approx(3.5 / 4)


def test_no_correlation_without_variance(spark):
    df = spark.createDataFrame([("k", 1, 1.0), ("k", 1, 2.0), ("k", 1, 3.0), ("j", 1, 1.0), ("j", 2, 2.0)], "k string, x int, y double")
    assert {r.k: r.ic for r in stats.pearson(df, "x", "y", "k").collect()} == {"k": None, "j": None}


def test_profit_factor_without_losses_is_null(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "k string, x double")
    assert stats.summary(df, "x", "k").first().profit_factor is None


def test_slices_put_the_remainder_last(spark):
    df = spark.createDataFrame([("k", i) for i in range(7)], "k string, x int")
    assert [r.slice for r in stats.slices(df, "x", 5, ("k",), ()).orderBy("x").collect()] == [1, 2, 3, 3, 4, 5, 5]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sym", "verdict", "n"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "n", "col", "new"), [("d03_wilder_atr", 14, "atr", ("tr",)), ("d07_rsi2_smoothed", 2, "rsi", ("gain", "loss"))])
def test_smoothed_indicators_cover_all_sessions(spark, name, n, col, new):
    rows = indicators.with_ranges(base.bars(spark, SF)).where("tr is not null").orderBy("date").collect()
    want, avg, seen = {}, {}, {}
    for x in rows:
        k = seen[x.sym] = seen.get(x.sym, 0) + 1
        old = avg.setdefault(x.sym, [0.0] * len(new))
        avg[x.sym] = [v + x[c] / n if k <= n else v * (n - 1) / n + x[c] / n for v, c in zip(old, new)]
        if k >= n:
            a = avg[x.sym]
            want[x.sym, x.date] = a[0] if col == "atr" else 100.0 if a[1] == 0 else 100 - 100 / (1 + a[0] / a[1])
    got = {(x.sym, x.date): x[col] for x in __spark_entry__.queries()[name](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 5000
    assert all(got[k] == pytest.approx(want[k], abs=1e-3, rel=1e-6) for k in want)


# The exchange's published closures and early closes of two years.
CLOSED = "2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25 2027-01-01 2027-01-18 2027-02-15 2027-03-26 2027-05-31 2027-06-18 2027-07-05 2027-09-06 2027-11-25 2027-12-24"
HALF = "2026-11-27 2026-12-24 2027-11-26"


def test_calendar_by_rule(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2026-01-01', DATE '2027-12-31')) AS day")
    on = lambda c: " ".join(str(x.day) for x in days.where(c).orderBy("day").collect())
    assert on(scalars.is_market_holiday(C("day")) & ~scalars.is_weekend(C("day"))) == CLOSED
    assert on(scalars.is_half_day(C("day"))) == HALF
    easter = {1981: "04-17", 1997: "03-28", 2000: "04-21", 2049: "04-16", 2076: "04-17"}
    rows = spark.createDataFrame([(dt.date(y, 6, 1),) for y in easter], "day date").select(scalars.good_friday(C("day")).alias("f")).collect()
    assert {x.f.year: x.f.strftime("%m-%d") for x in rows} == easter


def test_report_with_the_index_over_the_same_days(spark):
    day = lambda i: DAY + dt.timedelta(i)
    done = spark.createDataFrame([("A", 1, day(0), "long", "x", "TIME", 2, 10.0, day(2)), ("B", 1, day(1), "short", "x", "TIME", 1, 4.0, day(2)), ("C", 1, day(0), "long", "x", "EOD", 9, 1.0, day(9))], "sym string, rn int, entry_date date, side string, label string, reason string, hold int, pnl double, exit_date date")
    index = spark.createDataFrame([(day(0), 100.0), (day(1), 110.0), (day(2), 121.0)], "date date, close double")
    row = trades.rule_report(trades.with_index(done, index)).first()
    assert row.n == 3 and row.avg_index == pytest.approx((21 + 10) / 2) and row.edge == pytest.approx(5 - 15.5)
    assert "edge" not in trades.rule_report(done).columns
