"""Recursions as scans, as-of joins, the daily log, symbol search, deep exits and the bootstrap against plain loops; plan shapes."""

import datetime as dt
import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from candlefold.operators import asof, checklist, indicators, ranking, scoring, stats, trades

C = F.col
DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(i)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [2, 14])
def test_smoothing_over_chunks_equals_the_recursion(spark, n):
    g = random.Random(n)
    rows = [(s, day(i), g.choice([0.0, 0.0, g.uniform(0, 9), 1e6])) for s, m in (("a", 1700), ("b", n), ("c", n - 1), ("d", n + 512), ("e", n + 513)) for i in range(m)]
    got = {(r.sym, r.date): r.v for r in indicators.wilder_of(spark.createDataFrame(rows, "sym string, date date, x double"), "x", n).collect()}
    want, v, seen = {}, {}, {}
    for s, d, x in rows:
        seen.setdefault(s, []).append(x)
        k = len(seen[s])
        if k >= n:
            v[s] = sum(seen[s]) / n if k == n else (v[s] * (n - 1) + x) / n
            want[s, d] = v[s]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-280) for k in want)


def test_smoothing_and_memory_take_linear_time(spark):
    def took(m):
        rows = spark.range(m).select(F.lit("a").alias("sym"), F.date_add(F.lit(DAY), C("id").cast("int")).alias("date"), (C("id") % 7).cast("double").alias("x"))
        rows = rows.select("*", F.when(C("x") == 0, "BUY").otherwise("NEUTRAL").alias("verdict"), F.lit(9).alias("buy_score"), F.lit(1).alias("sell_score"))
        began = time.perf_counter()
        assert indicators.wilder_of(rows, "x", 14).count() == m - 13 and trades.sticky(rows).where("held = 'BUY'").count() == m
        return time.perf_counter() - began

    took(1000)
    small, large = took(10_000), took(100_000)
    assert large < 10 * max(small, 2)


def test_memory_of_nulls_and_other_verdicts(spark):
    g = random.Random(5)
    rows = [(s, day(i), g.choice(["BUY", "SELL", "BLOCKED", None, "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEUTRAL"]), g.choice([None, 3, 5, 9]), g.choice([None, 2, 5, 9])) for s in "abc" for i in range(150)]
    got = {(r.sym, r.date): r.held for r in trades.sticky(spark.createDataFrame(rows, "sym string, date date, verdict string, buy_score int, sell_score int")).collect()}
    held = {}
    for s, d, v, b, q in rows:
        was = held.get(s, "NEUTRAL")
        own, other = (b, q) if was == "BUY" else (q, b)
        stays = was in ("BUY", "SELL") and None not in (own, other) and own / 24 >= 0.2 and own >= other
        held[s] = (was if stays else "NEUTRAL") if v == "NEUTRAL" else v
        assert got[s, d] == held[s]


def test_point_in_time_with_late_statements(spark):
    g = random.Random(6)
    facts = [(s, day(90 * q), float(q), day(90 * q + g.choice([30, 45, 400]))) for s in "ab" for q in range(20)]
    checks = [(s, day(g.randrange(2000))) for s in "abc" for _ in range(60)]
    st = spark.createDataFrame(facts, "sym string, period_end date, revenue double, accepted_date date")
    df = asof.point_in_time(spark.createDataFrame(checks, "sym string, date date"), st, 4)
    got = sorted((r.sym, r.date, r.nth, r.revenue) for r in df.collect())
    want = sorted((s, d, k + 1, q) for s, d in set(checks) for k, (_, q) in enumerate(sorted(((p, q) for t, p, q, a in facts if t == s and a <= d), reverse=True)[:4]))
    assert got == want and "SortMergeJoin" not in plan(df) and "NestedLoop" not in plan(df)


def test_back_or_oldest(spark):
    g = random.Random(7)
    snaps = sorted({(s, day(g.randrange(400))) for s in "ab" for _ in range(25)})
    snaps = [(s, d, float(i)) for i, (s, d) in enumerate(snaps)]
    checks = sorted({(s, day(g.randrange(450))) for s in "abc" for _ in range(60)})
    df = asof.back_or_oldest(spark.createDataFrame(checks, "sym string, date date"), spark.createDataFrame(snaps, "sym string, date date, v double"), "v")
    want = []
    for s, d in checks:
        past = sorted((x, v) for t, x, v in snaps if t == s and x <= d)
        if past:
            far = [v for x, v in past if x <= d - dt.timedelta(60)]
            want.append((s, d, past[-1][1], None if len(past) < 2 else far[-1] if far else past[0][1]))
    assert sorted(tuple(r) for r in df.collect()) == want and "Join" not in plan(df)


def test_series_at_carries_forward(spark):
    s = spark.createDataFrame([(day(2), 5.0), (day(4), None), (day(6), 7.0)], "date date, vix double")
    got = asof.series_at(spark.createDataFrame([(day(i), i) for i in (1, 2, 3, 5, 6, 9, 9)], "date date, k int"), s, "vix").orderBy("k").collect()
    assert [r.vix for r in got] == [None, 5.0, 5.0, 5.0, 7.0, 7.0, 7.0]


def test_daily_log_with_exit_and_entry_on_one_day(spark):
    days = spark.createDataFrame([("a", day(i), i == 0) for i in range(9)], "sym string, date date, watch boolean")
    done = spark.createDataFrame([("a", day(1), day(3), "STOP"), ("a", day(3), day(5), "TIME")], "sym string, entry_date date, exit_date date, reason string")
    now = spark.createDataFrame([("a", (day(7),)), ("b", None)], "sym string, open struct<date:date>")
    df = trades.daily_log(days, done, now, 15)
    got = sorted((r.date, r.action, r.reason) for r in df.collect())
    assert [(a, x) for _, a, x in got] == [("WATCH", None), ("BUY", None), ("HOLD", None), ("BUY", None), ("SELL", "STOP"), ("HOLD", None), ("SELL", "TIME"), ("FLAT", None), ("BUY", None), ("HOLD", None)]
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_search_by_pieces_equals_comparing_all(spark):
    g = random.Random(8)
    names = [("".join(g.choices("ab", k=g.randint(1, 4))), g.choice([None, "".join(g.choices("aB ", k=g.randint(0, 9)))])) for _ in range(80)] + [("a.b", "x"), ("AB", "dup")]
    asked = ["a", "AB", "b a", "", "zzz", "abab"]
    df = ranking.search(spark.createDataFrame(names, "ticker string, name string").dropDuplicates(["ticker"]), spark.createDataFrame([(q,) for q in asked], "query string"), 500)
    known = {r.ticker: r.name for r in spark.createDataFrame(names, "ticker string, name string").dropDuplicates(["ticker"]).collect()}

    def rank(q, t, m):
        q, t, m = q.upper(), t.upper(), (m or "").upper()
        return 0 if t == q else 1 if t.startswith(q) else 2 if m.startswith(q) else 3 if q in m else None

    want = sorted((q, t, rank(q, t, m)) for q in asked for t, m in known.items() if "." not in t and rank(q, t, m) is not None)
    assert sorted((r.query, r.ticker, r.match) for r in df.collect()) == want and "NestedLoop" not in plan(df)


def test_deep_exits_equal_a_loop(spark):
    g, rows = random.Random(9), []
    for sym in "abcd":
        c = 100.0
        for i in range(420):
            o, c = c * g.uniform(0.96, 1.03), max(1.0, c * g.uniform(0.94, 1.063))
            gap = g.random() < 0.03
            high, low = (None, None) if gap else (max(o, c) * g.uniform(1, 1.03), min(o, c) * g.uniform(0.96, 1))
            rows.append((sym, i + 1, day(i), None if gap else o, high, low, c, g.choice([None, c * g.uniform(0.8, 1.1)]), g.choice([None, c * g.uniform(0.7, 1.05)]), None if g.random() < 0.2 else g.uniform(1, 8)))
    bars = spark.createDataFrame(rows, "sym string, rn int, date date, open double, high double, low double, close double, sma50 double, sma200 double, atr double")
    df = trades.deep_exits(bars.where("rn % 40 = 0"), bars, 150)
    got = {(r.sym, r.rn, r.label): (r.reason, r.hold, pytest.approx(r.pnl)) for r in df.collect()}
    want = {}
    for sym in "abcd":
        b = [r[2:] for r in rows if r[0] == sym]
        for i in range(39, 420, 40):
            for label, trail, trend, cross, limit in trades.DEEP_RULES:
                entry, top, end = b[i][4], b[i][2] or b[i][4], min(len(b) - 1, i + 150)
                for k in range(i + 1, end + 1):
                    _, o, h, lo, c, s50, s200, atr = b[k]
                    o, h, lo, atr, out = o or c, h or c, lo or c, atr or b[k - 1][7], None
                    line = top - trail * atr if trail and atr else None
                    if lo <= entry * 0.6:
                        out = ("STOP", min(o, entry * 0.6))
                    elif line is not None and lo <= line:
                        out = ("TRAIL", min(o, line))
                    elif trend and s50 and c < s50:
                        out = ("TREND", c)
                    elif cross and s50 and s200 and s50 < s200:
                        out = ("MACROSS", c)
                    elif k - i >= limit:
                        out = ("TIME", c)
                    elif k == end:
                        out = ("EOD", c)
                    if out:
                        want[sym, i + 1, label] = (out[0], k - i, (out[1] - entry) / entry * 100)
                        break
                    top = max(top, h)
    assert got == want and {"STOP", "TRAIL", "TREND", "MACROSS", "TIME", "EOD"} <= {w[0] for w in want.values()}


def test_grids_have_their_named_rules():
    named, wide = [r[0] for r in trades.swing_rule_rows()], [r[0] for r in trades.extended_rule_rows()]
    assert len(named) == len(set(named)) == 22 and {"atr3", "chand4_t40"} <= set(named)
    assert wide[:22] == named and {"cross_atr3.5", "cross_atr4.5", "cross_atr5", "cross_t40", "cross_t84"} <= set(wide) and len(wide) == len(set(wide))


def test_bootstrap_sums_do_not_grow_with_rows(spark):
    df = spark.range(300).select(C("id"), F.when(C("id") % 50 > 0, (C("id") % 17).cast("double")).alias("x"))
    got = {r.rep: r["mean"] for r in stats.bootstrap_means(df, "x", "id", 20).collect()}
    for rep in range(1, 21):
        w = {i: sum(int(hashlib.md5(f"7_{rep}_{i}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in stats.POISSON_CUTS) for i in range(300) if i % 50}
        assert got[rep] == pytest.approx(sum(k * (i % 17) for i, k in w.items()) / sum(w.values()))
    assert "Generate" not in plan(stats.bootstrap_means(df, "x", "id", 20))


def test_masks_leave_factors_out(spark):
    f = spark.createDataFrame([(3, 2, 1, None, 3, 1, 0, 3, 2, 1, True), (3, 3, 3, 3, 0, 0, 0, 0, 3, 3, False)], "rsi_buy int, pctb_buy int, clx_buy int, rs_buy int, rsi_sell int, pctb_sell int, clx_sell int, rs_sell int, dry_pts int, exp_pts int, favorable boolean")
    f = f.withColumns({c: F.lit(1.0) for c in ("liq_mult", "adr_mult", "gap_mult")}).withColumn("vix_mult", F.lit(1.15))
    masks = spark.createDataFrame([("none", []), ("no_rsi", ["rsi"]), ("most", ["rsi", "pctb", "dry", "exp"])], "mask string, factors array<string>")
    got = {(r["mask"], r.favorable): (r.buy_score, r.sell_score) for r in scoring.masked_scores(f, masks).collect()}
    half_up = lambda x: math.floor(x + 0.5)
    assert got["none", True] == (half_up(9 * 1.15), half_up(10 * 1.15)) and got["no_rsi", True] == (half_up(6 * 1.15), half_up(7 * 1.15))
    assert got["most", False] == (half_up(6 * 0.85 * 1.15), 0)
    plain = scoring.bounce_score(f).select("favorable", "buy_score", "sell_score").collect()
    assert all(got["none", r.favorable] == (r.buy_score, r.sell_score) for r in plain)


def test_block_points_need_three_factors(spark):
    rows = [("a", day(90 * q), float(100 + 10 * q), 10, day(90 * q + 45)) for q in range(9)]
    st = spark.createDataFrame(rows, "sym string, period_end date, revenue double, n_orders long, accepted_date date")
    got = [r.points for r in checklist.block_points(checklist.block_inputs(st)).orderBy("period_end").collect()]
    assert got[:4] == [None] * 4 and all(p is not None for p in got[4:])  # four quarters give two factors, the fifth the third
    # growth 40 % (3), pace 140 x 4 / 500 (3), order value the same (3), no growth of the sums yet; later pace 180 x 4 / 660 (2), sums 660 / 500 (3)
    assert got[4] == 9 and got[8] == 11
