"""Technical indicators: window expressions over one partitioning and order, so one exchange and one sort serve them all."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Look-backs (bars) and weights of the rate-of-change strength.
STRENGTH_LEGS = ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2))


class Bars:
    """Expressions over bars of ``key``, ordered by ``date``. A value is null until its history is long enough."""

    def __init__(self, key: tuple[str, ...] = ("sym",), date: str = "date"):
        self.w = Window.partitionBy(*key).orderBy(date) if key else Window.partitionBy(F.lit(0)).orderBy(date)
        self.rn = F.row_number().over(self.w)
        self.close, self.open, self.high, self.low, self.volume = map(F.col, ("close", "open", "high", "low", "volume"))

    def over(self, a: int, b: int = 0) -> WindowSpec:
        return self.w.rowsBetween(a, b)

    def last(self, n: int) -> WindowSpec:
        return self.over(-(n - 1))

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def true_range(self) -> Column:
        pc = self.lag(self.close)
        known = pc.isNotNull() & self.high.isNotNull() & self.low.isNotNull()
        return F.when(known, F.greatest(self.high - self.low, F.abs(self.high - pc), F.abs(self.low - pc)))

    def sma(self, n: int) -> Column:
        return F.when(self.rn >= n, F.avg(self.close).over(self.last(n)))

    def ret(self, n: int) -> Column:
        then = self.lag(self.close, n)
        return F.when(then > 0, F.try_divide(self.close, then) - 1)

    def strength(self) -> Column:
        """Weighted rate of change over the legs there are, weights made to sum to 1; needs 64 bars."""
        legs = [(self.ret(n), w) for n, w in STRENGTH_LEGS]
        total = sum((F.coalesce(r * w, F.lit(0.0)) for r, w in legs), F.lit(0.0))
        weight = sum((F.when(r.isNotNull(), w).otherwise(0.0) for r, w in legs), F.lit(0.0))
        return F.when((self.rn >= 64) & (weight > 0), F.try_divide(total, weight))

    def relative_volume(self) -> Column:
        v, before = F.when(self.volume > 0, self.volume), self.over(-20, -1)
        ok = (self.rn >= 21) & (F.count(v).over(before) >= 15)
        return F.when(ok, F.try_divide(self.volume, F.avg(v).over(before)))

    def positive_mean(self, x: Column, n: int) -> Column:
        return F.avg(F.when(x > 0, x)).over(self.last(n))


@cache
def _range_columns(key: tuple[str, ...]) -> list[Column]:
    """Expressions name columns only, so that one list serves every table; making it anew for each costs a second on the driver."""
    b = Bars(key)
    pc = b.lag(b.close)
    change = b.close - pc
    gap = F.abs(F.try_divide(b.open, pc) - 1)
    money = b.close * b.volume
    signed = F.when(pc.isNotNull() & (b.volume > 0), F.when(b.close > pc, money).when(b.close < pc, -money).otherwise(0.0))
    return [
        b.rn.alias("rn"), pc.alias("pc"), b.true_range().alias("tr"), F.greatest(change, F.lit(0.0)).alias("gain"), F.greatest(-change, F.lit(0.0)).alias("loss"),
        F.when((pc > 0) & gap.between(-0.9, 9), gap).alias("gap"), signed.alias("flow1"), money.alias("money"), b.lag(b.close, 2).alias("pc2"),
        F.when(b.close > 0, F.try_divide(b.high - b.low, b.close)).alias("range_pct"), b.lag(b.volume).alias("pv"),
    ]


def with_ranges(bars: DataFrame, key: tuple[str, ...] = ("sym",)) -> DataFrame:
    """First layer: what later windows aggregate: bar number, true range, gaps, signed money, one-bar facts."""
    return bars.select("*", *_range_columns(key))


@cache
def _indicator_columns(key: tuple[str, ...]) -> list[Column]:
    b = Bars(key)
    rn = F.col("rn")
    gains, losses = F.sum("gain").over(b.last(2)), F.sum("loss").over(b.last(2))
    mid, sd = F.avg("close").over(b.last(20)), F.stddev_pop("close").over(b.last(20))
    span = b.high - b.low
    ups = F.sum(F.when(F.col("flow1") > 0, F.col("flow1"))).over(b.last(10))
    downs = F.sum(F.when(F.col("flow1") < 0, -F.col("flow1"))).over(b.last(10))
    both = F.coalesce(ups, F.lit(0.0)) + F.coalesce(downs, F.lit(0.0))
    flow = F.when((F.count("flow1").over(b.last(10)) >= 6) & (both > 0), F.try_divide(F.coalesce(ups, F.lit(0.0)) - F.coalesce(downs, F.lit(0.0)), both))
    vol = F.when(b.volume > 0, b.volume)
    near, far = b.over(-4, 0), b.over(-24, -5)
    dry = F.try_divide(F.avg(vol).over(near), F.avg(vol).over(far))
    gaps = F.count("gap").over(b.last(60))
    atr = {n: F.avg("tr").over(b.last(n)) for n in (5, 14, 20)}
    high, low = F.max("close").over(b.last(260)), F.min("close").over(b.last(260))
    adr = F.avg("range_pct").over(b.last(20))
    return [
        *[v.alias(f"atr{n}") for n, v in atr.items()], *[b.sma(n).alias(f"sma{n}") for n in (5, 20, 50, 200)],
        F.when(rn >= 3, F.when(losses == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gains, losses)))).alias("rsi2"),
        F.when(rn >= 20, F.when(sd == 0, 0.5).otherwise(F.try_divide(b.close - (mid - 2 * sd), 4 * sd))).alias("pctb"),
        b.relative_volume().alias("rv"), F.when(span > 0, F.try_divide(b.close - b.low, span)).alias("pos"), b.strength().alias("strength"),
        F.when((rn >= 26) & (F.count(vol).over(near) >= 4) & (F.count(vol).over(far) >= 15) & dry.between(0, 20), dry).alias("dryup"),
        F.when(F.try_divide(atr[5], atr[20]).between(0, 20), F.try_divide(atr[5], atr[20])).alias("expansion"),
        F.when((rn >= 21) & (gaps >= 15), F.avg("gap").over(b.last(60))).alias("gap_avg"),
        F.when((rn >= 21) & (gaps >= 15), F.avg((F.col("gap") >= 0.03).cast("double")).over(b.last(60))).alias("gap_share"),
        F.when(F.count("range_pct").over(b.last(20)) >= 15, adr * 100).alias("adr"),
        b.positive_mean(F.col("money"), 20).alias("adv"), b.ret(62).alias("ret63"), b.ret(125).alias("ret126"), b.ret(126).alias("ret126_index"), b.ret(252).alias("ret252"),
        high.alias("high260"), low.alias("low260"), F.try_divide(high - b.close, high).alias("off_high"), F.try_divide(b.close - low, low).alias("off_low"), flow.alias("flow10"),
        F.stddev_samp(F.log(F.try_divide(b.close, F.col("pc")))).over(b.last(20)).alias("sd20"),
    ]


def indicators(bars: DataFrame, key: tuple[str, ...] = ("sym",)) -> DataFrame:
    """All indicators in one projection over ``with_ranges``; unused ones are pruned by the optimizer."""
    return with_ranges(bars, key).select("*", *_indicator_columns(key))


def distribution_days(bars: DataFrame, key: tuple[str, ...] = ("sym",), sessions: int = 25, drop: float = -0.002, expiry: float = 1.05) -> DataFrame:
    """Adds ``dist_days``: of the last sessions, falls on higher volume that the present close has not outrun; null before 26 bars."""
    b = Bars(key)
    d = bars.select("*", b.rn.alias("rn"), b.lag(b.close).alias("pc"), b.lag(b.volume).alias("pv"))
    fell = (F.try_divide(b.close, F.col("pc")) - 1 <= drop) & (b.volume > F.col("pv"))
    marks = F.collect_list(F.when(fell, b.close)).over(b.last(sessions))
    return d.select("*", F.when(F.col("rn") >= sessions + 1, F.size(F.filter(marks, lambda c: F.col("close") <= c * expiry))).alias("dist_days"))


def beta(joined: DataFrame, n: int = 252, least: int = 100) -> DataFrame:
    """Adds ``beta`` (least squares) and ``beta0`` (through the origin, 120 log returns, over 30 pairs) of ``r`` on ``ri``."""
    b = Bars()
    w, w2 = b.last(n), b.last(120)
    pair = F.col("r").isNotNull() & F.col("ri").isNotNull()
    x, y = F.when(pair, F.col("ri")), F.when(pair, F.col("r"))
    lx, ly = F.log1p(x), F.log1p(y)
    k = F.count(x).over(w)
    slope = F.try_divide(F.sum(x * y).over(w) - F.try_divide(F.sum(x).over(w) * F.sum(y).over(w), k), F.sum(x * x).over(w) - F.try_divide(F.sum(x).over(w) * F.sum(x).over(w), k))
    return joined.select("*", F.when(k >= least, slope).alias("beta"), F.when(F.count(x).over(w2) > 30, F.try_divide(F.sum(lx * ly).over(w2), F.sum(lx * lx).over(w2))).alias("beta0"))


def cross_age(ind: DataFrame) -> DataFrame:
    """Adds ``cross_age``: sessions since the 50-bar average last rose above the 200-bar one; null while it is not."""
    b = Bars()
    on = F.col("sma50") > F.col("sma200")
    flips = ind.select("*", F.when(F.coalesce(on, F.lit(False)), 1).otherwise(0).alias("on"))
    island = F.sum(1 - F.col("on")).over(b.w.rowsBetween(Window.unboundedPreceding, 0))
    d = flips.select("*", island.alias("island"))
    age = F.col("rn") - F.min(F.when(F.col("on") == 1, F.col("rn"))).over(Window.partitionBy("sym", "island"))
    return d.select("*", F.when(F.col("on") == 1, age).alias("cross_age")).drop("on", "island")


#: Values of a symbol whose recursion is closed within one window before chunks are chained.
CHUNK = 512


def wilder_of(df: DataFrame, value: str, n: int) -> DataFrame:
    """``v``: the mean of a symbol's first ``n`` values, then (previous x (n - 1) + next) / n.

    A scan in two steps: each step is an affine map, and the maps of ``CHUNK`` values compose to one, so that a window over
    the chunk gives every value up to the one that enters it; only one map a chunk is chained per symbol. Values must not
    be negative: the weights of a chunk then lose no digits.
    """
    keep, whole = (n - 1) / n, Window.partitionBy("sym")
    d = df.select("sym", "date", F.col(value).alias("x")).withColumn("k", F.row_number().over(whole.orderBy("date")))
    d = d.withColumn("seed", F.avg(F.when(F.col("k") <= n, F.col("x"))).over(whole)).where(F.col("k") >= n)
    at = F.col("k") - n - 1  # the value at k = n is the seed itself
    d = d.select("sym", "date", "x", "seed", F.floor(at / CHUNK).alias("c"), F.pmod(at, F.lit(CHUNK)).alias("j"), (F.col("k") == n).alias("first"))
    within = Window.partitionBy("sym", "c").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.col("x") / n * F.pow(F.lit(keep), -F.col("j"))).over(within) * F.pow(F.lit(keep), F.col("j"))
    d = d.select("sym", "date", "seed", "c", "j", "first", F.when(~F.col("first"), own).alias("own"))
    ends = d.where((F.col("j") == CHUNK - 1) & ~F.col("first")).groupBy("sym").agg(F.first("seed").alias("s"), F.array_sort(F.collect_list(F.struct("c", "own"))).alias("ends"))
    start = F.struct(F.col("s").alias("v"), F.array().cast("array<struct<c:bigint,v:double>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        v = acc["v"] * keep**CHUNK + e["own"]
        return F.struct(v.alias("v"), F.concat(acc["out"], F.array(F.struct((e["c"] + 1).alias("c"), v.alias("v")))).alias("out"))

    entering = ends.select("sym", F.explode(F.aggregate("ends", start, step, lambda a: a["out"])).alias("o")).select("sym", "o.c", F.col("o.v").alias("entering"))
    met = d.hint("merge").join(entering.hint("merge"), ["sym", "c"], "left")
    v = F.coalesce("entering", "seed") * F.pow(F.lit(keep), F.col("j") + 1) + F.col("own")
    return met.select("sym", "date", F.when(F.col("first"), F.col("seed")).otherwise(v).alias("v"))


def wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Smoothed ATR."""
    return wilder_of(with_ranges(bars).where("tr is not null"), "tr", n).withColumnRenamed("v", "atr")
