"""Grouped statistics of trades and factors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, win rate, profit factor (null without losses), sample sd, Sharpe, Sortino, lower median."""
    x = C(value)
    loss, win = F.sum(F.when(x <= 0, -x)), F.sum(F.when(x > 0, x))
    down = F.sqrt(F.try_divide(F.sum(F.when(x < 0, x * x)), F.count_if(x < 0)))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("win_rate"), F.when(loss > 0, F.try_divide(F.coalesce(win, F.lit(0.0)), loss)).alias("profit_factor"),
        F.stddev_samp(x).alias("sd"), F.when(F.stddev_samp(x) > 0, F.try_divide(F.avg(x), F.stddev_samp(x))).alias("sharpe"), F.when(down > 0, F.try_divide(F.avg(x), down)).alias("sortino"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median_low"),
    )


def corr(x: Column, y: Column) -> Column:
    """Correlation of complete pairs; null without variance, where the built-in one fails."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x.cast("double")), F.when(pair, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n and ic: the correlation of complete pairs, null below three pairs or without variance."""
    pair = df.where(C(x).isNotNull() & C(y).isNotNull())
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return pair.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & ~flat, corr(C(x), C(y))).alias("ic"))


def average_rank(df: DataFrame, x: str, by: tuple[str, ...], name: str) -> DataFrame:
    """Adds the rank of x with ties averaged, per key: counts per distinct value, so ties cost one row each in the sort."""
    counts = df.where(C(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.select(*by, x, (F.sum("_n").over(upto) - (C("_n") - 1) / 2).alias(name))
    return df.hint("merge").join(ranks, [*by, x], "left")


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    pair = df.where(C(x).isNotNull() & C(y).isNotNull()).select(*by, x, y)
    return pearson(average_rank(average_rank(pair, x, by, "_rx"), y, by, "_ry"), "_rx", "_ry", *by)


def auc(df: DataFrame, x: str, label: Column, *by: str) -> DataFrame:
    """Mann-Whitney: chance that a positive row has the larger x, ties one half."""
    d = df.where(C(x).isNotNull() & label.isNotNull()).select(*by, x, label.cast("long").alias("_y"))
    r = average_rank(d, x, by, "_r").groupBy(*by).agg(F.sum(C("_r") * C("_y")).alias("s"), F.sum("_y").alias("p"), F.count("*").alias("n"))
    q = C("n") - C("p")
    return r.select(*by, "n", F.when((C("p") > 0) & (q > 0), F.try_divide(C("s") - C("p") * (C("p") + 1) / 2, C("p") * q)).alias("auc"))


def max_drawdown(df: DataFrame, pct: str, order: str, *by: str) -> DataFrame:
    """Largest fall (percent, not positive) of the compounded returns from their running peak, which starts at 1."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = df.select(*by, order, F.exp(F.sum(F.log1p(C(pct) / 100)).over(w)).alias("_v"))
    peak = curve.select(*by, C("_v"), F.greatest(F.lit(1.0), F.max("_v").over(w)).alias("_p"))
    return peak.groupBy(*by).agg(F.min((C("_v") / C("_p") - 1) * 100).alias("max_drawdown"))


def unpivot_factors(df: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...], side: str = "buy") -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("key"), C(f"{k}_{side}").alias("points")) for k in keys])
    return df.select(*keep, F.explode(rows).alias("f")).select(*keep, "f.key", "f.points")


def attribution(long: DataFrame, value: str) -> DataFrame:
    """Per factor and points bucket, and per factor over all buckets (bucket null) with the IC: one pass with grouping sets."""
    d = long.where(C("points").isNotNull() & C(value).isNotNull())
    return d.groupingSets([[C("key"), C("points")], [C("key")]], C("key"), C("points")).agg(
        F.count("*").alias("n"), F.avg(value).alias("avg_ret"), F.avg((C(value) > 0).cast("double")).alias("win_rate"),
        F.when((F.grouping("points") == 1) & (F.count("*") >= 3), corr(C("points"), C(value))).alias("ic"),
    )


def slices(df: DataFrame, x: str, n: int, by: tuple[str, ...], tie: tuple[str, ...]) -> DataFrame:
    """Adds ``slice`` 1..n by position: slice q ends before position floor(q * rows / n)."""
    w = Window.partitionBy(*by)
    pos = F.row_number().over(w.orderBy(x, *tie))
    return df.select("*", F.ceil(pos * n / F.count("*").over(w)).alias("slice"))


def split_chronological(df: DataFrame, date: str, by: tuple[str, ...], tie: tuple[str, ...], share: float = 0.7, folds: int = 5) -> DataFrame:
    """Adds ``in_sample`` (the first ``share`` by rank) and ``fold`` (k blocks in order; block 0 only trains)."""
    w = Window.partitionBy(*by)
    pos, n = F.row_number().over(w.orderBy(date, *tie)) - 1, F.count("*").over(w)
    return df.select("*", (pos < F.floor(n * share)).alias("in_sample"), F.floor(pos * folds / n).cast("int").alias("fold"))


def normal_cdf(z: Column) -> Column:
    """Polynomial approximation of the standard normal distribution function (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def significance(df: DataFrame, value: str, tests: Column, *by: str) -> DataFrame:
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when(C("sd") > 0, F.try_divide(C("mean"), C("sd") / F.sqrt("n")))
    d = s.select(*by, "n", t.alias("t"))
    p = 2 * (1 - normal_cdf(F.abs(C("t"))))
    return d.select(*by, "n", "t", p.alias("p"), F.least(F.lit(1.0), p * tests).alias("p_bonferroni"), (p * tests < 0.05).alias("survives"))


#: Distribution function of the Poisson law of mean 1 at 0 to 5.
POISSON_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def bootstrap_means(df: DataFrame, value: str, id_: str, reps: int, seed: int = 7) -> DataFrame:
    """``rep``, ``mean``: Poisson bootstrap; each row's weight in a replicate follows from a hash, so any partitioning gives it.

    A task adds its rows to one array of sums per replicate and hands on the arrays: what is shuffled are ``reps`` sums a
    task, however many rows there are. Rows without a value have no part.
    """
    cuts = np.array([math.ceil(c * 4294967296.0) for c in POISSON_CUTS], np.uint32)  # u >= c for whole numbers u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [f"{seed}_{rep}_".encode() for rep in range(1, reps + 1)]
        weights, sums = np.zeros(reps, np.int64), np.zeros(reps)
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x is None:
                    continue
                tail = str(key).encode()
                u = np.frombuffer(b"".join([hashlib.md5(h + tail).digest()[:4] for h in heads]), ">u4")
                w = np.searchsorted(cuts, u, side="right")
                weights += w
                sums += w * x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1), pa.int32()), pa.array(weights), pa.array(sums)], ["rep", "w", "s"])

    rows = df.select(C(id_).cast("string"), C(value).cast("double")).repartition(df.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    each = rows.mapInArrow(run, "rep int, w long, s double")
    return each.groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("mean"))


def concurrency(trades: DataFrame, entry: str = "entry_date", exit: str = "exit_date") -> DataFrame:
    """Open trades at the end of each date that has an entry or exit: a sweep over +1 and -1 events summed per date."""
    e = trades.select(C(entry).alias("date"), F.lit(1).alias("d")).unionByName(trades.select(C(exit).alias("date"), F.lit(-1).alias("d")))
    daily = e.groupBy("date").agg(F.sum("d").alias("d"))
    return daily.select("date", F.sum("d").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("open_trades"))
