"""Scores over indicator columns: the two-sided bounce score and verdict, the swing core and its entry signal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlefold.functions.scalars import down, in_range, up

C = F.col


@dataclass(frozen=True)
class Scale:
    """Money floors of the liquidity ladders; fixtures have smaller prices than the defaults are made for."""

    best: float = 100e6
    good: float = 20e6
    least: float = 10e6


def volume_day(up_day: Column, down_day: Column, rv: Column, good: Column, bad: Column) -> tuple[Column, Column]:
    big, heavy = rv >= 2.5, rv >= 1.5
    buy = F.when(big & down_day, 3).when(heavy & down_day, 2).when(heavy & up_day, 1).otherwise(0)
    sell = F.when(big & up_day, 3).when(heavy & up_day, 2).when(heavy & down_day, 1).otherwise(0)
    known = rv.isNotNull() & C("pv").isNotNull()
    return F.when(known, buy), F.when(known, sell)


def surge(rv: Column, up_day: Column, down_day: Column, flow: Column, sign: int = 1) -> Column:
    """Accumulation ladder of the last session and the 10-session flow; ``sign`` -1 gives its mirror."""
    f = F.coalesce(flow * sign, F.lit(0.0))
    strong, mild, against = f >= 0.3, f >= 0.1, f <= -0.3
    with_day, counter = (up_day, down_day) if sign > 0 else (down_day, up_day)
    return (
        F.when(((rv >= 1.5) & counter) | against, 0)
        .when(with_day & ((rv >= 2.5) | ((rv >= 1.5) & strong)), 3)
        .when((with_day & (rv >= 1.5)) | (strong & (rv >= 0.8)), 2)
        .when(rv >= 0.8, 1)
        .otherwise(0)
    )


def bounce_factors(ind: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Adds ``<key>_buy`` and ``<key>_sell`` points (0-3, null if not available) and the multipliers.

    ``ind`` needs ``rs_delta`` (strength less the index's); the other inputs are indicator columns.
    """
    up_day, down_day = C("close") > C("pc"), C("close") < C("pc")
    rv = in_range(C("rv"), "relvol")
    clx_buy, clx_sell = volume_day(up_day, down_day, rv, None, None)
    before_down, before_up = F.coalesce(C("pc") < C("pc2"), F.lit(False)), F.coalesce(C("pc") > C("pc2"), F.lit(False))
    pos, known = C("pos"), C("pos").isNotNull() & C("pc").isNotNull()
    rev_buy = F.when(before_down & (pos >= 0.8), 3).when(before_down & (pos >= 0.6), 2).when(pos >= 0.8, 1).otherwise(0)
    rev_sell = F.when(before_up & (pos <= 0.2), 3).when(before_up & (pos <= 0.4), 2).when(pos <= 0.2, 1).otherwise(0)
    liq, adr = up(C("adv"), scale.least, scale.good, scale.best), C("adr")
    return ind.select(
        "*",
        down(C("rsi2"), 20, 10, 5).alias("rsi_buy"), up(C("rsi2"), 80, 90, 95).alias("rsi_sell"),
        down(C("pctb"), 0.25, 0.1, 0).alias("pctb_buy"), up(C("pctb"), 0.75, 0.9, 1.0).alias("pctb_sell"),
        clx_buy.alias("clx_buy"), clx_sell.alias("clx_sell"), F.when(known, rev_buy).alias("rev_buy"), F.when(known, rev_sell).alias("rev_sell"),
        up(C("rs_delta"), -0.05, 0.05, 0.15).alias("rs_buy"), down(C("rs_delta"), 0.05, -0.05, -0.15).alias("rs_sell"),
        down(C("dryup"), 0.9, 0.7, 0.5).alias("dry_pts"), up(C("expansion"), 1.0, 1.2, 1.5).alias("exp_pts"),
        F.when(liq.isNull(), 1.0).when(liq == 3, 1.0).when(liq == 2, 0.85).when(liq == 1, 0.6).otherwise(0.35).alias("liq_mult"),
        F.when(adr.isNull() | adr.between(3, 8), 1.0).when(adr.between(2, 12), 0.7).otherwise(0.4).alias("adr_mult"),
        F.when(C("gap_avg").isNull() | (C("gap_avg") <= 0.015), 1.0).when(C("gap_avg") <= 0.022, 0.9).when(C("gap_avg") <= 0.03, 0.78).otherwise(0.65).alias("gap_mult"),
    )


def regime(index_ind: DataFrame) -> DataFrame:
    """Index rows with ``uptrend``, ``favorable`` (uptrend and at most 5 distribution days), ``label``; null before 200 bars."""
    ready = C("rn") >= 200
    trend = (C("close") > C("sma50")) & (C("sma50") > C("sma200"))
    calm = F.coalesce(C("dist_days") <= 5, F.lit(True))
    label = F.when(trend & calm, "confirmed uptrend").when(trend, "uptrend under pressure").when(C("close") > C("sma200"), "mixed").otherwise("downtrend")
    return index_ind.select("*", F.when(ready, trend).alias("uptrend"), F.when(ready, trend & calm).alias("favorable"), F.when(ready, label).alias("label"))


def vix_class(vix: Column) -> Column:
    return F.when(vix.isNull(), 1.0).when(vix < 15, 0.85).when(vix < 20, 1.0).when(vix < 30, 1.15).otherwise(1.3)


def bounce_score(f: DataFrame, mask: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``buy_score`` and ``sell_score`` (0-24): points times the multipliers, halves up; ``mask`` leaves factors out."""

    def total(side: str) -> Column:
        parts = [C(f"{k}_{side}") for k in ("rsi", "pctb", "clx", "rs") if k not in mask] + [C(c) for c in ("dry_pts", "exp_pts") if c[:3] not in mask]
        raw = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
        tilt = F.when(~C("favorable"), 0.85 if side == "buy" else 1.15).otherwise(1.0)
        return F.least(F.lit(24), F.floor(raw * C("liq_mult") * C("adr_mult") * F.coalesce(tilt, F.lit(1.0)) * C("vix_mult") * C("gap_mult") + 0.5)).cast("int")

    return f.select("*", total("buy").alias("buy_score"), total("sell").alias("sell_score"))


#: Factors of the bounce score by the name a mask uses, with their buy and sell columns.
BOUNCE_FACTORS = {"rsi": ("rsi_buy", "rsi_sell"), "pctb": ("pctb_buy", "pctb_sell"), "clx": ("clx_buy", "clx_sell"), "rs": ("rs_buy", "rs_sell"), "dry": ("dry_pts",) * 2, "exp": ("exp_pts",) * 2}


def masked_scores(f: DataFrame, masks: DataFrame) -> DataFrame:
    """The bounce scores of every row under every mask (``mask``, ``factors``: array of the names left out), in one pass.

    ``masks`` is a stated, short list and is broadcast; adds ``mask``, ``buy_score``, ``sell_score``.
    """
    x = f.crossJoin(F.broadcast(masks))

    def total(i: int, tilt: float) -> Column:
        raw = sum((F.when(F.array_contains("factors", k), 0).otherwise(F.coalesce(C(c[i]), F.lit(0))) for k, c in BOUNCE_FACTORS.items()), F.lit(0))
        market = F.when(~C("favorable"), tilt).otherwise(1.0)
        return F.least(F.lit(24), F.floor(raw * C("liq_mult") * C("adr_mult") * F.coalesce(market, F.lit(1.0)) * C("vix_mult") * C("gap_mult") + 0.5)).cast("int")

    return x.select(*f.columns, "mask", total(0, 0.85).alias("buy_score"), total(1, 1.15).alias("sell_score"))


def bounce_verdict(s: DataFrame, blocked: Column | None = None) -> DataFrame:
    """Adds ``verdict`` and ``tier``, then applies the conviction gates: BUY only for leaders, SELL only for laggards."""
    b, q, block = C("buy_score") / 24, C("sell_score") / 24, F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    strong, moderate, weak = 0.75, 0.55, 0.30
    top = F.greatest(b, q)
    force_buy = F.coalesce((C("rsi2") <= 5) | (C("pctb") <= 0), C("rsi2") <= 5, C("pctb") <= 0, F.lit(False))
    force_sell = F.coalesce((C("rsi2") >= 95) | (C("pctb") >= 1), C("rsi2") >= 95, C("pctb") >= 1, F.lit(False))
    call = (
        F.when(block, "BLOCKED.").when(b >= strong, "BUY.strong").when(b >= moderate, "BUY.moderate").when(q >= strong, "SELL.strong").when(q >= moderate, "SELL.moderate")
        .when(top >= weak, F.when(b == q, "NEUTRAL.").when(b > q, "BUY.weak").otherwise("SELL.weak"))
        .when(force_buy & (b >= q), "BUY.weak").when(force_sell & (q >= b), "SELL.weak").otherwise("NEUTRAL.")
    )
    raw = F.split_part(call, F.lit("."), F.lit(1))
    fails = ((raw == "BUY") & ~F.coalesce(C("rs_delta") >= 0, F.lit(False))) | ((raw == "SELL") & ~F.coalesce(C("rs_delta") <= 0, F.lit(False)))
    tier = F.nullif(F.split_part(call, F.lit("."), F.lit(2)), F.lit(""))
    return s.select("*", F.when(fails, "NEUTRAL").otherwise(raw).alias("verdict"), F.when(~fails, tier).alias("tier"))


def stop_price(side: Column, price: Column, atr: Column, mult: float = 2.5) -> Column:
    """mult ATRs below a long's price, above a short's; null without a positive ATR."""
    level = F.when(side == "BUY", price - mult * atr).when(side == "SELL", price + mult * atr)
    return F.when((price > 0) & (atr > 0), F.round(level, 2))


def agreement(direction: Column) -> Column:
    keys = ("rsi", "pctb", "clx", "rev", "rs")
    lead = [F.coalesce(C(f"{k}_buy"), F.lit(0)) - F.coalesce(C(f"{k}_sell"), F.lit(0)) for k in keys]
    votes = lambda sign: sum(((x * sign > 0).cast("int") for x in lead), F.lit(0))
    return F.when(direction == "BUY", votes(1)).when(direction == "SELL", votes(-1)).otherwise(0)


def trend_points(sign: int = 1) -> Column:
    """3 for price over the 50-bar average by 8 % and that over the 200-bar one, 2 for the order alone, 1 for price alone."""
    p, a, b = C("close") * sign, C("sma50") * sign, C("sma200") * sign
    lead = F.try_divide(p - a, C("sma50"))
    return F.when(C("rn") >= 200, F.when((p > a) & (a > b) & (lead >= 0.08), 3).when((p > a) & (a > b), 2).when(p > a, 1).otherwise(0))


def near_high_points() -> Column:
    off = C("off_high")
    return F.when((off > 0.05) & (off <= 0.18), 3).when(off <= 0.05, 2).when(off <= 0.30, 1).otherwise(0)


def swing_core(ind: DataFrame, scale: Scale = Scale(), checked: bool = False) -> DataFrame:
    """Adds both sides' points of the six swing factors and their sums (0-18); rows before bar 200 get null points.

    ``ind`` needs ``sec_delta``, the sector's strength less the index's. ``checked`` applies the plausible ranges to the
    return and the relative volume first, as studies do; the replayed signal does not.
    """
    ready = C("rn") >= 200
    ret = in_range(C("ret63"), "ret3m") if checked else C("ret63")
    rv = in_range(C("rv"), "relvol") if checked else C("rv")
    up_day, down_day = C("close") > C("pc"), C("close") < C("pc")
    points = {
        "trend": (trend_points(1), trend_points(-1)),
        "mom": (up(ret, 0.0, 0.05, 0.15), down(ret, 0.0, -0.05, -0.15)),
        "near": (near_high_points(), down(C("off_low"), 0.30, 0.15, 0.05)),
        "liq": (up(C("adv"), scale.least, scale.good, scale.best),) * 2,
        "vol": tuple(F.when(rv.isNotNull(), surge(rv, up_day, down_day, C("flow10"), s)) for s in (1, -1)),
        "sec": (up(C("sec_delta"), -0.03, 0.08, 0.15), down(C("sec_delta"), 0.03, -0.08, -0.15)),
    }
    zero = lambda c: F.when(ready, F.coalesce(c, F.lit(0)))
    d = ind.select("*", *[zero(p[i]).alias(f"{k}_{s}") for k, p in points.items() for i, s in enumerate(("buy", "sell"))])
    total = lambda s: sum((C(f"{k}_{s}") for k in points), F.lit(0))
    return d.select("*", total("buy").alias("core"), total("sell").alias("core_short"), F.when(ready, (C("close") > C("sma50")) & (C("sma50") > C("sma200"))).alias("clean_uptrend"), F.when(ready, C("sma50") < C("sma200")).alias("death_cross"))


def entry_strong(score: int = 14, floor: float = 1e9, sector: int = 2, lead: float | None = 0.30) -> Column:
    """The swing entry gate; ``lead`` None leaves the relative-strength floor out."""
    gate = C("clean_uptrend") & (C("core") >= score) & (C("adv") >= floor) & (C("sec_buy") >= sector)
    return F.coalesce(gate if lead is None else gate & (C("rs126") >= lead), F.lit(False))


def weighted_core(weights: dict[str, float]) -> Column:
    """Core score with per-factor weights; factors that are not named weigh 1."""
    return sum((C(f"{k}_buy") * weights.get(k, 1.0) for k in ("trend", "mom", "near", "liq", "vol", "sec")), F.lit(0.0))
