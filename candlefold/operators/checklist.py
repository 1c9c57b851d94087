"""Fundamental points and the eight-point checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlefold.functions.scalars import in_range, up

C = F.col


def inputs(statements: DataFrame) -> DataFrame:
    """Per symbol and quarter from the fourth on: four-quarter sums, growth by quarter and by year, divergence of the two."""
    w = Window.partitionBy("sym").orderBy("period_end")
    four = w.rowsBetween(-3, 0)
    a = statements.select(
        "*", F.row_number().over(w).alias("k"), F.sum("revenue").over(four).alias("ttm"), F.count("*").over(four).alias("nq"), F.lag("revenue", 4).over(w).alias("y_ago"), F.sum("n_orders").over(four).alias("orders_ttm")
    )
    b = a.select("*", F.lag("ttm", 4).over(w).alias("ttm_ago"))
    q, y = C("revenue") / C("y_ago") - 1, C("ttm") / C("ttm_ago") - 1
    return b.where("k >= 4").select(
        "*", in_range(q, "revenueGrowth").alias("growth_q"), F.when(C("nq") == 4, in_range(y, "revenueGrowth")).alias("growth_ttm"), F.coalesce(F.abs(q - y) > 0.5, F.lit(False)).alias("diverges")
    )


def leverage(net_debt: Column, ebitda: Column) -> Column:
    x = net_debt / ebitda
    return F.when(ebitda <= 0, F.when(net_debt > 0, 0).otherwise(3)).when(x < 1, 3).when(x < 3, 2).when(x < 5, 1).otherwise(0)


def valuation(pe: Column, p75: Column) -> Column:
    return F.when(pe <= p75 * 0.75, 3).when(pe <= p75, 2).when(pe <= p75 * 1.5, 1).otherwise(0)


def quality(fcf: Column, roe: Column, median: Column) -> Column:
    good, fair = fcf > 0, roe > median
    return F.when(good & (roe > median * 1.5), 3).when(good & fair, 2).when(good | fair, 1).otherwise(0)


def revisions(composite: Column) -> Column:
    return F.when(composite >= 0.05, 3).when(composite >= 0, 2).when(composite >= -0.05, 1).otherwise(0)


def catalyst(days: Column, beats: Column, least: int = 7, most: int = 90) -> Column:
    return F.when(days.isNotNull(), F.when((days < least) | (days > most), 0).when(beats >= 3, 3).when(beats >= 1, 2).otherwise(1))


def debt_ok(ratio: Column, capital_intensive: Column, regulated: Column, cash_flow: Column, limit: float = 1.0) -> Column:
    return F.when(regulated, True).when(capital_intensive, (ratio < 1.5) & cash_flow).otherwise(ratio < limit)


def differs(primary: Column, other: Column, share: float = 0.05) -> Column:
    return F.coalesce(F.abs(primary / other - 1) > share, F.lit(False))


POINTS = ("revenue_ok", "margin_ok", "contract_ok", "debt_ok", "departures_ok", "forecast_ok", "disruption_ok", "insider_ok")


def score(rows: DataFrame) -> DataFrame:
    """Adds ``good`` (0-8), ``signed_score`` (an insider purchase adds one and flips the sign) and ``colour``."""
    good = sum((C(p).cast("int") for p in POINTS), F.lit(0))
    d = rows.withColumn("good", good)
    with_buy = F.least(F.lit(8), C("good") + C("insider_buy").cast("int"))
    colour = F.when(with_buy >= 7, "green").when(with_buy >= 5, "yellow").otherwise("red")
    return d.select("*", F.when(C("insider_buy"), -with_buy).otherwise(C("good")).alias("signed_score"), colour.alias("colour"))


def insider_facts(tx: DataFrame, as_of: Column, sold_since: str, bought_since: str, days: int) -> DataFrame:
    """``insider_ok``: no late sale and no net selling over the window; ``insider_buy``: a late purchase."""
    late = C("date") > F.date_sub(as_of, days)
    signed = F.when(C("type") == "S", C("value_usd")).when(C("type") == "P", -C("value_usd")).otherwise(0.0)
    g = tx.groupBy("sym").agg(F.max(F.when(C("type") == "P", C("date"))).alias("b"), F.max(F.when(C("type") == "S", C("date"))).alias("s"), F.sum(F.when(late, signed)).alias("net"))
    bad = F.coalesce((C("s") >= F.lit(sold_since).cast("date")) | (C("net") > 0), C("s") >= F.lit(sold_since).cast("date"), C("net") > 0, F.lit(False))
    return g.select("sym", (~bad).alias("insider_ok"), F.coalesce(C("b") >= F.lit(bought_since).cast("date"), F.lit(False)).alias("insider_buy"))


#: Statement factors of the fundamental block with their cuts for 1, 2 and 3 points.
BLOCK = {"growth_q": (0.0, 0.05, 0.15), "growth_ttm": (0.0, 0.03, 0.10), "pace": (0.9, 1.0, 1.1), "order_value": (0.98, 1.0, 1.02)}


def block_inputs(statements: DataFrame) -> DataFrame:
    """Per symbol and statement: growth by quarter and by year, the quarter's revenue against the mean of the last four, and
    its revenue an order against theirs; null where the history is too short."""
    w = Window.partitionBy("sym").orderBy("period_end")
    four = w.rowsBetween(-3, 0)
    full = F.count("*").over(four) == 4
    a = statements.select("*", F.when(full, F.sum("revenue").over(four)).alias("ttm"), F.when(full, F.sum("n_orders").over(four)).alias("orders"), F.lag("revenue", 4).over(w).alias("y_ago"))
    b = a.select("*", F.lag("ttm", 4).over(w).alias("ttm_ago"))
    return b.select(
        "sym", "period_end", "accepted_date", (C("revenue") / C("y_ago") - 1).alias("growth_q"), (C("ttm") / C("ttm_ago") - 1).alias("growth_ttm"), (C("revenue") * 4 / C("ttm")).alias("pace"),
        F.try_divide(C("revenue") / C("n_orders"), C("ttm") / C("orders")).alias("order_value"),
    )


def block_points(rows: DataFrame, least: int = 3) -> DataFrame:
    """Adds ``points``, the sum over the block's factors that are present, null if fewer than ``least`` are."""
    each = {k: up(C(k), *cuts) for k, cuts in BLOCK.items()}
    present = sum((p.isNotNull().cast("int") for p in each.values()), F.lit(0))
    return rows.withColumn("points", F.when(present >= least, sum((F.coalesce(p, F.lit(0)) for p in each.values()), F.lit(0))))


def labels(rows: DataFrame) -> DataFrame:
    """Text columns: against the sector's mean, forward against trailing, trend arrow, month."""
    a, b = C("ttm") / C("ttm_ago"), C("revenue") / C("y_ago")
    d = rows.select("*", a.alias("a"), b.alias("b"), F.avg(a).over(Window.partitionBy("period_end")).alias("m"))
    rel = C("a") / C("m") - 1
    return d.select(
        "*", (rel * 100).alias("vs_sector_pct"), F.when(rel <= -0.1, "green").when(rel <= 0.1, "yellow").otherwise("red").alias("colour"),
        F.when(C("b") < C("a") * 0.95, "improving").when(C("b") > C("a") * 1.05, "worsening").otherwise("flat").alias("forward_vs_ttm"),
        F.when(C("b") > 1.05, "up").when(C("b") < 0.95, "down").otherwise("side").alias("arrow"), F.date_format("period_end", "MMM yyyy").alias("catalyst_month"),
    )


def fixture_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist over the tables: orders give the figures, returned lines the insiders, nation keys the label table."""
    from candlefold.sources import tables

    newest = Window.partitionBy("sym").orderBy(F.desc("period_end"))
    x = inputs(tables.statements(spark, sf_dir)).where("k >= 8").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    tx = tables.insiders(spark, sf_dir)
    end = tx.agg(F.max("date").alias("_end"))
    facts = insider_facts(tx.crossJoin(F.broadcast(end)), C("_end"), "2001-10-01", "2001-11-01", 2200)  # one row
    k = C("nationkey")
    lab = tables.places_of(spark, sf_dir).select("sym", (k % 3 != 0).alias("contract_ok"), (k % 4 != 0).alias("departures_ok"), (k % 5 != 0).alias("disruption_ok"))
    j = x.join(facts, "sym").join(F.broadcast(lab), "sym")
    return score(j.select(
        "sym", (C("revenue") > C("y_ago")).alias("revenue_ok"), (C("ttm") > C("ttm_ago")).alias("margin_ok"), "contract_ok", (C("ttm") * 0.1 < C("orders_ttm") * 3000).alias("debt_ok"), "departures_ok",
        (C("revenue") > 0.9 * C("ttm") / 4).alias("forecast_ok"), "disruption_ok", "insider_ok", "insider_buy",
    ))

