"""Ranked lists: diversified top-n, universe top-n, digests, search, set operations on symbol lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def diversified(df: DataFrame, order: tuple[Column, ...], n: int = 15, cap: int = 4, sector: str = "sector") -> DataFrame:
    """Best ``n`` rows with at most ``cap`` of a sector, filled up from the others: the capped go behind all within their cap.

    Only the best ``n`` rows of each sector can be picked, so the global sort sees those alone."""
    rank = F.row_number().over(Window.partitionBy(sector).orderBy(*order))
    d = df.withColumn("_r", rank).where(C("_r") <= n)
    return d.withColumn("_late", (C("_r") > cap).cast("int")).orderBy("_late", *order).limit(n).drop("_r", "_late")


def universe_top(losers: DataFrame, liquid: DataFrame, n: int) -> DataFrame:
    """Losers in feed order, then by money volume; each symbol once; ``n`` in all. Columns ``sym``, ``rank``."""
    a = losers.select("sym", F.lit(0).alias("_p"), C("feed_order").cast("double").alias("_o"))
    b = liquid.select("sym", F.lit(1).alias("_p"), (-C("money")).alias("_o"))
    one = a.unionByName(b).groupBy("sym").agg(F.min(F.struct("_p", "_o")).alias("k"))
    top = one.orderBy("k._p", "k._o", "sym").limit(n)
    return top.select("sym", F.row_number().over(Window.orderBy("k._p", "k._o", "sym")).alias("rank"))


def digest(df: DataFrame, side: str, order: tuple[Column, ...], n: int = 8) -> DataFrame:
    """The first ``n`` of each side with their rank and how many of that side are left out."""
    w = Window.partitionBy(side)
    return df.select("*", F.row_number().over(w.orderBy(*order)).alias("rank"), F.greatest(F.count("*").over(w) - n, F.lit(0)).alias("overflow")).where(C("rank") <= n)


def search(names: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """Per query: exact symbol 0, symbol prefix 1, name prefix 2, name holds it 3; ties by symbol; the first ``n``.

    An index of the names' pieces: of every length that a query has (``queries`` is a stated, short list), the prefix of the
    symbol and all pieces of the name, met by the query's text in an equi join; nothing is compared that does not match.
    """
    d = names.dropDuplicates(["ticker"]).where(~C("ticker").contains("."))
    lengths = sorted(r[0] for r in queries.where("query is not null").select(F.char_length("query")).distinct().collect())
    t, m = F.upper(C("ticker")), F.coalesce(F.upper(C("name")), F.lit(""))
    none = F.array().cast("array<string>")

    def cut(k: int) -> Column:
        return F.when(F.char_length(m) >= k, F.transform(F.sequence(F.lit(1), F.char_length(m) - k + 1), lambda i: m.substr(i, F.lit(k)))).otherwise(none)

    pieces = [F.array(F.substring(t, 1, k)) for k in lengths] + [cut(k) for k in lengths]
    index = d.select("ticker", "name", F.explode(F.array_distinct(F.concat(*pieces)) if pieces else none).alias("piece"))
    q = F.upper(C("query"))
    rank = F.when(t == q, 0).when(t.startswith(q), 1).when(m.startswith(q), 2).when(m.contains(q), 3)
    asked = F.broadcast(queries.withColumn("_q", q))  # a stated, short list
    hit = index.join(asked, C("piece") == C("_q")).select("query", "ticker", "name", rank.alias("match")).where("match is not null")
    w = Window.partitionBy("query").orderBy("match", "ticker")
    return hit.withColumn("rank", F.row_number().over(w)).where(C("rank") <= n)
