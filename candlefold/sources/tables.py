"""Bars, calendars and point-in-time tables as views over the star schema, and readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlefold.sources.shared import kept

BAR_SCHEMA = "sym string, sector string, date date, open double, high double, low double, close double, volume double"
#: Sessions of all symbols (some 60 bytes each) that are broadcast to their lines; a merge join beyond.
BROADCAST_SESSIONS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", last: int | None = None) -> DataFrame:
    """Bars from files of any Spark format; with ``last`` the newest so many sessions of each symbol."""
    bars = spark.read.schema(BAR_SCHEMA).format(fmt).load(path)
    return last_sessions(bars, last) if last else bars


def last_sessions(bars: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    newest = Window.partitionBy("sym").orderBy(F.desc("date"))
    return bars.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A study document (one JSON object with a map of symbol to bars) as bar rows."""
    bar = "struct<date:string,open:double,high:double,low:double,close:double,volume:double>"
    doc = spark.read.schema(f"histBySym map<string, array<{bar}>>").option("multiLine", True).json(path)
    each = doc.select(F.explode("histBySym").alias("sym", "bars")).select("sym", F.explode("bars").alias("b"))
    return each.select("sym", F.try_to_date("b.date").alias("date"), "b.open", "b.high", "b.low", "b.close", "b.volume")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    places = F.broadcast(places_of(spark, sf_dir))
    joined = line.join(supp, line.l_suppkey == supp.s_suppkey).join(places, F.col("s_nationkey") == F.col("nationkey"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return joined.select(
        "sym", "sector", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("q"), order.alias("k"), "l_returnflag", "l_extendedprice",
    )


def places_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations with their regions: a fixed list, so it may be broadcast."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("sym"), F.col("r_name").alias("sector")
    )


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that the panel is made from; the files themselves are not opened."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "supplier", "nation", "region")]
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "length")
    seen = files.coalesce(1).agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "modificationTime", "length")))
    return tuple(seen.first())


def _sessions(ticks: DataFrame) -> DataFrame:
    """``first`` and ``last`` (place and price), ``high``, ``low`` and ``volume`` of every symbol and session, in two passes over the lines.

    The least of structs is taken by a sort of all its rows. So a hash aggregation, whose memory grows with symbols x sessions alone,
    first finds each session's least and greatest order; only these orders' lines are compared by their whole place. Null orders
    come first, as they do in structs.
    """
    key, order = ("sym", "sector", "date"), F.col("k.l_orderkey")
    ends = kept(ticks.groupBy(*key).agg(
        F.when(F.count_if(order.isNull()) == 0, F.min(order)).alias("lo"), F.max(order).alias("hi"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("q").alias("volume")
    ))
    few = F.broadcast if ends.count() <= BROADCAST_SESSIONS else lambda x: x.hint("merge")
    of = ends.select(*[F.col(c).alias(f"_{c}") for c in key], "lo", "hi")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    some = ticks.join(few(of), same).where(order.eqNullSafe(F.col("lo")) | order.eqNullSafe(F.col("hi")))
    point = F.struct("k", "price")
    points = some.groupBy(*[F.col(f"_{c}") for c in key]).agg(F.min(point).alias("first"), F.max(point).alias("last"))
    return ends.hint("merge").join(points.hint("merge"), same).select(*key, "first", "last", "high", "low", "volume")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol and session with its first and last price, each with its place in the order of the lines.

    Lines are scanned once per application, folder and state of its files: the panel (symbols x sessions, however many lines)
    is a table in the shared folder, and sector and index bars roll it up.
    """
    known = spark.sparkContext.__dict__.setdefault("_candlefold_panels", {})
    key = (sf_dir, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.session.timeZone"), *_fingerprint(spark, sf_dir))
    if key not in known:
        done = kept(_sessions(_ticks(spark, sf_dir)))
        known[key] = (done.schema, done.inputFiles())
    schema, files = known[key]
    return spark.read.schema(schema).parquet(*files)


def _ohlc(sessions: DataFrame, *key: str) -> DataFrame:
    return sessions.groupBy(*key, "date").agg(
        F.min("first")["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last")["price"].alias("close"), F.sum("volume").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol (nation) and session (ship date); first and last price in a total order of the lines."""
    price = lambda c: F.col(f"{c}.price")
    return panel(spark, sf_dir).select("sym", "sector", "date", price("first").alias("open"), "high", "low", price("last").alias("close"), "volume")


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(panel(spark, sf_dir), "sector")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(panel(spark, sf_dir))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders' dates by the customer's nation stand for earnings dates."""
    return _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select("sym", F.to_date("o_orderdate").alias("date")).distinct()


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(cust, orders.o_custkey == cust.c_custkey).join(F.broadcast(places_of(spark, sf_dir)), F.col("c_nationkey") == F.col("nationkey"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue of each symbol's orders, published 45 days after the quarter's end."""
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
    sums = _orders(spark, sf_dir).groupBy("sym", quarter.alias("period_end")).agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n_orders"))
    return sums.withColumn("accepted_date", F.date_add("period_end", 45))


def insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("F")
    return _ticks(spark, sf_dir).select("sym", "date", kind.alias("type"), F.col("l_extendedprice").alias("value_usd"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("sym"), "ts", F.col("value").alias("price"), "user_id")


def display_name(sym: Column) -> Column:
    return F.initcap(sym)
