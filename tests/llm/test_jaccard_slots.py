"""Slots of the Jaccard join: hot or not, the same rows are crowded and the same texts lead."""

from pyspark.sql import functions as F

from candlefold.llm import jaccard


def _now(spark, hot):
    x = spark.range(600).select((F.col("id") % 40).alias("slot"), (F.col("id") * 7919 % 601).alias("t"), F.floor(F.col("id") / 40).alias("n"), (F.col("id") % 5 + 1).alias("at"))
    root = F.when(F.col("slot") % 4 == 0, F.col("slot")).otherwise(F.col("n") % 3)  # every fourth slot is one component
    return x.withColumns({"hot": F.lit(hot).cast("long"), "root": root, "links": (F.col("t") % 4).cast("long")})


def test_hot_slots_give_the_same_rows_and_leads(spark):
    cols = ("slot", "t", "n", "at", "root", "links", "held")
    found = [jaccard._crowded(_now(spark, hot)) for hot in (0, 1)]
    rows = [sorted(map(tuple, x.select(*cols).collect())) for x in found]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {s for s in range(40) if s % 4} and {r[-1] for r in rows[0]} == {15}
    for k in (1, 8):
        leads = [sorted(map(tuple, jaccard._leads(x, k).select("slot", "t").collect())) for x in found]
        assert leads[0] == leads[1] and len(leads[0]) == 30 * k
