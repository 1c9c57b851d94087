"""Text chunking as rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key``, ``chunk_no``, ``chunk``: lines are packed into chunks of at most ``size`` characters, longer lines are cut.

    Within a text the running length decides: a chunk is a list of lines folded in one pass."""
    pieces = F.flatten(F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(line) - 1) / size), F.lit(0)).cast("int")), lambda i: F.struct(F.substring(line, i * size + 1, F.lit(size)).alias("t"), (i == 0).alias("new"))),
    ))
    start = F.struct(F.lit("").alias("now"), F.lit(False).alias("any"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(acc["now"], F.lit("\n"), p["t"])
        fits = acc["any"] & p["new"] & (F.length(joined) <= size)
        return F.struct(
            F.when(fits, joined).otherwise(p["t"]).alias("now"), F.lit(True).alias("any"), F.when(fits | ~acc["any"], acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))).alias("out")
        )

    all_ = F.aggregate(pieces, start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))
    return df.select(key, F.posexplode(all_).alias("chunk_no", "chunk"))
