"""What the corpus operators share: tables in the cluster's shared folder, word blocks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlefold.sources.shared import ship_package

#: A word is a maximal run of characters outside ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


#: Rows up to which a stored table of a few numbers a row counts as small (some MB).
FEW = 100_000

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A private one is made only where the setting is missing and the master is local, as in tests on one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor costs no earlier stage again), computes a table that is used several times
    once, and gives later joins the real size instead of an estimate. Within ``scratch`` the table goes at its end
    unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    made = _made.get()
    if made is not None and not keep:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(table: DataFrame) -> DataFrame:
    """A stored table as the right side of a join: broadcast if it is small, merged otherwise."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def gathered(table: DataFrame) -> DataFrame:
    """A stored table, read as one partition if it is small: aggregates and joins of such tables need no exchange.

    An exchange costs as many tasks as there are shuffle partitions, however few the rows; for a small table those tasks
    are all of the time.
    """
    return table.coalesce(1) if table.count() <= FEW else table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored meanwhile are deleted at the end: what is still needed then has to be stored with ``keep``."""
    token = _made.set(made := [])
    try:
        yield
    finally:
        _made.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in made:
            folder = hadoop.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes of text, so that a huge text needs little memory."""
    at, end = 0, len(text)
    while at < end:
        to = at + size
        if to >= end:
            to = end
        else:
            hit = _SPACE.search(text, to)
            to = hit.start() if hit else end
        if words := text[at:to].split():
            yield words
        at = to


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``root``, the smallest node that can be reached; one row per node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each round is joins and partial aggregates over
    the edges, never over pairs of a group; either step's result is written to the shared folder. No step makes more edges
    than it reads, so repeated ones are left until the end, and a small graph stays small: it is walked without exchanges.
    Rounds grow with the logarithm of the longest path; edges that are stars around their smallest nodes already need none.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), name)
    small = now.count() <= FEW
    one = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    deal = (lambda low: low.withColumnRenamed("u", "key").hint("merge")) if small else _dealt_anew
    now = one(now)
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = now.select(ways.alias("e")).select("e.*")
        low = deal(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = one(stored(both.hint("merge").join(low, F.col("u") == F.col("key")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), name))
        low = deal(large.groupBy("u").agg(F.min("v").alias("m")))
        met = large.hint("merge").join(low, F.col("u") == F.col("key"))
        # the edge to the smallest stays, every other one moves to it
        now = one(stored(met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), name))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))
    return now.select(ends.alias("e")).select("e.*").distinct()


def _dealt_anew(low: DataFrame) -> DataFrame:
    """``key`` and ``m`` for the ``u`` and ``m`` of an aggregate by ``u``, dealt out by the join itself.

    A join that found its rows dealt out by the aggregate could not split the centre of a large star over tasks.
    """
    return low.select(F.col("u").bitwiseXOR(F.lit(0)).alias("key"), "m").hint("merge")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` of the edges (``u`` > ``v``; they may repeat) has one ``v``, which is no ``u`` itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("to")), F.struct(F.col("v").alias("x"), F.col("v").alias("to")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.min("to").alias("least"), F.max("to").alias("most")).where("least < most").isEmpty()
