"""Row warnings: lists of large groups are spread over tasks, whatever Spark thinks of the small input."""

from pyspark.sql import functions as F

from candlefold.operators import hygiene


def test_lists_of_a_large_group_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hygiene, "TASK_CHARS", 100_000, raising=False)
    new = spark.range(1000).select(F.col("id").alias("sym"), F.when(F.col("id") < 500, "one").when(F.col("id") < 501, "alone").otherwise(F.concat(F.lit("n"), (F.col("id") % 5).cast("string"))).alias("name"), F.lit(10.0).alias("price"), F.lit(1).alias("score"))
    old = new.where("sym % 3 = 0").select("sym", (F.col("price") * F.when(F.col("sym") % 2 == 0, 2).otherwise(1)).alias("price"), (F.col("score") + F.col("sym") % 5).alias("score"))
    got = hygiene.row_warnings(old, new)
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(F.length(F.array_join("warnings", ""))).alias("chars")).collect()
    rows = {r.sym: list(r.warnings) for r in got.collect()}
    groups = {}
    for r in new.collect():
        groups.setdefault(r.name, []).append(r.sym)
    want = {}
    for syms in groups.values():
        for s in syms:
            known = s % 3 == 0
            want[s] = (["name:" + ",".join(map(str, syms))] if len(syms) > 1 else []) + (["price"] if known and s % 2 == 0 else []) + (["score"] if known and s % 5 >= 4 else [])
    assert rows == want
    assert max(t.chars for t in tasks) < sum(t.chars for t in tasks) / 3
