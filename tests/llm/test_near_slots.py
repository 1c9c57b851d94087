"""Near-dedup: table slots are made of few texts a task, however many texts a file holds."""

import random

from pyspark.sql import functions as F

from candlefold.llm import simhash


def test_a_task_makes_slots_of_few_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(100_000)}" for _ in range(80)] for _ in range(400)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*texts[i][:-1], "other"])) for i in range(5)]
    most, slots = [], simhash.slots

    def watched(x):
        most.append(x.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0])
        return slots(x)

    monkeypatch.setattr(simhash, "SLOT_TEXTS", 25, raising=False)
    monkeypatch.setattr(simhash, "slots", watched)
    found = {r.doc_id: r.root for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i % 1000 for i, _ in rows}
    assert len(most) == 2 and max(most) <= 50  # two of 25: what is dealt in turns ends unevenly
