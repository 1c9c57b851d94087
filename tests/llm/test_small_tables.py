"""Small tables: what few rows need is not multiplied by the number of shuffle partitions, and both ways give the same."""

import random

import pytest

from candlefold.llm import common, simhash
from candlefold.llm.common import connected_components, ship_package, stored
from tests.llm.test_simhash_families import family

MANY = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many(spark):
    before = {k: spark.conf.get(k) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield int(MANY["spark.sql.shuffle.partitions"])
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks(spark, run):
    """What ``run`` gives, and the tasks that its jobs ran."""
    sc, group = spark.sparkContext, f"tasks-{random.random()}"
    sc.setJobGroup(group, group)
    out = run()
    sc.setJobGroup("rest", "rest")
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := seen.getStageInfo(s)))


def test_a_small_graph_is_walked_without_exchanges(spark, many):
    edges = stored(spark.createDataFrame([(i, i + 1) for i in range(1, 80)] + [(500, 500 + i) for i in range(1, 30)], "a long, b long"), "test-edges")
    got, n = tasks(spark, lambda: {r.node: r.root for r in connected_components(edges, "a", "b", "test-cc").collect()})
    assert got == {i: 1 for i in range(1, 81)} | {500 + i: 500 for i in range(30)}
    assert n < 2 * many, n


def test_tasks_of_labels_with_many_partitions(spark, many):
    ship_package(spark)
    docs = stored(spark.createDataFrame(list(enumerate(family(300, 3) + family(40, 4))), "doc_id long, fp long"), "test-docs")
    got, n = tasks(spark, lambda: simhash._labels(docs, 8192).collect())
    assert len(got) == 342
    assert n < 25 * many, n


def test_large_tables_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    values = [v for k in range(4) for v in family(rng.randrange(20, 150), 50 + k)]
    rows = list(enumerate(values)) + [(0, values[-1]), (7, values[-1])]  # ids with several texts
    ship_package(spark)
    docs = stored(spark.createDataFrame(rows, "doc_id long, fp long"), "test-docs")
    small = sorted(simhash._labels(docs, 8192).collect())
    monkeypatch.setattr(common, "FEW", 0)
    assert sorted(simhash._labels(docs, 8192).collect()) == small
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "a long, b long")
    large = sorted(connected_components(edges, "a", "b").collect())
    monkeypatch.undo()
    assert sorted(connected_components(edges, "a", "b").collect()) == large
