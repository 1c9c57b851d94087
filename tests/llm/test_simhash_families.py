"""Families of near fingerprints: what is written stays linear in their size, components stay exact."""

import random

import pytest
from pyspark.sql import functions as F

from candlefold.llm import simhash
from candlefold.llm.common import connected_components, ship_package, stored


def family(n, seed):
    """A centre and n members at one to three flipped bits."""
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) <= n:
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    return [v - (1 << 64) if v >> 63 else v for v in out]


def left_apart(spark, values):
    """Roots and pairs that are written after the leaders' stars and the rounds."""
    ship_package(spark)
    fps = stored(spark.createDataFrame([(v,) for v in values], "fp long"), "test-fps")
    first = connected_components(simhash.leader_links(fps), "a", "b", "test-cc")
    apart = stored(fps.join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "test-apart")
    done = simhash.contracted(apart)
    return done.select("root").distinct().count(), simhash.links(done).count()


def test_pairs_of_a_family_grow_with_its_members(spark):
    for n in (1000, 4000):
        roots, pairs = left_apart(spark, family(n, n))
        assert pairs <= 2 * n, (n, roots, pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_keep_components(spark, seed):
    rng = random.Random(seed)
    values = list({v for k in range(6) for v in family(rng.randrange(2, 120), 100 * seed + k)})
    ship_package(spark)
    docs = stored(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long"), "test-docs")
    got = {r.fp: r.component_id for r in simhash._labels(docs, 8192).collect()}
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if ((a ^ values[j]) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert got == {v: find(i) for i, v in enumerate(values)}
