"""Near-dedup: texts that meet by chance only are told by their fingerprints, and open ones meet by their rarest shingles."""

import random

from pyspark.sql import functions as F

from candlefold.llm import simhash


def test_chance_meetings_make_no_sets(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(100_000)}" for _ in range(120)] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*texts[i][:-1], "other"])) for i in range(3)]
    made, stored = [], simhash.stored

    def counted(df, name, keep=False):
        out = stored(df, name, keep)
        if name == "near-shingles":
            made.append(out.count())
        return out

    # two slots for all, whatever the texts are: no copy meets its original in a slot of its own
    monkeypatch.setattr(simhash, "slots", lambda x: x.select(F.pmod("t", F.lit(2)).alias("slot"), "t", F.lit(False).alias("own")))
    monkeypatch.setattr(simhash, "stored", counted)
    found = {r.doc_id: r.root for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i % 100 for i, _ in rows}
    assert sum(made) == 6  # the three originals and their copies
