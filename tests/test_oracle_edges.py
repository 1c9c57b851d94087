"""Queries against the tails of their SQL, on hand-made rows that leave ties and constants."""

import duckdb

from candlefold.plans import ORACLE_SQL, QUERIES, stat_queries

KEYS = stat_queries.KEYS


def _both(spark, monkeypatch, name, rows, schema, cut):
    """Rows of the query and of what follows ``f`` in its SQL, over ``rows`` as swing bars."""
    monkeypatch.setattr(stat_queries, "fwd", lambda s, d: spark.createDataFrame(rows, schema))
    con = duckdb.connect()
    con.register("f", spark.createDataFrame(rows, schema).toArrow())
    tail = ORACLE_SQL[name].split(cut, 1)[1]
    return sorted(map(tuple, QUERIES[name](spark, "").collect())), sorted(con.execute(f"WITH {cut}{tail}").fetchall())


def test_transfer_leaves_out_sectors_without_variance(spark, monkeypatch):
    schema = "sector string, fwd double, " + ", ".join(f"{k}_buy int" for k in KEYS)
    flat = [("A", float(i), *[3] * len(KEYS)) for i in range(4)]
    rising = [("B", float(i), *[i] * len(KEYS)) for i in range(4)]
    still = [("C", 1.5, *[i] * len(KEYS)) for i in range(4)]
    got, want = _both(spark, monkeypatch, "f30_transfer", flat + rising + still, schema, "lf AS (")
    assert got == want == sorted((k, 1.0, 1, 0) for k in KEYS)


def test_nearest_floor_of_several_is_the_smallest(spark, monkeypatch):
    rows = [(adv, float(i)) for i, adv in enumerate((250e3, 250e3, 100e3, 90e3))]
    got, want = _both(spark, monkeypatch, "f31_f32_sweep_matched_n", rows, "adv double, fwd double", "t AS (SELECT unnest")
    assert got == want
    assert [(floor, n, nearest) for floor, n, _, nearest in got] == [(f, 4 if f <= 80000 else 2, f == 0) for f in (0, 40000, 80000, 120000, 160000, 200000)]
    assert "ORDER BY abs(n - 10000), floor" in ORACLE_SQL["f31_f32_sweep_matched_n"]  # arg_min leaves ties to chance
