"""Scales within a limit, the finest and the nearest one, against a loop over all pairs."""

import random

from pyspark.sql import functions as F

from gridspark.operators import registry
from gridspark.plans import catalog
from tests import oracle


def test_finest_and_nearest_like_the_loop_over_pairs(spark):
    """A frequent key beside ones with few scales far apart; null keys, limits and scales, scales that repeat, limits equal to a scale."""
    rnd = random.Random(4)
    keys = lambda: rnd.choice([1] * 5 + [2, rnd.randint(10, 60), rnd.randint(10, 60), None])
    want = [(i, keys(), None if i % 40 == 3 else rnd.randint(0, 900)) for i in range(1500)]
    have = [(keys(), None if i % 50 == 7 else rnd.randint(5, 1200)) for i in range(600)] + [(4, 1), (1, 5), (1, 5)]
    want.append((1500, 1, 5))
    expected = {}
    for i, k, limit in want:
        fit = [s for h, s in have if k is not None and h == k and s is not None and limit is not None and s <= limit]
        if fit:
            expected[i] = (k, min(fit), max(fit))
    assert sum(a < b for _, a, b in expected.values()) > 900
    found = registry.best_at_most(spark.createDataFrame(want, "i long, key long, limit long"), spark.createDataFrame(have, "key long, scale long"), "key", "limit", "scale", ["i"])
    assert {r["i"]: (r["key"], r["best"], r["nearest"]) for r in found.collect()} == expected
    window = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line)
    assert "[key#" in window and "__range#" in window.split("[key#")[-1]


def test_the_query_on_repeated_events_and_orders_like_its_sql(spark, sf, tmp_path):
    """An event that is there twice counts by its lesser size; an order that is there twice is one row."""
    events = [(1, 7, "purchase", 0.02), (2, 7, "purchase", 0.05), (2, 7, "purchase", 0.09), (3, 7, "view", 0.06), (4, 7, "purchase", 50.0), (5, 8, "purchase", 0.01), (5, 9, "purchase", 0.03), (6, None, "purchase", 0.01), (None, 7, "purchase", 0.07), (None, 7, "purchase", 0.08), (7, 9, "purchase", None)]
    orders = [(1, 7), (1, 9), (2, 8), (3, 9), (4, None), (None, 7), (619, 7), (5, 10)]  # limits 97, 97, 194, 291, 388, null, 43, 485
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").select("*", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = oracle.connect(sf)
    for t in ("events", "orders"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES["j8_best_resolution"](spark, str(tmp_path))
    oracle.same(df, catalog.ORACLE["j8_best_resolution"], con)
    assert {tuple(r) for r in df.select("o_orderkey", "best", "nearest").collect()} == {(1, 20, 70), (2, 10, 10), (3, 30, 30), (619, 20, 20)}
