"""The driver tables seen as grids, regions, features, reaches, roads and a request log; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORLD = (90.0, -90.0, 180.0, -180.0)  # north, south, east, west
STD = (40.0, 39.9, -75.1, -75.2)
CITY = (39.960, 39.950, -75.140, -75.170)
CLASSES = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> Column:
    """Rounded to six decimals for comparison. The cut lies beside the half, where neither exact values nor sums of either
    engine fall; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000000 + 0.4871).cast("double") / 1000000 + F.lit(0.0)


def s6(x: str) -> str:
    return f"(floor(({x})::DOUBLE * 1000000 + 0.4871::DOUBLE) / 1000000 + 0::DOUBLE)"


def emb(spark, sf) -> DataFrame:
    """A complete grid, 64 columns wide: cells(row, col, value)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return e.select("row", "col", F.round(F.col("e").cast("double") * 1000, 3).alias("value"))


def li(spark, sf) -> DataFrame:
    """A gappy 128 x 128 grid of the world."""
    x = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 128).cast("int").alias("row"), (F.col("l_partkey") % 128).cast("int").alias("col"))
    return x.agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / (F.count("*") * 10000) - 500).alias("value"))


def cover(spark, sf) -> DataFrame:
    """Land-cover classes on the same cells: cells(row, col, class_id)."""
    x = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 128).cast("int").alias("row"), (F.col("l_partkey") % 128).cast("int").alias("col"))
    return x.agg(F.element_at(F.array(*map(F.lit, CLASSES)), (F.min("l_suppkey") % 12 + 1).cast("int")).alias("class_id"))


def regions(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    west, south = (-180.0 + (k % 5) * 72.0), (-90.0 + F.floor(k / 5) * 36.0)
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("name"), F.col("r_name").alias("label"), F.least(south + 41.0, F.lit(90.0)).alias("north"), south.alias("south"),
        F.least(west + 82.0, F.lit(180.0)).alias("east"), west.alias("west"), (100 + k * 10).cast("int").alias("dim"), (k / 10.0).alias("depth_scale"), ((k % 12) / 10.0).alias("water_scale"), (k - 2.0).alias("height"),
    )


def buildings(spark, sf) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = -75.17 + (k % 40) * 0.00075, 39.95 + (F.floor(k / 40) % 40) * 0.00025
    return table(spark, sf, "part").select(
        k.alias("feature_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.0004 + (s % 5) * 0.0001).alias("x1"), (y0 + 0.00015 + (s % 3) * 0.00006).alias("y1"),
        F.when(k % 4 != 0, F.regexp_extract("p_brand", r"([0-9]+)", 1)).alias("height_tag"), F.when(s % 7 != 0, (s % 10 + 1).cast("string")).alias("levels_tag"),
    )


def rivers(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x1, y1 = -180.0 + (k * 37 % 3600) / 10.0, -90.0 + (c * 53 % 1800) / 10.0
    dx, dy = (k % 21 - 10) / 5.0, (c % 17 - 8) / 5.0
    return table(spark, sf, "orders").select(k.alias("reach_id"), (k % 9 + 1).cast("int").alias("ord_stra"), (F.col("o_totalprice") / 1000).alias("dis_av_cms"), x1.alias("x1"), y1.alias("y1"), (x1 + dx).alias("xm"), y1.alias("ym"), (x1 + 2 * dx).alias("x2"), (y1 + dy).alias("y2"))


def roads(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.create_map(*[F.lit(x) for p in (("AUTOMOBILE", "motorway"), ("BUILDING", "residential"), ("FURNITURE", "service"), ("MACHINERY", "primary")) for x in p])
    return table(spark, sf, "customer").select(
        k.alias("feature_id"), F.try_element_at(kind, F.col("c_mktsegment")).alias("highway"), (-75.17 + (k * 37 % 300) * 0.0001).alias("x1"), (39.95 + (k * 53 % 100) * 0.0001).alias("y1"),
        (-75.17 + (k * 71 % 300) * 0.0001).alias("x2"), (39.95 + (k * 29 % 100) * 0.0001).alias("y2"),
    )


def requests(spark, sf) -> DataFrame:
    space = F.create_map(*[F.lit(x) for p in (("view", "dem"), ("click", "water"), ("purchase", "satellite"), ("signup", "osm"), ("error", "composite")) for x in p])
    return table(spark, sf, "events").select(F.col("event_id"), F.try_element_at(space, F.col("event_type")).alias("namespace"), F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), (F.col("value") * 1000).cast("long").alias("size_bytes"), F.col("event_type").isin("view", "click").alias("hit"), F.col("props"))


def points(spark, sf) -> DataFrame:
    place = lambda k: [(-180.0 + (k * 7919 % 36000) / 100.0).alias("lon"), (-90.0 + (k * 104729 % 18000) / 100.0).alias("lat")]
    a = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("pid"), *place(F.col("c_custkey")))
    return a.union(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), *place(F.col("s_suppkey"))))


def edges(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("u"), (F.col("o_orderkey") + 1).alias("v"))


FIX = f"""
WITH RECURSIVE emb AS (SELECT vec_id::INT AS row, (i - 1)::INT AS col, round(embedding[i]::DOUBLE * 1000, 3) AS value FROM embeddings, range(1, 65) t(i)),
li AS (SELECT (l_orderkey % 128)::INT AS row, (l_partkey % 128)::INT AS col, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (count(*) * 10000) - 500 AS value FROM lineitem GROUP BY 1, 2),
cover AS (SELECT (l_orderkey % 128)::INT AS row, (l_partkey % 128)::INT AS col, {list(CLASSES)}[(min(l_suppkey) % 12 + 1)::INT]::INT AS class_id FROM lineitem GROUP BY 1, 2),
reg AS (SELECT n_name AS name, r_name AS label, least(-90::DOUBLE + (n_nationkey // 5) * 36 + 41, 90::DOUBLE) AS north, -90::DOUBLE + (n_nationkey // 5) * 36 AS south,
        least(-180::DOUBLE + (n_nationkey % 5) * 72 + 82, 180::DOUBLE) AS east, -180::DOUBLE + (n_nationkey % 5) * 72 AS west, 100 + n_nationkey * 10 AS dim, n_nationkey / 10::DOUBLE AS depth_scale,
        (n_nationkey % 12) / 10::DOUBLE AS water_scale, n_nationkey - 2::DOUBLE AS height FROM nation JOIN region ON n_regionkey = r_regionkey),
bld0 AS (SELECT p_partkey AS feature_id, p_size AS s, -75.17::DOUBLE + (p_partkey % 40) * 0.00075::DOUBLE AS x0, 39.95::DOUBLE + ((p_partkey // 40) % 40) * 0.00025::DOUBLE AS y0,
        CASE WHEN p_partkey % 4 <> 0 THEN regexp_extract(p_brand, '([0-9]+)', 1) END AS height_tag, CASE WHEN p_size % 7 <> 0 THEN (p_size % 10 + 1)::VARCHAR END AS levels_tag FROM part),
bld AS (SELECT feature_id, x0, y0, x0 + 0.0004::DOUBLE + (s % 5) * 0.0001::DOUBLE AS x1, y0 + 0.00015::DOUBLE + (s % 3) * 0.00006::DOUBLE AS y1, height_tag, levels_tag FROM bld0),
riv0 AS (SELECT o_orderkey AS reach_id, (o_orderkey % 9 + 1)::INT AS ord_stra, o_totalprice / 1000 AS dis_av_cms, -180::DOUBLE + (o_orderkey * 37 % 3600) / 10::DOUBLE AS x1, -90::DOUBLE + (o_custkey * 53 % 1800) / 10::DOUBLE AS y1,
        (o_orderkey % 21 - 10) / 5::DOUBLE AS dx, (o_custkey % 17 - 8) / 5::DOUBLE AS dy FROM orders),
riv AS (SELECT reach_id, ord_stra, dis_av_cms, x1, y1, x1 + dx AS xm, y1 AS ym, x1 + 2 * dx AS x2, y1 + dy AS y2 FROM riv0),
road AS (SELECT c_custkey AS feature_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'motorway' WHEN 'BUILDING' THEN 'residential' WHEN 'FURNITURE' THEN 'service' WHEN 'MACHINERY' THEN 'primary' END AS highway,
        -75.17::DOUBLE + (c_custkey * 37 % 300) * 0.0001::DOUBLE AS x1, 39.95::DOUBLE + (c_custkey * 53 % 100) * 0.0001::DOUBLE AS y1, -75.17::DOUBLE + (c_custkey * 71 % 300) * 0.0001::DOUBLE AS x2, 39.95::DOUBLE + (c_custkey * 29 % 100) * 0.0001::DOUBLE AS y2 FROM customer),
req AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'dem' WHEN 'click' THEN 'water' WHEN 'purchase' THEN 'satellite' WHEN 'signup' THEN 'osm' WHEN 'error' THEN 'composite' END AS namespace, user_id AS key, ts AS cached_at,
        trunc(value * 1000)::BIGINT AS size_bytes, event_type IN ('view', 'click') AS hit, props FROM events),
pts AS (SELECT 'c' || c_custkey AS pid, -180::DOUBLE + (c_custkey * 7919 % 36000) / 100::DOUBLE AS lon, -90::DOUBLE + (c_custkey * 104729 % 18000) / 100::DOUBLE AS lat FROM customer
        UNION ALL SELECT 's' || s_suppkey, -180::DOUBLE + (s_suppkey * 7919 % 36000) / 100::DOUBLE, -90::DOUBLE + (s_suppkey * 104729 % 18000) / 100::DOUBLE FROM supplier),
edg AS (SELECT o_orderkey AS u, o_orderkey + 1 AS v FROM orders WHERE o_custkey % 5 <> 0)
"""


def sql(body: str) -> str:
    """body over the fixtures; it may begin with further CTEs (', x AS (...) SELECT ...')."""
    return FIX + body




def tall(spark, sf) -> DataFrame:
    """A gappy grid 64 columns wide whose rows grow with the orders: cells(row, col, value)."""
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"))
    return x.agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / (F.count("*") * 10000) - 500).alias("value"))


TALL = ", tall AS (SELECT l_orderkey::INT AS row, (l_partkey % 64)::INT AS col, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (count(*) * 10000) - 500 AS value FROM lineitem GROUP BY 1, 2)"
