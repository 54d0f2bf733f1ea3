"""Vector, burn, join, component, mesh and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import components, vector
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql
from gridspark.streaming import requests as live

Q, S = {}, {}
SIDE = 128
GRID = (SIDE, SIDE)
AREA_BOX = (39.961, 39.949, -75.138, -75.171)  # holds the city fixtures


def query(name: str, body: str | None):
    def keep(f):
        Q[name] = f
        if body is not None:
            S[name] = sql(body)
        return f

    return keep


def gx(x: str) -> str:
    return f"(({x} - -75.171::DOUBLE) / (-75.138::DOUBLE - -75.171::DOUBLE) * {SIDE})"


def gy(y: str) -> str:
    return f"((39.961::DOUBLE - {y}) / (39.961::DOUBLE - 39.949::DOUBLE) * {SIDE})"


HEIGHT = "round_even(least(greatest(coalesce(try_cast(height_tag AS DOUBLE), coalesce(try_cast(levels_tag AS DOUBLE), 3) * 4), 3), 300), 1)"


def houses(spark, sf):
    return X.buildings(spark, sf).withColumn("h", vector.fill_height(F.col("height_tag"), F.col("levels_tag")))


def house_segments(spark, sf, keep=("feature_id",)):
    b = vector.to_grid(houses(spark, sf), AREA_BOX, GRID, [("x0", "y0"), ("x1", "y1")])
    return vector.segments(b.withColumn("p", vector.ring("x0", "y0", "x1", "y1")), "p", list(keep))


@query("v1_segments", "SELECT reach_id, 0 AS seg, x1, y1, xm AS x2, ym AS y2 FROM riv UNION ALL SELECT reach_id, 1, xm, ym, x2, y2 FROM riv")
def _(spark, sf):
    r = X.rivers(spark, sf).withColumn("p", vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2")))
    return vector.segments(r, "p", ["reach_id"])


@query("v2_height_fill", f"SELECT feature_id, {HEIGHT} AS h FROM bld")
def _(spark, sf):
    return houses(spark, sf).select("feature_id", "h")


@query("v3_height_rules", "SELECT feature_id, " + s6("coalesce(try_cast(height_tag AS DOUBLE), try_cast(levels_tag AS DOUBLE) * 3.9, 10)") + " AS a, coalesce(try_cast(levels_tag AS DOUBLE) * 3, 10)::DOUBLE AS b FROM bld")
def _(spark, sf):
    t, n = F.col("height_tag").try_cast("double"), F.col("levels_tag").try_cast("double")
    return X.buildings(spark, sf).select("feature_id", r6(F.coalesce(t, n * 3.9, F.lit(10.0))).alias("a"), F.coalesce(n * 3, F.lit(10.0)).alias("b"))


@query("v4_collinear", "SELECT reach_id, CASE WHEN abs((xm - x1) * (y2 - y1) - (ym - y1) * (x2 - x1)) > 1e-4 THEN 3 ELSE 2 END AS n FROM riv")
def _(spark, sf):
    r = X.rivers(spark, sf).withColumn("p", vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2")))
    return r.select("reach_id", F.size(vector.drop_collinear("p")).alias("n"))


@query("v5_turns", "SELECT reach_id, CASE WHEN degrees(abs(atan2((x1 - xm) * (y2 - ym) - (y1 - ym) * (x2 - xm), (x1 - xm) * (x2 - xm) + (y1 - ym) * (y2 - ym)))) < 170.123 THEN 3 ELSE 2 END AS n FROM riv")
def _(spark, sf):
    r = X.rivers(spark, sf).withColumn("p", vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2")))
    return r.select("reach_id", F.size(vector.turn_removal("p", 170.123)).alias("n"))


SN = lambda c: f"round_even({c} / 0.7::DOUBLE, 0)"


@query("v6_snap", f"SELECT reach_id, 1 + ({SN('xm')} <> {SN('x1')} OR {SN('ym')} <> {SN('y1')})::INT + ({SN('x2')} <> {SN('xm')} OR {SN('y2')} <> {SN('ym')})::INT AS n FROM riv")
def _(spark, sf):
    r = X.rivers(spark, sf).withColumn("p", vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2")))
    return r.select("reach_id", F.size(vector.snap("p", 0.7)).alias("n"))


@query("v7_mercator_length", f"SELECT feature_id, round(sqrt(pow(radians(x2 - x1) * 6378137, 2) + pow((ln(tan(pi() / 4 + radians(y2) / 2)) - ln(tan(pi() / 4 + radians(y1) / 2))) * 6378137, 2)), 3) + 0::DOUBLE AS metres FROM road")
def _(spark, sf):
    (_, ya), (_, yb) = geo.mercator_xy(F.col("x1"), F.col("y1")), geo.mercator_xy(F.col("x2"), F.col("y2"))
    dx = F.radians(F.col("x2") - F.col("x1")) * geo.MERCATOR_R
    return X.roads(spark, sf).select("feature_id", (F.round(F.sqrt(dx * dx + (yb - ya) * (yb - ya)), 3) + F.lit(0.0)).alias("metres"))


BG = f", bg AS (SELECT feature_id, {HEIGHT} AS h, {gx('x0')} AS xa, {gx('x1')} AS xb, {gy('y1')} AS ya, {gy('y0')} AS yb FROM bld), bc AS (SELECT feature_id, h, r::INT AS row, c::INT AS col FROM bg, unnest(range(greatest(ceil(ya - 0.5), 0)::BIGINT, least(ceil(yb - 0.5), {SIDE})::BIGINT)) a(r), unnest(range(greatest(ceil(xa - 0.5), 0)::BIGINT, least(ceil(xb - 0.5), {SIDE})::BIGINT)) b(c))"


@query("v9_polygon_burn", BG + "SELECT feature_id, row, col FROM bc")
def _(spark, sf):
    return vector.burn_polygons(house_segments(spark, sf), GRID, ["feature_id"])


@query("v11_burn_reducers", BG + f"SELECT row, col, arg_max(h, feature_id) AS last, min(h) AS low, max(h) AS high, {s6('sum(h)')} AS total, count(*) AS n FROM bc GROUP BY 1, 2")
def _(spark, sf):
    c = vector.burn_polygons(house_segments(spark, sf, ("feature_id", "h")), GRID, ["feature_id", "h"])
    return c.groupBy("row", "col").agg(F.max_by("h", "feature_id").alias("last"), F.min("h").alias("low"), F.max("h").alias("high"), r6(F.sum("h")).alias("total"), F.count("*").alias("n"))


def near_sql(table: str, key: str, d: str) -> str:
    return f""", ln AS (SELECT {key} AS k, {gx('x1')} AS xa, {gy('y1')} AS ya, {gx('x2')} AS xb, {gy('y2')} AS yb, ({d})::DOUBLE AS d FROM {table}),
lc AS (SELECT *, r + 0.5 AS py, c + 0.5 AS px FROM ln, unnest(range(greatest(floor(least(ya, yb) - d - 1), 0)::BIGINT, least(ceil(greatest(ya, yb) + d + 1), {SIDE})::BIGINT)) a(r), unnest(range(greatest(floor(least(xa, xb) - d - 1), 0)::BIGINT, least(ceil(greatest(xa, xb) + d + 1), {SIDE})::BIGINT)) b(c)),
lt AS (SELECT *, least(1, greatest(0, coalesce(((px - xa) * (xb - xa) + (py - ya) * (yb - ya)) / nullif(pow(xb - xa, 2) + pow(yb - ya, 2), 0), 0))) AS t FROM lc)
, near AS (SELECT DISTINCT k, r::INT AS row, c::INT AS col FROM lt WHERE pow(px - xa - t * (xb - xa), 2) + pow(py - ya - t * (yb - ya), 2) <= d * d)"""


def road_segments(spark, sf):
    return vector.to_grid(X.roads(spark, sf), AREA_BOX, GRID, [("x1", "y1"), ("x2", "y2")])


@query("v8_line_burn", near_sql("road", "feature_id", "1.37") + "SELECT row, col, count(*) AS n, min(k) AS first FROM near GROUP BY 1, 2")
def _(spark, sf):
    return vector.burn_lines(road_segments(spark, sf), GRID, F.lit(1.37), ["feature_id"]).groupBy("row", "col").agg(F.count("*").alias("n"), F.min("feature_id").alias("first"))


@query("v12_city_bands", BG + near_sql("road", "feature_id", "0.73") + f"SELECT row, col, {s6('sum(b)')} AS buildings, max(r)::INT AS roads FROM (SELECT row, col, h AS b, 0 AS r FROM bc UNION ALL SELECT row, col, 0, 1 FROM near) GROUP BY 1, 2")
def _(spark, sf):
    b = vector.burn_polygons(house_segments(spark, sf, ("feature_id", "h")), GRID, ["feature_id", "h"]).select("row", "col", F.col("h").alias("b"), F.lit(0).alias("r"))
    r = vector.burn_lines(road_segments(spark, sf), GRID, F.lit(0.73), []).select("row", "col", F.lit(0.0), F.lit(1))
    return b.union(r).groupBy("row", "col").agg(r6(F.sum("b")).alias("buildings"), F.max("r").alias("roads"))


@query("v13_city_height", BG + near_sql("road", "feature_id", "0.73") + "SELECT row, col, coalesce(max(h), -0.5)::DOUBLE AS height FROM (SELECT row, col, h FROM bc UNION ALL SELECT row, col, NULL FROM near) GROUP BY 1, 2")
def _(spark, sf):
    b = vector.burn_polygons(house_segments(spark, sf, ("feature_id", "h")), GRID, ["feature_id", "h"]).select("row", "col", "h")
    r = vector.burn_lines(road_segments(spark, sf), GRID, F.lit(0.73), []).select("row", "col", F.lit(None).cast("double"))
    return b.union(r).groupBy("row", "col").agg(F.coalesce(F.max("h"), F.lit(-0.5)).alias("height"))


@query("v14_line_embedding", f", s AS (SELECT feature_id, {gx('x1')} AS xa, {gy('y1')} AS ya, {gx('x2')} AS xb, {gy('y2')} AS yb FROM road), n AS (SELECT *, trunc(greatest(abs(xb - xa), abs(yb - ya)))::BIGINT AS n FROM s) SELECT DISTINCT feature_id, round_even(ya + t / greatest(n, 1)::DOUBLE * (yb - ya), 0)::INT AS row, round_even(xa + t / greatest(n, 1)::DOUBLE * (xb - xa), 0)::INT AS col FROM n, unnest(range(0, n + 1)) u(t)")
def _(spark, sf):
    return vector.embed_lines(road_segments(spark, sf), ["feature_id"])


@query("e3_hydrology_burn", f", w AS (SELECT reach_id, ord_stra, (x1 + 180) / 360 * 128 AS xa, (90 - y1) / 180 * 128 AS ya, (xm + 180) / 360 * 128 AS xb, (90 - ym) / 180 * 128 AS yb FROM riv WHERE ord_stra >= 3 UNION ALL SELECT reach_id, ord_stra, (xm + 180) / 360 * 128, (90 - ym) / 180 * 128, (x2 + 180) / 360 * 128, (90 - y2) / 180 * 128 FROM riv WHERE ord_stra >= 3), z AS (SELECT *, greatest(0.6, 0.6 * ord_stra / 3)::DOUBLE AS d FROM w), c AS (SELECT *, r + 0.5 AS py, k + 0.5 AS px FROM z, unnest(range(greatest(floor(least(ya, yb) - d - 1), 0)::BIGINT, least(ceil(greatest(ya, yb) + d + 1), 128)::BIGINT)) a(r), unnest(range(greatest(floor(least(xa, xb) - d - 1), 0)::BIGINT, least(ceil(greatest(xa, xb) + d + 1), 128)::BIGINT)) b(k)), t AS (SELECT *, least(1, greatest(0, coalesce(((px - xa) * (xb - xa) + (py - ya) * (yb - ya)) / nullif(pow(xb - xa, 2) + pow(yb - ya, 2), 0), 0))) AS t FROM c), q AS (SELECT r::INT AS row, k::INT AS col, ord_stra, sqrt(pow(px - xa - t * (xb - xa), 2) + pow(py - ya - t * (yb - ya), 2)) - d AS off FROM t), m AS (SELECT row, col, min(-5 * pow(ord_stra / 9::DOUBLE, 1.5)) AS v FROM q WHERE off <= 0 GROUP BY 1, 2) SELECT li.row, li.col, {s6('CASE WHEN v IS NULL THEN li.value ELSE least(li.value, v) END')} AS value FROM li LEFT JOIN m USING (row, col)")
def _(spark, sf):
    r = X.rivers(spark, sf).where("ord_stra >= 3").withColumn("p", vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2")))
    seg = vector.to_grid(vector.segments(r, "p", ["reach_id", "ord_stra"]), X.WORLD, GRID, [("x1", "y1"), ("x2", "y2")])
    bed = vector.burn_lines(seg, GRID, geo.river_buffer(1.0, F.col("ord_stra")), ["ord_stra"]).groupBy("row", "col").agg(F.min(geo.river_depth(-5.0, F.col("ord_stra"), 1.5)).alias("value"))
    from gridspark.operators import raster

    return raster.merge_rivers(X.li(spark, sf), bed).select("row", "col", r6("value").alias("value"))


@query("v10_points_in_polygons", "SELECT pid, feature_id FROM (SELECT pid, -75.17 + (lon + 180) / 360 * 0.03 AS x, 39.95 + (lat + 90) / 180 * 0.01 AS y FROM pts) p JOIN bld ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def _(spark, sf):
    p = X.points(spark, sf).select("pid", (F.lit(-75.17) + (F.col("lon") + 180) / 360 * 0.03).alias("x"), (F.lit(39.95) + (F.col("lat") + 90) / 180 * 0.01).alias("y"))
    seg = vector.segments(X.buildings(spark, sf).withColumn("p", vector.ring("x0", "y0", "x1", "y1")), "p", ["feature_id"])
    return vector.points_in_polygons(p, seg, "feature_id").select("pid", "feature_id")


@query("r23_mask_by_polygon", f"SELECT row, col, {s6('CASE WHEN col + 0.5 >= 20.2 AND col + 0.5 < 90.7 AND row + 0.5 >= 15.3 AND row + 0.5 < 70.9 THEN value ELSE -1 END')} AS value FROM li")
def _(spark, sf):
    one = X.li(spark, sf).agg(F.lit(20.2).alias("x0"), F.lit(15.3).alias("y0"), F.lit(90.7).alias("x1"), F.lit(70.9).alias("y1"), F.lit(1).alias("k"))
    inside = vector.burn_polygons(vector.segments(one.withColumn("p", vector.ring("x0", "y0", "x1", "y1")), "p", ["k"]), GRID, ["k"])
    return X.li(spark, sf).join(inside, ["row", "col"], "left").select("row", "col", r6(F.when(F.col("k").isNull(), F.lit(-1.0)).otherwise(F.col("value"))).alias("value"))


@query("v15_network_lines", "SELECT u, v, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM edg LEFT JOIN (SELECT o_orderkey AS k, 1 AS n FROM orders) a ON a.k = u LEFT JOIN (SELECT o_orderkey AS k, 1 AS n FROM orders) b ON b.k = v")
def _(spark, sf):
    n = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("n"))
    e = X.edges(spark, sf)
    j = e.join(n.select(F.col("k").alias("u"), F.col("n").alias("a")), "u", "left").join(n.select(F.col("k").alias("v"), F.col("n").alias("b")), "v", "left")
    return j.select("u", "v", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


@query("v16_piste_colours", "SELECT p_partkey, coalesce(c, 'gray') AS colour, coalesce(i, -1) AS idx FROM part LEFT JOIN (VALUES (0, 'green', 0), (1, 'blue', 1), (2, 'red', 2), (3, 'black', 3)) t(k, c, i) ON p_size % 6 = k")
def _(spark, sf):
    t = spark.createDataFrame([(0, "green", 0), (1, "blue", 1), (2, "red", 2), (3, "black", 3)], "k int, c string, i int")
    return X.table(spark, sf, "part").join(F.broadcast(t), F.col("p_size") % 6 == F.col("k"), "left").select("p_partkey", F.coalesce("c", F.lit("gray")).alias("colour"), F.coalesce("i", F.lit(-1)).alias("idx"))


@query("v17_water_exclusion", "SELECT feature_id FROM road WHERE highway IS NULL OR highway NOT IN ('service', 'primary')")
def _(spark, sf):
    return X.roads(spark, sf).where(F.coalesce(~F.col("highway").isin("service", "primary"), F.lit(True))).select("feature_id")


@query("v18_triangle_max", f", t AS (SELECT {gx('x0')} AS xa, {gy('y0')} AS ya, {gx('x1')} AS xb, {gy('y1')} AS yc, {HEIGHT} AS z FROM bld), c AS (SELECT *, r + 0.5 AS py, k + 0.5 AS px FROM t, unnest(range(greatest(floor(least(ya, yc) - 1), 0)::BIGINT, least(ceil(greatest(ya, yc) + 1), {SIDE})::BIGINT)) a(r), unnest(range(greatest(floor(xa - 1), 0)::BIGINT, least(ceil(xb + 1), {SIDE})::BIGINT)) b(k)), s AS (SELECT r, k, z, (xb - xa) * (py - ya) - 0 * (px - xa) AS s1, (xa - xb) * (py - ya) - (yc - ya) * (px - xb) AS s2, 0 * (py - yc) - (ya - yc) * (px - xa) AS s3 FROM c) SELECT r::INT AS row, k::INT AS col, max(z) AS value FROM s WHERE (s1 >= 0 AND s2 >= 0 AND s3 >= 0) OR (s1 <= 0 AND s2 <= 0 AND s3 <= 0) GROUP BY 1, 2")
def _(spark, sf):
    b = vector.to_grid(houses(spark, sf), AREA_BOX, GRID, [("x0", "y0"), ("x1", "y1")])
    t = b.select(F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("cy"), F.col("h").alias("z"))
    t = t.select(F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("ay").alias("y2"), F.col("ax").alias("x3"), F.col("cy").alias("y3"), "z")
    return vector.triangle_max(t, GRID)


@query("a11_feature_counts", "SELECT highway, count(*) AS n, sum(2) AS vertices FROM road GROUP BY highway")
def _(spark, sf):
    r = X.roads(spark, sf).withColumn("p", vector.line(("x1", "y1"), ("x2", "y2")))
    return r.groupBy("highway").agg(F.count("*").alias("n"), F.sum(F.size("p")).alias("vertices"))


@query("a12_feature_centroids", f"SELECT feature_id, {s6('(x0 + x1 + x1 + x0 + x0) / 5')} AS cx, {s6('(y0 + y0 + y1 + y1 + y0) / 5')} AS cy, {s6('x0')} AS west, {s6('x1')} AS east FROM bld")
def _(spark, sf):
    b = X.buildings(spark, sf).withColumn("p", vector.ring("x0", "y0", "x1", "y1"))
    mean = lambda c: F.aggregate("p", F.lit(0.0), lambda s, q: s + q[c]) / F.size("p")
    return b.select("feature_id", r6(mean("x")).alias("cx"), r6(mean("y")).alias("cy"), r6(F.array_min(F.transform("p", lambda q: q["x"]))).alias("west"), r6(F.array_max(F.transform("p", lambda q: q["x"]))).alias("east"))


@query("a13_centroid_extent", f"SELECT {s6('min(cx)')} AS west, {s6('max(cx)')} AS east, {s6('min(cy)')} AS south, {s6('max(cy)')} AS north FROM (SELECT (3 * x0 + 2 * x1) / 5 AS cx, (3 * y0 + 2 * y1) / 5 AS cy FROM bld)")
def _(spark, sf):
    cx, cy = (3 * F.col("x0") + 2 * F.col("x1")) / 5, (3 * F.col("y0") + 2 * F.col("y1")) / 5
    return X.buildings(spark, sf).agg(r6(F.min(cx)).alias("west"), r6(F.max(cx)).alias("east"), r6(F.min(cy)).alias("south"), r6(F.max(cy)).alias("north"))


@query("j1_box_intersections", "SELECT a.name AS a_name, b.name AS b_name, least(a.north, b.north) AS north, greatest(a.south, b.south) AS south, least(a.east, b.east) AS east, greatest(a.west, b.west) AS west FROM reg a, reg b WHERE least(a.north, b.north) > greatest(a.south, b.south) AND least(a.east, b.east) > greatest(a.west, b.west)")
def _(spark, sf):
    r = X.regions(spark, sf).select("name", "north", "south", "east", "west")
    return vector.box_intersections(r, r).select("a_name", "b_name", "north", "south", "east", "west")


SAMPLE = "least(greatest(round_even((90 - {lat}) / 180 * 127, 0), 0), 127)::INT AS row, least(greatest(round_even(({lon} + 180) / 360 * 127, 0), 0), 127)::INT AS col"


@query("j2_sample_points", f", p AS (SELECT pid, {SAMPLE.format(lat='lat', lon='lon')} FROM pts) SELECT pid, {s6('coalesce(value, 0)')} AS z FROM p LEFT JOIN li USING (row, col)")
def _(spark, sf):
    at = lambda x: F.least(F.greatest(F.bround(x, 0), F.lit(0.0)), F.lit(127.0)).cast("int")
    p = X.points(spark, sf).select("pid", at((90 - F.col("lat")) / 180 * 127).alias("row"), at((F.col("lon") + 180) / 360 * 127).alias("col"))
    return p.join(X.li(spark, sf), ["row", "col"], "left").select("pid", r6(F.coalesce("value", F.lit(0.0))).alias("z"))


@query("j3_building_z", f", p AS (SELECT feature_id, {HEIGHT} AS h, (feature_id % 128)::INT AS row, (feature_id // 128 % 128)::INT AS col FROM bld) SELECT feature_id, 0::DOUBLE AS z0, {s6('h + coalesce(value, 0) + 1')} AS z1 FROM p LEFT JOIN li USING (row, col)")
def _(spark, sf):
    p = houses(spark, sf).select("feature_id", "h", (F.col("feature_id") % 128).cast("int").alias("row"), (F.floor(F.col("feature_id") / 128) % 128).cast("int").alias("col"))
    return p.join(X.li(spark, sf), ["row", "col"], "left").select("feature_id", F.lit(0.0).alias("z0"), r6(F.col("h") + F.coalesce("value", F.lit(0.0)) + 1).alias("z1"))


@query("j5_touching_pairs", f", b AS (SELECT *, {HEIGHT} AS h FROM bld) SELECT a.feature_id AS u, b.feature_id AS v FROM b a JOIN b ON a.h = b.h AND a.feature_id < b.feature_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def _(spark, sf):
    return vector.overlapping_pairs(houses(spark, sf), "feature_id", "h")


@query("j10_viewport_cull", "SELECT reach_id FROM riv WHERE greatest(x1, xm, x2) >= 0 AND least(x1, xm, x2) <= 20 AND greatest(y1, ym, y2) >= 40 AND least(y1, ym, y2) <= 60")
def _(spark, sf):
    from gridspark.operators import scan

    return scan.within_box(scan.with_cover(X.rivers(spark, sf)), (60.0, 40.0, 20.0, 0.0)).select("reach_id")


@query("j11_mean_height", f", p AS (SELECT reach_id, unnest([x1, xm, x2]) AS lon, unnest([y1, ym, y2]) AS lat FROM riv), k AS (SELECT reach_id, {SAMPLE.format(lat='lat', lon='lon')} FROM p) SELECT reach_id, {s6('avg(coalesce(value, 0))')} AS z1 FROM k LEFT JOIN li USING (row, col) GROUP BY 1")
def _(spark, sf):
    p = X.rivers(spark, sf).select("reach_id", F.inline(vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2"))))
    at = lambda x: F.least(F.greatest(F.bround(x, 0), F.lit(0.0)), F.lit(127.0)).cast("int")
    k = p.select("reach_id", at((90 - F.col("y")) / 180 * 127).alias("row"), at((F.col("x") + 180) / 360 * 127).alias("col"))
    return k.join(X.li(spark, sf), ["row", "col"], "left").groupBy("reach_id").agg(r6(F.avg(F.coalesce("value", F.lit(0.0)))).alias("z1"))


def recursive(ctes: str, edges: str, nodes: str, tail: str) -> str:
    return ctes + f", ee AS (SELECT u, v FROM {edges} UNION ALL SELECT v, u FROM {edges}), rc AS (SELECT n AS a, n AS b FROM {nodes} UNION SELECT rc.a, ee.v FROM rc JOIN ee ON rc.b = ee.u), cc AS (SELECT a AS node, min(b) AS root FROM rc GROUP BY a) " + tail


@query("c1_dissolve_touching", recursive(f", b AS (SELECT *, {HEIGHT} AS h FROM bld), pr AS (SELECT a.feature_id AS u, b.feature_id AS v FROM b a JOIN b ON a.h = b.h AND a.feature_id < b.feature_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)", "pr", "(SELECT feature_id AS n FROM b)", "SELECT root, count(*) AS members, min(h) AS h FROM cc JOIN b ON feature_id = node GROUP BY root"))
def _(spark, sf):
    b = houses(spark, sf)
    pairs = vector.overlapping_links(b, "feature_id", "h").union(b.select("feature_id", "feature_id"))
    c = components.label(pairs)
    return c.join(b.select(F.col("feature_id").alias("node"), "h"), "node").groupBy("root").agg(F.count("*").alias("members"), F.min("h").alias("h"))


def land(spark, sf):
    return X.li(spark, sf).where("value > 30").select("row", "col")


LAND = ", la AS (SELECT row * 128 + col AS n, row, col FROM li WHERE value > 30), le AS (SELECT a.n AS u, b.n AS v FROM la a JOIN la b ON (b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1))"


def labelled(spark, sf):
    r = vector.runs(land(spark, sf))
    c = components.label(vector.run_links(r, SIDE))
    return r.join(c, (F.col("row").cast("long") * SIDE + F.col("first")) == F.col("node")).select("row", "first", "last", "n", "root")


@query("c2_remove_small_objects", recursive(LAND, "le", "la", "SELECT root::BIGINT AS root, count(*)::BIGINT AS area FROM cc GROUP BY root HAVING count(*) >= 5"))
def _(spark, sf):
    return labelled(spark, sf).groupBy("root").agg(F.sum("n").alias("area")).where("area >= 5")


@query("c3_mainland", recursive(LAND, "le", "la", "SELECT la.row, la.col FROM cc JOIN la ON la.n = node WHERE root = (SELECT root FROM cc GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)"))
def _(spark, sf):
    c = labelled(spark, sf)
    size = c.groupBy("root").agg(F.sum("n").alias("area"))
    top = size.agg(F.max_by("root", F.struct("area", -F.col("root"))).alias("root"))
    return c.join(F.broadcast(top), "root").select("row", F.explode(F.sequence("first", "last")).alias("col"))


@query("c4_long_river_chains", recursive("", "edg", "(SELECT u AS n FROM edg UNION SELECT v FROM edg)", "SELECT u, v FROM edg JOIN cc ON node = u WHERE root IN (SELECT root FROM cc GROUP BY root HAVING count(*) > 10)"))
def _(spark, sf):
    e = X.edges(spark, sf)
    c = components.label(e)
    big = c.groupBy("root").agg(F.count("*").alias("n")).where("n > 10")
    return e.join(c.join(big, "root", "left_semi").select(F.col("node").alias("u")), "u", "left_semi")


@query("c5_dissolve_by_height", f"SELECT {HEIGHT} AS h, count(*) AS members, {s6('sum((x1 - x0) * (y1 - y0)) * 1000000')} AS area FROM bld GROUP BY 1")
def _(spark, sf):
    return houses(spark, sf).groupBy("h").agg(F.count("*").alias("members"), r6(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) * 1000000).alias("area"))


@query("m1_surface_mesh", ", m AS (SELECT max(row) AS mr FROM emb) SELECT ((row * 63 + col) * 2 + k)::INT AS fid, CASE k WHEN 0 THEN row * 64 + col ELSE row * 64 + col + 1 END AS a, row * 64 + col + 64 AS b, CASE k WHEN 0 THEN row * 64 + col + 1 ELSE row * 64 + col + 65 END AS c FROM emb, range(2) t(k), m WHERE row < mr AND col < 63")
def _(spark, sf):
    n = X.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return vector.surface_faces((int(n), 64), X.emb(spark, sf))


@query("m2_m4_closed_solid", ", m AS (SELECT (max(row) + 1)::BIGINT AS h, 64 AS w FROM emb) SELECT 4 * (h - 1) * (w - 1) + 4 * (h - 1) + 4 * (w - 1) AS faces, 3 * (4 * (h - 1) * (w - 1) + 4 * (h - 1) + 4 * (w - 1)) // 2 AS edges, 0::BIGINT AS boundary, 0::BIGINT AS non_manifold, 0::BIGINT AS misdirected, true AS watertight FROM m")
def _(spark, sf):
    n = X.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    e = X.emb(spark, sf)
    return vector.mesh_health(vector.surface_faces((int(n), 64), e).select("a", "b", "c").union(vector.skirt_faces((int(n), 64), e)))


@query("m3_building_prisms", "SELECT feature_id, 8 AS walls, 2 AS roof, 2 AS floor, feature_id * 8 AS low, feature_id * 8 + 7 AS high FROM bld")
def _(spark, sf):
    f = vector.prism_faces(X.buildings(spark, sf), "feature_id")
    n = lambda part: F.count_if(F.col("part") == part).cast("int")
    return f.groupBy("feature_id").agg(n("wall").alias("walls"), n("roof").alias("roof"), n("floor").alias("floor"), F.min(F.least("a", "b", "c")).alias("low"), F.max(F.greatest("a", "b", "c")).alias("high"))


@query("m5_split_pieces", f", p AS (SELECT floor(((x0 + x1) / 2 - w) / (e - w + 1e-9) * 3)::INT AS px, floor(((y0 + y1) / 2 - s) / (n - s + 1e-9) * 2)::INT AS py FROM bld, (SELECT min(x0) AS w, max(x1) AS e, min(y0) AS s, max(y1) AS n FROM bld)) SELECT px, py, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, sf):
    b = X.buildings(spark, sf)
    box = b.agg(F.min("x0").alias("w"), F.max("x1").alias("e"), F.min("y0").alias("s"), F.max("y1").alias("n"))
    j = b.crossJoin(F.broadcast(box))
    at = lambda lo, hi, a, z, k: F.floor(((F.col(lo) + F.col(hi)) / 2 - F.col(a)) / (F.col(z) - F.col(a) + 1e-9) * k).cast("int")
    return j.groupBy(at("x0", "x1", "w", "e", 3).alias("px"), at("y0", "y1", "s", "n", 2).alias("py")).agg(F.count("*").alias("n"))


@query("m6_model_dimensions", f"SELECT name, 150::DOUBLE AS width_mm, {s6('150 / ((east - west) * cos(radians((north + south) / 2)) / (north - south))')} AS height_mm FROM reg")
def _(spark, sf):
    aspect = (F.col("east") - F.col("west")) * F.cos(F.radians((F.col("north") + F.col("south")) / 2)) / (F.col("north") - F.col("south"))
    return X.regions(spark, sf).select("name", F.lit(150.0).alias("width_mm"), r6(150 / aspect).alias("height_mm"))


@query("m7_mesh_offsets", "SELECT p_size AS mesh, count(*) * 8 AS vertices, (sum(count(*) * 8) OVER (ORDER BY p_size) - count(*) * 8)::BIGINT AS first_vertex FROM part GROUP BY p_size")
def _(spark, sf):
    from pyspark.sql import Window

    m = X.table(spark, sf, "part").groupBy(F.col("p_size").alias("mesh")).agg((F.count("*") * 8).alias("vertices"))
    return m.withColumn("first_vertex", F.sum("vertices").over(Window.orderBy("mesh")) - F.col("vertices"))  # one row a mesh


@query("t1_windowed_hits", "SELECT time_bucket(INTERVAL '1 hour', cached_at) AS start, count(*) AS requests, count(*) FILTER (hit) AS hits FROM req GROUP BY 1")
def _(spark, sf):
    return live.hits_by_window(X.requests(spark, sf), "1 hour")


@query("t2_first_requests", "SELECT key, namespace, min(cached_at) AS first FROM req GROUP BY 1, 2")
def _(spark, sf):
    return live.first_requests(X.requests(spark, sf)).select("key", "namespace", "first")


@query("t3_sessions", ", o AS (SELECT key, cached_at, CASE WHEN cached_at - lag(cached_at) OVER (PARTITION BY key ORDER BY cached_at) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM req), s AS (SELECT key, cached_at, sum(new) OVER (PARTITION BY key ORDER BY cached_at) AS k FROM o) SELECT key, min(cached_at) AS start, count(*) AS n FROM s GROUP BY key, k")
def _(spark, sf):
    return live.sessions(X.requests(spark, sf), "6 hours")


@query("t4_running_summary", f"SELECT namespace, count(*) AS n, {s6('min(size_bytes)')} AS lo, {s6('max(size_bytes)')} AS hi FROM req GROUP BY 1")
def _(spark, sf):
    return live.running_summary(X.requests(spark, sf)).select("namespace", "n", r6("lo").alias("lo"), r6("hi").alias("hi"))


