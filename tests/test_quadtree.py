"""Joins on quadtree leaves against plain versions, and the spread of a crowded place over tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import quadtree, vector, zonal


def boxes(n, seed, crowd=0.9, size=0.5):
    rnd, out = random.Random(seed), []
    for k in range(n):
        x, y = (rnd.uniform(10, 10.5), rnd.uniform(20, 20.5)) if rnd.random() < crowd else (rnd.uniform(-170, 170), rnd.uniform(-80, 80))
        out.append((k, k % 3, x, x + rnd.random() * size, y, y + rnd.random() * size))
    return [*out, (n, 0, -180.0, 180.0, -90.0, 90.0), (n + 1, 1, 10.0, 10.0, 20.0, 20.0), (n + 2, 1, 10.0, 10.0, 20.0, 20.0)]


DDL = "id long, h int, x0 double, x1 double, y0 double, y1 double"


@pytest.mark.parametrize("most", [1, 8, 10_000])
def test_overlapping_pairs(spark, most):
    rows = boxes(150, 1, size=0.05)
    got = sorted(map(tuple, vector.overlapping_pairs(spark.createDataFrame(rows, DDL), "id", "h", most).collect()))
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5])
    assert got == want and want


def test_box_intersections_of_two_tables(spark):
    a, b = boxes(80, 2), boxes(60, 3)
    df = lambda rows: spark.createDataFrame([(r[0], r[5], r[4], r[3], r[2]) for r in rows], "name long, north double, south double, east double, west double")
    got = sorted((r.a_name, r.b_name, r.north, r.south, r.east, r.west) for r in vector.box_intersections(df(a), df(b), 4).collect())
    cut = lambda p, q: (min(p[5], q[5]), max(p[4], q[4]), min(p[3], q[3]), max(p[2], q[2]))
    want = sorted((p[0], q[0], *cut(p, q)) for p in a for q in b if cut(p, q)[0] > cut(p, q)[1] and cut(p, q)[2] > cut(p, q)[3])
    assert got == want


def inside(x, y, edges):
    n = 0
    for x1, y1, x2, y2 in edges:
        if (y1 <= y < y2 or y2 <= y < y1) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            n += 1
    return n % 2 == 1


@pytest.mark.parametrize("most", [3, 10_000])
def test_points_in_polygons_with_holes(spark, most):
    rnd = random.Random(4)
    ring = lambda cx, cy, r, n: [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    polygons = {k: [ring(rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.5, 4), rnd.randint(3, 12))] for k in range(12)}
    polygons[99] = [ring(5, 5, 4, 9), ring(5, 5, 2, 7), ring(20, 20, 1, 4)]
    edges = {k: [(*a, *b) for r in rs for a, b in zip(r, [*r[1:], r[0]], strict=True)] for k, rs in polygons.items()}
    pts = [(k, *((rnd.gauss(5, 0.3), rnd.gauss(5, 0.3)) if k % 2 else (rnd.uniform(-1, 21), rnd.uniform(-1, 21)))) for k in range(300)]
    seg = spark.createDataFrame([(k, *e) for k, es in edges.items() for e in es], "poly long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.pid, r.poly) for r in vector.points_in_polygons(spark.createDataFrame(pts, "pid long, x double, y double"), seg, "poly", most).collect())
    assert got == sorted((p, k) for p, x, y in pts for k, es in edges.items() if inside(x, y, es))


def test_polygons_with_holes_and_many_rings(spark):
    square = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    shapes = {
        1: [square(0, 0, 10, 10), square(2, 2, 8, 8)], 2: [square(3, 3, 7, 7)], 3: [square(1, 4, 5, 5)], 4: [square(0.5, 0.5, 1, 1)], 5: [square(20, 20, 21, 21), square(4, 4.5, 4.2, 4.7)], 6: [square(10, 10, 12, 12)], 7: [square(30, 30, 31, 31)],
    }
    df = spark.createDataFrame([(k, 1, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rs]) for k, rs in shapes.items()], "id long, h int, parts array<array<struct<x:double,y:double>>>")
    # 2 lies in the hole of 1 and touches nothing of it; 5's second ring lies in 2 and in 3; 6 touches a corner of 1.
    want = [(1, 3), (1, 4), (1, 6), (2, 3), (2, 5), (3, 5)]
    assert sorted(map(tuple, vector.intersecting_polygons(df, "id", "parts", "h", 2).collect())) == want


def test_rings_of_a_hundred_thousand_corners(spark):
    n = 100_000
    corners = lambda r: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((F.cos(k * (2 * math.pi / n)) * r).alias("x"), (F.sin(k * (2 * math.pi / n)) * r).alias("y")))
    df = spark.range(3).select(F.col("id"), F.lit(1).alias("h"), F.array(corners(F.when(F.col("id") == 2, 0.5).otherwise(1 + F.col("id") * 0.001))).alias("parts"))
    moved = df.withColumn("parts", F.when(F.col("id") == 1, F.transform("parts", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 0.01).alias("x"), p["y"].alias("y"))))).otherwise(F.col("parts")))
    assert sorted(map(tuple, vector.intersecting_polygons(moved, "id", "parts", "h").collect())) == [(0, 1), (0, 2), (1, 2)]


def test_a_crowded_place_is_many_tasks(spark):
    """With nine tenths of the rows in one degree, the largest of the tasks on leaves stays near the median."""
    at = F.when(F.col("id") % 10 == 0, (F.xxhash64("id") % 18000) / 100).otherwise((F.xxhash64("id") % 1000) / 2000)
    pts = spark.range(200_000).select(at.alias("x"), F.when(F.col("id") % 10 == 0, (F.xxhash64("id", F.lit(1)) % 9000) / 100).otherwise((F.xxhash64("id", F.lit(1)) % 1000) / 2000).alias("y"))
    tree = quadtree.grow(pts, 500)
    tasks = quadtree.on_leaves(pts, tree, "x", "x", "y", "y").repartition(16, "__leaf").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in tasks.collect())
    assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
    assert quadtree.on_leaves(pts, tree, "x", "x", "y", "y").groupBy("__leaf").count().agg(F.max("count")).first()[0] <= 500
    assert tree.inner.count() < 200_000 // 500 * 16


def test_zones_hold_cell_centres(spark):
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    regions = spark.createDataFrame([("a", 90.0, 0.0, 0.0, -180.0), ("b", 45.0, -45.0, 90.0, -90.0), ("w", 90.0, -90.0, 180.0, -180.0)], "name string, north double, south double, east double, west double")
    got = {r["name"]: r["count"] for r in zonal.zones(cells, regions, (90.0, -90.0, 180.0, -180.0), (20, 20), 16).groupBy("name").count().collect()}
    assert got == {"a": 100, "b": 100, "w": 400}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    assert vector.overlapping_pairs(none, "id", "h").collect() == []
    assert vector.overlapping_pairs(spark.createDataFrame([(1, 1, None, None, None, None)], DDL), "id", "h").collect() == []


def test_equal_shapes_are_looked_at_once(spark, monkeypatch):
    """A hundred equal polygons over a hundred equal points: the joins on leaves see one of each, and all pairs come out, also by several arrays a class."""
    from gridspark.operators import components

    monkeypatch.setattr(vector, "MEMBERS", 7)
    ring = lambda x: [[{"x": x, "y": 0.0}, {"x": x + 1.0, "y": 0.0}, {"x": x + 1.0, "y": 1.0}, {"x": x, "y": 1.0}]]
    rows = [(k, k % 2, ring(0.0 if k < 100 else 0.5)) for k in range(120)] + [(500, 1, ring(9.0)), (501, 1, ring(9.0)), (502, None, ring(0.0)), (503, 1, [[]])]
    df = spark.createDataFrame(rows, "id long, h int, parts array<array<struct<x:double,y:double>>>")
    want = sorted([(a, b) for a in range(120) for b in range(a + 1, 120) if a % 2 == b % 2] + [(500, 501)])
    assert sorted(map(tuple, vector.intersecting_polygons(df, "id", "parts", "h", 2).collect())) == want
    linked, _ = vector.intersecting_classes(df, "id", "parts", "h", 2)
    assert linked.count() == 7
    roots = lambda e: sorted(map(tuple, components.label(e).collect()))
    links = vector.intersecting_links(df, "id", "parts", "h", 2)
    assert links.count() < 130 and roots(links.where("u <> v")) == roots(spark.createDataFrame(want, "u long, v long"))
    boxes_ = df.where("size(parts[0]) > 0").select("id", "h", F.col("parts")[0][0]["x"].alias("x0"), F.col("parts")[0][1]["x"].alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"))
    assert sorted(map(tuple, vector.overlapping_pairs(boxes_, "id", "h", 2).collect())) == want
    assert vector.overlapping_links(boxes_, "id", "h", 2).count() < 130
    seg = vector.ring_segments(df, "parts", ["id"])
    pts = spark.createDataFrame([(k, 0.75, 0.5) for k in range(100)] + [(100, 5.0, 5.0), (101, None, 1.0)], "pid long, x double, y double")
    got = sorted((r.pid, r.id) for r in vector.points_in_polygons(pts, seg, "id", 3).collect())
    assert got == [(p, k) for p in range(100) for k in [*range(120), 502]]
