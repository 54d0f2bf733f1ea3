import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import components, focal, names, raster, registry, scan, terrain, vector, zonal
from gridspark.streaming import requests

G3 = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]


def cells(spark, grid, kind="double"):
    rows = [(r, c, None if v is None else (float(v) if kind == "double" else int(v))) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"row int, col int, value {kind}")


def grid(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_algebra_on_a_small_grid(spark):
    g = cells(spark, G3)
    assert grid(raster.normalise(g))[1, 1] == 0.5
    assert grid(raster.invert(g))[0, 0] == 9
    assert sorted(grid(raster.clip(g, 3, 7)).values()) == [3, 3, 3, 4, 5, 6, 7, 7, 7]
    assert grid(raster.crop(g, (1, 3), (0, 2))) == {(0, 0): 4, (0, 1): 5, (1, 0): 7, (1, 1): 8}
    assert grid(raster.area_average(g, 3)) == {(0, 0): 5}
    with pytest.raises(ValueError):
        raster.blend(g, g, "other")
    with pytest.raises(ValueError):
        raster.project(g, (1, 0, 1, 0), (3, 3), "other")


def test_constant_empty_and_missing(spark):
    flat = cells(spark, [[7.0] * 4] * 4)
    assert set(grid(raster.normalise(flat)).values()) == {7.0}
    assert zonal.similarity(flat, flat).first()[0] == 0
    h = {r["bin"]: r["n"] for r in zonal.histogram(flat).collect()}
    assert h[0] == 16 and sum(h.values()) == 16
    none = flat.where("row < 0")
    assert raster.normalise(none).count() == 0
    assert zonal.summary(none).first()["n"] == 0
    holes = raster.clean(cells(spark, [[1.0, float("nan")], [None, 3.0]]))
    s = zonal.summary(holes).first()
    assert (s["lo"], s["hi"], s["n"]) == (1.0, 3.0, 2)
    assert grid(raster.clip(holes, 2, 9))[1, 0] is None


def test_resample_identity_and_corners(spark):
    g = cells(spark, G3)
    assert grid(raster.resample_bilinear(g, (3, 3), (3, 3))) == grid(g)
    up = grid(raster.resample_bilinear(g, (3, 3), (5, 5), "corners"))
    assert up[0, 0] == 1 and up[4, 4] == 9 and up[2, 2] == 5 and up[0, 1] == 1.5
    assert grid(raster.resample_nearest(g, (3, 3), (6, 6)))[5, 5] == 9


def test_projections_keep_shape_and_binary_values(spark):
    ones = cells(spark, [[1.0] * 8] * 8)
    for name in ("none", "cosine", "mercator", "lambert", "sinusoidal"):
        out = grid(raster.project(ones, (40.0, 39.9, -75.1, -75.2), (8, 8), name))
        assert all(abs(v - 1) < 1e-9 for v in out.values())
        assert max(r for r, _ in out) <= 7 and max(c for _, c in out) <= 7


def test_close_up_drops_empty_borders(spark):
    g = cells(spark, [[None, None, None], [None, 5.0, None], [None, None, 6.0]])
    assert grid(raster.close_up(g)) == {(0, 0): 5.0, (1, 1): 6.0}


def test_impulse_through_gaussian(spark):
    g = cells(spark, [[1.0 if (r, c) == (4, 4) else 0.0 for c in range(9)] for r in range(9)])
    out = grid(focal.smooth(g, (9, 9), 1.0))
    assert abs(sum(out.values()) - 1) < 1e-9
    assert abs(out[4, 3] - out[3, 4]) < 1e-12 and out[4, 4] == max(out.values())
    corner = grid(focal.smooth(cells(spark, [[1.0 if r == c == 0 else 0.0 for c in range(9)] for r in range(9)]), (9, 9), 1.0))
    w = focal.gaussian_weights(1.0)
    assert abs(corner[0, 0] - (w[4] + w[5]) ** 2) < 1e-12  # reflected at the edge


def test_morphology(spark):
    m = [[1 if r < 3 and c < 3 else 0 for c in range(6)] for r in range(6)]
    for c in range(6):
        m[5][c] = 1
    mask = cells(spark, m, "int")
    assert {(1, 1)} == {k for k, v in grid(focal.erode(mask, (6, 6), 1)).items() if v}
    thin = {(r["row"], r["col"]) for r in focal.thin_features(mask, (6, 6), 3).collect()}
    assert thin == {(5, c) for c in range(6)}
    one = cells(spark, [[1 if (r, c) == (2, 2) else 0 for c in range(5)] for r in range(5)], "int")
    assert focal.dilate_disk(one, (5, 5), 1).count() == 5 and focal.dilate_disk(one, (5, 5), 2).count() == 13
    assert set(grid(focal.median(cells(spark, G3), (3, 3), 3)).values()) >= {5.0}


def test_shared_edges_burn_once(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 8.0), (2, 4.0, 0.0, 8.0, 8.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    seg = vector.segments(p.withColumn("p", vector.ring("x0", "y0", "x1", "y1")), "p", ["k"])
    out = vector.burn_polygons(seg, (8, 8), ["k"])
    assert out.count() == 64 and out.select("row", "col").distinct().count() == 64
    tri = spark.createDataFrame([(1, [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0), (0.0, 0.0)])], "k int, p array<struct<x:double,y:double>>")
    inside = {(r["row"], r["col"]) for r in vector.burn_polygons(vector.segments(tri, "p", ["k"]), (8, 8), ["k"]).collect()}
    assert {(r, c) for r in range(8) for c in range(8) if r + 0.5 + c + 0.5 < 8} <= inside <= {(r, c) for r in range(8) for c in range(8) if r + c + 1 <= 8}


def test_line_burn_and_degenerate_segment(spark):
    seg = spark.createDataFrame([(1, 1.0, 2.5, 6.0, 2.5), (2, 6.5, 6.5, 6.5, 6.5)], "k int, x1 double, y1 double, x2 double, y2 double")
    out = {(r["k"], r["row"], r["col"]) for r in vector.burn_lines(seg, (8, 8), F.lit(0.5), ["k"]).collect()}
    assert {(1, 2, c) for c in range(1, 6)} <= out and {r for k, r, _ in out if k == 1} == {2}
    assert (2, 6, 6) in out


def test_collinear_and_turns(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring)], "k int, p array<struct<x:double,y:double>>")
    assert df.select(F.size(vector.drop_collinear("p"))).first()[0] == 5
    assert df.select(F.size(vector.turn_removal("p"))).first()[0] == 5


def test_closed_solid(spark):
    g = cells(spark, G3)
    faces = vector.surface_faces((3, 3), g).select("a", "b", "c").union(vector.skirt_faces((3, 3), g))
    h = vector.mesh_health(faces).first()
    assert h["watertight"] and h["boundary"] == 0 and h["misdirected"] == 0
    assert not vector.mesh_health(vector.surface_faces((2, 2), cells(spark, [[0, 0], [0, 0]]))).first()["watertight"]


def test_components_of_a_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(1000, 1001), (2000, 2000)], "u long, v long"))
    out = {r["node"]: r["root"] for r in components.label(e).collect()}
    assert {out[i] for i in range(301)} == {0} and out[1001] == 1000 and out[2000] == 2000
    assert components.label(e.where("u < 0")).count() == 0


def test_names_keys_and_parsing(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "base string, k int")
    assert {r["name"] for r in names.unique_names(d, "base", "k").collect()} == {"a", "a_2", "a_3", "b"}
    t = spark.createDataFrame([("N43.6",), ("W72.8",), ("x",), (None,)], "t string")
    assert [r[0] for r in t.select(geo.hemisphere(F.col("t"))).collect()] == [43.6, -72.8, None, None]
    with pytest.raises(Exception):  # noqa: B017
        scan.extent_of_name(spark.createDataFrame([("bad.tif",)], "path string"), "path").collect()
    assert math.isclose(registry.road_width(spark.createDataFrame([("track",), (None,)], "highway string")).agg(F.sum("width_m")).first()[0], 5.0)


def test_range_joins_are_binned(spark, sf):
    from gridspark.plans import catalog

    for name in ("j5_touching_pairs", "j1_box_intersections", "a9_zonal_summary", "v10_points_in_polygons"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name


def test_unique_names_of_all_orders_in_ranges(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("base"))
    want, seen = {}, {}
    for r in sorted(o.collect(), key=lambda r: r["k"]):
        n = seen[r["base"]] = seen.get(r["base"], 0) + 1
        want[r["k"]] = r["base"] if n == 1 else f"{r['base']}_{n}"
    out = names.unique_names(o, "base", "k")
    assert {r["k"]: r["name"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(base" in plan and "__range" in plan.split("windowspecdefinition(base")[1].split("ASC")[0]
    odd = spark.createDataFrame([("b", None), (None, 1), (None, 2), ("b", 5)], "base string, k long")
    assert sorted((r["k"] or 0, r["name"]) for r in names.unique_names(odd, "base", "k").where("base = 'b'").collect()) == [(0, "b"), (5, "b_2")]
    assert names.unique_names(odd, "base", "k").count() == 4 and names.unique_names(odd.where("false"), "base", "k").count() == 0


def test_components_by_rounds_and_in_one_task_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7000, 7000)]
    df = spark.createDataFrame(edges, "u long, v long")
    one = sorted(map(tuple, components.label(df).select("node", "root").collect()))
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert sorted(map(tuple, components.label(df).select("node", "root").collect())) == one
    assert (1040, 1000) in one and (7000, 7000) in one
    assert components.label(df.where("false")).count() == 0


def test_percentiles_are_exact_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 5000)] + [("b", float(x)) for x in rng.integers(0, 3, 400)] + [("c", 5.0), ("a", None)]
    ps = [0.0, 0.013, 0.5, 0.98, 1.0]
    got = {r["g"]: r for r in zonal.percentiles(spark.createDataFrame(rows, "g string, value double"), ps, by=("g",)).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g]["n"] == len(v) and np.allclose(got[g]["p"], np.quantile(v, ps), atol=1e-12)


def test_tiles_equal_whole_array(spark, monkeypatch):
    monkeypatch.setattr(focal, "TILE", 8)
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (30, 21))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(21)], "row int, col int, value double")
    w = np.array(focal.gaussian_weights(1.0))
    pad = np.pad(a, len(w) // 2, mode="symmetric")
    want = focal.along(focal.along(pad, w).T, w).T
    for r in focal.smooth(df, (30, 21), 1.0).collect():
        assert abs(r["value"] - want[r["row"], r["col"]]) < 1e-12
    pad = np.pad(a, 1, mode="symmetric")
    got = focal.median(df, (30, 21), 3).collect()
    assert len(got) == a.size and all(abs(r["value"] - np.median(pad[r["row"] : r["row"] + 3, r["col"] : r["col"] + 3])) < 1e-12 for r in got)


def test_terrain_shapes_and_rules(spark):
    c = spark.createDataFrame([(0, 0, 80), (0, 1, 10)], "row int, col int, class_id int")
    low = spark.createDataFrame([(0, 0, 5.0), (0, 1, -9.0)], "row int, col int, value double")
    wet = lambda box: {r["col"]: r["water"] for r in terrain.water_mask(c, box, elevation=low).collect()}
    assert wet((40.0, 39.9, -75.1, -75.2)) == {0: 1, 1: 0} and wet((41.0, 39.0, -74.0, -76.0)) == {0: 1, 1: 1}
    assert terrain.fit((100, 50), 600) == (600, 300) and terrain.fit((50, 100), 60) == (30, 60)
    assert terrain.shrink(low, (1, 2), 2)[1] == (1, 2) and raster.row_at(-90, (90.0, -90.0), 10) == 9
    flat = spark.createDataFrame([(0, 0, 3.0), (0, 1, 3.0)], "row int, col int, value double")
    assert {r["value"] for r in terrain.standardise(flat).collect()} == {0.0}
    with pytest.raises(ValueError):
        raster.project(low, (90.0, -90.0, 180.0, -180.0), (1, 2), "robinson")


def test_polygons_that_hold_or_only_near_each_other(spark):
    ring = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in (*xy, xy[0])]
    rows = [
        (1, 1, ring((0, 0), (10, 0), (10, 10), (0, 10))), (2, 1, ring((4, 4), (5, 4), (5, 5))), (3, 1, ring((10, 10), (12, 10), (12, 12))), (4, 1, ring((20, 0), (30, 0), (20, 10))),
        (5, 1, ring((29, 9), (30, 9), (30, 10))), (6, 2, ring((0, 0), (1, 0), (1, 1))),
    ]
    df = spark.createDataFrame(rows, "id long, h int, p array<struct<x:double,y:double>>")
    # One holds another, two touch at a corner; two have bounding boxes that overlap and nothing more; one has another height.
    assert sorted(map(tuple, vector.intersecting_polygons(df.withColumn("parts", F.array("p")), "id", "parts", "h").collect())) == [(1, 2), (1, 3)]


def test_requests_that_miss(spark):
    rows = [("k", "n", t) for t in (0, 5, 10, 14, 21, 100, None)] + [("j", None, 3)]
    df = spark.createDataFrame(rows, "key string, namespace string, t long").withColumn("cached_at", F.timestamp_seconds("t"))
    got = requests.misses_within(df, 10).select("key", F.unix_seconds("at")).collect()
    assert sorted(map(tuple, got)) == [("j", 3), ("k", 0), ("k", 10), ("k", 21), ("k", 100)]


def test_cells_of_single_segments_are_not_compared(spark):
    """Lines of one segment, of several that cross, and without a key give each cell once a key; steps that round to one cell count once."""
    rows = [(1, 0.5, 0.5, 7.5, 0.5), (2, 0.0, 0.0, 7.0, 7.0), (2, 0.0, 7.0, 7.0, 0.0), (2, 0.0, 0.0, 7.0, 7.0), (3, 2.0, 2.0, 2.0, 2.0), (None, 1.0, 1.0, 3.0, 1.0)]
    seg = spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double")
    for keep in (["k"], []):
        got = [tuple(r) for r in vector.embed_lines(seg, keep).collect()]
        want = set()
        for k, x1, y1, x2, y2 in rows:
            n = int(max(abs(x2 - x1), abs(y2 - y1)))
            want |= {(*([k] if keep else []), round(y1 + t / max(n, 1) * (y2 - y1)), round(x1 + t / max(n, 1) * (x2 - x1))) for t in range(n + 1)}
        assert len(got) == len(set(got)) and set(got) == want
        burnt = [tuple(r) for r in vector.burn_lines(seg, (8, 8), F.lit(0.75), keep).collect()]
        assert len(burnt) == len(set(burnt)) and len(burnt) > 20
    plan = vector.embed_lines(seg, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.index("Aggregate") > plan.index("Union")


def test_polygons_over_several_bands(spark):
    """A polygon higher than a band burns as one."""
    b = spark.createDataFrame([(1, 2.0, 3.0, 90.0, 150.0)], "k int, x0 double, y0 double, x1 double, y1 double").withColumn("p", vector.ring("x0", "y0", "x1", "y1"))
    cells = vector.burn_polygons(vector.segments(b, "p", ["k"]), (200, 100), ["k"])
    assert cells.count() == 88 * 147 and cells.distinct().count() == 88 * 147
    assert "__band" in cells._jdf.queryExecution().optimizedPlan().toString()
