"""Rules, ramps, settings, files and meshes with known values."""

import gzip
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import raster, registry, scan, vector


@pytest.mark.parametrize(
    "name,t,want",
    [
        ("terrain", 0.0, (0.0, 0.3, 0.0)), ("terrain", 0.2, (0.2, 0.5, 0.0)), ("terrain", 0.4, (0.4, 0.6, 0.2)), ("terrain", 0.8, (0.55, 0.45, 0.15)), ("terrain", 1.0, (0.9, 0.9, 0.9)), ("nothing", 1.0, (0.9, 0.9, 0.9)),
        ("gray", 0.3, (0.3, 0.3, 0.3)), ("gray", 7.0, (1.0, 1.0, 1.0)), ("viridis", 1.0, (0.95, 0.05, 0.05)), ("viridis", 0.0, (0.23, 0.05, 0.95)), ("raindow", 1.0, (1.0, 0.0, 0.0)),
        ("stops", 0.0, (0.10, 0.22, 0.50)), ("stops", 0.15, (0.15, 0.36, 0.675)), ("stops", 1.0, (1.0, 1.0, 1.0)), ("hot", 0.5, (1.0, 0.5, 0.0)), ("jet", 0.5, (0.5, 1.0, 0.5)),
    ],
)
def test_ramps(spark, name, t, want):
    got = raster.ramp(spark.createDataFrame([(0, 0, t)], "row int, col int, value double"), name).first()
    assert all(math.isclose(got[c], w, abs_tol=1e-9) for c, w in zip("rgb", want, strict=True))


def test_settings(spark):
    defaults = {"dem": {"dim": "600", "colormap": '"terrain"'}, "view": {"zoom": "3", "dim": "1"}}
    rows = [('{"dem": {"dim": 800, "new": true}, "x": {"a": 1}, "view": 3}',), ('{"dim": 700, "zoom": 9, "unknown": 1}',), ("{}",), (None,), ("broken",), ('{"colormap": {"a": 1}}',)]
    s = [r[0] for r in spark.createDataFrame(rows, "j string").select(registry.settings_of(F.col("j"), defaults)).collect()]
    assert s[0] == {"dem": {"dim": "800", "colormap": '"terrain"', "new": "true"}, "view": {"zoom": "3", "dim": "1"}}
    assert s[1] == {"dem": {"dim": "700", "colormap": '"terrain"'}, "view": {"zoom": "9", "dim": "1"}}
    assert s[2] == s[3] == s[4] == s[5] == defaults
    typed = spark.createDataFrame(rows, "j string").select(registry.settings_of(F.col("j"), defaults).alias("s")).select(registry.setting(F.col("s"), "dem", "dim", "int"), registry.setting(F.col("s"), "dem", "colormap", "string"), registry.setting(F.col("s"), "dem", "colormap", "int"), registry.setting(F.col("s"), "no", "x", "int"))
    assert [tuple(r) for r in typed.collect()][:2] == [(800, "terrain", None, None), (700, "terrain", None, None)]


def test_keys(spark):
    one = spark.range(1).select(F.lit(1.5).alias("n"))
    box = tuple(F.lit(x) for x in (40.0, 39.9, -75.1, -75.2))
    params = F.create_map(F.lit("b"), F.lit("[1,2]"), F.lit("a"), F.lit('"x"'))
    got = one.select(geo.cache_key(F.lit("dem"), box, geo.sorted_json(params)), geo.vector_cache_key(box, F.lit("0.5"), F.lit("5.0")), geo.sorted_json(F.lit(None).cast("map<string,string>"))).first()
    text = json.dumps({"b": [1, 2], "a": "x"}, sort_keys=True, separators=(",", ":"))
    assert got[0] == hashlib.md5(f"dem:N40.0000_S39.9000_E-75.1000_W-75.2000:{text}".encode()).hexdigest()
    assert got[1] == hashlib.md5(b"40.0000_39.9000_-75.1000_-75.2000_t0.5_a5.0").hexdigest()
    assert got[2] == "{}"


def test_sizes_and_widths(spark):
    dims = spark.createDataFrame([(0,), (1,), (2000,), (2001,), (None,)], "d int").select(geo.dim_problem(F.col("d")).isNull())
    assert [r[0] for r in dims.collect()] == [False, True, True, False, True]
    tags = spark.createDataFrame([(["trunk", "track"],), ([],), (None,), (["odd"],)], "highway array<string>")
    assert [r["width_m"] for r in registry.road_width(tags).collect()] == [10.0, 4.0, 3.0, 3.0]


def test_rings_lose_corners_that_do_not_turn(spark):
    ring = [(1, 0), (2, 0), (2, 2), (0, 2), (0, 1), (0, 0), (1, 0)]
    df = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ring]), (2, [{"x": float(x), "y": float(y)} for x, y in ring[:-1]])], "k int, p array<struct<x:double,y:double>>")
    for r in df.select(vector.ring_turns("p")).collect():
        assert [(p["x"], p["y"]) for p in r[0]] == [(2, 0), (2, 2), (0, 2), (0, 0)]


def test_parts_in_a_box(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, "LineString", [line((0, 0), (1, 1))]), (2, "MultiLineString", [line((9, 9), (8, 8)), line((1, 1), (5, 5))]), (3, "MultiLineString", [line((-5, -5), (-4, -4)), line((5, 5), (6, 6))]), (4, "Polygon", [line((0, 0), (1, 1))]), (5, None, [line((0, 0))]), (6, "LineString", [])]
    df = spark.createDataFrame(rows, "id int, geom_type string, parts array<array<struct<x:double,y:double>>>")
    assert {r["id"] for r in scan.parts_in_box(df, (1.0, 0.0, 1.0, 0.0)).collect()} == {1, 2}


def test_geojson_files(spark, tmp_path):
    feature = lambda k: {"type": "Feature", "id": k, "geometry": {"type": "Point", "coordinates": [k, 1.5]}, "properties": {"a": str(k)}}
    collection = lambda *ks: {"type": "FeatureCollection", "features": [feature(k) for k in ks]}
    (tmp_path / "one.json").write_text(json.dumps(collection(1, 2), indent=1))
    (tmp_path / "city.json.gz").write_bytes(gzip.compress(json.dumps({"roads": collection(3), "walls": collection(), "count": 1, "towers": collection(4)}).encode()))
    (tmp_path / "bad.json").write_text("[1]")
    got = sorted((r["feature_id"], r["file"], r["layer"], r["parts"][0][0]["x"], r["props"]["a"]) for r in scan.geojson_files(spark, str(tmp_path)).collect())
    assert got == [(1, "one.json", None, 1.0, "1"), (2, "one.json", None, 2.0, "2"), (3, "city.json.gz", "roads", 3.0, "3"), (4, "city.json.gz", "towers", 4.0, "4")]


def test_prisms_stand_on_the_ground(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1))]
    df = spark.createDataFrame([(1, ring, 50.0, 8.0), (2, ring, None, None), (3, ring, 0.0, 0.0)], "k int, p array<struct<x:double,y:double>>, terrain_z double, height_m double")
    ground = spark.createDataFrame([(-10.0, 90.0)], "lo double, hi double")
    v = {(r["k"], r["id"]): (r["x"], r["y"], r["z"]) for r in vector.prism_vertices(df, "k", "p", (1.0, 0.0, 1.0, 0.0), (100.0, 50.0), 2.0, 20.0, ground, 0.5).collect()}
    assert len(v) == 18
    assert v[1, 0] == (0.0, 0.0, 14.0) and v[1, 5] == (100.0, 50.0, 18.0)
    assert v[2, 0][2] == v[3, 0][2] == 2.0 and v[2, 3][2] == v[3, 3][2] == 7.0


def test_a_solid_has_no_holes(spark):
    cells = spark.range(12).select(F.floor(F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    faces = vector.surface_faces((3, 4), cells).select("a", "b", "c").union(vector.skirt_faces((3, 4), cells))
    r = vector.mesh_report(vector.surface_vertices(cells, (3, 4), (30.0, 20.0), 1.0, 9.0, solid=True), faces).first()
    assert r["watertight"] and (r["holes"], r["vertices"], r["z_low"], r["z_high"]) == (0, 24, 0.0, 10.0)
