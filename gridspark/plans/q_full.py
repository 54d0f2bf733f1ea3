"""Rules, ramps, sources and meshes in all their cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import raster, registry, scan, vector
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql
from gridspark.plans.q_features import fresh
from gridspark.plans.q_raster import NORM
from gridspark.plans.q_vector import AREA_BOX, HEIGHT, SAMPLE, houses

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


# Rules -----------------------------------------------------------------------------------------------


@query("p1_dim_range", "SELECT event_id, CASE WHEN d < 1 OR d > 2000 THEN 'dim not in 1..2000' END AS reason FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN size_bytes % 2500 - 3 END AS d FROM req)")
def _(spark, sf):
    d = F.when(F.col("event_id") % 10 != 0, F.col("size_bytes") % 2500 - 3)
    return X.requests(spark, sf).select("event_id", geo.dim_problem(d).alias("reason"))


@query("p5_parts_in_box", "SELECT reach_id FROM riv WHERE reach_id % 3 <> 0 AND (CASE WHEN reach_id % 3 = 1 THEN greatest(x1, xm) >= -20 AND least(x1, xm) <= 55 AND y1 >= -35 AND y1 <= 38 OR greatest(xm, x2) + 40 >= -20 AND least(xm, x2) + 40 <= 55 AND greatest(ym, y2) >= -35 AND least(ym, y2) <= 38 ELSE greatest(x1, xm, x2) >= -20 AND least(x1, xm, x2) <= 55 AND greatest(y1, ym, y2) >= -35 AND least(y1, ym, y2) <= 38 END)")
def _(spark, sf):
    k = F.col("reach_id") % 3
    moved = F.transform(vector.line(("xm", "ym"), ("x2", "y2")), lambda p: F.struct((p["x"] + 40.0).alias("x"), p["y"].alias("y")))
    parts = F.when(k == 1, F.array(vector.line(("x1", "y1"), ("xm", "ym")), moved)).otherwise(F.array(vector.line(("x1", "y1"), ("xm", "ym"), ("x2", "y2"))))
    kind = F.when(k == 0, "Polygon").when(k == 1, "MultiLineString").otherwise("LineString")
    return scan.parts_in_box(X.rivers(spark, sf).select("reach_id", kind.alias("geom_type"), parts.alias("parts")), (38.0, -35.0, 55.0, -20.0)).select("reach_id")


SAVED = """CASE event_id % 4 WHEN 0 THEN '{"dem": {"dim": ' || size_bytes % 900 || ', "extra": [1]}, "view": {"zoom": 5}, "other": {"dim": 1}}' WHEN 1 THEN '{"dim": ' || size_bytes % 900 || ', "odd": {"dim": 4}}' WHEN 2 THEN 'not json' END"""
DEFAULTS = {"dem": {"dim": "600", "colormap": '"terrain"'}, "view": {"zoom": "3", "dim": "1"}}


@query("p11_grouped_settings", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN size_bytes % 900 ELSE 600 END::INT AS dim, CASE WHEN event_id % 4 = 0 THEN 5 ELSE 3 END::INT AS zoom, 1::INT AS view_dim, 'terrain' AS colormap, CASE WHEN event_id % 4 = 0 THEN '[1]' END AS extra, 2 AS groups FROM req")
def _(spark, sf):
    saved = X.requests(spark, sf).select("event_id", registry.settings_of(F.expr(SAVED), DEFAULTS).alias("s"))
    get = lambda g, k, t: registry.setting(F.col("s"), g, k, t)
    extra = F.try_element_at(F.try_element_at("s", F.lit("dem")), F.lit("extra"))
    return saved.select("event_id", get("dem", "dim", "int").alias("dim"), get("view", "zoom", "int").alias("zoom"), get("view", "dim", "int").alias("view_dim"), get("dem", "colormap", "string").alias("colormap"), extra.alias("extra"), F.size("s").alias("groups"))


@query("p17_sorted_key", "SELECT name, md5('dem:N' || printf('%.4f', north) || '_S' || printf('%.4f', south) || '_E' || printf('%.4f', east) || '_W' || printf('%.4f', west) || ':{\"dim\":' || dim || ',\"scale\":2.5,\"source\":\"' || label || '\"}') AS key, md5(printf('%.4f', north) || '_' || printf('%.4f', south) || '_' || printf('%.4f', east) || '_' || printf('%.4f', west) || '_t0.5_a5.0') AS vector_key FROM reg")
def _(spark, sf):
    box = tuple(F.col(c) for c in ("north", "south", "east", "west"))
    params = F.create_map(F.lit("source"), F.concat(F.lit('"'), "label", F.lit('"')), F.lit("dim"), F.col("dim").cast("string"), F.lit("scale"), F.lit("2.5"))
    return X.regions(spark, sf).select("name", geo.cache_key(F.lit("dem"), box, geo.sorted_json(params)).alias("key"), geo.vector_cache_key(box, F.lit("0.5"), F.lit("5.0")).alias("vector_key"))


@query("j9_highway_lists", "SELECT feature_id, CASE WHEN feature_id % 5 = 0 THEN 4 WHEN highway IS NULL THEN 3 ELSE coalesce(w, 3) END::DOUBLE AS width_m FROM road LEFT JOIN (VALUES ('motorway', 12), ('residential', 4), ('service', 2), ('primary', 8)) t(h, w) ON highway = h")
def _(spark, sf):
    tags = F.when(F.col("feature_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("highway").isNotNull(), F.array("highway", F.lit("track")))
    return registry.road_width(X.roads(spark, sf).withColumn("highway", tags)).select("feature_id", "width_m")


@query("v5_ring_turns", "SELECT feature_id, 4 + (feature_id % 3 = 2)::INT AS n FROM bld")
def _(spark, sf):
    # The ring begins in the middle of a side, or with an extra corner there.
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    first = p((x0 + x1) / 2, F.when(F.col("feature_id") % 3 == 2, y0 - (y1 - y0)).otherwise(y0))
    ring = F.array(first, p(x1, y0), p(x1, y1), p((x0 + x1) / 2, y1), p(x0, y1), p(x0, y0), first)
    return X.buildings(spark, sf).withColumn("q", ring).select("feature_id", F.size(vector.ring_turns("q")).alias("n"))


# Ramps -----------------------------------------------------------------------------------------------


def ramp(name: str, body: list[str]):
    @query(f"r14_ramp_{name}", NORM + "SELECT row, col, " + ", ".join(f"{s6(x)} AS {c}" for x, c in zip(body, "rgb", strict=True)) + " FROM nn")
    def _(spark, sf):
        cells = raster.ramp(raster.normalise(X.li(spark, sf)), name)
        return cells.select("row", "col", *(r6(c).alias(c) for c in "rgb"))


LERP = lambda a, b, f: f"{a} * (1 - {f}) + {b} * {f}"
T1, T2, T3 = "(t / 0.4)", "((t - 0.4) / 0.4)", "((t - 0.8) / 0.2)"
ramp("terrain", [f"CASE WHEN t < 0.4 THEN {a} WHEN t < 0.8 THEN {b} ELSE {c} END" for a, b, c in (
    (LERP(0.0, 0.4, T1), LERP(0.4, 0.55, T2), LERP(0.55, 0.9, T3)), (f"0.3 * (1 - {T1}) + 0.25 * {T1} + 0.45 * {T1}", LERP(0.6, 0.45, T2), LERP(0.45, 0.9, T3)), ("0.0", LERP(0.2, 0.15, T2), LERP(0.15, 0.9, T3)))])
ramp("gray", ["t", "t", "t"])
#: Hue to red, green, blue by the sixths of the circle, for lightness 0.5 and saturation 0.9: from 0.05 to 0.95.
SIXTH = lambda h: f"CASE WHEN {h} < 1/6::DOUBLE THEN 0.05 + 0.9 * 6 * {h} WHEN {h} < 0.5 THEN 0.95 WHEN {h} < 2/3::DOUBLE THEN 0.05 + 0.9 * (2/3::DOUBLE - {h}) * 6 ELSE 0.05 END"
TURN = lambda d: f"((0.7 - 0.7 * t + {d}) - floor(0.7 - 0.7 * t + {d}))"
ramp("viridis", [SIXTH(TURN("1/3::DOUBLE")), SIXTH(TURN("0")), SIXTH(TURN("2/3::DOUBLE"))])
ramp("stops", ["CASE " + " ".join(f"WHEN t <= {b} THEN {c[k]} + (t - {a}) / ({b} - {a})::DOUBLE * ({d[k]} - {c[k]})" for (a, c), (b, d) in zip(raster.STOPS, raster.STOPS[1:], strict=False)) + " END" for k in range(3)])


# Sources ---------------------------------------------------------------------------------------------


@query("s9_geojson_files", f"SELECT feature_id, CASE WHEN feature_id % 2 = 0 THEN 'buildings' ELSE 'walls' END AS layer, {s6('x1')} AS x, height_tag FROM bld WHERE feature_id // 500 % 2 = 0 UNION ALL SELECT feature_id, NULL, {s6('x1')}, height_tag FROM bld WHERE feature_id // 500 % 2 = 1")
def _(spark, sf):
    b = X.buildings(spark, sf)
    feature = F.concat(F.lit('{"type": "Feature", "id": '), "feature_id", F.lit(', "geometry": {"type": "LineString", "coordinates": [['), F.col("x0"), F.lit(", "), F.col("y0"), F.lit("], ["), F.col("x1"), F.lit(", "), F.col("y1"), F.lit(']]}, "properties": '), F.to_json(F.struct(F.col("height_tag").alias("height"))), F.lit("}"))
    doc = F.floor(F.col("feature_id") / 500)
    rows = b.select(doc.alias("doc"), F.when(F.col("feature_id") % 2 == 0, "buildings").otherwise("walls").alias("layer"), feature.alias("f"))
    collection = lambda fs: F.concat(F.lit('{"type": "FeatureCollection",\n "features": ['), F.array_join(fs, ",\n"), F.lit("]}"))
    whole = rows.where("doc % 2 = 1").groupBy("doc").agg(collection(F.collect_list("f")).alias("value"))  # 500 features a document
    layered = rows.where("doc % 2 = 0").groupBy("doc", "layer").agg(collection(F.collect_list("f")).alias("c")).groupBy("doc")
    layered = layered.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "layer", F.lit('": '), "c")), ","), F.lit(', "note": "of many"}')).alias("value"))
    path = fresh(spark, "geojson")
    for k, (docs, codec) in enumerate(((whole, "none"), (layered, "gzip"))):  # a file a document, half of them gzip
        docs.repartitionByRange(max(1, docs.count()), "doc").write.option("compression", codec).partitionBy("doc").text(f"{path}/k={k}")
    f = scan.geojson_files(spark, f"{path}/*/*")
    return f.select("feature_id", "layer", r6(F.col("parts")[0][1]["x"]).alias("x"), F.col("props.height").alias("height_tag"))


# Meshes ----------------------------------------------------------------------------------------------


def emb_rows(spark, sf) -> int:
    return int(X.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]) + 1


Z = "5 + (value - lo) / (hi - lo) * 25"


@query("m1_surface_vertices", f", m AS (SELECT max(row) AS mr, min(value) AS lo, max(value) AS hi FROM emb) SELECT row * 64 + col AS id, {s6('col / 63::DOUBLE * 150')} AS x, {s6('100 - row / mr::DOUBLE * 100')} AS y, {s6(Z)} AS z FROM emb, m UNION ALL SELECT (mr + 1) * 64 + row * 64 + col, {s6('col / 63::DOUBLE * 150')}, {s6('100 - row / mr::DOUBLE * 100')}, 0 FROM emb, m")
def _(spark, sf):
    v = vector.surface_vertices(X.emb(spark, sf), (emb_rows(spark, sf), 64), (150.0, 100.0), 5.0, 25.0, solid=True)
    return v.select("id", *(r6(c).alias(c) for c in "xyz"))


@query("m3_prism_vertices", f", p AS (SELECT *, {HEIGHT} AS h, {SAMPLE.format(lat='((y0 + y1) / 2 - 39.95) * 10000', lon='((x0 + x1) / 2 + 75.155) * 8000')} FROM bld), s AS (SELECT min(value) AS lo, max(value) AS hi FROM li), q AS (SELECT p.*, 3 + (coalesce(nullif(value, 0), lo) - lo) / (hi - lo) * 20 AS foot FROM p LEFT JOIN li USING (row, col), s) SELECT feature_id, k AS id, {s6('(CASE WHEN k % 4 IN (1, 2) THEN x1 ELSE x0 END - -75.171::DOUBLE) / (-75.138::DOUBLE - -75.171::DOUBLE) * 150')} AS x, {s6('(CASE WHEN k % 4 IN (2, 3) THEN y1 ELSE y0 END - 39.949::DOUBLE) / (39.961::DOUBLE - 39.949::DOUBLE) * 90')} AS y, {s6('foot + CASE WHEN k > 3 THEN h * 0.5 ELSE 0 END')} AS z FROM q, (SELECT unnest(range(8))::INT AS k)")
def _(spark, sf):
    at = lambda x: F.least(F.greatest(F.bround(x, 0), F.lit(0.0)), F.lit(127.0)).cast("int")
    lat, lon = ((F.col("y0") + F.col("y1")) / 2 - 39.95) * 10000, ((F.col("x0") + F.col("x1")) / 2 + 75.155) * 8000
    b = houses(spark, sf).withColumn("p", F.slice(vector.ring("x0", "y0", "x1", "y1"), 1, 4)).select("feature_id", F.col("h").alias("height_m"), "p", at((90 - lat) / 180 * 127).alias("row"), at((lon + 180) / 360 * 127).alias("col"))
    ground = X.li(spark, sf)
    b = b.join(ground.withColumnRenamed("value", "terrain_z"), ["row", "col"], "left")
    v = vector.prism_vertices(b, "feature_id", "p", AREA_BOX, (150.0, 90.0), 3.0, 20.0, ground.agg(F.min("value").alias("lo"), F.max("value").alias("hi")), 0.5)
    return v.select("feature_id", "id", *(r6(c).alias(c) for c in "xyz"))


@query("m4_mesh_report", f", m AS (SELECT (max(row) + 1)::BIGINT AS h, min(value) AS lo, max(value) AS hi FROM emb) SELECT 2 * (h - 1) * 63 - 8 AS faces, h * 64 AS vertices, (3 * (2 * (h - 1) * 63 - 8) + 2 * (h - 1) + 2 * 63 + 8) // 2 AS edges, 2 * (h - 1) + 2 * 63 + 8 AS boundary, 0::BIGINT AS non_manifold, 0::BIGINT AS misdirected, false AS watertight, 2::BIGINT AS holes, 5::DOUBLE AS z_low, 30::DOUBLE AS z_high FROM m")
def _(spark, sf):
    # An open surface in which four quads are missing: two loops of boundary edges.
    shape, e = (emb_rows(spark, sf), 64), X.emb(spark, sf)
    faces = vector.surface_faces(shape, e.where("not (row between 10 and 11 and col between 20 and 21)"))
    return vector.mesh_report(vector.surface_vertices(e, shape, (150.0, 100.0), 5.0, 25.0), faces).withColumn("z_low", r6("z_low")).withColumn("z_high", r6("z_high"))
