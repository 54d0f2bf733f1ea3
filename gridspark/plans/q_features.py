"""Sources and sinks, rules, polygons, city layers, meshes and reports in full."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import components, registry, scan, vector
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql
from gridspark.plans.q_vector import AREA_BOX, BG, GRID, HEIGHT, SAMPLE, house_segments, houses, near_sql, recursive, road_segments
from gridspark.streaming import requests as live

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


def fresh(spark, what: str) -> str:
    """A path of its own in the folder that all executors share."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        components.saved(spark.range(1))  # sets a folder where the master is local
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def five(c):
    return F.round(c, 3) + F.lit(0.0)


# Sources and sinks -------------------------------------------------------------------------------


@query("s6_csv_round_trip", "SELECT 'r' || o_orderkey AS name, greatest(a, b) AS north, least(a, b) AS south FROM (SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE (o_custkey % 90)::VARCHAR END AS DOUBLE) AS a, (o_orderkey % 90)::DOUBLE AS b FROM orders) t(o_orderkey, a, b) WHERE a IS NOT NULL AND a <> b")
def _(spark, sf):
    o = X.table(spark, sf, "orders").select(F.concat(F.lit("r"), "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise((F.col("o_custkey") % 90).cast("string")).alias("a"), (F.col("o_orderkey") % 90).cast("string").alias("b"))
    path = fresh(spark, "csv")
    o.write.csv(f"{path}/in", header=True)
    return scan.convert_tile_index(spark, f"{path}/in", f"{path}/out")


@query("s8_legacy_labels", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'Asia' END AS label, CASE WHEN event_id % 2 = 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS depth_scale, 0.05::DOUBLE AS water_scale, event_id % 5 <> 0 AS subtract_water, 500 AS sat_scale FROM req")
def _(spark, sf):
    k = F.col("event_id")
    text = F.concat(
        F.lit('{"label": "'), F.when(k % 3 == 0, "own").otherwise(""), F.lit('", "continent": "Asia", "params": {'), F.when(k % 2 == 0, '"depth_scale": 0.7, ').otherwise(""), F.lit('"subtract_water": '),
        F.when(k % 5 == 0, "false").otherwise("true"), F.lit("}}"),
    )
    return scan.legacy_regions(X.requests(spark, sf).select("event_id", text.alias("j")), "j").select("event_id", "label", "depth_scale", "water_scale", "subtract_water", "sat_scale")


KINDS = ("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


@query("s9_geojson_kinds", f"SELECT feature_id, {list(KINDS)}[(feature_id % 5 + 1)::INT] AS geom_type, [1, 1, 2, 1, 2][(feature_id % 5 + 1)::INT] AS n_parts, [1, 2, 4, 5, 10][(feature_id % 5 + 1)::INT] AS n_points, {s6('x0')} AS first_x, height_tag FROM bld")
def _(spark, sf):
    b = X.buildings(spark, sf)
    p = lambda x, y: F.array(F.col(x), F.col(y))
    line, ring = F.array(p("x0", "y0"), p("x1", "y1")), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    shapes = (p("x0", "y0"), line, F.array(line, line), F.array(ring), F.array(F.array(ring), F.array(ring)))
    k = F.col("feature_id") % 5
    coordinates = F.coalesce(*(F.when(k == i, F.to_json(x)) for i, x in enumerate(shapes)))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int"))
    head = F.to_json(F.struct(F.col("height_tag").alias("height")))
    feature = F.concat(F.lit('{"type": "Feature", "id": '), "feature_id", F.lit(', "geometry": {"type": "'), kind, F.lit('", "coordinates": '), coordinates, F.lit('}, "properties": '), head, F.lit("}"))
    docs = b.select(F.floor(F.col("feature_id") / 1000).alias("doc"), feature.alias("f")).groupBy("doc").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("json"))  # 1,000 features a document
    f = scan.geojson_features(docs, "json")
    return f.select("feature_id", "geom_type", F.size("parts").alias("n_parts"), F.size(F.flatten("parts")).alias("n_points"), r6(F.col("parts")[0][0]["x"]).alias("first_x"), F.col("props.height").alias("height_tag"))


@query("s11_store_round_trip", "SELECT row, col, value::FLOAT::DOUBLE AS value, 'dem' AS source, (SELECT count(*) FROM li WHERE col % 2 = 0) AS cells FROM li WHERE col % 2 = 0")
def _(spark, sf):
    part = F.when(F.col("col") % 2 == 0, "dem").otherwise("water")
    cells = X.li(spark, sf).select(part.alias("namespace"), F.lit("world").alias("key"), "row", "col", "value")
    meta = cells.groupBy("namespace", "key").agg(F.count("*").alias("cells")).withColumn("source", F.col("namespace"))
    path = fresh(spark, "arrays")
    scan.write_arrays(cells, meta, path)
    return scan.read_arrays(spark, path, "dem").select("row", "col", F.col("value").cast("double").alias("value"), "source", "cells")


# Rules -------------------------------------------------------------------------------------------

RULES = [("pois", "amenity", None, ("Point",)), ("walls", "barrier", "wall", ("LineString", "Polygon")), ("walls", "barrier", "city_wall", ("LineString", "Polygon")), ("towers", "man_made", "tower", ("Point", "Polygon")), ("water", "natural", "water", ("Polygon",))]


@query("p8_layer_rules", ", f AS (SELECT p_partkey AS feature_id, ['Point', 'LineString', 'Polygon'][(p_partkey % 3 + 1)::INT] AS g, ['amenity', 'barrier', 'man_made', 'natural', 'shop'][(p_size % 5 + 1)::INT] AS k, CASE p_size % 5 WHEN 0 THEN 'cafe' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'wall' ELSE 'hedge' END WHEN 2 THEN 'tower' WHEN 3 THEN 'water' ELSE 'x' END AS v FROM part) SELECT feature_id, CASE k WHEN 'amenity' THEN 'pois' WHEN 'barrier' THEN 'walls' WHEN 'man_made' THEN 'towers' ELSE 'water' END AS layer FROM f WHERE (k = 'amenity' AND g = 'Point') OR (k = 'barrier' AND v = 'wall' AND g <> 'Point') OR (k = 'man_made' AND g <> 'LineString') OR (k = 'natural' AND g = 'Polygon')")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size") % 5
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    value = F.when(s == 0, "cafe").when(s == 1, F.when(k % 2 == 0, "wall").otherwise("hedge")).when(s == 2, "tower").when(s == 3, "water").otherwise("x")
    f = X.table(spark, sf, "part").select(k.alias("feature_id"), of(("Point", "LineString", "Polygon"), k % 3).alias("geom_type"), F.create_map(of(("amenity", "barrier", "man_made", "natural", "shop"), s), value).alias("props"))
    return registry.layers_by_rules(f, RULES)


@query("p10_parameter_kinds", "SELECT name, v AS violation FROM (SELECT name, unnest([CASE WHEN dim < 1 OR dim > 300 THEN 'dim' END, CASE WHEN height <= 0 THEN 'height' END, CASE WHEN label NOT IN ('ASIA', 'EUROPE', 'AFRICA') THEN 'label not allowed' END, CASE WHEN depth_scale <> floor(depth_scale) OR depth_scale < 1 THEN 'depth_scale not whole or below 1' END]) AS v FROM reg) WHERE v IS NOT NULL")
def _(spark, sf):
    return registry.parameter_violations(X.regions(spark, sf), "name", [("dim", 1, 300, False), ("height", 0, None, True)], {"label": ("ASIA", "EUROPE", "AFRICA")}, {"depth_scale": 1})


@query("p15_sub_tile_pixel", ", t AS (SELECT pid, (lon + 180) / 360 * 32 AS x, (1 - ln(tan(r) + 1 / cos(r)) / pi()) / 2 * 32 AS y FROM (SELECT *, radians(least(greatest(lat, -85.05), 85.05)) AS r FROM pts)) SELECT pid, floor((x - floor(x)) * 256)::INT AS px, floor((y - floor(y)) * 256)::INT AS py FROM t")
def _(spark, sf):
    px, py = geo.tile_pixel(F.col("lon"), F.col("lat"), F.lit(32.0))
    return X.points(spark, sf).select("pid", px.alias("px"), py.alias("py"))


# Polygons ----------------------------------------------------------------------------------------


def cut_rings(df):
    """Buildings whose upper right corner is cut off: five corners, closed."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return df.withColumn("p", F.array(at(x0, y0), at(x1, y0), at(x1, my), at(mx, y1), at(x0, y1), at(x0, y0)))


UP = "ln(tan(pi() / 4 + radians({}) / 2))"
PENTAGON = f"((radians(x1 - x0) * 6378137) * ({UP.format('y1')} - {UP.format('y0')}) * 6378137 - radians(x1 - (x0 + x1) / 2) * 6378137 * ({UP.format('y1')} - {UP.format('(y0 + y1) / 2')}) * 6378137 / 2)"


@query("v7_polygon_area", f"SELECT feature_id, round({PENTAGON}, 3) + 0::DOUBLE AS area_m2 FROM bld WHERE {PENTAGON} >= 1500")
def _(spark, sf):
    b = cut_rings(X.buildings(spark, sf)).withColumn("a", vector.ring_area("p"))
    return b.where("a >= 1500").select("feature_id", five(F.col("a")).alias("area_m2"))


CORNERS = f", b AS (SELECT *, {HEIGHT} AS h, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM bld), sd AS (SELECT feature_id, h, x0, y0, x1, y1, unnest([x0, x1, x1, mx, x0]) AS ax, unnest([y0, y0, my, y1, y1]) AS aw, unnest([x1, x1, mx, x0, x0]) AS bx, unnest([y0, my, y1, y1, y0]) AS bw FROM b)"
TURN = lambda a, b, c: f"(({b}x - {a}x) * ({c}w - {a}w) - ({b}w - {a}w) * ({c}x - {a}x))"
PAIRS = CORNERS + (
    f", pq AS (SELECT a.feature_id AS u, b.feature_id AS v FROM b a JOIN b ON a.h = b.h AND a.feature_id < b.feature_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), ms AS (SELECT pq.u, pq.v, s.ax, s.aw, s.bx, s.bw, t.ax AS cx, t.aw AS cw, t.bx AS dx, t.bw AS dw FROM pq JOIN sd s ON s.feature_id = u JOIN sd t ON t.feature_id = v), "
    f"mt AS (SELECT DISTINCT u, v FROM ms WHERE least(ax, bx) <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, bx) AND least(aw, bw) <= greatest(cw, dw) AND least(cw, dw) <= greatest(aw, bw) AND {TURN('a', 'b', 'c')} * {TURN('a', 'b', 'd')} <= 0 AND {TURN('c', 'd', 'a')} * {TURN('c', 'd', 'b')} <= 0), "
    "inn AS (SELECT u, v FROM pq JOIN sd s ON s.feature_id = u JOIN b ON b.feature_id = v WHERE (s.aw <= b.y0) <> (s.bw <= b.y0) AND b.x0 < s.ax + (b.y0 - s.aw) / nullif(s.bw - s.aw, 0) * (s.bx - s.ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1 UNION SELECT u, v FROM pq JOIN sd s ON s.feature_id = v JOIN b ON b.feature_id = u WHERE (s.aw <= b.y0) <> (s.bw <= b.y0) AND b.x0 < s.ax + (b.y0 - s.aw) / nullif(s.bw - s.aw, 0) * (s.bx - s.ax) GROUP BY 1, 2 HAVING count(*) % 2 = 1), "
    "pr AS (SELECT u, v FROM mt UNION SELECT u, v FROM inn)"
)


@query("j5_polygon_pairs", PAIRS + " SELECT u, v FROM pr")
def _(spark, sf):
    return vector.intersecting_polygons(cut_rings(houses(spark, sf)).withColumn("parts", F.array("p")), "feature_id", "parts", "h")


@query("c1_dissolve_polygons", recursive(PAIRS, "pr", "(SELECT feature_id AS n FROM b)", "SELECT root, count(*) AS members, min(h) AS h FROM cc JOIN b ON feature_id = node GROUP BY root"))
def _(spark, sf):
    b = cut_rings(houses(spark, sf))
    pairs = vector.intersecting_links(b.withColumn("parts", F.array("p")), "feature_id", "parts", "h").union(b.select("feature_id", "feature_id"))
    c = components.label(pairs)
    return c.join(b.select(F.col("feature_id").alias("node"), "h"), "node").groupBy("root").agg(F.count("*").alias("members"), F.min("h").alias("h"))


@query("v15_network_geometry", "SELECT u, v, CASE WHEN u % 4 = 0 THEN 3 WHEN b.o_orderkey IS NOT NULL THEN 2 END AS points, " + s6("CASE WHEN u % 4 = 0 THEN 7 ELSE a.o_custkey % 100 END") + " AS first_x FROM edg JOIN orders a ON a.o_orderkey = u LEFT JOIN orders b ON b.o_orderkey = v WHERE u % 4 = 0 OR b.o_orderkey IS NOT NULL")
def _(spark, sf):
    nodes = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    own = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (7, 8, 9)))
    e = X.edges(spark, sf).withColumn("geometry", F.when(F.col("u") % 4 == 0, own))
    return vector.network_lines(e, nodes).where("points is not null").select("u", "v", F.size("points").alias("points"), r6(F.col("points")[0]["x"]).alias("first_x"))


@query("v17_open_water", "SELECT p_partkey AS feature_id FROM part WHERE p_size % 4 <> 1")
def _(spark, sf):
    tag = F.when(F.col("p_size") % 4 == 0, "sea").when(F.col("p_size") % 4 == 1, "pond").when(F.col("p_size") % 4 == 2, "bay")
    return vector.open_water(X.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), tag.alias("water")), "water").select("feature_id")


# City layers and triangles -----------------------------------------------------------------------

WATER_ROADS = "(SELECT * FROM road WHERE highway = 'service')"
BANDS = BG + near_sql("road", "feature_id", "0.73") + near_sql(WATER_ROADS, "feature_id", "1.13").replace(", ln AS", ", ln2 AS").replace("FROM ln,", "FROM ln2,").replace("lc AS", "lc2 AS").replace("FROM lc)", "FROM lc2)").replace("lt AS", "lt2 AS").replace("FROM lt ", "FROM lt2 ").replace("near AS", "near2 AS")


def bands(spark, sf):
    b = vector.burn_polygons(house_segments(spark, sf, ("feature_id", "h")), GRID, ["feature_id", "h"]).select("feature_id", "row", "col", F.col("h").alias("value"))
    one = lambda df, d: vector.burn_lines(df, GRID, F.lit(d), []).select("row", "col", F.lit(1.0).alias("value"))
    roads = road_segments(spark, sf)
    return b, one(roads, 0.73), one(roads.where("highway = 'service'"), 1.13)


@query("v12_city_stack", BANDS + f"SELECT row, col, {s6('sum(b)')} AS buildings, {s6('max(r)')} AS roads, {s6('max(w)')} AS waterways, {s6('sum(x)')} AS walls FROM (SELECT row, col, h AS b, 0 AS r, 0 AS w, CASE WHEN feature_id % 10 = 0 THEN 8 ELSE 0 END AS x FROM bc UNION ALL SELECT row, col, 0, 1, 0, 0 FROM near UNION ALL SELECT row, col, 0, 0, 1, 0 FROM near2) GROUP BY 1, 2")
def _(spark, sf):
    b, roads, water = bands(spark, sf)
    walls = b.where("feature_id % 10 = 0").select("row", "col", F.lit(8.0).alias("value"))
    s = vector.city_stack({"buildings": (b, "sum"), "roads": (roads, "max"), "waterways": (water, "max"), "walls": (walls, "sum")})
    return s.select("row", "col", *(r6(c).alias(c) for c in ("buildings", "roads", "waterways", "walls")))


@query("v13_city_heights", BANDS + "SELECT row, col, coalesce(max(h), CASE WHEN max(k) = 1 THEN -0.5 ELSE -2 END)::DOUBLE AS height FROM (SELECT row, col, h, 2 AS k FROM bc UNION ALL SELECT row, col, NULL, 1 FROM near UNION ALL SELECT row, col, NULL, 0 FROM near2) GROUP BY 1, 2")
def _(spark, sf):
    return vector.city_height(*bands(spark, sf))


@query("v18_triangle_filter", f", t AS (SELECT feature_id, (x0 - -75.171::DOUBLE) / (-75.138::DOUBLE - -75.171::DOUBLE) * 128 AS xa, (x1 - -75.171::DOUBLE) / (-75.138::DOUBLE - -75.171::DOUBLE) * 128 AS xb, (39.961::DOUBLE - y0) / (39.961::DOUBLE - 39.949::DOUBLE) * 128 AS ya, (39.961::DOUBLE - y1) / (39.961::DOUBLE - 39.949::DOUBLE) * 128 AS yc, {HEIGHT} AS z FROM bld) SELECT feature_id FROM t WHERE z >= 12 AND abs((xb - xa) * (yc - ya)) / 2 >= 2.5")
def _(spark, sf):
    b = vector.to_grid(houses(spark, sf), AREA_BOX, GRID, [("x0", "y0"), ("x1", "y1")]).select("feature_id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("cy"), F.col("h").alias("z"))
    t = b.select("feature_id", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("ay").alias("y2"), F.col("ax").alias("x3"), F.col("cy").alias("y3"), "z")
    return vector.worth_drawing(t, GRID, 12, 2.5).select("feature_id")


@query("j3_building_z_at_centroid", f", p AS (SELECT feature_id, {HEIGHT} AS h, {SAMPLE.format(lat='((y0 + y1) / 2 - 39.95) * 10000', lon='((x0 + x1) / 2 + 75.155) * 8000')} FROM bld) SELECT feature_id, 0::DOUBLE AS z0, {s6('h + coalesce(value, 0) + 1')} AS z1 FROM p LEFT JOIN li USING (row, col)")
def _(spark, sf):
    at = lambda x: F.least(F.greatest(F.bround(x, 0), F.lit(0.0)), F.lit(127.0)).cast("int")
    # The city's centroids, spread over the world's grid.
    lat, lon = ((F.col("y0") + F.col("y1")) / 2 - 39.95) * 10000, ((F.col("x0") + F.col("x1")) / 2 + 75.155) * 8000
    p = houses(spark, sf).select("feature_id", "h", at((90 - lat) / 180 * 127).alias("row"), at((lon + 180) / 360 * 127).alias("col"))
    return p.join(X.li(spark, sf), ["row", "col"], "left").select("feature_id", F.lit(0.0).alias("z0"), r6(F.col("h") + F.coalesce("value", F.lit(0.0)) + 1).alias("z1"))


# Meshes and reports ------------------------------------------------------------------------------


@query("m3_ring_prisms", "SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN 12 ELSE 10 END AS walls, CASE WHEN feature_id % 3 = 0 THEN 0 ELSE 3 END AS roof, feature_id % 3 <> 0 AS convex, CASE WHEN feature_id % 3 = 0 THEN 11 ELSE 9 END AS high FROM bld")
def _(spark, sf):
    b = cut_rings(X.buildings(spark, sf))
    dent = F.struct(((F.col("x0") * 3 + F.col("x1")) / 4).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    open_ = F.slice("p", 1, 5)
    f = vector.ring_prisms(b.withColumn("q", F.when(F.col("feature_id") % 3 == 0, F.concat(open_, F.array(dent))).otherwise(open_)), "feature_id", "q")
    n = lambda part: F.count_if(F.col("part") == part).cast("int")
    return f.groupBy("feature_id").agg(n("wall").alias("walls"), n("roof").alias("roof"), F.bool_and("convex").alias("convex"), F.max(F.greatest("a", "b", "c")).alias("high"))


@query("m5_split_faces", ", m AS (SELECT max(row) AS mr FROM emb), f AS (SELECT row + CASE k WHEN 0 THEN 1 ELSE 2 END / 3::DOUBLE AS y, col + CASE k WHEN 0 THEN 1 ELSE 2 END / 3::DOUBLE AS x, mr FROM emb, range(2) t(k), m WHERE row < mr AND col < 63) SELECT least(floor(round(x / 63 * 4, 9)), 3)::INT AS px, least(floor(round(y / mr * 3, 9)), 2)::INT AS py, count(*) AS n FROM f GROUP BY 1, 2")
def _(spark, sf):
    e = X.emb(spark, sf)
    top = X.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    faces = vector.surface_faces((int(top), 64), e)
    corners = e.select((F.col("row") * 64 + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return vector.split_faces(faces, corners, 4, 3).groupBy("px", "py").agg(F.count("*").alias("n"))


@query("m6_model_z", f"SELECT row, col, {s6('4 + (value - lo) / (hi - lo) * 25')} AS value FROM li, (SELECT min(value) lo, max(value) hi FROM li)")
def _(spark, sf):
    return vector.model_z(X.li(spark, sf), 4.0, 25.0).select("row", "col", r6("value").alias("value"))


@query("m7_concatenated_faces", ", v AS (SELECT p_size AS mesh, p_partkey AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS id FROM part), s AS (SELECT mesh, count(*) AS n, min(k)::DOUBLE AS lo, max(k)::DOUBLE AS hi FROM v GROUP BY mesh), o AS (SELECT mesh, n, lo, hi, coalesce(sum(n) OVER (ORDER BY mesh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM s) SELECT mesh, id + first AS a, (id + 1) % n + first AS b, (id + 2) % n + first AS c, lo AS min_x, hi AS max_x FROM v JOIN o USING (mesh)")
def _(spark, sf):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("mesh").orderBy("p_partkey")) - 1
    v = X.table(spark, sf, "part").select(F.col("p_size").alias("mesh"), "p_partkey").withColumn("id", at)
    v = v.select("mesh", "id", F.col("p_partkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    n = F.count("*").over(Window.partitionBy("mesh"))
    faces = v.withColumn("n", n).select("mesh", F.col("id").cast("long").alias("a"), ((F.col("id") + 1) % F.col("n")).alias("b"), ((F.col("id") + 2) % F.col("n")).alias("c"))
    offsets, moved = vector.concatenated(v, faces, "mesh")
    return moved.join(offsets.select("mesh", "min_x", "max_x"), "mesh").select("mesh", "a", "b", "c", "min_x", "max_x")


@query("a11_simplification", f"SELECT height_tag IS NULL AS plain, count(*) AS features, sum(6)::BIGINT AS vertices_before, sum(5)::BIGINT AS vertices_after, round(sum({PENTAGON}), 1) AS area_before, {s6('100 * (6 - 5) / 6::DOUBLE')} AS vertices_gone FROM bld GROUP BY 1")
def _(spark, sf):
    b = cut_rings(X.buildings(spark, sf)).withColumn("q", F.filter("p", lambda p, i: i != 2)).withColumn("plain", F.col("height_tag").isNull())
    r = vector.simplification(b, "plain", "p", "q")
    return r.select("plain", "features", "vertices_before", "vertices_after", F.round("area_before", 1).alias("area_before"), r6("vertices_gone").alias("vertices_gone"))


@query("t2_misses_within_ttl", ", o AS (SELECT key, namespace, cached_at, row_number() OVER (PARTITION BY key, namespace ORDER BY cached_at) AS n FROM req), w AS (SELECT key, namespace, cached_at, n, cached_at AS miss FROM o WHERE n = 1 UNION ALL SELECT o.key, o.namespace, o.cached_at, o.n, CASE WHEN o.cached_at >= w.miss + INTERVAL '36 hours' THEN o.cached_at ELSE w.miss END FROM w JOIN o ON o.key = w.key AND o.namespace IS NOT DISTINCT FROM w.namespace AND o.n = w.n + 1) SELECT DISTINCT key, namespace, miss AS at FROM w")
def _(spark, sf):
    return live.misses_within(X.requests(spark, sf), 36 * 3600)
