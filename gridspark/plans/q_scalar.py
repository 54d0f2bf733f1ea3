"""Scans and scalar rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import names, registry, scan
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


TILE_PATH = """ , tl AS (SELECT DISTINCT 't_n' || (90 - (row // 16) * 22.5)::DECIMAL(5,1) || '_s' || (90 - (row // 16 + 1) * 22.5)::DECIMAL(5,1) || '_w' || (-180 + (col // 16) * 45.0)::DECIMAL(5,1) || '_e' || (-180 + (col // 16 + 1) * 45.0)::DECIMAL(5,1) || '.tif' AS path FROM li)"""


def tile_paths(spark, sf):
    n = lambda x: F.format_string("%.1f", x)
    tr, tc = F.floor(F.col("row") / 16), F.floor(F.col("col") / 16)
    return X.li(spark, sf).select(F.concat(F.lit("t_n"), n(90 - tr * 22.5), F.lit("_s"), n(90 - (tr + 1) * 22.5), F.lit("_w"), n(-180 + tc * 45.0), F.lit("_e"), n(-180 + (tc + 1) * 45.0), F.lit(".tif")).alias("path"), tr.alias("tr"), tc.alias("tc")).distinct()


EXTENT = r"regexp_extract(path, '_?{k}(-?[0-9.]+?)\.?(_|\.tif|$)', 1)::DOUBLE AS {name}"


@query("s1_tile_catalog", TILE_PATH + "SELECT path, " + ", ".join(f"regexp_extract(path, '{k}(-?[0-9]+\\.[0-9]+)', 1)::DOUBLE AS {n}" for k, n in (("_n", "north"), ("_s", "south"), ("_w", "west"), ("_e", "east"))) + " FROM tl")
def _(spark, sf):
    return scan.extent_of_name(tile_paths(spark, sf).select("path"), "path")


@query("s2_mosaic", ", b AS (SELECT 60.0 AS n, -50.0 AS s, 100.0 AS e, -100.0 AS w) SELECT row - 22 AS row, col - 29 AS col, value FROM li WHERE row BETWEEN 22 AND 98 AND col BETWEEN 29 AND 98")
def _(spark, sf):
    tiles = scan.to_tiles(X.li(spark, sf), 16)
    return scan.mosaic(tiles, 16, rows=(22, 98), cols=(29, 98))


@query("s3_tile_address", f"SELECT pid, (floor(lon / 5) + 37)::INT AS tx, (floor(-lat / 5) + 13)::INT AS ty, floor((lon / 5 - floor(lon / 5)) * 6000)::INT AS px, floor((-lat / 5 - floor(-lat / 5)) * 6000)::INT AS py FROM pts")
def _(spark, sf):
    return X.points(spark, sf).select("pid", *(c.alias(n) for n, c in geo.tile_address(F.col("lon"), F.col("lat")).items()))


@query("s4_tile_origin", "SELECT o_orderkey AS k, round_even(180::DOUBLE * (o_orderkey % 72 + 1 - 37) / 36 + round_even(o_custkey % 6000 / 6000::DOUBLE * 5, 4), 6) + 0::DOUBLE AS lon, round_even(-(60::DOUBLE * (o_orderkey % 24 + 1 - 13) / 12 + round_even(o_orderkey % 6000 / 6000::DOUBLE * 5, 4)), 6) + 0::DOUBLE AS lat FROM orders")
def _(spark, sf):
    o = X.table(spark, sf, "orders")
    p = geo.tile_origin(F.col("o_orderkey") % 72 + 1, F.col("o_orderkey") % 24 + 1, F.col("o_custkey") % 6000, F.col("o_orderkey") % 6000)
    return o.select(F.col("o_orderkey").alias("k"), *((c + F.lit(0.0)).alias(n) for n, c in p.items()))


@query("s5_section_read", ", g AS (SELECT r::INT AS row, c::INT AS col FROM range(100, 150) a(r), range(100, 150) b(c)) SELECT row, col, greatest(coalesce(value, 0), 0)::DOUBLE AS value FROM g LEFT JOIN li USING (row, col)")
def _(spark, sf):
    return scan.section(scan.to_tiles(X.li(spark, sf), 16), 16, rows=(100, 150), cols=(100, 150))


@query("s5_missing_tiles", ", g AS (SELECT r::INT AS tr, c::INT AS tc FROM range(0, 10) a(r), range(0, 10) b(c)) SELECT tr, tc FROM g WHERE NOT EXISTS (SELECT 1 FROM li WHERE row // 16 = tr AND col // 16 = tc)")
def _(spark, sf):
    return scan.missing_tiles(scan.to_tiles(X.li(spark, sf), 16), (0, 10), (0, 10))


@query("s6_tile_index_to_regions", "SELECT o_orderkey AS k, greatest(a, b) AS north, least(a, b) AS south FROM (SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE (o_custkey % 90)::VARCHAR END AS DOUBLE) AS a, (o_orderkey % 90)::DOUBLE AS b FROM orders) t(o_orderkey, a, b) WHERE a IS NOT NULL AND a <> b")
def _(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise((F.col("o_custkey") % 90).cast("string")).alias("a"), (F.col("o_orderkey") % 90).cast("string").alias("b"))
    return scan.ordered_pairs(o, "a", "b").select("k", "north", "south")


@query("s7_unique_names", ", x AS (SELECT o_orderkey AS k, o_orderpriority AS base, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT k, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS name FROM x")
def _(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("base"))
    return names.unique_names(o, "base", "k").select("k", "name")


@query("s8_legacy_regions", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.params.dim') AS INT), try_cast(json_extract_string(props, '$.k') AS INT), 600) AS dim, 25::DOUBLE AS height, 5::DOUBLE AS base FROM req")
def _(spark, sf):
    return scan.legacy_regions(X.requests(spark, sf), "props").select("event_id", "dim", "height", "base")


@query("s9_geojson_features", "SELECT feature_id, 'Polygon' AS geom_type, 5 AS n_points, height_tag FROM bld")
def _(spark, sf):
    b = X.buildings(spark, sf)
    ring = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), geometry.alias("geometry"), F.struct(F.col("height_tag").alias("height")).alias("properties"))
    docs = b.groupBy(F.floor(F.col("feature_id") / 1000).alias("doc"))  # 1,000 features a document at most
    docs = docs.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("json"))
    return scan.geojson_polygons(docs, "json").select("feature_id", "geom_type", F.size(F.flatten("parts")).alias("n_points"), F.col("props.height").alias("height_tag"))


@query("s10_river_tiers", "SELECT reach_id, CASE WHEN ord_stra >= 3 THEN 1 ELSE 0 END AS tier, least(x1, xm, x2) AS min_x, greatest(x1, xm, x2) AS max_x, least(y1, ym, y2) AS min_y, greatest(y1, ym, y2) AS max_y FROM riv")
def _(spark, sf):
    return scan.with_cover(X.rivers(spark, sf)).select("reach_id", "tier", "min_x", "max_x", "min_y", "max_y")


@query("s11_array_store", "SELECT row, col, value::FLOAT::DOUBLE AS value FROM li")
def _(spark, sf):
    return X.li(spark, sf).select("row", "col", F.col("value").cast("float").cast("double").alias("value"))


SETS = [name for name, _ in scan.DATASETS] + ["local", "unknown"]


@query("s12_source_catalog", f", u AS (SELECT {SETS}[(key % 8 + 1)::INT] AS dataset FROM req), c(dataset, resolution_m, available) AS (VALUES " + ", ".join(f"('{n}', {m}, false)" for n, m in scan.DATASETS) + ", ('local', 90, true)) SELECT dataset, resolution_m, coalesce(available, false) AS available, count(*) AS requests FROM u LEFT JOIN c USING (dataset) GROUP BY ALL")
def _(spark, sf):
    uses = X.requests(spark, sf).select(F.element_at(F.array(*map(F.lit, SETS)), (F.col("key") % 8 + 1).cast("int")).alias("dataset"))
    return scan.available_sources(uses, "dataset", spark, has_key=False).groupBy("dataset", "resolution_m", "available").agg(F.count("*").alias("requests"))


@query("p1_box_validation", "SELECT reach_id, CASE WHEN x2 IS NULL THEN 'missing' WHEN y2 <= y1 THEN 'north<=south' WHEN x2 <= x1 THEN 'east<=west' END AS reason FROM riv")
def _(spark, sf):
    return X.rivers(spark, sf).select("reach_id", geo.box_problem(F.col("y2"), F.col("y1"), F.col("x2"), F.col("x1")).alias("reason"))


@query("p2_tolerant_parsing", "SELECT feature_id, coalesce(try_cast(nullif(height_tag, '') AS DOUBLE), -1) AS f, coalesce(trunc(try_cast(levels_tag || '.9' AS DOUBLE))::INT, 7) AS i, CASE WHEN levels_tag IS NULL THEN true ELSE levels_tag IN ('1') END AS b FROM bld")
def _(spark, sf):
    return X.buildings(spark, sf).select("feature_id", geo.to_float(F.col("height_tag"), -1.0).alias("f"), geo.to_int(F.concat("levels_tag", F.lit(".9")), 7).alias("i"), geo.to_bool(F.col("levels_tag"), True).alias("b"))


DIAG = "6371 * sqrt(pow(radians(north - south), 2) + pow(radians(east - west) * cos(radians((north + south) / 2)), 2))"


@query("p3_diagonal", f"SELECT name, {s6(DIAG)} AS km, {DIAG} <= 15 AS city FROM reg")
def _(spark, sf):
    km = geo.diagonal_km(*(F.col(c) for c in ("north", "south", "east", "west")))
    return X.regions(spark, sf).select("name", r6(km).alias("km"), (km <= 15).alias("city"))


@query("p4_point_to_cell", "SELECT pid, least(greatest(floor((90 - lat) / 180 * 128), 0), 127)::INT AS row, least(greatest(floor((lon + 180) / 360 * 128), 0), 127)::INT AS col FROM pts")
def _(spark, sf):
    row, col = geo.cell_of(F.col("lon"), F.col("lat"), X.WORLD, 128, 128)
    return X.points(spark, sf).select("pid", row.alias("row"), col.alias("col"))


@query("p5_feature_box_filter", "SELECT reach_id FROM riv WHERE greatest(x1, xm, x2) >= -20 AND least(x1, xm, x2) <= 55 AND greatest(y1, ym, y2) >= -35 AND least(y1, ym, y2) <= 38")
def _(spark, sf):
    return scan.within_box(scan.with_cover(X.rivers(spark, sf)), (38.0, -35.0, 55.0, -20.0)).select("reach_id")


@query("p6_regions_by_box", ", t AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {n}::DOUBLE)" for c, (w, s, e, n) in registry.RIVER_REGIONS.items()) + ") t(code, w, s, e, n)) SELECT name, code FROM reg, t WHERE reg.west < e AND reg.east > w AND reg.south < n AND reg.north > s")
def _(spark, sf):
    return registry.river_regions(X.regions(spark, sf)).select("name", "code")


@query("p7_strahler_filter", "SELECT reach_id, ord_stra FROM riv WHERE coalesce(ord_stra, 1) >= greatest(1, least(9, 3))")
def _(spark, sf):
    return X.rivers(spark, sf).where(F.coalesce("ord_stra", F.lit(1)) >= max(1, min(9, 3))).select("reach_id", "ord_stra")


@query("p8_tag_rules", ", r(layer, key, value) AS (VALUES ('main', 'highway', 'motorway'), ('main', 'highway', 'primary'), ('local', 'highway', 'residential'), ('local', 'highway', 'service')) SELECT feature_id, layer FROM road JOIN r ON highway = value")
def _(spark, sf):
    rules = [("main", "highway", "motorway"), ("main", "highway", "primary"), ("local", "highway", "residential"), ("local", "highway", "service")]
    f = X.roads(spark, sf).select("feature_id", F.map_filter(F.create_map(F.lit("highway"), "highway"), lambda k, v: v.isNotNull()).alias("props"))
    return registry.layers_by_tags(f, rules).select("feature_id", "layer")


AREA = "(radians(x1 - x0) * 6378137) * (ln(tan(pi() / 4 + radians(y1) / 2)) - ln(tan(pi() / 4 + radians(y0) / 2))) * 6378137"


@query("p9_minimum_area", f"SELECT feature_id, round({AREA}, 3) AS area_m2 FROM bld WHERE {AREA} >= 2000")
def _(spark, sf):
    (xa, ya), (xb, yb) = geo.mercator_xy(F.col("x0"), F.col("y0")), geo.mercator_xy(F.col("x1"), F.col("y1"))
    area = (xb - xa) * (yb - ya)
    return X.buildings(spark, sf).where(area >= 2000).select("feature_id", F.round(area, 3).alias("area_m2"))


@query("p10_region_parameters", "SELECT name, v AS violation FROM (SELECT name, unnest([CASE WHEN dim < 1 OR dim > 300 THEN 'dim' END, CASE WHEN water_scale < 0 OR water_scale > 1 THEN 'water_scale' END, CASE WHEN height <= 0 THEN 'height' END]) AS v FROM reg) WHERE v IS NOT NULL")
def _(spark, sf):
    return registry.violations(X.regions(spark, sf), [("dim", 1, 300, False), ("water_scale", 0, 1, False), ("height", 0, None, True)], "name")


@query("p11_settings_overlay", "SELECT event_id, g AS grp, k AS key, coalesce(CASE WHEN k = 'k' THEN json_extract_string(props, '$.k') END, d) AS value FROM req, (VALUES ('view', 'k', '0'), ('view', 'zoom', '3'), ('dem', 'dim', '600')) t(g, k, d)")
def _(spark, sf):
    saved = X.requests(spark, sf).select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    ids = X.requests(spark, sf).select("event_id")
    return registry.overlay(ids, saved, [("view", "k", "0"), ("view", "zoom", "3"), ("dem", "dim", "600")], "event_id")


@query("p12_auto_scale", f"SELECT name, CASE WHEN km <= 10 THEN 10 WHEN km <= 30 THEN 30 WHEN km <= 100 THEN 100 WHEN km <= 500 THEN 500 ELSE 1000 END AS sat_scale, CASE WHEN km <= 10 THEN 600 WHEN km <= 50 THEN 500 WHEN km <= 200 THEN 300 ELSE 200 END AS dim FROM (SELECT name, {DIAG} / 200 AS km FROM reg)")
def _(spark, sf):
    km = geo.diagonal_km(*(F.col(c) for c in ("north", "south", "east", "west"))) / 200
    return X.regions(spark, sf).select("name", geo.by_size(km, geo.SAT_SCALES).alias("sat_scale"), geo.by_size(km, geo.DIMS).alias("dim"))


@query("p13_scale_clamp", "SELECT name, greatest(10::DOUBLE, ceil(sqrt(w * h / 25165824)), ceil(w / 32768), ceil(h / 32768)) AS scale FROM (SELECT name, (east - west) * 111320 * cos(radians((north + south) / 2)) AS w, (north - south) * 111320 AS h FROM reg)")
def _(spark, sf):
    w = (F.col("east") - F.col("west")) * geo.METRES_PER_DEGREE * F.cos(F.radians((F.col("north") + F.col("south")) / 2))
    return X.regions(spark, sf).select("name", geo.clamp_scale(w, (F.col("north") - F.col("south")) * geo.METRES_PER_DEGREE, F.lit(10)).alias("scale"))


WTILE = "trunc(({lon} + 180) / 360 * n)::INT"
HTILE = "trunc((1 - ln(tan(radians(least(greatest({lat}, -85.05), 85.05))) + 1 / cos(radians(least(greatest({lat}, -85.05), 85.05)))) / pi()) / 2 * n)::INT"


@query("p14_optimal_zoom", f""", z AS (SELECT name, north, south, east, west, z, pow(2, z) AS n, greatest(1, sqrt(pow((east - west) * 111320 * cos(radians((north + south) / 2)), 2) + pow((north - south) * 111320, 2)) / (600 * sqrt(2))) AS m FROM reg, range(6, 19) t(z)),
t AS (SELECT name, z, greatest(6, least(18, round_even(log2(40075000 / (256 * m)), 0))) AS z0, greatest(abs({WTILE.format(lon='east')} - {WTILE.format(lon='west')}) + 1, abs({HTILE.format(lat='north')} - {HTILE.format(lat='south')}) + 1) AS span FROM z)
SELECT name, coalesce(max(z) FILTER (span <= 64 AND z <= z0), 6)::INT AS zoom FROM t GROUP BY name""")
def _(spark, sf):
    return scan.optimal_zoom(X.regions(spark, sf), 600).select("name", "zoom")


@query("p15_slippy_tiles", f", z AS (SELECT *, 8 AS n FROM reg), t AS (SELECT name, {WTILE.format(lon='west')} AS xa, {WTILE.format(lon='east')} AS xb, {HTILE.format(lat='north')} AS ya, {HTILE.format(lat='south')} AS yb FROM z) SELECT name, x::INT AS x, y::INT AS y FROM t, unnest(range(xa, xb + 1)) a(x), unnest(range(ya, yb + 1)) b(y)")
def _(spark, sf):
    return scan.covering_tiles(X.regions(spark, sf), 3).select("name", "x", "y")


@query("p16_hemisphere_text", "SELECT pid, lat + 0::DOUBLE AS lat FROM (SELECT pid, CASE WHEN lat < 0 THEN -abs(lat) ELSE abs(lat) END AS lat FROM pts)")
def _(spark, sf):
    p = X.points(spark, sf).withColumn("t", F.concat(F.when(F.col("lat") < 0, "S").otherwise("N"), F.abs("lat").cast("string")))
    return p.select("pid", (geo.hemisphere(F.col("t")) + F.lit(0.0)).alias("lat"))


@query("p17_cache_key", "SELECT name, md5('dem:N' || printf('%.4f', north) || '_S' || printf('%.4f', south) || '_E' || printf('%.4f', east) || '_W' || printf('%.4f', west) || ':{\"dim\":' || dim || '}') AS key FROM reg")
def _(spark, sf):
    return X.regions(spark, sf).select("name", geo.cache_key(F.lit("dem"), tuple(F.col(c) for c in ("north", "south", "east", "west")), F.to_json(F.struct("dim"))).alias("key"))


@query("p18_continent", f"SELECT pid, {geo.continent_case()} AS continent FROM pts")
def _(spark, sf):
    return X.points(spark, sf).select("pid", F.expr(geo.continent_case()).alias("continent"))


@query("p21_river_depth", f"SELECT reach_id, {s6('-5 * pow(ord_stra / 9::DOUBLE, 1.5)')} AS depth, {s6('greatest(0.6 * 0.1, 0.6 * 0.1 * ord_stra / 3)')} AS buffer FROM riv")
def _(spark, sf):
    return X.rivers(spark, sf).select("reach_id", r6(geo.river_depth(-5.0, F.col("ord_stra"), 1.5)).alias("depth"), r6(geo.river_buffer(0.1, F.col("ord_stra"))).alias("buffer"))


@query("k1_region_merge", ", c AS (SELECT event_id AS seq, 'R' || (key % 40) AS name, hit, size_bytes FROM req), l AS (SELECT name, arg_max(hit, seq) AS put, arg_max(size_bytes, seq) AS v FROM c GROUP BY name) SELECT name, v FROM l WHERE put UNION ALL SELECT name, dim::BIGINT FROM reg WHERE name NOT IN (SELECT name FROM l)")
def _(spark, sf):
    changes = X.requests(spark, sf).select(F.col("event_id").alias("seq"), F.concat(F.lit("R"), F.col("key") % 40).alias("name"), "hit", F.col("size_bytes").alias("v"))
    return registry.merge(X.regions(spark, sf).select("name", F.col("dim").cast("long").alias("v")), changes, "name", "seq", "hit")


TTLS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in registry.TTL.items()) + ") t(namespace, ttl)"


@query("k2_cache_prune", f", j AS (SELECT req.*, ttl, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(cached_at) AS age FROM req JOIN {TTLS} USING (namespace)), r AS (SELECT *, row_number() OVER (PARTITION BY namespace, age <= ttl ORDER BY cached_at DESC, event_id DESC) AS n FROM j) SELECT namespace, count(*) FILTER (age > ttl) AS stale, count(*) FILTER (age <= ttl AND n > 200) AS excess FROM r GROUP BY namespace")
def _(spark, sf):
    gone = registry.prune(X.requests(spark, sf), F.lit("2024-01-31 00:00:00").cast("timestamp"), 200)
    return gone.groupBy("namespace").agg(F.count_if(F.col("why") == "stale").alias("stale"), F.count_if(F.col("why") == "excess").alias("excess"))


@query("k3_cache_clear", "SELECT namespace, count(*) AS entries, sum(size_bytes)::BIGINT AS bytes FROM req GROUP BY namespace")
def _(spark, sf):
    return X.requests(spark, sf).groupBy("namespace").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("bytes"))


@query("a10_region_groups", f", g AS (SELECT coalesce(nullif(trim(CASE WHEN dim % 20 = 0 THEN label ELSE '' END), ''), c) AS continent, name FROM (SELECT *, {geo.continent_case()} AS c FROM (SELECT *, (north + south) / 2 AS lat, (east + west) / 2 AS lon FROM reg))) SELECT continent, string_agg(name, ',' ORDER BY name) AS names, coalesce(nullif(list_position({list(geo.CONTINENT_ORDER)}, continent), 0), 9)::INT AS position FROM g GROUP BY continent")
def _(spark, sf):
    r = X.regions(spark, sf).withColumn("label", F.when(F.col("dim") % 20 == 0, F.col("label")).otherwise(""))
    return registry.by_continent(r).select("continent", F.array_join("names", ",").alias("names"), "position")


@query("a14_cache_status", ", r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY cached_at DESC, event_id DESC) AS n FROM req) SELECT namespace, count(*) AS entries, sum(size_bytes)::BIGINT AS bytes, string_agg(event_id, ',' ORDER BY n) FILTER (n <= 5) AS recent, string_agg((floor(epoch(TIMESTAMP '2024-01-31 00:00:00'))::BIGINT - floor(epoch(cached_at))::BIGINT)::VARCHAR, ',' ORDER BY n) FILTER (n <= 5) AS ages FROM r GROUP BY namespace")
def _(spark, sf):
    return registry.cache_status(X.requests(spark, sf), 5, F.lit("2024-01-31 00:00:00"))


@query("a15_hit_rate", f"SELECT namespace, count(*) FILTER (hit) AS hits, {s6('count(*) FILTER (hit) / count(*)')} AS rate FROM req GROUP BY namespace")
def _(spark, sf):
    return X.requests(spark, sf).groupBy("namespace").agg(F.count_if("hit").alias("hits"), r6(F.try_divide(F.count_if("hit"), F.count("*"))).alias("rate"))


@query("o1_region_order", "SELECT name, row_number() OVER (ORDER BY name)::INT AS n FROM reg")
def _(spark, sf):
    return X.regions(spark, sf).select("name", F.row_number().over(W.orderBy("name")).alias("n"))  # 25 rows: the registry is small by nature


@query("o2_recent_files", "SELECT event_id, cached_at FROM req ORDER BY cached_at DESC, event_id DESC LIMIT 200")
def _(spark, sf):
    return X.requests(spark, sf).select("event_id", "cached_at").orderBy(F.desc("cached_at"), F.desc("event_id")).limit(200)


@query("j6_regions_with_settings", "SELECT name, coalesce(s, '{}') AS settings FROM reg LEFT JOIN (SELECT 'x' AS z, n_name AS nn, '{\"k\": ' || n_nationkey || '}' AS s FROM nation WHERE n_nationkey % 3 = 0) t ON name = nn")
def _(spark, sf):
    s = X.table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit('{"k": '), "n_nationkey", F.lit("}")).alias("settings"))
    return registry.with_settings(X.regions(spark, sf).select("name"), s)


@query("j7_cache_lookup", ", last AS (SELECT namespace, key, max(cached_at) AS last_at FROM req GROUP BY 1, 2), want AS (SELECT DISTINCT 'dem' AS namespace, key + 5 AS key FROM req) SELECT key, last_at IS NOT NULL AS cached FROM want LEFT JOIN (SELECT * FROM last WHERE last_at >= TIMESTAMP '2024-01-20 00:00:00') l USING (namespace, key)")
def _(spark, sf):
    r = X.requests(spark, sf)
    want = r.select(F.lit("dem").alias("namespace"), (F.col("key") + 5).alias("key")).distinct()
    have, miss = registry.lookup(want, r, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return have.select("key", F.lit(True).alias("cached")).union(miss.select("key", F.lit(False)))


@query("j8_best_resolution", ", c AS (SELECT key, min(size_bytes) AS scale, event_id FROM req WHERE namespace = 'satellite' GROUP BY key, event_id) SELECT o_orderkey, min(c.scale) AS best, max(c.scale) AS nearest FROM (SELECT o_orderkey, o_custkey AS key, (o_orderkey * 97 % 60000) AS want FROM orders) o JOIN c ON c.key = o.key AND c.scale <= o.want GROUP BY 1")
def _(spark, sf):
    have = X.requests(spark, sf).where("namespace = 'satellite'").groupBy("key", "event_id").agg(F.min("size_bytes").alias("scale"))
    want = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 97 % 60000).alias("want"))
    return registry.best_at_most(want, have, "key", "want", "scale", ["o_orderkey"]).groupBy("o_orderkey").agg(F.min("best").alias("best"), F.max("nearest").alias("nearest"))


@query("j9_highway_width", "SELECT feature_id, coalesce(w, 3)::DOUBLE AS width_m FROM road LEFT JOIN (VALUES ('motorway', 12), ('residential', 4), ('service', 2), ('primary', 8)) t(h, w) ON highway = h")
def _(spark, sf):
    return registry.road_width(X.roads(spark, sf)).select("feature_id", "width_m")


@query("u1_union_reaches", "SELECT reach_id FROM riv WHERE x1 < 30 OR x1 > -30")
def _(spark, sf):
    r = X.rivers(spark, sf).select("reach_id", "x1")
    return r.where("x1 < 30").unionByName(r.where("x1 > -30")).dropDuplicates(["reach_id"]).select("reach_id")


@query("u2_new_names", "SELECT DISTINCT n_name AS name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 10)")
def _(spark, sf):
    n = X.table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("name")).distinct().join(n.where("n_nationkey < 10").select(F.col("n_name").alias("name")), "name", "left_anti")
