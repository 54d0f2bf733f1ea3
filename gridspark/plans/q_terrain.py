"""Layer processing, merging, masks, edge maps, registration and projections in all their modes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspark.operators import raster, terrain, zonal
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql
from gridspark.plans.q_more import COS
from gridspark.plans.q_raster import CASES, LATS, LAYER, MY, OPENED, RGB, emb_shape, layer, out, rgb, smooth_ctes, v

Q, S = {}, {}
GRID = (128, 128)


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


# Processing and merging ------------------------------------------------------------------------

STEPS = terrain.Steps(least=-150, most=200, sigma=1.0, sharpen=True, normalise=True, invert=True)


@query("r6_all_steps", ", c AS (SELECT row, col, least(greatest(value, -150), 200) AS value FROM emb)" + smooth_ctes(1.0, "c", "a") + smooth_ctes(1.5, "g2a", "b") + ", sh AS (SELECT row, col, g2a.value + 0.5 * (g2a.value - g2b.value) AS value FROM g2a JOIN g2b USING (row, col)), n AS (SELECT row, col, (value - lo) / (hi - lo) AS value FROM sh, (SELECT min(value) lo, max(value) hi FROM sh)) " + v("hi - value + lo") + " FROM n, (SELECT min(value) lo, max(value) hi FROM n)")
def _(spark, sf):
    return out(terrain.process(X.emb(spark, sf), emb_shape(spark, sf), STEPS))


@query("r6_thin_steps", OPENED + "SELECT m.row, m.col, (NOT (m.value = 1 AND o.value = 0))::INT::DOUBLE AS value FROM m JOIN o USING (row, col)")
def _(spark, sf):
    layer_ = X.emb(spark, sf).select("row", "col", F.when(F.col("value") > -60, 1.0).otherwise(0.0).alias("value"))
    return terrain.process(layer_, emb_shape(spark, sf), terrain.Steps(thin=3, invert=True))


def bil(src: str, name: str, n: int, dst: int) -> str:
    """name: the n x n layer src at dst x dst, bilinear about cell centres."""
    at = lambda c: f"least(greatest(({c} + 0.5) * {n / dst!r}::DOUBLE - 0.5, 0), {n - 1})::DOUBLE"
    return f", k{name} AS (SELECT r::INT AS row, c::INT AS col, {at('r')} AS y, {at('c')} AS x FROM range({dst}) p(r), range({dst}) q(c)), w{name} AS (SELECT row, col, least(floor(y)::INT + dy, {n - 1}) AS sr, least(floor(x)::INT + dx, {n - 1}) AS sc, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM k{name}, range(2) a(dy), range(2) b(dx)), {name} AS (SELECT w.row, w.col, sum(w * value) AS value FROM w{name} w JOIN {src} s ON s.row = sr AND s.col = sc WHERE w > 0 GROUP BY 1, 2)"


@query("r8_merge_processed", LAYER + ", c1 AS (SELECT row, col, least(greatest(value, -200), 300) AS value FROM li), c2 AS (SELECT row, col, (value - lo) / (hi - lo) AS value FROM ly, (SELECT min(value) lo, max(value) hi FROM ly)), c3 AS (SELECT row, col, hi - value + lo AS value FROM li, (SELECT min(value) lo, max(value) hi FROM li))" + bil("c1", "b1", 128, 70) + bil("c2", "b2", 128, 70) + bil("c3", "b3", 128, 70) + ", x1 AS (SELECT b1.row, b1.col, CASE WHEN b2.value IS NULL THEN b1.value ELSE b1.value * 0.7::DOUBLE + b2.value * 0.3::DOUBLE END AS value FROM b1 LEFT JOIN b2 USING (row, col)) " + v("CASE WHEN b3.value IS NULL THEN x1.value ELSE greatest(x1.value, b3.value) END").replace("SELECT row, col", "SELECT x1.row, x1.col") + " FROM x1 LEFT JOIN b3 USING (row, col)")
def _(spark, sf):
    li = X.li(spark, sf)
    layers = [(li, GRID, terrain.Steps(least=-200, most=300), "base", 1.0), (layer(spark, sf), GRID, terrain.Steps(normalise=True), "blend", 0.3), (li, GRID, terrain.Steps(invert=True), "max", 1.0)]
    return out(terrain.merge(layers, 70)[0])


@query("r10_water_occurrence", ", oc AS (SELECT row, col, (row * 13 + col * 7) % 101 AS value FROM cover WHERE (row + col) % 9 <> 0) SELECT row, col, (coalesce(oc.value > 50, false) OR coalesce(li.value < -2, false))::INT AS water FROM cover LEFT JOIN oc USING (row, col) LEFT JOIN li USING (row, col)")
def _(spark, sf):
    c = X.cover(spark, sf)
    wet = c.where("(row + col) % 9 <> 0").select("row", "col", ((F.col("row") * 13 + F.col("col") * 7) % 101).cast("double").alias("value"))
    return terrain.water_mask(c, X.WORLD, wet, X.li(spark, sf))


@query("r10_water_small_box", "SELECT row, col, (class_id = 80)::INT AS water FROM cover")
def _(spark, sf):
    return terrain.water_mask(X.cover(spark, sf), X.CITY, elevation=X.li(spark, sf))  # a few kilometres: heights don't count


@query("r11_raise_land", v("CASE WHEN value > 0 THEN value + (hi - lo) * 0.05 ELSE value END") + " FROM li, (SELECT min(value) lo, max(value) hi FROM li)")
def _(spark, sf):
    li = X.li(spark, sf)
    return out(terrain.lower_water(li, li, 0.05, raise_land=True))


@query("r19_composite_terms", RGB + LAYER + f", t AS (SELECT row, col, -3 * (class_id = 80)::INT AS x FROM cover UNION ALL SELECT row, col, 1.5 * CASE WHEN (g - r) / (g + r + 1)::DOUBLE > 0.1 THEN (g - r) / (g + r + 1)::DOUBLE * 4 ELSE 0 END FROM px UNION ALL SELECT row, col, 2 * {CASES(raster.COVER_HEIGHT)}::DOUBLE FROM cover UNION ALL SELECT row, col, 0.5 * value FROM ly UNION ALL SELECT row, col, -1.2 * (class_id = 50)::INT FROM cover UNION ALL SELECT row, col, -2 * (class_id = 90)::INT FROM cover UNION ALL SELECT row, col, 0.5 * 8 * (class_id = 60)::INT FROM cover), s AS (SELECT row, col, sum(x) AS x FROM t GROUP BY 1, 2) " + v("value + coalesce(x, 0)") + " FROM li LEFT JOIN s USING (row, col)")
def _(spark, sf):
    c = X.cover(spark, sf)
    of = lambda k, h=1.0: c.select("row", "col", F.when(F.col("class_id") == k, h).otherwise(0.0).alias("value"))
    green = rgb(spark, sf).select("row", "col", terrain.greenness(F.col("r"), F.col("g")).alias("value"))
    # Water, satellite greenness, land cover, and the city's buildings, roads, waterways and walls; one more term has no weight.
    terms = [(of(80), -3.0), (green, 1.5), (raster.reclass(c, raster.COVER_HEIGHT), 2.0), (layer(spark, sf), 0.5), (of(50), -1.2), (of(90), -2.0), (of(60, 8.0), 0.5), (of(10), 0.0)]
    return out(terrain.composite(X.li(spark, sf), terms))


SECTION = v("(value - lo) / (hi - lo) * 20 + 5") + " FROM li, (SELECT min(value) lo, max(value) hi FROM li WHERE {w}) WHERE {w}"


@query("r25_section_at_latitude", SECTION.format(w="row = 35"))
def _(spark, sf):
    return out(raster.cross_section(X.li(spark, sf), raster.row_at(40.0, X.WORLD, 128), 20, 5))


@query("r25_section_column", SECTION.format(w="col = 17"))
def _(spark, sf):
    return out(raster.cross_section(X.li(spark, sf), 17, 20, 5, axis="col"))


# Resampling and projection -----------------------------------------------------------------------

OVER = lambda c: f"greatest(0, least(({c} + 1) * {50 / 128!r}::DOUBLE, i{c} + 1) - greatest({c} * {50 / 128!r}::DOUBLE, i{c}::DOUBLE))"


@query("g3_shrink", f", e AS (SELECT irow::INT AS row, icol::INT AS col, value, {OVER('row')} * {OVER('col')} AS w FROM li, unnest(range(floor(row * {50 / 128!r}::DOUBLE)::INT, least(50, floor(row * {50 / 128!r}::DOUBLE)::INT + 2))) a(irow), unnest(range(floor(col * {50 / 128!r}::DOUBLE)::INT, least(50, floor(col * {50 / 128!r}::DOUBLE)::INT + 2))) b(icol)) SELECT row, col, {s6('sum(w * value) / sum(w)')} AS value FROM e WHERE w > 1e-9 GROUP BY 1, 2")
def _(spark, sf):
    return out(terrain.shrink(X.li(spark, sf), GRID, 50)[0])


NEAR = ", k AS (SELECT r::INT AS row, c::INT AS col, least(floor(r * 128 / {h}::DOUBLE), 127)::INT AS a, least(floor(c * 128 / {w}::DOUBLE), 127)::INT AS b FROM range({h}) x(r), range({w}) y(c)) SELECT k.row, k.col, class_id AS value FROM k JOIN cover ON cover.row = a AND cover.col = b"


def classes(spark, sf):
    return X.cover(spark, sf).withColumnRenamed("class_id", "value")


@query("g3_shrink_classes", NEAR.format(h=50, w=50))
def _(spark, sf):
    return terrain.shrink(classes(spark, sf), GRID, 50, categorical=True)[0]


@query("g17_conform_classes", NEAR.format(h=40, w=90))
def _(spark, sf):
    c = classes(spark, sf)
    kind = raster.is_categorical(c.withColumn("value", F.col("value").cast("double"))).first()[0]  # a corner's cells
    return terrain.conform(c, GRID, (40, 90), kind)


@query("g17_conform_values", bil("li", "b", 128, 77) + v("value") + " FROM b")
def _(spark, sf):
    li = X.li(spark, sf)
    return out(terrain.conform(li, GRID, (77, 77), raster.is_categorical(li).first()[0]))


@query("g10_equidistant", COS + f" SELECT e.row, e.col, {s6('sum(w * value)')} AS value FROM e JOIN li ON li.row = e.row AND li.col = src WHERE w > 0 GROUP BY 1, 2")
def _(spark, sf):
    return out(raster.project(X.li(spark, sf), X.WORLD, GRID, "equidistant"))


TALL = (60.0, 0.0, 90.0, 0.0)  # 90 degrees wide and 60 high about latitude 30: in proportion, 1.3 times as wide as high
WIDE = int(128 * (90 * math.cos(math.radians(30)) / 60))


@query("g10_true_aspect", f", k AS (SELECT r::INT AS row, c::INT AS col, least(greatest((c + 0.5) * {128 / WIDE!r}::DOUBLE - 0.5, 0), 127)::DOUBLE AS x FROM range(128) a(r), range({WIDE}) b(c)), e AS (SELECT row, col, least(floor(x)::INT + d, 127) AS src, CASE d WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END AS w FROM k, range(2) t(d)) SELECT e.row, e.col, {s6('sum(w * value)')} AS value FROM e JOIN li ON li.row = e.row AND li.col = src WHERE w > 0 GROUP BY 1, 2")
def _(spark, sf):
    return out(raster.true_aspect(X.li(spark, sf), TALL, GRID)[0])


MERCATOR = f"degrees(2 * atan(exp({MY.format('85::DOUBLE')} + i * (({MY.format('-85::DOUBLE')} - {MY.format('85::DOUBLE')}) / 127))) - pi() / 2)"
LAMBERT = "degrees(asin(least(greatest(sin(radians(90)) + i * ((sin(radians(-90)) - sin(radians(90))) / 127), -1), 1)))"
ROWS = ", k AS (SELECT i::INT AS row, round((90 - {lat}) / 180 * 127, 9) AS pos FROM range(128) t(i)), kk AS (SELECT row, pos FROM k WHERE pos >= 0 AND pos <= 127)"
SINUS = f", c AS (SELECT i::INT AS row, cos(radians({LATS})) AS c FROM range(128) t(i)), kk AS (SELECT row, j::INT AS col, round(((j * (2 / 127::DOUBLE) - 1) / c + 1) / 2 * 127, 9) AS pos FROM c, range(128) t(j) WHERE c >= 0.01)"
NEAREST = {
    "mercator": ROWS.format(lat=MERCATOR) + " SELECT kk.row, cover.col, class_id AS value FROM kk JOIN cover ON cover.row = round_even(pos, 0)::INT",
    "lambert": ROWS.format(lat=LAMBERT) + " SELECT kk.row, cover.col, class_id AS value FROM kk JOIN cover ON cover.row = round_even(pos, 0)::INT",
    "sinusoidal": SINUS + " SELECT kk.row, kk.col, class_id AS value FROM kk JOIN cover ON cover.row = kk.row AND cover.col = round_even(pos, 0)::INT WHERE pos >= 0 AND pos <= 127",
    "cosine": COS + " SELECT k.row, k.col, class_id AS value FROM k JOIN cover ON cover.row = k.row AND cover.col = round_even(pos, 0)::INT",
}
for mode, body in NEAREST.items():

    def _nearest(spark, sf, mode=mode):
        return raster.project(classes(spark, sf), X.WORLD, GRID, mode, nearest=True)

    Q[f"g16_nearest_{mode}"], S[f"g16_nearest_{mode}"] = _nearest, sql(body)


def _aligned(mode):
    def run(spark, sf):
        c = X.cover(spark, sf).where("row between 20 and 100 and col between 10 and 90")
        mask = c.select("row", "col", (F.col("class_id") == 80).cast("double").alias("value"))
        return raster.aligned(mask, c.withColumnRenamed("class_id", "value"), X.WORLD, GRID, mode, close=True).select("row", "col", "water", "class_id")

    return run


CUT = ", cv AS (SELECT * FROM cover WHERE row BETWEEN 20 AND 100 AND col BETWEEN 10 AND 90)"
CLOSED = " SELECT (dense_rank() OVER (ORDER BY m.row) - 1)::INT AS row, (dense_rank() OVER (ORDER BY m.col) - 1)::INT AS col, (v > 0.500000001)::INT AS water, coalesce(cv.class_id, 0) AS class_id FROM m "
ALIGNED = {
    "mercator": ROWS.format(lat=MERCATOR) + ", e AS (SELECT row, floor(pos)::INT + d AS src, CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM kk, range(2) x(d)), m AS (SELECT e.row, cv.col, sum(w * (class_id = 80)::INT) AS v FROM e JOIN cv ON cv.row = src WHERE w > 0 GROUP BY 1, 2)" + CLOSED + "JOIN kk ON kk.row = m.row LEFT JOIN cv ON cv.row = round_even(pos, 0)::INT AND cv.col = m.col",
    "sinusoidal": SINUS + ", e AS (SELECT row, col, floor(pos)::INT + d AS src, CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM kk, range(2) x(d) WHERE pos >= 0 AND pos <= 127), m AS (SELECT e.row, e.col, sum(w * (class_id = 80)::INT) AS v FROM e JOIN cv ON cv.row = e.row AND cv.col = src WHERE w > 0 GROUP BY 1, 2)" + CLOSED + "JOIN kk ON kk.row = m.row AND kk.col = m.col LEFT JOIN cv ON cv.row = m.row AND cv.col = round_even(pos, 0)::INT",
}
for mode, body in ALIGNED.items():
    Q[f"g14_aligned_{mode}"], S[f"g14_aligned_{mode}"] = _aligned(mode), sql(CUT + body)


# Edges, registration, flat water -----------------------------------------------------------------

GREY = ", q AS (SELECT row, col, 0.299 * ((row * 7 + col * 3) % 256) + 0.587 * ((row * 5 + col * 11) % 256) + 0.114 * abs(value) AS value FROM emb)"
AROUND = lambda i, n: f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - 2 - ({i}) ELSE {i} END"
G5 = [math.exp(-x * x / 2) for x in (-2, -1, 0, 1, 2)]
G5 = [x / sum(G5) for x in G5]
EDGES = (
    GREY + ", nn AS (SELECT row, col, (value - lo) / (hi - lo) * 255 AS value FROM q, (SELECT min(value) lo, max(value) hi FROM q)), dm AS (SELECT max(row) + 1 AS nr FROM emb), na AS (SELECT row, col, dr, dc, " + AROUND("row + dr", "nr") + " AS r2, " + AROUND("col + dc", "64")
    + " AS c2 FROM emb, dm, range(-1, 2) a(dr), range(-1, 2) b(dc)), sb AS (SELECT na.row, na.col, sqrt(pow(sum(dc * (2 - abs(dr)) * nn.value), 2) + pow(sum(dr * (2 - abs(dc)) * nn.value), 2)) AS value FROM na JOIN nn ON nn.row = r2 AND nn.col = c2 GROUP BY 1, 2), gk(d, w) AS (VALUES "
    + ", ".join(f"({k - 2}, {w!r}::DOUBLE)" for k, w in enumerate(G5)) + "), nc AS (SELECT row, col, d, w, " + AROUND("row + d", "nr") + " AS r2 FROM emb, dm, gk), b1 AS (SELECT nc.row, nc.col, sum(w * sb.value) AS value FROM nc JOIN sb ON sb.row = r2 AND sb.col = nc.col GROUP BY 1, 2), nd AS (SELECT row, col, w, " + AROUND("col + d", "64")
    + " AS c2 FROM emb, gk), b2 AS (SELECT nd.row, nd.col, sum(w * b1.value) AS value FROM nd JOIN b1 ON b1.row = nd.row AND b1.col = c2 GROUP BY 1, 2), ed AS (SELECT row, col, (value - m) / s AS value FROM b2, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM b2)) "
)


def grey(spark, sf):
    row, col = F.col("row"), F.col("col")
    return X.emb(spark, sf).select("row", "col", terrain.luminance((row * 7 + col * 3) % 256, (row * 5 + col * 11) % 256, F.abs("value")).alias("value"))


@query("f9_edge_map", EDGES + v("value") + " FROM ed")
def _(spark, sf):
    return out(terrain.edge_map(grey(spark, sf), emb_shape(spark, sf)))


@query("a17_edge_coverage_water", EDGES + f", k AS (SELECT avg((abs(value) > 0.5)::INT) AS c FROM ed), w AS (SELECT 100 * count(*) FILTER (class_id = 80) / count(*)::DOUBLE AS p FROM cover) SELECT {s6('c')} AS coverage, c < 0.02 OR least(p, 100 - p) < 5 AS low FROM k, w")
def _(spark, sf):
    e = terrain.edge_map(grey(spark, sf), emb_shape(spark, sf))
    return terrain.edge_coverage(e, zonal.water_coverage(X.cover(spark, sf))).select(r6("coverage").alias("coverage"), "low")


REGISTERED = ", o AS (SELECT dr, dc FROM range(-3, 4) a(dr), range(-3, 4) b(dc)), p AS (SELECT row + dr AS row, col + dc AS col, dr, dc, value AS x FROM emb, o), s AS (SELECT dr, dc, covar_pop(x, mv.value) / (stddev_pop(x) * stddev_pop(mv.value)) AS n FROM p JOIN mv USING (row, col) GROUP BY 1, 2), b AS (SELECT * FROM s ORDER BY n DESC LIMIT 1), k AS (SELECT avg((abs(value) > 0.5)::INT) AS c FROM ed) SELECT dr::INT AS dr, dc::INT AS dc, round(n, 4) AS ncc, " + s6("sqrt(dr * dr + dc * dc)") + " AS distance, c < 0.02 AS low, sqrt(dr * dr + dc * dc) >= 2 AND c >= 0.02 AS applied FROM b, k"


@query("l2_registration", EDGES + ", mv AS (SELECT row + 2 AS row, col - 1 AS col, value FROM emb)" + REGISTERED)
def _(spark, sf):
    e, shape = X.emb(spark, sf), emb_shape(spark, sf)
    moved = e.select((F.col("row") + 2).alias("row"), (F.col("col") - 1).alias("col"), "value")
    r = terrain.register(e, moved, shape, 3, terrain.edge_coverage(terrain.edge_map(grey(spark, sf), shape)))
    return r.select("dr", "dc", F.round("ncc", 4).alias("ncc"), r6("distance").alias("distance"), "low", "applied")


SMOOTH2 = ", sm AS (SELECT row, col, sin(row / 37.0) * 300 + cos(row / 11.0 + col / 9.0) * 200 + value / 20 AS value FROM emb), mv AS (SELECT row + 40 AS row, col + 3 AS col, value FROM sm)"


@query("l2_registration_far", SMOOTH2 + " SELECT 40 AS dr, 3 AS dc, " + s6("sqrt(1609)") + " AS distance, count(*) > 0 AS applied FROM sm")
def _(spark, sf):
    # Found through a pyramid of halved layers: forty cells are a few on the coarsest.
    wave = F.sin(F.col("row") / 37.0) * 300 + F.cos(F.col("row") / 11.0 + F.col("col") / 9.0) * 200 + F.col("value") / 20
    e, shape = X.emb(spark, sf).select("row", "col", wave.alias("value")), emb_shape(spark, sf)
    moved = e.select((F.col("row") + 40).alias("row"), (F.col("col") + 3).alias("col"), "value")
    r = terrain.register(e, moved, shape, 48, terrain.edge_coverage(terrain.edge_map(grey(spark, sf), shape)))
    return r.select("dr", "dc", r6("distance").alias("distance"), "applied")


FLAT = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"


@query("f12_flat_water", f", fl AS (SELECT row, col, floor(value / 400) AS value FROM emb), g1 AS (SELECT row, col, value, max(value) OVER (PARTITION BY col ORDER BY row {FLAT}) AS hi, min(value) OVER (PARTITION BY col ORDER BY row {FLAT}) AS lo FROM fl), g AS (SELECT row, col, value, max(hi) OVER (PARTITION BY row ORDER BY col {FLAT}) - min(lo) OVER (PARTITION BY row ORDER BY col {FLAT}) AS g FROM g1) SELECT row, col, (g < 0.001)::INT + (least(greatest(value, 0), 3) < 0.15)::INT AS value FROM g")
def _(spark, sf):
    steps = X.emb(spark, sf).select("row", "col", F.floor(F.col("value") / 400).cast("double").alias("value"))
    return terrain.flat(steps, emb_shape(spark, sf))


@query("a16_similarity_by_band", RGB + ", o AS (SELECT row, col, r * 2 + col AS r, g * g AS g, 7 AS b FROM px), c AS (SELECT (SELECT covar_pop(px.r, o.r) / (stddev_pop(px.r) * stddev_pop(o.r)) FROM px JOIN o USING (row, col)) AS x, (SELECT covar_pop(px.g, o.g) / (stddev_pop(px.g) * stddev_pop(o.g)) FROM px JOIN o USING (row, col)) AS y) SELECT round((x + y) / 3, 5) AS ncc FROM c")
def _(spark, sf):
    px = rgb(spark, sf)
    other = px.select("row", "col", (F.col("r") * 2 + F.col("col")).alias("r"), (F.col("g") * F.col("g")).alias("g"), F.lit(7).alias("b"))
    return terrain.similarity_by_band(px, other, ["r", "g", "b"]).select(F.round("ncc", 5).alias("ncc"))

