"""Raster algebra, resampling, projection, focal and zonal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import focal, raster, terrain, zonal
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


def out(df):
    return df.select("row", "col", r6("value").alias("value"))


def v(expr: str) -> str:
    return f"SELECT row, col, {s6(expr)} AS value"


HAND = 64  # the emb grid's width


def emb_shape(spark, sf) -> tuple[int, int]:
    """Rows from the file's own statistics (one row read from the aggregate), columns as stored."""
    top = X.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    return int(top) + 1, HAND


@query("a1_grid_summary", f"SELECT {s6('min(value)')} AS lo, {s6('max(value)')} AS hi, {s6('avg(value)')} AS mean, {s6('max(value) - min(value)')} AS ptp, count(value) AS n FROM emb")
def _(spark, sf):
    s = zonal.summary(raster.clean(X.emb(spark, sf)))
    return s.select(*(r6(c).alias(c) for c in ("lo", "hi", "mean", "ptp")), "n")


@query("r1_depth_scaling", v("CASE WHEN value < 0 THEN value * 0.5 ELSE value END") + " FROM li")
def _(spark, sf):
    return out(X.li(spark, sf).withColumn("value", raster.scale_depth(F.col("value"), 0.5)))


@query("r2_clip", v("least(greatest(value, -100), 250)") + " FROM li")
def _(spark, sf):
    return out(raster.clip(X.li(spark, sf), -100, 250))


@query("r3_normalise", v("(value - lo) / (hi - lo)") + " FROM li, (SELECT min(value) lo, max(value) hi FROM li)")
def _(spark, sf):
    return out(raster.normalise(X.li(spark, sf)))


@query("r4_invert", v("hi - value + lo") + " FROM li, (SELECT min(value) lo, max(value) hi FROM li)")
def _(spark, sf):
    return out(raster.invert(X.li(spark, sf)))


RIVER = ", rr AS (SELECT row, col, CASE WHEN (row + col) % 7 = 0 THEN -5::DOUBLE ELSE 0 END AS value FROM li WHERE (row * 3 + col) % 5 < 3)"


def river(spark, sf):
    return X.li(spark, sf).where("(row * 3 + col) % 5 < 3").select("row", "col", F.when((F.col("row") + F.col("col")) % 7 == 0, -5.0).otherwise(0.0).alias("value"))


LAYER = ", ly AS (SELECT row, col, class_id::DOUBLE AS value FROM cover WHERE (row + col) % 3 <> 0)"


def layer(spark, sf):
    return X.cover(spark, sf).where("(row + col) % 3 <> 0").select("row", "col", F.col("class_id").cast("double").alias("value"))


for mode, expr in {"base": "b", "replace": "CASE WHEN l <> 0 THEN l ELSE b END", "blend": "b * (1 - 0.25) + l * 0.25", "rivers": "b - l * 0.25", "max": "greatest(b, l)", "min": "least(b, l)"}.items():

    def _blend(spark, sf, mode=mode):
        return out(raster.blend(X.li(spark, sf), layer(spark, sf), mode, 0.25))

    Q[f"r7_blend_{mode}"], S[f"r7_blend_{mode}"] = _blend, sql(LAYER + v(f"CASE WHEN l IS NULL THEN b ELSE {expr} END") + " FROM (SELECT li.row, li.col, li.value AS b, ly.value AS l FROM li LEFT JOIN ly USING (row, col))")


@query("r8_merge_layers", LAYER + RIVER + v("greatest(CASE WHEN l IS NULL THEN b ELSE b * 0.5 + l * 0.5 END, coalesce(r, -1e9))") + " FROM (SELECT li.row, li.col, coalesce(li.value, 0) AS b, ly.value AS l, rr.value AS r FROM li LEFT JOIN ly USING (row, col) LEFT JOIN rr USING (row, col))")
def _(spark, sf):
    return out(raster.merge_layers([(X.li(spark, sf), "base", 1.0), (layer(spark, sf), "blend", 0.5), (river(spark, sf), "max", 1.0)]))


@query("r9_river_merge", RIVER + v("CASE WHEN coalesce(rr.value, 0) <> 0 THEN least(li.value, rr.value) ELSE li.value END") + " FROM li LEFT JOIN rr USING (row, col)")
def _(spark, sf):
    return out(raster.merge_rivers(X.li(spark, sf), river(spark, sf)))


@query("r9_river_merge_relative", RIVER + v("CASE WHEN coalesce(rr.value, 0) <> 0 THEN li.value + rr.value ELSE li.value END") + " FROM li LEFT JOIN rr USING (row, col)")
def _(spark, sf):
    return out(raster.merge_rivers(X.li(spark, sf), river(spark, sf), "relative"))


@query("r10_water_mask", "SELECT row, col, (class_id = 80 OR value < -2)::INT AS water FROM cover JOIN li USING (row, col)")
def _(spark, sf):
    return X.cover(spark, sf).join(X.li(spark, sf), ["row", "col"]).select("row", "col", ((F.col("class_id") == 80) | (F.col("value") < -2)).cast("int").alias("water"))


@query("r11_subtract_water", v("li.value - (class_id = 80)::INT * (hi - lo) * 0.05") + " FROM li JOIN cover USING (row, col), (SELECT min(value) lo, max(value) hi FROM li)")
def _(spark, sf):
    w = X.cover(spark, sf).select("row", "col", (F.col("class_id") == 80).cast("double").alias("value"))
    return out(raster.subtract_water(X.li(spark, sf), w, 0.05))


CASES = lambda t: "CASE class_id " + " ".join(f"WHEN {k} THEN {x}" for k, x in t.items()) + " ELSE 0 END"


@query("r12_reclass_height", v(CASES(raster.COVER_HEIGHT)) + " FROM cover")
def _(spark, sf):
    return out(raster.reclass(X.cover(spark, sf), raster.COVER_HEIGHT))


@query("r12_reclass_offset", v(CASES(raster.COVER_OFFSET)) + " FROM cover")
def _(spark, sf):
    return out(raster.reclass(X.cover(spark, sf), raster.COVER_OFFSET))


@query("r13_colourise", "SELECT row, col, " + ", ".join("CASE class_id " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in raster.COVER_RGB.items()) + f" ELSE {(180, 0, 180)[i]} END AS {n}" for i, n in enumerate("rgb")) + " FROM cover")
def _(spark, sf):
    return raster.colourise(X.cover(spark, sf))


NORM = ", nn AS (SELECT row, col, (value - lo) / (hi - lo) AS t FROM li, (SELECT min(value) lo, max(value) hi FROM li))"


@query("r14_ramp_jet", NORM + "SELECT row, col, " + ", ".join(f"{s6(f'greatest(0, least(1, 1.5 - abs(4 * t - {k})))')} AS {c}" for k, c in ((3, "r"), (2, "g"), (1, "b"))) + " FROM nn")
def _(spark, sf):
    n = raster.normalise(X.li(spark, sf))
    return n.select("row", "col", *(r6(x).alias(c) for x, c in zip(raster.jet(F.col("value")), "rgb", strict=True)))


@query("r14_ramp_hot", NORM + "SELECT row, col, " + ", ".join(f"{s6(f'least(1, greatest(0, 3 * t - {k}))')} AS {c}" for k, c in ((0, "r"), (1, "g"), (2, "b"))) + " FROM nn")
def _(spark, sf):
    n = raster.normalise(X.li(spark, sf))
    return n.select("row", "col", *(r6(x).alias(c) for x, c in zip(raster.hot(F.col("value")), "rgb", strict=True)))


@query("r14_sea_colour", "SELECT row, col, floor(30 * (1 - t))::INT AS r, floor(144 * (1 - t))::INT AS g, floor(80 + 175 * (1 - t))::INT AS b FROM (SELECT row, col, least(1, abs(value) / d) AS t FROM li, (SELECT max(abs(value)) AS d FROM li WHERE value < 0) WHERE value < 0)")
def _(spark, sf):
    return raster.sea_colour(X.li(spark, sf))


def curve_sql(points) -> str:
    steps = [f"WHEN t <= {points[0][0]} THEN {points[0][1]}::DOUBLE"]
    steps += [f"WHEN t <= {b[0]} THEN {a[1]}::DOUBLE + (t - {a[0]}) / ({b[0] - a[0]!r})::DOUBLE * ({b[1]} - {a[1]})::DOUBLE" for a, b in zip(points, points[1:], strict=False)]
    return "CASE " + " ".join(steps) + f" ELSE {points[-1][1]} END"


for name, points in raster.CURVES.items():

    def _curve(spark, sf, points=points):
        n = raster.normalise(X.li(spark, sf))
        return out(n.withColumn("value", raster.remap(F.col("value"), points)))

    Q[f"r15_curve_{name.replace('-', '_')}"], S[f"r15_curve_{name.replace('-', '_')}"] = _curve, sql(NORM + v(curve_sql(points)) + " FROM nn")


@query("r16_curve_rescale", ", p(i, x, y) AS (VALUES (0, 0, 0), (1, 0.25, 0.1), (2, 0.5, 0.5), (3, 0.75, 0.9), (4, 1, 1)), q AS (SELECT i, CASE i WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE round(least(1, greatest(0, (lo + x * (hi - lo) + 300) / 700)), 6) END::DOUBLE AS x, y::DOUBLE AS y FROM p, (SELECT min(value) lo, max(value) hi FROM li)) SELECT x + 0::DOUBLE AS x, arg_min(y, i) AS y FROM q GROUP BY x")
def _(spark, sf):
    return terrain.rescale_curve(X.li(spark, sf).agg(F.min("value").alias("lo"), F.max("value").alias("hi")), raster.CURVES["s-curve"], -300, 400)


RGB = ", px AS (SELECT row, col, (row * 7 + col) % 256 AS r, (row + col * 5) % 256 AS g, class_id % 256 AS b FROM cover)"


def rgb(spark, sf):
    return X.cover(spark, sf).select("row", "col", ((F.col("row") * 7 + F.col("col")) % 256).alias("r"), ((F.col("row") + F.col("col") * 5) % 256).alias("g"), (F.col("class_id") % 256).alias("b"))


@query("r17_greenness", RGB + v("CASE WHEN (g - r) / (g + r + 1)::DOUBLE > 0.1 THEN (g - r) / (g + r + 1)::DOUBLE * 4 ELSE 0 END") + " FROM px")
def _(spark, sf):
    return out(rgb(spark, sf).withColumn("value", terrain.greenness(F.col("r"), F.col("g"))))


@query("r18_luminance", RGB + v("0.299 * r + 0.587 * g + 0.114 * b") + " FROM px")
def _(spark, sf):
    return out(rgb(spark, sf).withColumn("value", terrain.luminance(F.col("r"), F.col("g"), F.col("b"))))


@query("r19_composite", RIVER + LAYER + f", c AS (SELECT li.row, li.col, li.value - 3 * ((class_id = 80)::INT) + 0.5 * coalesce(ly.value, 0) + 2 * coalesce({CASES(raster.COVER_HEIGHT)}, 0) AS value FROM li LEFT JOIN cover USING (row, col) LEFT JOIN ly USING (row, col)) SELECT {s6('min(value)')} AS lo, {s6('max(value)')} AS hi, {s6('avg(value)')} AS mean, count(*) AS n FROM c")
def _(spark, sf):
    c = X.cover(spark, sf)
    water = c.select("row", "col", (F.col("class_id") == 80).cast("double").alias("water"))
    height = raster.reclass(c, raster.COVER_HEIGHT).withColumnRenamed("value", "cover")
    total = X.li(spark, sf)
    terms = F.col("value")
    for df, name, w in ((water, "water", -3.0), (layer(spark, sf).withColumnRenamed("value", "city"), "city", 0.5), (height, "cover", 2.0), (None, "satellite", 0.0)):
        if w:  # a branch of weight 0 is not planned at all
            total = total.join(df, ["row", "col"], "left")
            terms = terms + w * F.coalesce(name, F.lit(0.0))
    s = zonal.summary(total.select("row", "col", terms.alias("value")))
    return s.select(r6("lo").alias("lo"), r6("hi").alias("hi"), r6("mean").alias("mean"), "n")


@query("r20_model_height", v("(greatest(value * 1.5, 0) - lo) / (hi - lo) * 20 + 5") + " FROM li, (SELECT min(greatest(value * 1.5, 0)) lo, max(greatest(value * 1.5, 0)) hi FROM li)")
def _(spark, sf):
    return out(raster.model_height(X.li(spark, sf), 20, 5, 1.5, sea_cap=True))


@query("r21_contours", ", z AS (SELECT row, col, (value - lo) / (hi - lo) * 20 + 5 AS z FROM li, (SELECT min(value) lo, max(value) hi FROM li)), p AS (SELECT *, (z - 5) / 2 - floor((z - 5) / 2) AS a, (z - 5) / 10 - floor((z - 5) / 10) AS i, 0.3::DOUBLE / 2 / 2 AS h FROM z)" + v("CASE WHEN i < 2 * h OR i > 1 - 2 * h THEN greatest(z - 0.48, 2.5) WHEN a < h OR a > 1 - h THEN greatest(z - 0.24, 2.5) ELSE z END") + " FROM p WHERE abs(a - h) > 1e-9 AND abs(a - 1 + h) > 1e-9 AND abs(i - 2 * h) > 1e-9 AND abs(i - 1 + 2 * h) > 1e-9")
def _(spark, sf):
    return out(raster.contours(raster.model_height(X.li(spark, sf), 20, 5), 2, 20, 5))


@query("r24_crop", v("value").replace("row, col", "row - 10 AS row, col - 20 AS col") + " FROM li WHERE row >= 10 AND row < 50 AND col >= 20 AND col < 90")
def _(spark, sf):
    return out(raster.crop(X.li(spark, sf), (10, 50), (20, 90)))


@query("r25_cross_section", v("(value - lo) / (hi - lo) * 20 + 5") + " FROM li, (SELECT min(value) lo, max(value) hi FROM li WHERE row = 64) WHERE row = 64")
def _(spark, sf):
    return out(raster.cross_section(X.li(spark, sf), 64, 20, 5))


@query("r27_flip", "SELECT 127 - row AS row, col, " + s6("value") + " AS value FROM li")
def _(spark, sf):
    return out(X.li(spark, sf).withColumn("row", 127 - F.col("row")))


@query("r28_clean_numbers", "SELECT row, col, CASE WHEN row % 5 = 0 THEN 0 WHEN row % 5 = 1 THEN 3.4028234663852886e38 ELSE value END AS value FROM li")
def _(spark, sf):
    bad = F.when(F.col("row") % 5 == 0, F.lit(float("nan"))).when(F.col("row") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return X.li(spark, sf).withColumn("value", raster.clean_numbers(bad))


@query("r29_spherical_factor", "SELECT pid, " + s6("cos(radians(lat)) * cos(radians(lon)) * 128 / 180 * 180 / pi()") + " AS f FROM pts")
def _(spark, sf):
    return X.points(spark, sf).select("pid", r6(terrain.spherical_factor(F.col("lat"), F.col("lon"), 128, 180)).alias("f"))


@query("r30_stretch", v("CASE WHEN value > 0 THEN pow(value / hi, 0.7) * hi ELSE greatest(value - 0.02 * (hi - lo), -400) END") + " FROM li, (SELECT min(value) lo, max(value) hi FROM li)")
def _(spark, sf):
    return out(terrain.stretch(X.li(spark, sf)))


@query("g1_nearest", ", k AS (SELECT r::INT AS row, c::INT AS col, least(floor(r * 128 / 50::DOUBLE), 127)::INT AS a, least(floor(c * 128 / 77::DOUBLE), 127)::INT AS b FROM range(50) x(r), range(77) y(c))" + v("li.value").replace("row, col", "k.row, k.col") + " FROM k JOIN li ON li.row = a AND li.col = b")
def _(spark, sf):
    return out(raster.resample_nearest(X.li(spark, sf), (128, 128), (50, 77)))


def bilinear_sql(src, dst, align):
    def ax(c, k):
        at = f"({c} + 0.5) * {src[k] / dst[k]!r}::DOUBLE - 0.5" if align == "half_pixel" else f"{c} * {(src[k] - 1) / (dst[k] - 1)!r}::DOUBLE"
        return f"least(greatest({at}, 0), {src[k] - 1})::DOUBLE"

    return f", k AS (SELECT r::INT AS row, c::INT AS col, {ax('r', 0)} AS y, {ax('c', 1)} AS x FROM range({dst[0]}) p(r), range({dst[1]}) q(c)), f AS (SELECT *, floor(y)::INT AS y0, floor(x)::INT AS x0 FROM k), w AS (SELECT row, col, least(y0 + dy, {src[0] - 1}) AS sr, least(x0 + dx, {src[1] - 1}) AS sc, (CASE dy WHEN 0 THEN 1 - (y - y0) ELSE y - y0 END) * (CASE dx WHEN 0 THEN 1 - (x - x0) ELSE x - x0 END) AS w FROM f, range(2) a(dy), range(2) b(dx)) SELECT w.row, w.col, {s6('sum(w * value)')} AS value FROM w JOIN li ON li.row = sr AND li.col = sc WHERE w > 0 GROUP BY 1, 2"


@query("g2_bilinear_half_pixel", bilinear_sql((128, 128), (70, 200), "half_pixel"))
def _(spark, sf):
    return out(raster.resample_bilinear(X.li(spark, sf), (128, 128), (70, 200)))


@query("g2_bilinear_corners", bilinear_sql((128, 128), (70, 200), "corners"))
def _(spark, sf):
    return out(raster.resample_bilinear(X.li(spark, sf), (128, 128), (70, 200), "corners"))


@query("g3_area_average", f"SELECT row // 4 AS row, col // 4 AS col, {s6('avg(value)')} AS value FROM li GROUP BY 1, 2")
def _(spark, sf):
    return out(raster.area_average(X.li(spark, sf), 4))


@query("g4_fit_to_dim", "SELECT name, (h * least(1, 600 / greatest(h, w)))::INT AS height, (w * least(1, 600 / greatest(h, w)))::INT AS width FROM (SELECT name, (north - south) * 20 AS h, (east - west) * 20 AS w FROM reg)")
def _(spark, sf):
    h, w = terrain.fit_columns((F.col("north") - F.col("south")) * 20, (F.col("east") - F.col("west")) * 20, 600)
    return X.regions(spark, sf).select("name", h.alias("height"), w.alias("width"))


@query("g5_strided", v("value") + " FROM emb WHERE row % 4 = 0 AND col % 4 = 0")
def _(spark, sf):
    return out(X.emb(spark, sf).where("row % 4 = 0 and col % 4 = 0"))


LATS = "90 - i * (180 / 127::DOUBLE)"



@query("g7_cosine", f", c AS (SELECT i::INT AS row, cos(radians({LATS})) AS c FROM range(128) t(i)), r AS (SELECT row, round(c / (SELECT avg(c) FROM c), 12) AS s FROM c), w AS (SELECT row, floor(128 * s)::INT AS width, floor((128 - floor(128 * s)) / 2)::INT AS start FROM r WHERE s >= 0.01 AND floor(128 * s) >= 1), k AS (SELECT row, col::INT AS col, round(CASE WHEN width > 1 THEN (col - start) / (width - 1)::DOUBLE * 127 ELSE 0 END, 9) AS pos FROM w, unnest(range(greatest(start, 0), least(start + width, 128))) u(col)), e AS (SELECT row, col, floor(pos)::INT + d AS src, CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM k, range(2) x(d)) SELECT e.row, e.col, {s6('sum(w * value)')} AS value FROM e JOIN li ON li.row = e.row AND li.col = src WHERE w > 0 GROUP BY 1, 2")
def _(spark, sf):
    return out(raster.project(X.li(spark, sf), X.WORLD, (128, 128), "cosine"))


def rows_sql(lat: str) -> str:
    return f", k AS (SELECT i::INT AS row, round((90 - {lat}) / 180 * 127, 9) AS pos FROM range(128) t(i)), e AS (SELECT row, floor(pos)::INT + d AS src, CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM k, range(2) x(d) WHERE pos >= 0 AND pos <= 127) SELECT e.row, li.col, {s6('sum(w * value)')} AS value FROM e JOIN li ON li.row = src WHERE w > 0 GROUP BY 1, 2"


MY = "ln(tan(pi() / 4 + radians({}) / 2))"


@query("g9_mercator", rows_sql(f"degrees(2 * atan(exp({MY.format('85::DOUBLE')} + i * (({MY.format('-85::DOUBLE')} - {MY.format('85::DOUBLE')}) / 127))) - pi() / 2)"))
def _(spark, sf):
    return out(raster.project(X.li(spark, sf), X.WORLD, (128, 128), "mercator"))


@query("g11_lambert", rows_sql("degrees(asin(least(greatest(sin(radians(90)) + i * ((sin(radians(-90)) - sin(radians(90))) / 127), -1), 1)))"))
def _(spark, sf):
    return out(raster.project(X.li(spark, sf), X.WORLD, (128, 128), "lambert"))


@query("g12_sinusoidal", f", c AS (SELECT i::INT AS row, cos(radians({LATS})) AS c FROM range(128) t(i)), k AS (SELECT row, j::INT AS col, round(((j * (2 / 127::DOUBLE) - 1) / c + 1) / 2 * 127, 9) AS pos FROM c, range(128) t(j) WHERE c >= 0.01), e AS (SELECT row, col, floor(pos)::INT + d AS src, CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM k, range(2) x(d) WHERE pos >= 0 AND pos <= 127) SELECT e.row, e.col, {s6('sum(w * value)')} AS value FROM e JOIN li ON li.row = e.row AND li.col = src WHERE w > 0 GROUP BY 1, 2")
def _(spark, sf):
    return out(raster.project(X.li(spark, sf), X.WORLD, (128, 128), "sinusoidal"))


@query("g8_cosine_scatter", f", k AS (SELECT li.*, trunc(trunc(col - 63.5) * round(cos(radians(90 - row * (180 / 127::DOUBLE))), 12) + 63.5)::INT AS c2 FROM li), t AS (SELECT row, c2, arg_max(value, col) AS value FROM k WHERE c2 >= 0 AND c2 < 128 GROUP BY 1, 2) SELECT (dense_rank() OVER (ORDER BY row) - 1)::INT AS row, (dense_rank() OVER (ORDER BY c2) - 1)::INT AS col, {s6('value')} AS value FROM t")
def _(spark, sf):
    return out(raster.scatter_cosine(X.li(spark, sf), X.WORLD, (128, 128)))


@query("g13_border_clip", f"SELECT (dense_rank() OVER (ORDER BY row) - 1)::INT AS row, (dense_rank() OVER (ORDER BY col) - 1)::INT AS col, {s6('value')} AS value FROM li WHERE row BETWEEN 30 AND 90 AND col % 3 = 0")
def _(spark, sf):
    return out(raster.close_up(X.li(spark, sf).withColumn("value", F.when(F.expr("row between 30 and 90 and col % 3 = 0"), F.col("value")))))


@query("g17_layer_kind", "SELECT (count(DISTINCT class_id) <= 20) AS categorical FROM cover WHERE row < 10 AND col < 10")
def _(spark, sf):
    return raster.is_categorical(X.cover(spark, sf).select("row", "col", F.col("class_id").cast("double").alias("value")))


GW = lambda sigma: "(VALUES " + ", ".join(f"({k - len(focal.gaussian_weights(sigma)) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(focal.gaussian_weights(sigma))) + ")"
FOLD = "CASE WHEN (({i}) % (2 * n) + 2 * n) % (2 * n) < n THEN (({i}) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - (({i}) % (2 * n) + 2 * n) % (2 * n) END"


def smooth_ctes(sigma, src="emb", tag=""):
    return f""", gw{tag}(k, w) AS ({GW(sigma)[1:-1]}), dim{tag} AS (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM {src}),
g1{tag} AS (SELECT t.row, s.col, sum(w * value) AS value FROM (SELECT DISTINCT row FROM {src}) t, gw{tag}, (SELECT nr AS n FROM dim{tag}), {src} s WHERE s.row = {FOLD.format(i='t.row + k')} GROUP BY 1, 2),
g2{tag} AS (SELECT s.row, t.col, sum(w * value) AS value FROM (SELECT DISTINCT col FROM {src}) t, gw{tag}, (SELECT nc AS n FROM dim{tag}), g1{tag} s WHERE s.col = {FOLD.format(i='t.col + k')} GROUP BY 1, 2)"""


@query("f2_gaussian", smooth_ctes(2.0) + f"SELECT row, col, {s6('value')} AS value FROM g2")
def _(spark, sf):
    return out(focal.smooth(X.emb(spark, sf), emb_shape(spark, sf), 2.0))


@query("f3_high_pass", smooth_ctes(1.0) + f"SELECT row, col, {s6('greatest(emb.value - g2.value, 0)')} AS value FROM g2 JOIN emb USING (row, col)")
def _(spark, sf):
    return out(raster.clip(focal.high_pass(X.emb(spark, sf), emb_shape(spark, sf), 1.0), low=0))


@query("r5_sharpen", smooth_ctes(1.5) + f"SELECT row, col, {s6('emb.value + 0.5 * (emb.value - g2.value)')} AS value FROM g2 JOIN emb USING (row, col)")
def _(spark, sf):
    return out(focal.sharpen(X.emb(spark, sf), emb_shape(spark, sf)))


@query("r6_pipeline", ", c AS (SELECT row, col, least(greatest(value, -150), 200) AS value FROM emb)" + smooth_ctes(1.0, "c") + f"SELECT row, col, {s6('hi - (value - lo) / (hi - lo) * 1 - hi + 1')} AS value FROM g2, (SELECT min(value) lo, max(value) hi FROM g2)")
def _(spark, sf):
    shape = emb_shape(spark, sf)
    steps = X.emb(spark, sf).transform(raster.clip, -150, 200).transform(focal.smooth, shape, 1.0).transform(raster.normalise).transform(raster.invert)
    return out(steps)


@query("f14_relief", ", p AS (SELECT row, col, greatest(value, 0) AS value FROM emb)" + smooth_ctes(2.0, "p") + f"SELECT row, col, {s6('emb.value - 2 * greatest(g2.value - p.value, 0)')} AS value FROM emb JOIN p USING (row, col) JOIN g2 USING (row, col)")
def _(spark, sf):
    e = X.emb(spark, sf)
    p = raster.clip(e, low=0)
    s = focal.smooth(p, emb_shape(spark, sf), 2.0).withColumnRenamed("value", "s")
    j = e.join(p.withColumnRenamed("value", "p"), ["row", "col"]).join(s, ["row", "col"])
    return out(j.withColumn("value", F.col("value") - 2 * F.greatest(F.col("s") - F.col("p"), F.lit(0.0))))



OFF = ", nb AS (SELECT a.row, a.col, b.value, dr, dc FROM {t} a, range(-{r}, {r} + 1) x(dr), range(-{r}, {r} + 1) y(dc), {t} b WHERE b.row = a.row + dr AND b.col = a.col + dc)"


REFLECT = ", dm AS (SELECT max(row) AS mr, max(col) AS mc FROM {t}), na AS (SELECT row, col, least(greatest(row + dr, 0), mr) AS r2, least(greatest(col + dc, 0), mc) AS c2 FROM {t}, range(-1, 2) x(dr), range(-1, 2) y(dc), dm), nb AS (SELECT na.row, na.col, b.value FROM na JOIN {t} b ON b.row = r2 AND b.col = c2)"


@query("f4_median", REFLECT.format(t="emb") + f"SELECT row, col, {s6('quantile_cont(value, 0.5)')} AS value FROM nb GROUP BY 1, 2")
def _(spark, sf):
    return out(focal.median(X.emb(spark, sf), emb_shape(spark, sf), 3))


@query("f8_sobel", OFF.format(t="emb", r=1) + f", d AS (SELECT max(row) AS mr FROM emb) SELECT row, col, {s6('sqrt(pow(sum(-dc * (2 - abs(dr)) * value), 2) + pow(sum(-dr * (2 - abs(dc)) * value), 2))')} AS value FROM nb, d WHERE row > 0 AND row < mr AND col > 0 AND col < 63 GROUP BY 1, 2")
def _(spark, sf):
    return out(focal.sobel(X.emb(spark, sf), emb_shape(spark, sf)))


@query("f12_gradient", OFF.format(t="emb", r=1) + f"SELECT row, col, {s6('max(value) - min(value)')} AS value FROM nb GROUP BY 1, 2")
def _(spark, sf):
    return out(focal.morphological_gradient(X.emb(spark, sf), emb_shape(spark, sf)))


MASK = ", m AS (SELECT row, col, (value > -60)::INT AS value FROM emb)"
FRAME = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
#: The complete grid's rows and columns give the frames; cells at the border erode to 0.
EROSION = MASK + f", e1 AS (SELECT row, col, min(value) OVER (PARTITION BY col ORDER BY row {FRAME}) AS value FROM m), e2 AS (SELECT row, col, min(value) OVER (PARTITION BY row ORDER BY col {FRAME}) AS value FROM e1), er AS (SELECT row, col, CASE WHEN row > 0 AND row < (SELECT max(row) FROM m) AND col > 0 AND col < 63 THEN value ELSE 0 END AS value FROM e2)"
OPENED = EROSION + f", o1 AS (SELECT row, col, max(value) OVER (PARTITION BY col ORDER BY row {FRAME}) AS value FROM er), o AS (SELECT row, col, max(value) OVER (PARTITION BY row ORDER BY col {FRAME}) AS value FROM o1) "


def mask(spark, sf):
    return X.emb(spark, sf).select("row", "col", (F.col("value") > -60).cast("int").alias("value"))


@query("f5_opening", OPENED + "SELECT row, col, value FROM o")
def _(spark, sf):
    return focal.opening(mask(spark, sf), emb_shape(spark, sf), 1)


@query("f6_thin_features", OPENED + "SELECT m.row, m.col FROM m JOIN o USING (row, col) WHERE m.value = 1 AND o.value = 0")
def _(spark, sf):
    return focal.thin_features(mask(spark, sf), emb_shape(spark, sf), 3)


HIGH = ", m AS (SELECT row, col, (value > 200)::INT AS value FROM emb)"


@query("f7_disk_dilation", HIGH + OFF.format(t="m", r=2) + "SELECT DISTINCT row, col FROM nb WHERE value = 1 AND dr * dr + dc * dc <= 4")
def _(spark, sf):
    m = X.emb(spark, sf).select("row", "col", (F.col("value") > 200).cast("int").alias("value"))
    return focal.dilate_disk(m, emb_shape(spark, sf), 2)


@query("f13_shoreline", HIGH + OFF.format(t="m", r=2) + "SELECT DISTINCT nb.row, nb.col FROM nb JOIN m ON m.row = nb.row AND m.col = nb.col WHERE nb.value = 1 AND dr * dr + dc * dc <= 4 AND m.value = 0")
def _(spark, sf):
    return focal.shoreline(X.emb(spark, sf).withColumn("value", F.col("value") - 200), emb_shape(spark, sf))


@query("f13_carved_shore", HIGH + OFF.format(t="m", r=2) + f", ring AS (SELECT DISTINCT nb.row, nb.col, 1 AS k FROM nb JOIN m ON m.row = nb.row AND m.col = nb.col WHERE nb.value = 1 AND dr * dr + dc * dc <= 4 AND m.value = 0) SELECT row, col, {s6('value - 200 - coalesce(k, 0) * (hi - lo) * 0.01')} AS value FROM emb LEFT JOIN ring USING (row, col), (SELECT min(value) lo, max(value) hi FROM emb)")
def _(spark, sf):
    return out(focal.carve_shoreline(X.emb(spark, sf).withColumn("value", F.col("value") - 200), emb_shape(spark, sf)))


@query("f9_edge_score", OFF.format(t="emb", r=1) + f", d AS (SELECT max(row) AS mr FROM emb), g AS (SELECT row, col, sqrt(pow(sum(-dc * (2 - abs(dr)) * value), 2) + pow(sum(-dr * (2 - abs(dc)) * value), 2)) AS value FROM nb, d WHERE row > 0 AND row < mr AND col > 0 AND col < 63 GROUP BY 1, 2) SELECT row, col, {s6('(value - m) / s')} AS value FROM g, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM g)")
def _(spark, sf):
    g = focal.sobel(X.emb(spark, sf), emb_shape(spark, sf))
    s = raster.with_stats(g, m=F.avg("value"), s=F.stddev_pop("value"))
    return out(s.withColumn("value", F.try_divide(F.col("value") - F.col("m"), F.nullif("s", F.lit(0.0)))))


@query("a2_water_coverage", f"SELECT count(*) FILTER (class_id = 80) AS water, count(*) AS total, {s6('100 * count(*) FILTER (class_id = 80) / count(*)')} AS percent FROM cover")
def _(spark, sf):
    return zonal.water_coverage(X.cover(spark, sf)).withColumn("percent", r6("percent"))


@query("a3_a4_histogram_cdf", ", h AS (SELECT least(39, floor((value - lo) / (hi - lo) * 40))::INT AS bin, count(*) AS n FROM emb, (SELECT min(value) lo, max(value) hi FROM emb) GROUP BY 1) SELECT b::INT AS bin, coalesce(n, 0)::BIGINT AS n, (sum(coalesce(n, 0)) OVER (ORDER BY b))::BIGINT AS cdf FROM range(40) t(b) LEFT JOIN h ON bin = b")
def _(spark, sf):
    return zonal.histogram(X.emb(spark, sf))


@query("a5_percentile_clip", v("least(greatest(value, a), b)") + " FROM emb, (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM emb)")
def _(spark, sf):
    return out(zonal.percentile_clip(X.emb(spark, sf), 0.02, 0.98))


@query("a6_robust_normalise", ", p AS (SELECT quantile_cont(value, 0.01) AS l1, quantile_cont(value, 0.5) AS l2, quantile_cont(value, 0.99) AS l3 FROM emb WHERE (row * 64 + col) % 10 = 0)" + v("CASE WHEN value - l2 < 0 THEN (value - l2) / nullif(greatest(l1, l2 - 1), 0) ELSE (value - l2) / nullif(l3, 0) END") + " FROM emb, p")
def _(spark, sf):
    e = X.emb(spark, sf)
    return out(zonal.robust_normalise(e, e.where("(row * 64 + col) % 10 = 0")))


@query("a8_class_areas", f"SELECT class_id, count(*) AS n, {s6('count(*) / (SELECT count(*) FROM cover)')} AS share FROM cover GROUP BY ROLLUP (class_id)")
def _(spark, sf):
    return zonal.class_areas(X.cover(spark, sf)).select("class_id", "n", r6("share").alias("share"))


ZONE = ", z AS (SELECT name, value FROM li JOIN reg ON 90 - (row + 0.5) * 1.40625 >= south AND 90 - (row + 0.5) * 1.40625 < north AND -180 + (col + 0.5) * 2.8125 >= west AND -180 + (col + 0.5) * 2.8125 < east)"


@query("a9_zonal_summary", ZONE + f"SELECT name, {s6('min(value)')} AS lo, {s6('max(value)')} AS hi, {s6('avg(value)')} AS mean, {s6('max(value) - min(value)')} AS ptp, count(*) AS n FROM z GROUP BY name")
def _(spark, sf):
    z = zonal.zones(X.li(spark, sf), X.regions(spark, sf).select("name", "north", "south", "east", "west"), X.WORLD, (128, 128))
    return zonal.summary(z, ["name"]).select("name", *(r6(c).alias(c) for c in ("lo", "hi", "mean", "ptp")), "n")


@query("a16_similarity", ", j AS (SELECT value AS x, class_id::DOUBLE AS y FROM li JOIN cover USING (row, col)), c AS (SELECT x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM j)" + f"SELECT {s6('sum(x * y) / sqrt(sum(x * x) * sum(y * y))')} AS ncc FROM c")
def _(spark, sf):
    return zonal.similarity(X.li(spark, sf), X.cover(spark, sf).select("row", "col", F.col("class_id").cast("double").alias("value"))).select(r6("ncc").alias("ncc"))


@query("a17_edge_coverage", f"SELECT {s6('avg((abs((value - m) / s) > 0.5)::INT)')} AS coverage, avg((abs((value - m) / s) > 0.5)::INT) < 0.02 AS low FROM emb, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM emb)")
def _(spark, sf):
    s = raster.with_stats(X.emb(spark, sf), m=F.avg("value"), s=F.stddev_pop("value"))
    share = F.avg((F.abs(F.try_divide(F.col("value") - F.col("m"), F.nullif("s", F.lit(0.0)))) > 0.5).cast("double"))
    return s.agg(r6(share).alias("coverage"), (share < 0.02).alias("low"))


@query("u3_layer_intersection", "SELECT row, col FROM li WHERE value > 0 INTERSECT SELECT row, col FROM cover WHERE class_id = 80")
def _(spark, sf):
    return X.li(spark, sf).where("value > 0").select("row", "col").intersect(X.cover(spark, sf).where("class_id = 80").select("row", "col"))


@query("l1_aspect_check", f"SELECT name, {s6('abs(1.5 - g) / g')} AS off, abs(1.5 - g) / g <= 0.05 AS ok FROM (SELECT name, (east - west) * cos(radians((north + south) / 2)) / (north - south) AS g FROM reg)")
def _(spark, sf):
    g = (F.col("east") - F.col("west")) * F.cos(F.radians((F.col("north") + F.col("south")) / 2)) / (F.col("north") - F.col("south"))
    off = F.abs(1.5 - g) / g
    return X.regions(spark, sf).select("name", r6(off).alias("off"), (off <= 0.05).alias("ok"))


SHIFTS = ", o AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc)), j AS (SELECT dr, dc, p.value AS x, q.value AS y FROM o, emb p JOIN emb q ON q.row = p.row + dr AND q.col = p.col + dc)"


@query("l2_registration_shift", SHIFTS + f", s AS (SELECT dr, dc, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS n FROM j GROUP BY 1, 2) SELECT dr::INT AS dr, dc::INT AS dc, round(n, 4) + 0::DOUBLE AS ncc, n = (SELECT max(n) FROM s) AS best FROM s")
def _(spark, sf):
    e = X.emb(spark, sf)
    s = terrain.shift_scores(e, e, focal.square(2))
    return s.crossJoin(F.broadcast(s.agg(F.max("ncc").alias("top")))).select("dr", "dc", (F.round("ncc", 4) + F.lit(0.0)).alias("ncc"), (F.col("ncc") == F.col("top")).alias("best"))


@query("flagship_region_report", RIVER + f""", dem AS (SELECT li.row, li.col, CASE WHEN coalesce(rr.value, 0) <> 0 THEN least(li.value, rr.value) ELSE li.value END AS value, (class_id = 80)::INT AS water FROM li LEFT JOIN rr USING (row, col) JOIN cover USING (row, col)),
w AS (SELECT row, col, water, value - water * (hi - lo) * 0.05 AS value FROM dem, (SELECT min(value) lo, max(value) hi FROM dem)),
z AS (SELECT name, value, water FROM w JOIN reg ON 90 - (row + 0.5) * 1.40625 >= south AND 90 - (row + 0.5) * 1.40625 < north AND -180 + (col + 0.5) * 2.8125 >= west AND -180 + (col + 0.5) * 2.8125 < east)
SELECT name, {s6('min(value)')} AS lo, {s6('max(value)')} AS hi, {s6('avg(value)')} AS mean, count(*) AS n, {s6('100 * sum(water) / count(*)')} AS water_percent FROM z GROUP BY name""")
def flagship(spark, sf):
    """Per region: heights after burning rivers and subtracting water, and water coverage; one plan."""
    water = X.cover(spark, sf).select("row", "col", (F.col("class_id") == 80).cast("double").alias("value"))
    dem = raster.subtract_water(raster.merge_rivers(X.li(spark, sf), river(spark, sf)), water, 0.05)
    cells = dem.join(water.withColumnRenamed("value", "water"), ["row", "col"])
    z = zonal.zones(cells, X.regions(spark, sf).select("name", "north", "south", "east", "west"), X.WORLD, (128, 128))
    a = z.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.count("*").alias("n"), (100 * F.sum("water") / F.count("*")).alias("p"))
    return a.select("name", r6("lo").alias("lo"), r6("hi").alias("hi"), r6("mean").alias("mean"), "n", r6("p").alias("water_percent"))


