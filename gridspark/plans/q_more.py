"""Segmentation, rotation, aligned projections, windows and reports."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.operators import focal, raster, segment, zonal
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import r6, s6, sql
from gridspark.plans.q_raster import GW, LATS, OFF, REFLECT, emb_shape, out, smooth_ctes

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


@query("g6_no_projection", f"SELECT row, col, {s6('value')} AS value FROM li")
def _(spark, sf):
    return out(raster.project(X.li(spark, sf), X.WORLD, (128, 128), "none"))


COS = f", c AS (SELECT i::INT AS row, cos(radians({LATS})) AS c FROM range(128) t(i)), r AS (SELECT row, round(c / (SELECT avg(c) FROM c), 12) AS s FROM c), w AS (SELECT row, floor(128 * s)::INT AS width, floor((128 - floor(128 * s)) / 2)::INT AS start FROM r WHERE s >= 0.01 AND floor(128 * s) >= 1), k AS (SELECT row, col::INT AS col, round(CASE WHEN width > 1 THEN (col - start) / (width - 1)::DOUBLE * 127 ELSE 0 END, 9) AS pos FROM w, unnest(range(greatest(start, 0), least(start + width, 128))) u(col)), e AS (SELECT row, col, floor(pos)::INT + d AS src, CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM k, range(2) x(d))"


@query("g14_aligned_projection", COS + ", m AS (SELECT e.row, e.col, sum(w * (class_id = 80)::INT) AS v FROM e JOIN cover ON cover.row = e.row AND cover.col = src WHERE w > 0 GROUP BY 1, 2) SELECT m.row, m.col, (v > 0.500000001)::INT AS water, class_id FROM m JOIN k USING (row, col) LEFT JOIN cover ON cover.row = m.row AND cover.col = round_even(pos, 0)::INT")
def _(spark, sf):
    c = X.cover(spark, sf)
    mask = c.select("row", "col", (F.col("class_id") == 80).cast("double").alias("value"))
    return raster.aligned(mask, c.withColumnRenamed("class_id", "value"), X.WORLD, (128, 128)).select("row", "col", "water", "class_id")


@query("g15_rgb_projection", COS + ", px AS (SELECT row, col, unnest(['r', 'g', 'b']) AS band, unnest([(row * 7 + col) % 256, (row + col * 5) % 256, class_id % 256]) AS v FROM cover) SELECT band, e.row, e.col, " + s6("least(255, greatest(0, sum(w * v)))") + " AS value FROM e JOIN px ON px.row = e.row AND px.col = src WHERE w > 0 GROUP BY 1, 2, 3")
def _(spark, sf):
    bands = ((F.col("row") * 7 + F.col("col")) % 256, (F.col("row") + F.col("col") * 5) % 256, F.col("class_id") % 256)
    px = X.cover(spark, sf).select("row", "col", F.inline(F.array(*(F.struct(F.lit(n).alias("band"), v.cast("double").alias("value")) for n, v in zip("rgb", bands, strict=True)))))
    done = raster.project(px, X.WORLD, (128, 128), "cosine", by=("band",))
    return done.select("band", "row", "col", r6(F.least(F.lit(255.0), F.greatest(F.lit(0.0), "value"))).alias("value"))


COS30, SIN30 = repr(math.cos(math.radians(30))), repr(math.sin(math.radians(30)))


@query("g18_rotate", f", k AS (SELECT r::INT AS row, c::INT AS col, round((r - 63.5) * {COS30}::DOUBLE - (c - 63.5) * {SIN30}::DOUBLE + 63.5, 9) AS y, round((r - 63.5) * {SIN30}::DOUBLE + (c - 63.5) * {COS30}::DOUBLE + 63.5, 9) AS x FROM range(128) a(r), range(128) b(c)), e AS (SELECT row, col, floor(y)::INT + dy AS sr, floor(x)::INT + dx AS sc, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM k, range(2) p(dy), range(2) q(dx) WHERE y BETWEEN 0 AND 127 AND x BETWEEN 0 AND 127) SELECT e.row, e.col, {s6('sum(w * value)')} AS value FROM e JOIN li ON li.row = sr AND li.col = sc WHERE w > 0 GROUP BY 1, 2")
def _(spark, sf):
    return out(raster.rotate(X.li(spark, sf), (128, 128), 30))


EQ_X = [100 * k / 14 for k in range(15)]
EQ_P = [1 / (1 + math.exp(-(x - 50) / 8)) for x in EQ_X]


@query("a7_equalise", f", q AS (SELECT quantile_cont(value, {EQ_P}) AS q FROM emb WHERE value > 0), t AS (SELECT row, col, value, q, list_count(list_filter(q, lambda z: z <= value)) AS k FROM emb, q) SELECT row, col, {s6('CASE WHEN value <= 0 THEN value WHEN value <= q[1] THEN 0 WHEN k >= 15 THEN 100 ELSE (k - 1 + (value - q[k]) / (q[k + 1] - q[k])) * 100 / 14 END')} AS value FROM t")
def _(spark, sf):
    return out(segment.equalise(X.emb(spark, sf)))


def objects(cells: str, least: int) -> str:
    """obj(k, row, col): the cells of 4-connected objects of at least so many cells, k by k."""
    same = "x.k = y.k AND ((y.row = x.row AND abs(y.col - x.col) = 1) OR (y.col = x.col AND abs(y.row - x.row) = 1))"
    return f", ob AS MATERIALIZED ({cells}), oe AS MATERIALIZED (SELECT x.k, x.row AS r1, x.col AS c1, y.row AS r2, y.col AS c2 FROM ob x JOIN ob y ON {same}), oc AS (SELECT k, row AS r0, col AS c0, row, col FROM ob UNION SELECT oc.k, r0, c0, r2, c2 FROM oc JOIN oe ON oe.k = oc.k AND r1 = row AND c1 = col), on_ AS (SELECT k, r0, c0, count(*) AS n FROM oc GROUP BY 1, 2, 3), obj AS (SELECT k, r0 AS row, c0 AS col FROM on_ WHERE n >= {least}) "


DIST = ", rf(k, a, b, c) AS (VALUES " + ", ".join(f"({k + 1}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for k, c in enumerate(segment.COLOURS)) + f"""), px AS (SELECT row, col, ((row * 7 + col * 3) % 256) / 255::DOUBLE AS r, ((row * 5 + col * 11) % 256) / 255::DOUBLE AS g, abs(value) / 1000 AS b0 FROM emb),
d0 AS (SELECT k, row, col, -sqrt(pow(r - a, 2) + pow(g - b, 2) + pow(b0 - c, 2)) AS value FROM px, rf), d AS (SELECT k, row, col, greatest(value, avg(value) OVER (PARTITION BY k)) AS value FROM d0),
gw(j, w) AS ({GW(20.0)[1:-1]}), dim AS (SELECT max(row) + 1 AS nr FROM emb),
o1 AS (SELECT t.row, j, w, CASE WHEN ((t.row + j) % (2 * nr) + 2 * nr) % (2 * nr) < nr THEN ((t.row + j) % (2 * nr) + 2 * nr) % (2 * nr) ELSE 2 * nr - 1 - ((t.row + j) % (2 * nr) + 2 * nr) % (2 * nr) END AS src FROM (SELECT DISTINCT row FROM emb) t, gw, dim),
o2 AS (SELECT t.col, j, w, CASE WHEN ((t.col + j) % 128 + 128) % 128 < 64 THEN ((t.col + j) % 128 + 128) % 128 ELSE 127 - ((t.col + j) % 128 + 128) % 128 END AS src FROM (SELECT DISTINCT col FROM emb) t, gw),
b1 AS (SELECT k, o1.row, d.col, sum(w * value) AS value FROM d JOIN o1 ON d.row = src GROUP BY 1, 2, 3), b2 AS (SELECT k, b1.row, o2.col, sum(w * value) AS value FROM b1 JOIN o2 ON b1.col = src GROUP BY 1, 2, 3),
h AS (SELECT k, row, col, greatest(d.value - b2.value, 0) AS value FROM d JOIN b2 USING (k, row, col)), st AS (SELECT k, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM h GROUP BY k),
z AS (SELECT k, row, col, (least(greatest(value, med - 3 * sd), med + 3 * sd) - least(greatest(lo, med - 3 * sd), med + 3 * sd)) / nullif(least(greatest(hi, med - 3 * sd), med + 3 * sd) - least(greatest(lo, med - 3 * sd), med + 3 * sd), 0) AS t FROM h JOIN st USING (k))"""


@query("f10_colour_segments", DIST + objects("SELECT k, row, col FROM z WHERE t > 0.7501234", 20) + "SELECT row, col, max(k) AS label FROM obj GROUP BY 1, 2")
def _(spark, sf):
    px = X.emb(spark, sf).select("row", "col", ((F.col("row") * 7 + F.col("col") * 3) % 256 / 255.0).alias("r"), ((F.col("row") * 5 + F.col("col") * 11) % 256 / 255.0).alias("g"), (F.abs("value") / 1000).alias("b"))
    return segment.colour_segments(px, emb_shape(spark, sf), cut=0.7501234)


#: Bright diagonal lines, five cells wide, over a noisy ground.
LINES = ", px AS (SELECT row, col, value, CASE WHEN (row + col) % 40 < 5 THEN 0.6 ELSE 0.1 END AS b FROM emb), nm AS (SELECT row, col, sqrt(pow(b, 2) + pow(b * 0.9, 2) + pow(b + abs(value) / 4000, 2)) AS value FROM px)"


@query("f11_bright_lines", LINES + ", c AS (SELECT row, col, least(greatest(value, med - 2 * sd), med + 2 * sd) AS value FROM nm, (SELECT quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM nm))" + smooth_ctes(31.0, "c") + ", hp AS (SELECT row, col, c.value - g2.value AS value FROM c JOIN g2 USING (row, col))" + REFLECT.format(t="hp") + ", m AS (SELECT row, col, greatest(quantile_cont(value, 0.5), 0) AS value FROM nb GROUP BY 1, 2)" + objects("SELECT 1 AS k, row, col FROM m, (SELECT quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM m) WHERE value > med + sd", 100) + "SELECT row, col FROM obj")
def _(spark, sf):
    b = F.when((F.col("row") + F.col("col")) % 40 < 5, 0.6).otherwise(0.1)
    px = X.emb(spark, sf).select("row", "col", b.alias("r"), (b * 0.9).alias("g"), (b + F.abs("value") / 4000).alias("b"))
    return segment.bright_lines(px, emb_shape(spark, sf))


@query("l3_similarity_gain", ", j0 AS (SELECT a.value AS x, b.value AS y FROM emb a JOIN emb b ON a.row = b.row AND a.col = b.col + 1), j1 AS (SELECT value AS x, value AS y FROM emb), n AS (SELECT (SELECT covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) FROM j0) AS a, (SELECT covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) FROM j1) AS b) SELECT round(a, 5) + 0::DOUBLE AS before, round(b, 5) + 0::DOUBLE AS after, round(b - a, 5) + 0::DOUBLE AS gain FROM n")
def _(spark, sf):
    e = X.emb(spark, sf)
    moved = e.withColumn("col", F.col("col") + 1)
    a, b = zonal.similarity(e, moved).withColumnRenamed("ncc", "a"), zonal.similarity(e, e).withColumnRenamed("ncc", "b")
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return a.crossJoin(F.broadcast(b)).select(five(F.col("a")).alias("before"), five(F.col("b")).alias("after"), five(F.col("b") - F.col("a")).alias("gain"))


@query("r14_ramp_rainbow", ", nn AS (SELECT row, col, 0.66 * (1 - (value - lo) / (hi - lo)) * 6 AS h FROM li, (SELECT min(value) lo, max(value) hi FROM li)) SELECT row, col, " + ", ".join(f"{s6(f'greatest(0, least(1, {e}))')} AS {n}" for e, n in (("abs(h - 3) - 1", "r"), ("2 - abs(h - 2)", "g"), ("2 - abs(h - 4)", "b"))) + " FROM nn")
def _(spark, sf):
    n = raster.normalise(X.li(spark, sf))
    return n.select("row", "col", *(r6(x).alias(c) for x, c in zip(raster.rainbow(F.col("value")), "rgb", strict=True)))


@query("w1_newest_per_namespace", "SELECT namespace, event_id, n FROM (SELECT namespace, event_id, row_number() OVER (PARTITION BY namespace ORDER BY cached_at DESC, event_id DESC)::INT AS n FROM req) WHERE n <= 50")
def _(spark, sf):
    n = F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("cached_at"), F.desc("event_id")))
    return X.requests(spark, sf).select("namespace", "event_id", n.alias("n")).where("n <= 50")


@query("w2_neighbours_along_rows", f"SELECT row, col, {s6('value - lag(value) OVER (PARTITION BY row ORDER BY col)')} AS step, {s6('lead(value) OVER (PARTITION BY row ORDER BY col) - value')} AS next FROM li")
def _(spark, sf):
    w = W.partitionBy("row").orderBy("col")
    return X.li(spark, sf).select("row", "col", r6(F.col("value") - F.lag("value").over(w)).alias("step"), r6(F.lead("value").over(w) - F.col("value")).alias("next"))


@query("w3_row_runs", ", g AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM li WHERE value > 0) SELECT row, min(col) AS first, max(col) AS last, count(*) AS n FROM g GROUP BY row, g")
def _(spark, sf):
    from gridspark.operators import vector

    return vector.runs(X.li(spark, sf).where("value > 0").select("row", "col")).select("row", "first", "last", "n")


@query("w5_class_share_by_row", f"SELECT row, class_id, count(*) AS n, {s6('count(*) / sum(count(*)) OVER (PARTITION BY row)')} AS share FROM cover GROUP BY row, class_id")
def _(spark, sf):
    n = X.cover(spark, sf).groupBy("row", "class_id").agg(F.count("*").alias("n"))
    return n.select("row", "class_id", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("row"))).alias("share"))


@query("e1_region_dem", ", k AS (SELECT r::INT AS row, c::INT AS col, least(greatest((r + 0.5) * 2 - 0.5, 0), 127)::DOUBLE AS y, least(greatest((c + 0.5) * 2 - 0.5, 0), 127)::DOUBLE AS x FROM range(64) a(r), range(64) b(c)), e AS (SELECT row, col, least(floor(y)::INT + dy, 127) AS sr, least(floor(x)::INT + dx, 127) AS sc, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM k, range(2) p(dy), range(2) q(dx)), d AS (SELECT e.row, e.col, sum(w * value) AS value FROM e JOIN li ON li.row = sr AND li.col = sc WHERE w > 0 GROUP BY 1, 2) " + f"SELECT name, {s6('min(value)')} AS lo, {s6('max(value)')} AS hi, {s6('avg(value)')} AS mean, count(*) AS n FROM d JOIN reg ON 90 - (row + 0.5) * 2.8125 >= south AND 90 - (row + 0.5) * 2.8125 < north AND -180 + (col + 0.5) * 5.625 >= west AND -180 + (col + 0.5) * 5.625 < east GROUP BY name")
def _(spark, sf):
    small = raster.resample_bilinear(X.li(spark, sf), (128, 128), (64, 64))
    z = zonal.zones(small, X.regions(spark, sf).select("name", "north", "south", "east", "west"), X.WORLD, (64, 64))
    return zonal.summary(z, ["name"]).select("name", *(r6(c).alias(c) for c in ("lo", "hi", "mean")), "n")


@query("f1_box_kernel", OFF.format(t="emb", r=1) + f", d AS (SELECT max(row) AS mr FROM emb) SELECT row, col, {s6('sum(value) / 9')} AS value FROM nb, d WHERE row > 0 AND row < mr AND col > 0 AND col < 63 GROUP BY 1, 2")
def _(spark, sf):
    h, w = emb_shape(spark, sf)
    k = [1 / 3] * 3
    s = focal.pass_along(focal.pass_along(X.emb(spark, sf), "row", h, k, "reflect101"), "col", w, k, "reflect101")
    return out(s.where(f"row > 0 and row < {h - 1} and col > 0 and col < {w - 1}"))
