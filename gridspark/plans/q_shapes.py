"""Simplified lines and dissolved outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.operators import components, shapes, vector
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import s6, sql
from gridspark.plans.q_vector import BG, GRID, HEIGHT, house_segments, houses, recursive

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


#: A line a customer, a vertex an order.
TRACKS = ", pt AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey % 1000 / 10::DOUBLE AS x, o_totalprice / 10000 AS y FROM orders)"
SPLIT = (
    TRACKS + ", sg(k, a, b) AS (SELECT k, min(i), max(i) FROM pt GROUP BY k UNION ALL SELECT k, u.a, u.b FROM (SELECT k, a, b, arg_max(i, {'d': d, 'i': -i}) AS s FROM (SELECT sg.k, sg.a, sg.b, p.i, sqrt(pow(p.x - pa.x - t * (pb.x - pa.x), 2) + pow(p.y - pa.y - t * (pb.y - pa.y), 2)) AS d FROM sg JOIN pt p ON p.k = sg.k AND p.i > sg.a AND p.i < sg.b"
    " JOIN pt pa ON pa.k = sg.k AND pa.i = sg.a JOIN pt pb ON pb.k = sg.k AND pb.i = sg.b, LATERAL (SELECT least(1, greatest(0, coalesce(((p.x - pa.x) * (pb.x - pa.x) + (p.y - pa.y) * (pb.y - pa.y)) / nullif(pow(pb.x - pa.x, 2) + pow(pb.y - pa.y, 2), 0), 0))) AS t) l) q GROUP BY k, a, b HAVING max(d) > 7.3)"
    " m, LATERAL (SELECT unnest([m.a, m.s]) AS a, unnest([m.s, m.b]) AS b) u), st AS (SELECT k, a AS i FROM sg UNION SELECT k, b FROM sg)"
)


def tracks(spark, sf):
    o = X.table(spark, sf, "orders")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1  # a customer's orders
    return o.select(F.col("o_custkey").alias("k"), i.cast("int").alias("i"), (F.col("o_orderkey") % 1000 / 10).alias("x"), (F.col("o_totalprice") / 10000).cast("double").alias("y"))


@query("v6_simplified", SPLIT + " SELECT k, i::INT AS i FROM st")
def _(spark, sf):
    return shapes.simplified(tracks(spark, sf), "k", 7.3).select("k", "i")


@query("a11_simplification_bounded", SPLIT + f" SELECT count(DISTINCT pt.k) AS features, count(*) AS vertices_before, count(st.i) AS vertices_after, {s6('100 * (count(*) - count(st.i)) / count(*)')} AS vertices_gone FROM pt LEFT JOIN st USING (k, i)")
def _(spark, sf):
    before = tracks(spark, sf)
    both = shapes.as_lines(before, "k", "before").join(shapes.as_lines(shapes.simplified(before, "k", 7.3), "k", "after"), "k")
    n = vector.simplification(both.withColumn("layer", F.lit("tracks")), "layer", "before", "after")
    return n.select("features", F.col("vertices_before").cast("long").alias("vertices_before"), F.col("vertices_after").cast("long").alias("vertices_after"), X.r6("vertices_gone").alias("vertices_gone"))


SIZES = ", lc AS (SELECT DISTINCT label, row, col FROM lb), sizes AS (SELECT a.label, count(*) AS area, sum((n.label IS NULL)::INT + (s.label IS NULL)::INT + (e.label IS NULL)::INT + (w.label IS NULL)::INT)::BIGINT AS perimeter FROM lc a LEFT JOIN lc n ON n.label = a.label AND n.row = a.row - 1 AND n.col = a.col LEFT JOIN lc s ON s.label = a.label AND s.row = a.row + 1 AND s.col = a.col LEFT JOIN lc e ON e.label = a.label AND e.row = a.row AND e.col = a.col + 1 LEFT JOIN lc w ON w.label = a.label AND w.row = a.row AND w.col = a.col - 1 GROUP BY 1) SELECT label, area, perimeter FROM sizes"
PAIRS = f", b AS (SELECT *, {HEIGHT} AS hh FROM bld), pr AS (SELECT a.feature_id AS u, b.feature_id AS v FROM b a JOIN b ON a.hh = b.hh AND a.feature_id < b.feature_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"


@query("c1_dissolved_outlines", recursive(BG + PAIRS, "pr", "(SELECT feature_id AS n FROM b)", ", lb AS (SELECT root AS label, row, col FROM bc JOIN cc ON cc.node = bc.feature_id)" + SIZES))
def _(spark, sf):
    b = houses(spark, sf)
    pairs = vector.overlapping_links(b, "feature_id", "h").union(b.select("feature_id", "feature_id"))
    members = components.label(pairs).select(F.col("node").alias("feature_id"), F.col("root").alias("label"))
    cells = vector.burn_polygons(house_segments(spark, sf), GRID, ["feature_id"])
    return shapes.outline_sizes(shapes.dissolved(members, "label", cells, "feature_id"), "label").select("label", "area", "perimeter")


@query("c5_outlines_by_height", BG + ", lb AS (SELECT h AS label, row, col FROM bc)" + SIZES)
def _(spark, sf):
    cells = vector.burn_polygons(house_segments(spark, sf, ("feature_id", "h")), GRID, ["feature_id", "h"])
    return shapes.outline_sizes(shapes.outlines(cells.select(F.col("h").alias("label"), "row", "col"), "label"), "label").select("label", "area", "perimeter")
