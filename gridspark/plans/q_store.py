"""Stored layouts: the reach store, bucketed layers, the tile source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.operators import names, raster, store
from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import TALL, r6, s6, sql
from gridspark.plans.q_features import fresh
from gridspark.sources import tiles

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


def out(cells):
    return cells.select("row", "col", r6("value").alias("value"))


BOX = (60.0, 40.0, 20.0, 0.0)
OVER = "greatest(x1, xm, x2) >= 0 AND least(x1, xm, x2) <= 20 AND greatest(y1, ym, y2) >= 40 AND least(y1, ym, y2) <= 60"


@query("s10_river_store", f"SELECT reach_id, ord_stra, least(x1, xm, x2) AS min_x, greatest(y1, ym, y2) AS max_y FROM riv WHERE {OVER} AND ord_stra >= 4")
def _(spark, sf):
    path = fresh(spark, "reaches")
    store.write_reach_store(X.rivers(spark, sf), path)
    return store.read_reach_store(spark, path, BOX, 4).select("reach_id", "ord_stra", "min_x", "max_y")


def two_layers(spark, sf):
    t = X.tall(spark, sf)
    return t, t.where("(row + col) % 3 = 0").withColumn("value", F.col("value") * 2), t.where("row % 5 = 0").withColumn("value", F.lit(0.25))


MERGED = TALL + f" SELECT row, col, {s6('least(CASE WHEN (row + col) % 3 = 0 THEN value * 0.5 + value * 2 * 0.5 ELSE value END, CASE WHEN row % 5 = 0 THEN 0.25 ELSE 1e9 END)')} AS value FROM tall"


@query("r8_bucketed_layers", MERGED)
def _(spark, sf):
    # Layers are stored once; each merge of any of them then reads buckets side by side.
    root, names = fresh(spark, "layers"), []
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, cells in enumerate(two_layers(spark, sf)):
        names.append(f"layer_{uuid.uuid4().hex}")
        store.write_layer(cells, names[-1], f"{root}/{k}", buckets)
    return out(store.merge_stored(spark, names[0], [(names[1], "blend", 0.5), (names[2], "min", 1.0)]))


@query("r8_united_layers", MERGED)
def _(spark, sf):
    base, a, b = two_layers(spark, sf)
    return out(raster.merge_layers([(base, "base", 1.0), (a, "blend", 0.5), (b, "min", 1.0)]))


@query("s5_tile_source", ", g AS (SELECT r::INT AS row, c::INT AS col FROM range(100, 150) a(r), range(100, 150) b(c)) SELECT row, col, greatest(coalesce(value, 0), 0)::DOUBLE AS value FROM g LEFT JOIN li USING (row, col)")
def _(spark, sf):
    path = fresh(spark, "tiles")
    tiles.register(spark)
    tiles.write_tiles(X.li(spark, sf), path, 16, X.WORLD, (128, 128))
    return tiles.read_section(spark, path, 16, X.WORLD, (128, 128), (100, 150), (100, 150))


@query("sql_views", f"SELECT c.row // 32 AS band, count(*) AS n, {s6('avg(c.value)')} AS mean, count(DISTINCT r.name) AS regions FROM li c JOIN reg r ON 90 - (c.row + 0.5) * 180 / 128 >= r.south AND 90 - (c.row + 0.5) * 180 / 128 < r.north AND r.west = -180 AND c.col = 3 GROUP BY 1")
def _(spark, sf):
    rivers = X.rivers(spark, sf)
    segments = rivers.select("reach_id", "x1", "y1", "x2", "y2")
    tiles.create_views(X.li(spark, sf), rivers, segments, X.regions(spark, sf))
    mean = "floor(avg(c.value) * 1000000 + 0.4871D) / 1000000D + 0D"
    return spark.sql(f"SELECT c.row DIV 32 AS band, count(*) AS n, {mean} AS mean, count(DISTINCT r.name) AS regions FROM cells c JOIN regions r ON 90 - (c.row + 0.5D) * 180 / 128 >= r.south AND 90 - (c.row + 0.5D) * 180 / 128 < r.north AND r.west = -180 AND c.col = 3 GROUP BY 1")





# Names held before: every third number of a priority, and the third priority itself.
HELD = ", held AS (SELECT o_orderpriority || '_' || (3 * (o_orderkey % 200) + 2) AS name FROM orders UNION SELECT '3-MEDIUM'), bases AS (SELECT DISTINCT o_orderpriority AS b FROM orders)"
IMPORT = HELD + """, src AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN '  ' ELSE o_orderpriority END AS base, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_custkey % 90)::DOUBLE END AS north, (o_orderkey % 90)::DOUBLE AS south,
  CASE WHEN o_orderkey % 23 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS rotation FROM orders), ok AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM src WHERE trim(base) <> '' AND north > south),
top AS (SELECT base, max(r) AS m FROM ok GROUP BY base), num AS (SELECT base, i, row_number() OVER (PARTITION BY base ORDER BY i) AS r FROM top, unnest(range(1, 2 * m + 700)) u(i)
  WHERE CASE WHEN i = 1 THEN base ELSE base || '_' || i END NOT IN (SELECT name FROM held))"""


@query("s7_import_names", IMPORT + """ SELECT k, CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS name, north, CASE WHEN rotation <> 0 THEN '{"rotation": 1.5}' ELSE '{}' END AS settings FROM ok JOIN num USING (base, r)""")
def _(spark, sf):
    o = X.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    held = o.select(F.concat("o_orderpriority", F.lit("_"), 3 * (k % 200) + 2).alias("name")).union(spark.range(1).select(F.lit("3-MEDIUM")))
    text = lambda c: c.cast("string")
    rows = o.select(
        k.alias("k"), F.when(k % 31 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\t"))).alias("name"), F.when(k % 29 == 0, "x1").otherwise(text(F.col("o_custkey") % 90)).alias("north"),
        text(k % 90).alias("south"), F.lit("10").alias("east"), F.lit(" -1.5").alias("west"), F.when(k % 23 == 0, "1.5").otherwise("").alias("rotation"),
    )
    return names.import_regions(rows, "k", held).select("k", "name", "north", "settings")
