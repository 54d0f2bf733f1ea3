"""Tiles, mosaics and other sources as tables; what is scanned stays a DataFrame of cells, tiles or features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import geo


def extent_of_name(df: DataFrame, path: str) -> DataFrame:
    """df plus north, south, west, east read from names like t_n90.0_s67.5_w-180.0_e-135.0.tif; a bad name is an error."""
    out = df
    for k, name in (("n", "north"), ("s", "south"), ("w", "west"), ("e", "east")):
        text = F.regexp_extract(path, rf"_{k}(-?[0-9]+(\.[0-9]+)?)", 1)
        out = out.withColumn(name, F.when(text == "", F.raise_error(F.concat(F.lit("no extent in "), F.col(path)))).otherwise(text.try_cast("double")))
    return out


def to_tiles(cells: DataFrame, side: int, value: str = "value") -> DataFrame:
    """Cells packed into tiles(tr, tc, data): data holds (position in the tile, value), at most side x side."""
    tr, tc = F.floor(F.col("row") / side).cast("int"), F.floor(F.col("col") / side).cast("int")
    at = (F.col("row") % side) * side + F.col("col") % side
    return cells.groupBy(tr.alias("tr"), tc.alias("tc")).agg(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("value"))).alias("data"))


def mosaic(tiles: DataFrame, side: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a window (inclusive) cut from the tiles that meet it, counted from its corner."""
    hit = tiles.where(f"tr between {rows[0] // side} and {rows[1] // side} and tc between {cols[0] // side} and {cols[1] // side}")
    cells = hit.select("tr", "tc", F.inline("data")).select((F.col("tr") * side + F.floor(F.col("at") / side)).cast("int").alias("row"), (F.col("tc") * side + F.col("at") % side).cast("int").alias("col"), "value")
    return cells.where(f"row between {rows[0]} and {rows[1]} and col between {cols[0]} and {cols[1]}").select((F.col("row") - rows[0]).alias("row"), (F.col("col") - cols[0]).alias("col"), "value")


def grid(spark: SparkSession, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """All keys of a window (end exclusive), made on the executors."""
    width = cols[1] - cols[0]
    n = (rows[1] - rows[0]) * width
    return spark.range(n).select((F.floor(F.col("id") / width) + rows[0]).cast("int").alias("row"), (F.col("id") % width + cols[0]).cast("int").alias("col"))


def section(tiles: DataFrame, side: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A complete window (end exclusive): cells of missing tiles count 0, negative heights are raised to 0."""
    have = mosaic(tiles, side, (rows[0], rows[1] - 1), (cols[0], cols[1] - 1)).select((F.col("row") + rows[0]).cast("int").alias("row"), (F.col("col") + cols[0]).cast("int").alias("col"), "value")
    return grid(tiles.sparkSession, rows, cols).join(have, ["row", "col"], "left").select("row", "col", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("value"))


def missing_tiles(tiles: DataFrame, trs: tuple[int, int], tcs: tuple[int, int]) -> DataFrame:
    want = grid(tiles.sparkSession, trs, tcs).select(F.col("row").alias("tr"), F.col("col").alias("tc"))
    return want.join(tiles.select("tr", "tc"), ["tr", "tc"], "left_anti")


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two texts are numbers, as north and south in their order; equal or unreadable ones go."""
    x, y = F.col(a).try_cast("double"), F.col(b).try_cast("double")
    return df.withColumn("north", F.greatest(x, y)).withColumn("south", F.least(x, y)).where(x.isNotNull() & y.isNotNull() & (x != y))


#: Old settings' defaults by name, with their kind. Fixed values.
LEGACY = {"dim": ("int", 600), "depth_scale": ("double", 0.5), "water_scale": ("double", 0.05), "height": ("double", 25.0), "base": ("double", 5.0), "subtract_water": ("boolean", True), "sat_scale": ("int", 500)}


def legacy_regions(df: DataFrame, json: str) -> DataFrame:
    """Old JSON settings with defaults: params.x first, then x; the label is the continent where there is none."""

    def get(name: str) -> Column:
        kind, default = LEGACY[name]
        paths = [f"$.params.{name}", *(["$.k"] if name == "dim" else []), f"$.{name}"]
        return F.coalesce(*(F.get_json_object(json, p).try_cast(kind) for p in paths), F.lit(default).cast(kind))

    out = df.withColumns({name: get(name) for name in LEGACY})
    return out.withColumn("label", F.coalesce(F.nullif(F.get_json_object(json, "$.label"), F.lit("")), F.get_json_object(json, "$.continent")))


def convert_tile_index(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Reads a tile index (CSV with a header: name, a, b, and other texts), keeps rows whose latitudes are numbers, writes regions (name, north, south) as CSV and
    returns them as read back."""
    rows = spark.read.csv(source, header=True, schema="name string, a string, b string")
    ordered_pairs(rows, "a", "b").select("name", "north", "south").write.mode("errorifexists").csv(target, header=True)
    return spark.read.csv(target, header=True, schema="name string, north double, south double")


def write_arrays(cells: DataFrame, meta: DataFrame, path: str) -> None:
    """Cells (namespace, key, row, col, value) as 32-bit floats by namespace, and a table of metadata (namespace, key, ...) beside them."""
    cells.withColumn("value", F.col("value").cast("float")).write.mode("errorifexists").partitionBy("namespace").parquet(f"{path}/arrays")
    meta.write.mode("errorifexists").parquet(f"{path}/meta")


def read_arrays(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """The cells of a namespace with their arrays' metadata; only its partition is read."""
    meta = spark.read.parquet(f"{path}/meta").where(F.col("namespace") == namespace)
    return spark.read.parquet(f"{path}/arrays").where(F.col("namespace") == namespace).join(meta, ["namespace", "key"])


FEATURES = "struct<type:string,features:array<struct<id:bigint,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:map<string,string>>>>"


def geojson_polygons(df: DataFrame, json: str) -> DataFrame:
    """Features of FeatureCollection documents as (feature_id, geom_type, parts, props)."""
    f = df.select(F.explode(F.from_json(json, FEATURES)["features"]).alias("f"))
    parts = F.transform("f.geometry.coordinates", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select(F.col("f.id").alias("feature_id"), F.col("f.geometry.type").alias("geom_type"), parts.alias("parts"), F.col("f.properties").alias("props"))


#: How deep the coordinates of each geometry are nested above one point. Fixed values.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def geojson_features(df: DataFrame, json: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of any geometry as (feature_id, geom_type, parts, props): parts are lists of points, the rings of all polygons, the lines, or one list of the
    points. Another geometry has no parts."""
    raw = "struct<type:string,features:array<struct<id:bigint,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
    f = df.select(*keep, F.explode(F.from_json(json, raw)["features"]).alias("f")).select(*keep, F.col("f.id").alias("feature_id"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("__c"), F.col("f.properties").alias("props"))
    nested = lambda d: F.from_json("__c", "array<" * (d + 1) + "double" + ">" * (d + 1))
    flat = {0: F.array(F.array(nested(0))), 1: F.array(nested(1)), 2: nested(2), 3: F.flatten(nested(3))}
    parts = F.coalesce(*(F.when(F.col("geom_type").isin(*(k for k, d in DEPTH.items() if d == depth)), x) for depth, x in flat.items()), F.array().cast("array<array<array<double>>>"))
    points = F.transform(parts, lambda line: F.transform(line, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    return f.select(*keep, "feature_id", "geom_type", points.alias("parts"), "props")


def with_cover(reaches: DataFrame) -> DataFrame:
    """Reaches plus flat covering columns (pushed down to row groups when stored) and their order tier."""
    return reaches.select("*", F.when(F.col("ord_stra") >= 3, 1).otherwise(0).alias("tier"), F.least("x1", "xm", "x2").alias("min_x"), F.greatest("x1", "xm", "x2").alias("max_x"), F.least("y1", "ym", "y2").alias("min_y"), F.greatest("y1", "ym", "y2").alias("max_y"))


def within_box(df: DataFrame, box: tuple) -> DataFrame:
    """Features whose extent overlaps the box, edges included."""
    n, s, e, w = box
    return df.where((F.col("max_x") >= w) & (F.col("min_x") <= e) & (F.col("max_y") >= s) & (F.col("min_y") <= n))


#: name, metres per pixel. Fixed values.
DATASETS = (("SRTMGL1", 30), ("SRTMGL3", 90), ("AW3D30", 30), ("COP30", 30), ("COP90", 90), ("SRTM15Plus", 500))


def source_catalog(spark: SparkSession, has_key: bool) -> DataFrame:
    """Data sets with their resolution; remote ones need a key."""
    return spark.createDataFrame([(n, m, has_key) for n, m in DATASETS] + [("local", 90, True)], "dataset string, resolution_m int, available boolean")


def available_sources(uses: DataFrame, key: str, spark: SparkSession, has_key: bool) -> DataFrame:
    """uses plus the resolution and availability of the data set they name; unknown names have none and are not available."""
    c = F.broadcast(source_catalog(spark, has_key).withColumnRenamed("dataset", key))  # seven rows
    return uses.join(c, key, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def optimal_zoom(boxes: DataFrame, dim: int, low: int = 6, high: int = 18, tiles: int = 64) -> DataFrame:
    """boxes plus zoom: nearest to dim pixels over the diagonal, lowered until at most `tiles` tiles span a side."""
    n, s, e, w = (F.col(c) for c in ("north", "south", "east", "west"))
    mid = F.radians((n + s) / 2)
    metres = F.sqrt(F.pow((e - w) * geo.METRES_PER_DEGREE * F.cos(mid), 2) + F.pow((n - s) * geo.METRES_PER_DEGREE, 2))
    per_pixel = F.greatest(F.lit(1.0), metres / (dim * F.sqrt(F.lit(2.0))))
    z0 = F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.log2(geo.CIRCUMFERENCE / (256 * per_pixel)), 0)))

    def fits(z):
        k = F.pow(F.lit(2.0), z)
        (xa, ya), (xb, yb) = geo.mercator_tile(w, n, k), geo.mercator_tile(e, s, k)
        return (F.greatest(F.abs(xb - xa), F.abs(yb - ya)) + 1 <= tiles) & (z <= z0)

    return boxes.withColumn("zoom", F.coalesce(F.array_max(F.filter(F.sequence(F.lit(low), F.lit(high)), fits)), F.lit(low)))


def covering_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    n = F.lit(2.0**zoom)
    xa, ya = geo.mercator_tile(F.col("west"), F.col("north"), n)
    xb, yb = geo.mercator_tile(F.col("east"), F.col("south"), n)
    return boxes.withColumn("x", F.explode(F.sequence(xa, xb))).withColumn("y", F.explode(F.sequence(ya, yb)))


def geojson_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, feature_id, geom_type, parts, props) of all GeoJSON files under a path, plain or gzip, one document a file.

    A document is a FeatureCollection, whose layer is null, or an object of them by layer. Others give no rows. A file is read by one task; files are many."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("__j"))
    by_layer = F.map_filter(F.from_json("__j", "map<string,string>"), lambda k, v: F.coalesce(F.get_json_object(v, "$.type") == "FeatureCollection", F.lit(False)))
    one = F.coalesce(F.get_json_object("__j", "$.type") == "FeatureCollection", F.lit(False))
    docs = whole.where(one).select("file", F.lit(None).cast("string").alias("layer"), "__j").unionByName(whole.where(~one).select("file", F.explode(by_layer).alias("layer", "__j")))
    return geojson_features(docs, "__j", ("file", "layer"))


#: Geometries that a box filter knows. Fixed values.
LINES = ("LineString", "MultiLineString")


def parts_in_box(features: DataFrame, box: tuple, kinds: tuple[str, ...] = LINES) -> DataFrame:
    """Features (geom_type, parts) of known kinds one of whose parts has an extent that overlaps the box, edges included; features of other kinds go."""
    n, s, e, w = box
    least, most = (lambda p, c: F.array_min(F.transform(p, lambda q: q[c]))), (lambda p, c: F.array_max(F.transform(p, lambda q: q[c])))
    near = F.exists("parts", lambda p: (most(p, "x") >= w) & (least(p, "x") <= e) & (most(p, "y") >= s) & (least(p, "y") <= n))
    return features.where(F.col("geom_type").isin(*kinds) & near)
