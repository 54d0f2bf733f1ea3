"""Raster algebra over cells(row, col, value): per-cell expressions, layer joins on the cell key, one-row global statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["row", "col"]
#: Heights by land-cover class; classes that are not listed give 0. Fixed values.
COVER_OFFSET = {10: 5.0, 20: 0.0, 30: 0.0, 40: 0.0, 50: 10.0, 60: 0.0, 70: 0.0, 80: -10.0, 90: -5.0}
COVER_HEIGHT = {10: 8.0, 20: 1.5, 30: 0.3, 40: 0.8, 50: 6.0, 60: 0.0, 70: 0.0, 80: 0.0, 90: -0.5, 95: 3.0, 100: 0.0}
#: Colours by class; others (180, 0, 180). Fixed values.
COVER_RGB = {
    0: (0, 50, 150), 10: (34, 139, 34), 20: (107, 142, 35), 30: (144, 238, 144), 40: (210, 180, 140), 50: (128, 128, 128), 60: (205, 175, 130), 70: (240, 248, 255), 80: (30, 144, 255), 90: (0, 206, 209), 95: (0, 100, 0), 100: (188, 214, 182),
}
#: Control points of the named curves. Fixed values.
CURVES = {
    "linear": ((0.0, 0.0), (1.0, 1.0)), "enhance-peaks": ((0.0, 0.0), (0.3, 0.2), (0.5, 0.4), (0.7, 0.7), (0.85, 0.9), (1.0, 1.0)),
    "compress-depths": ((0.0, 0.2), (0.2, 0.3), (0.4, 0.45), (0.6, 0.6), (0.8, 0.8), (1.0, 1.0)), "s-curve": ((0.0, 0.0), (0.25, 0.1), (0.5, 0.5), (0.75, 0.9), (1.0, 1.0)),
}


def clean(cells: DataFrame) -> DataFrame:
    """NaN and null values mean no data: such cells are left out of statistics by becoming null."""
    return cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def with_stats(cells: DataFrame, **aggs: Column) -> DataFrame:
    """cells plus global statistics: one aggregated row, broadcast."""
    return cells.crossJoin(F.broadcast(cells.agg(*(a.alias(n) for n, a in aggs.items()))))


def scale_depth(v: Column, k: float) -> Column:
    return F.when(v < 0, v * k).otherwise(v)


def clip(cells: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values within [low, high]; null stays null (Spark's greatest and least skip nulls)."""
    v = F.col("value")
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return cells.withColumn("value", F.when(v.isNotNull(), out))


def normalise(cells: DataFrame) -> DataFrame:
    """To [0, 1]; a constant grid is unchanged."""
    s = with_stats(cells, lo=F.min("value"), hi=F.max("value"))
    return s.select(*KEY, F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(F.col("value")).alias("value"))


def invert(cells: DataFrame) -> DataFrame:
    s = with_stats(cells, lo=F.min("value"), hi=F.max("value"))
    return s.select(*KEY, (F.col("hi") - F.col("value") + F.col("lo")).alias("value"))


MODES = {
    "base": lambda b, x, w: b, "replace": lambda b, x, w: F.when(x != 0, x).otherwise(b), "blend": lambda b, x, w: b * (1 - w) + x * w,
    "rivers": lambda b, x, w: b - x * w, "max": lambda b, x, w: F.greatest(b, x), "min": lambda b, x, w: F.least(b, x),
}


def blend(base: DataFrame, layer: DataFrame, mode: str, weight: float = 1.0) -> DataFrame:
    """Two layers on one grid; where the layer has no cell the base stays. An unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown blend mode {mode}")
    j = base.join(layer.select(*KEY, F.col("value").alias("__l")), KEY, "left")
    return j.select(*KEY, F.when(F.col("__l").isNull(), F.col("value")).otherwise(MODES[mode](F.col("value"), F.col("__l"), weight)).alias("value"))


def merge_layers(layers: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """Layers blended in order onto the first; missing values of the base count 0, where it has no cell there is none.

    All are united and meet in one aggregation by cell, one exchange for any number of layers; a layer has a cell once at most. An unknown mode is an error."""
    for _, mode, _ in layers[1:]:
        if mode not in MODES:
            raise ValueError(f"unknown blend mode {mode}")
    names = [f"__{k}" for k in range(len(layers))]
    parts = [df.select(*KEY, *((F.col("value") if j == k else F.lit(None)).cast("double").alias(n) for j, n in enumerate(names)), F.lit(k == 0).alias("__base")) for k, (df, *_) in enumerate(layers)]
    cells = reduce(DataFrame.union, parts).groupBy(*KEY).agg(*(F.max(n).alias(n) for n in names), F.max("__base").alias("__base")).where("__base")
    value = F.coalesce(F.col(names[0]), F.lit(0.0))
    for n, (_, mode, w) in zip(names[1:], layers[1:], strict=True):
        value = F.when(F.col(n).isNull(), value).otherwise(MODES[mode](value, F.col(n), w))
    return cells.select(*KEY, value.alias("value"))


def merge_rivers(dem: DataFrame, river: DataFrame, mode: str = "absolute") -> DataFrame:
    """The lower of ground and river bed where a river is; relative: the bed lies below the ground by the river's depth."""
    j = dem.join(river.select(*KEY, F.col("value").alias("__r")), KEY, "left")
    bed = F.least("value", "__r") if mode == "absolute" else F.col("value") + F.col("__r")
    return j.select(*KEY, F.when(F.coalesce("__r", F.lit(0.0)) != 0, bed).otherwise(F.col("value")).alias("value"))


def subtract_water(dem: DataFrame, water: DataFrame, scale: float) -> DataFrame:
    s = with_stats(dem, lo=F.min("value"), hi=F.max("value")).join(water.select(*KEY, F.col("value").alias("__w")), KEY, "left")
    return s.select(*KEY, (F.col("value") - F.coalesce("__w", F.lit(0.0)) * (F.col("hi") - F.col("lo")) * scale).alias("value"))


def reclass(cells: DataFrame, table: dict, default: float = 0.0) -> DataFrame:
    t = F.broadcast(cells.sparkSession.createDataFrame([(k, float(v)) for k, v in table.items()], "class_id int, value double"))
    return cells.join(t, "class_id", "left").select(*KEY, F.coalesce("value", F.lit(default)).alias("value"))


def colourise(cells: DataFrame) -> DataFrame:
    t = F.broadcast(cells.sparkSession.createDataFrame([(k, *v) for k, v in COVER_RGB.items()], "class_id int, r int, g int, b int"))
    return cells.join(t, "class_id", "left").select(*KEY, *(F.coalesce(c, F.lit(d)).alias(c) for c, d in zip("rgb", (180, 0, 180), strict=True)))


def jet(t: Column) -> list[Column]:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return [unit(1.5 - F.abs(4 * t - k)) for k in (3, 2, 1)]


def rainbow(t: Column) -> list[Column]:
    """Hue from blue to red at full saturation and half lightness."""
    h = 0.66 * (1 - t) * 6
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return [unit(F.abs(h - 3) - 1), unit(2 - F.abs(h - 2)), unit(2 - F.abs(h - 4))]


def hot(t: Column) -> list[Column]:
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), 3 * t - k)) for k in (0, 1, 2)]


def gray(t: Column) -> list[Column]:
    return [t, t, t]


def hsl(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue of hue, saturation and lightness, all 0 to 1."""
    a = s * F.least(v, 1 - v)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 12, F.lit(12.0))
        return v - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return [channel(n) for n in (0, 8, 4)]


def viridis(t: Column) -> list[Column]:
    return hsl(0.7 - 0.7 * t, F.lit(0.9), F.lit(0.5))


#: Colours by their place, between which a ramp is linear. Fixed values.
STOPS = ((0.00, (0.10, 0.22, 0.50)), (0.30, (0.20, 0.50, 0.85)), (0.45, (0.20, 0.70, 0.30)), (0.60, (0.75, 0.70, 0.35)), (0.80, (0.55, 0.35, 0.20)), (1.00, (1.00, 1.00, 1.00)))
#: The default ramp's pieces: from, to, colour at either end. They don't meet at 0.4. Fixed values.
TERRAIN = ((0.0, 0.4, (0.0, 0.3, 0.0), (0.4, 0.7, 0.0)), (0.4, 0.8, (0.4, 0.6, 0.2), (0.55, 0.45, 0.15)), (0.8, 1.0, (0.55, 0.45, 0.15), (0.9, 0.9, 0.9)))


def pieces(t: Column, table: tuple) -> list[Column]:
    """Colours of a table of pieces (from, to, first, last), each linear; a place on a border belongs to the piece that begins there."""
    out = []
    for c in range(3):
        x = F.lit(float(table[-1][3][c]))
        for a, b, first, last in reversed(table):
            f = (t - a) / (b - a)
            inside = t < b if (a, b) != table[-1][:2] else F.lit(True)
            x = F.when(inside, first[c] * (1 - f) + last[c] * f).otherwise(x)
        out.append(x)
    return out


def terrain_ramp(t: Column) -> list[Column]:
    """The default: green lowlands, brown, white."""
    return pieces(t, TERRAIN)


def stops(t: Column, table: tuple = STOPS) -> list[Column]:
    return pieces(t, tuple((a, b, c, d) for (a, c), (b, d) in zip(table, table[1:], strict=False)))


RAMPS = {"jet": jet, "rainbow": rainbow, "raindow": rainbow, "viridis": viridis, "hot": hot, "gray": gray, "terrain": terrain_ramp, "stops": stops}


def ramp(cells: DataFrame, name: str = "terrain") -> DataFrame:
    """(row, col, r, g, b), 0 to 1, of values in 0..1, which are clamped; a name that is none of RAMPS gives the default."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "value"))
    return cells.select(*KEY, *(x.alias(c) for x, c in zip(RAMPS.get(name, terrain_ramp)(t), "rgb", strict=True)))


def sea_colour(cells: DataFrame) -> DataFrame:
    """Blue by depth for values below 0: (r, g, b) truncated to whole numbers; land is left out."""
    s = with_stats(cells.where("value < 0"), deep=F.max(F.abs("value")))
    t = F.least(F.lit(1.0), F.abs("value") / F.nullif("deep", F.lit(0.0)))
    return s.select(*KEY, F.floor(30 * (1 - t)).cast("int").alias("r"), F.floor(144 * (1 - t)).cast("int").alias("g"), F.floor(80 + 175 * (1 - t)).cast("int").alias("b"))


def remap(t: Column, points) -> Column:
    """Piecewise linear between control points, clamped to the first and last; as one expression that code generation covers."""
    pts = sorted(points)
    out = F.lit(float(pts[-1][1]))
    for (xa, ya), (xb, yb) in reversed(list(zip(pts, pts[1:], strict=False))):
        if xb > xa:
            out = F.when(t <= xb, ya + (t - xa) / (xb - xa) * (yb - ya)).otherwise(out)
    return F.when(t <= pts[0][0], F.lit(float(pts[0][1]))).otherwise(out)


def model_height(cells: DataFrame, height: float, base: float, exaggeration: float = 1.0, sea_cap: bool = False) -> DataFrame:
    v = F.col("value") * exaggeration
    c = cells.withColumn("value", F.greatest(v, F.lit(0.0)) if sea_cap else v)
    s = with_stats(c, lo=F.min("value"), hi=F.max("value"))
    return s.select(*KEY, (F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0)) * height + base).alias("value"))


def contours(cells: DataFrame, interval: float, height: float, base: float, engraved: bool = True) -> DataFrame:
    """Contour bands of a model-height grid whose relief spans `height`: every interval a line, every fifth twice as deep."""
    s = with_stats(cells, lo=F.min("value"), hi=F.max("value"))
    step = F.lit(float(interval))
    width = F.greatest(F.lit(0.3), step * 0.06)
    half = width / step / 2
    phase = F.pmod(F.col("value") - base, step) / step
    index = F.pmod(F.col("value") - base, step * 5) / (step * 5)
    on, big = (phase < half) | (phase > 1 - half), (index < half * 2) | (index > 1 - half * 2)
    depth = width * 0.8
    move = lambda d: F.greatest(F.col("value") - d, F.lit(base * 0.5)) if engraved else F.col("value") + d
    return s.select(*KEY, F.when(big, move(depth * 2)).when(on, move(depth)).otherwise(F.col("value")).alias("value"))


def crop(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    inside = cells.where(f"row >= {rows[0]} and row < {rows[1]} and col >= {cols[0]} and col < {cols[1]}")
    return inside.withColumn("row", F.col("row") - rows[0]).withColumn("col", F.col("col") - cols[0])


def cross_section(cells: DataFrame, at: int, height: float, base: float, axis: str = "row") -> DataFrame:
    """One row or column as model heights, stretched over its own range."""
    return model_height(cells.where(F.col(axis) == at), height, base)


def row_at(latitude: float, box: tuple, rows: int) -> int:
    """The row of a latitude in a box (north, south, ...), truncated and kept within the grid."""
    return min(max(int((box[0] - latitude) / (box[0] - box[1]) * rows), 0), rows - 1)


def clean_numbers(v: Column) -> Column:
    """NaN to 0, infinities to the largest 32-bit floats."""
    top = 3.4028234663852886e38
    return F.when(F.isnan(v), 0.0).when(v > top, top).when(v < -top, -top).otherwise(v)


def resample_nearest(cells: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """floor(dst * src / dst_n), as a gather: output keys are made per source row and column, then joined once."""
    g = _keys(cells, dst)
    pick = lambda c, k: F.least(F.floor(F.col(c) * src[k] / dst[k]), F.lit(src[k] - 1)).cast("int")
    return g.select("row", "col", pick("row", 0).alias("__r"), pick("col", 1).alias("__c")).join(cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value"), ["__r", "__c"]).select(*KEY, "value")


def _keys(cells: DataFrame, dst: tuple[int, int]) -> DataFrame:
    n = dst[0] * dst[1]
    return cells.sparkSession.range(n).select(F.floor(F.col("id") / dst[1]).cast("int").alias("row"), (F.col("id") % dst[1]).cast("int").alias("col"))


def resample_bilinear(cells: DataFrame, src: tuple[int, int], dst: tuple[int, int], align: str = "half_pixel") -> DataFrame:
    """Weighted sums of the four source cells around each output cell; edges clamp. align: half_pixel or corners."""
    g = _keys(cells, dst)

    def axis(c: str, k: int) -> Column:
        at = (F.col(c) + 0.5) * (src[k] / dst[k]) - 0.5 if align == "half_pixel" else F.col(c) * ((src[k] - 1) / max(1, dst[k] - 1))
        at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(src[k] - 1)))
        lo = F.floor(at).cast("int")
        return F.array(F.struct(lo.alias("i"), (1 - (at - lo)).alias("w")), F.struct(F.least(lo + 1, F.lit(src[k] - 1)).alias("i"), (at - lo).alias("w")))

    e = g.select("row", "col", F.explode(axis("row", 0)).alias("a"), axis("col", 1).alias("bs")).select("row", "col", "a", F.explode("bs").alias("b"))
    e = e.select("row", "col", F.col("a.i").alias("__r"), F.col("b.i").alias("__c"), (F.col("a.w") * F.col("b.w")).alias("w")).where("w > 0")
    return e.join(cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value"), ["__r", "__c"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def area_average(cells: DataFrame, factor: int) -> DataFrame:
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def is_categorical(cells: DataFrame, corner: int = 10, most: int = 20) -> DataFrame:
    """One row: true if the corner holds few different values, all whole."""
    c = cells.where(f"row < {corner} and col < {corner}")
    return c.agg((F.coalesce(F.bool_and(F.col("value") == F.floor("value")), F.lit(False)) & (F.count_distinct("value") <= most)).alias("categorical"))


def gather_rows(cells: DataFrame, rowmap: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Output rows as weighted sums of source rows: rowmap(row, src, w) is small (two entries a row) and broadcast."""
    return cells.withColumnRenamed("row", "src").join(F.broadcast(rowmap), "src").groupBy(*by, "row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _two(at: Column, nearest: bool) -> Column:
    """The places (src, w) that a position reads: two with their shares, or the nearest one."""
    if nearest:
        return F.array(F.struct(F.bround(at, 0).cast("int").alias("src"), F.lit(1.0).alias("w")))
    lo = F.floor(at).cast("int")
    return F.array(F.struct(lo.alias("src"), (1 - (at - lo)).alias("w")), F.struct((lo + 1).alias("src"), (at - lo).alias("w")))


def _latitude(i: Column, box: tuple, n: int) -> Column:
    return box[0] - i * ((box[0] - box[1]) / (n - 1))


def row_projection(cells: DataFrame, box: tuple, shape: tuple[int, int], kind: str, nearest: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Mercator and Lambert equal-area: the columns stay, output rows are interpolated between two source rows, or are the nearest one."""
    north, south = box[:2]
    rows = cells.sparkSession.range(shape[0]).select(F.col("id").cast("int").alias("row"))
    if kind == "mercator":
        y = lambda lat: F.ln(F.tan(F.pi() / 4 + F.radians(F.lit(max(-85.0, min(85.0, lat)))) / 2))
        at = y(north) + F.col("row") * ((y(south) - y(north)) / (shape[0] - 1))
        lat = F.degrees(2 * F.atan(F.exp(at)) - F.pi() / 2)
    else:
        y = lambda lat: F.sin(F.radians(F.lit(lat)))
        at = y(north) + F.col("row") * ((y(south) - y(north)) / (shape[0] - 1))
        lat = F.degrees(F.asin(F.least(F.greatest(at, F.lit(-1.0)), F.lit(1.0))))
    src = F.round((north - lat) / (north - south) * (shape[0] - 1), 9)
    # A position outside the grid has no value, not a partial one.
    return gather_rows(cells, rows.where((src >= 0) & (src <= shape[0] - 1)).select("row", F.inline(_two(src, nearest))).where("w > 0"), by)


def _gather_columns(keys: DataFrame, at: Column, cells: DataFrame, nearest: bool, by: tuple[str, ...]) -> DataFrame:
    """Output cells (row, col) of keys, each from the places `at` along its own row."""
    e = keys.select("row", "col", F.inline(_two(at, nearest))).where("w > 0")
    source = cells.select(*by, "row", F.col("col").alias("src"), "value")
    return e.join(source, ["row", "src"]).groupBy(*by, "row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def cosine(cells: DataFrame, box: tuple, shape: tuple[int, int], nearest: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Each row shrinks or grows to int(n cos(lat) / mean cos) columns, centred; what is wider than the grid is cropped."""
    m, n = shape
    rows = cells.sparkSession.range(m).select(F.col("id").cast("int").alias("row")).withColumn("c", F.cos(F.radians(_latitude(F.col("row"), box, m))))
    mean = rows.agg(F.avg("c").alias("mean"))
    r = rows.crossJoin(F.broadcast(mean)).withColumn("s", F.round(F.col("c") / F.col("mean"), 12)).where("s >= 0.01").withColumn("width", F.floor(n * F.col("s")).cast("int")).where("width >= 1")
    r = r.withColumn("start", F.floor((n - F.col("width")) / 2).cast("int"))
    keys = r.withColumn("col", F.explode(F.sequence(F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("width"), F.lit(n)) - 1)))
    at = F.when(F.col("width") > 1, (F.col("col") - F.col("start")) / F.nullif(F.col("width") - 1, F.lit(0)) * (n - 1)).otherwise(0.0)
    return _gather_columns(keys, F.round(at, 9), cells, nearest, by)


def aligned(mask: DataFrame, classes: DataFrame, box: tuple, shape: tuple[int, int], projection: str = "cosine", close: bool = False) -> DataFrame:
    """(row, col, water, class_id): a mask projected bilinearly and cut at one half, classes projected to the nearest, both on the mask's cells.

    close: rows and columns in which the projected mask has no value go, from both alike; a cell without a class has class 0."""
    m = project(mask, box, shape, projection).select(*KEY, (F.col("value") > 0.5 + 1e-9).cast("int").alias("value"))
    c = project(classes, box, shape, projection, nearest=True).withColumnRenamed("value", "class_id")
    if not close:
        return m.withColumnRenamed("value", "water").join(c, KEY, "left")
    both = m.join(c, KEY, "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))
    return close_up(both, keep=("class_id",)).withColumnRenamed("value", "water")


def rotate(cells: DataFrame, shape: tuple[int, int], degrees: float) -> DataFrame:
    """Turned about the centre: each output cell reads its place in the source, bilinearly; outside there is no value."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cy, cx = (shape[0] - 1) / 2, (shape[1] - 1) / 2
    y, x = F.col("row") - cy, F.col("col") - cx
    at = _keys(cells, shape).withColumn("y", F.round(y * c - x * s + cy, 9)).withColumn("x", F.round(y * s + x * c + cx, 9)).where(f"y >= 0 and y <= {shape[0] - 1} and x >= 0 and x <= {shape[1] - 1}")
    two = lambda a: F.array(F.struct(F.floor(a).cast("int").alias("i"), (1 - (F.col(a) - F.floor(a))).alias("w")), F.struct((F.floor(a) + 1).cast("int").alias("i"), (F.col(a) - F.floor(a)).alias("w")))
    e = at.select("row", "col", F.explode(two("y")).alias("a"), two("x").alias("bs")).select("row", "col", "a", F.explode("bs").alias("b"))
    e = e.select("row", "col", F.col("a.i").alias("__r"), F.col("b.i").alias("__c"), (F.col("a.w") * F.col("b.w")).alias("w")).where("w > 0")
    return e.join(cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value"), ["__r", "__c"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def sinusoidal(cells: DataFrame, box: tuple, shape: tuple[int, int], nearest: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Row-wise: column x of [-1, 1] comes from longitude x * half / cos(lat) about the centre; outside there is no value."""
    m, n = shape
    keys = _keys(cells, shape).withColumn("c", F.cos(F.radians(_latitude(F.col("row"), box, m)))).where("c >= 0.01")
    at = F.round(((F.col("col") * (2.0 / (n - 1)) - 1) / F.col("c") + 1) / 2 * (n - 1), 9)
    return _gather_columns(keys.where((at >= 0) & (at <= n - 1)), at, cells, nearest, by)


def true_aspect(cells: DataFrame, box: tuple, shape: tuple[int, int], nearest: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """Equidistant cylindrical in its true proportions, (cells, shape): as many rows, and columns by the box's width at its middle latitude."""
    n, s, e, w = box
    target = (shape[0], max(1, int(shape[0] * ((e - w) * math.cos(math.radians((n + s) / 2)) / (n - s)))))
    return (resample_nearest if nearest else resample_bilinear)(cells, shape, target), target


#: What project() knows: the projections and how each handles the grid.
PROJECTIONS = {
    "none": "unchanged", "cosine": "rows shrink by the cosine of their latitude", "equidistant": "as cosine where the shape stays", "mercator": "rows by the mercator ordinate",
    "lambert": "rows by the sine of their latitude", "equal_area": "as lambert", "sinusoidal": "rows shrink about the central meridian",
}


def project(cells: DataFrame, box: tuple, shape: tuple[int, int], projection: str, nearest: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The grid under one of PROJECTIONS on the same shape; another name is an error. nearest: classes are picked, never mixed. by: columns that keep several
    grids (bands) apart in one plan."""
    if projection not in PROJECTIONS:
        raise ValueError(f"unknown projection {projection}")
    if projection == "none":
        return cells
    if projection in ("cosine", "equidistant"):
        out = cosine(cells, box, shape, nearest, by)
    elif projection == "sinusoidal":
        out = sinusoidal(cells, box, shape, nearest, by)
    else:
        out = row_projection(cells, box, shape, "mercator" if projection == "mercator" else "lambert", nearest, by)
    return out.withColumn("value", F.col("value").cast(cells.schema["value"].dataType)) if nearest else out


def scatter_cosine(cells: DataFrame, box: tuple, shape: tuple[int, int]) -> DataFrame:
    """Forward scatter to centred, cosine-shrunk columns; the last source column wins; empty columns are closed up."""
    m, n = shape
    centre = (n - 1) / 2
    whole = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    c = F.round(F.cos(F.radians(_latitude(F.col("row"), box, m))), 12)
    col2 = whole(whole(F.col("col") - centre) * c + centre).cast("int")
    out = cells.withColumn("__c", col2).where(f"__c >= 0 and __c < {n}").groupBy("row", "__c").agg(F.max_by("value", "col").alias("value"))
    return close_up(out.withColumnRenamed("__c", "col"))


def close_up(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows and columns without a value go and the rest are numbered anew; ranks run over different rows and columns only."""
    from pyspark.sql import Window

    have = cells.select(*KEY, "value", *keep).where("value is not null and not isnan(value)")
    for c in KEY:
        seen = have.select(c).distinct()
        rank = seen.withColumn("__n", F.row_number().over(Window.orderBy(c)) - 1)
        have = have.join(F.broadcast(rank), c).withColumn(c, F.col("__n")).drop("__n")
    return have


SCHEMA = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])
