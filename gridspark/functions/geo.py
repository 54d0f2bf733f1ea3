"""Scalar rules over boxes, coordinates and parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_PER_DEGREE = 111320.0
CIRCUMFERENCE = 40075000.0
MERCATOR_R = 6378137.0


def tile_address(lon: Column, lat: Column) -> dict[str, Column]:
    """5-degree tile and pixel within it (6000 a side)."""
    tx, ty = F.floor(lon / 5), F.floor(-lat / 5)
    return {"tx": (tx + 37).cast("int"), "ty": (ty + 13).cast("int"), "px": F.floor((lon / 5 - tx) * 6000).cast("int"), "py": F.floor((-lat / 5 - ty) * 6000).cast("int")}


def tile_origin(tx: Column, ty: Column, px: Column, py: Column) -> dict[str, Column]:
    """Coordinates of a tile's pixel, rounded half to even as the addresses are kept."""
    lon = 180.0 * (tx - 37) / 36 + F.bround(px / 6000.0 * 5, 4)
    lat = -(60.0 * (ty - 13) / 12 + F.bround(py / 6000.0 * 5, 4))
    return {"lon": F.bround(lon, 6), "lat": F.bround(lat, 6)}


def box_problem(north: Column, south: Column, east: Column, west: Column) -> Column:
    """Null for a valid box, else the reason."""
    missing = north.isNull() | south.isNull() | east.isNull() | west.isNull()
    return F.when(missing, "missing").when(north <= south, "north<=south").when(east <= west, "east<=west")


#: Pixels along a grid's longer side, at most. Fixed value.
MAX_DIM = 2000


def dim_problem(dim: Column, most: int = MAX_DIM) -> Column:
    """Null for a size of 1 to `most`, or for none; else the reason."""
    return F.when((dim < 1) | (dim > most), f"dim not in 1..{most}")


def diagonal_km(north: Column, south: Column, east: Column, west: Column) -> Column:
    mid = F.radians((north + south) / 2)
    return EARTH_KM * F.sqrt(F.pow(F.radians(north - south), 2) + F.pow(F.radians(east - west) * F.cos(mid), 2))


def to_float(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def to_int(text: Column, default: int) -> Column:
    """Through a float, truncated."""
    x = text.try_cast("double")
    return F.coalesce(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int"), F.lit(default))


def to_bool(text: Column, default: bool) -> Column:
    t = F.lower(F.trim(text))
    return F.when(text.isNull() | (t == ""), F.lit(default)).otherwise(t.isin("true", "1", "yes", "on"))


def cell_of(lon: Column, lat: Column, box: tuple, width: int, height: int) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point, clipped to the grid."""
    n, s, e, w = box
    col = F.floor((lon - w) / (e - w) * width)
    row = F.floor((n - lat) / (n - s) * height)
    return F.least(F.greatest(row, F.lit(0)), F.lit(height - 1)).cast("int"), F.least(F.greatest(col, F.lit(0)), F.lit(width - 1)).cast("int")


CONTINENTS = (
    ("Antarctica", "lat < -60"), ("Oceania", "lat >= -55 AND lat <= -10 AND lon >= 110 AND lon <= 180"), ("Oceania", "lat >= -10 AND lat <= 0 AND lon >= 130 AND lon <= 180"),
    ("South America", "lat >= -56 AND lat <= 13 AND lon >= -82 AND lon <= -34"), ("North America", "lat >= 13 AND lat <= 75 AND lon >= -168 AND lon <= -52"), ("North America", "lat >= 8 AND lat <= 28 AND lon >= -90 AND lon <= -52"),
    ("Asia", "lat >= 55 AND lon >= 26 AND lon <= 180"), ("Asia", "lat >= -11 AND lat <= 55 AND lon >= 60 AND lon <= 145"), ("Asia", "lat >= 25 AND lat <= 43 AND lon >= 35 AND lon <= 60"),
    ("Africa", "lat >= -37 AND lat <= 38 AND lon >= -18 AND lon <= 52"), ("Europe", "lat >= 35 AND lat <= 72 AND lon >= -25 AND lon <= 45"),
)  # fmt: skip  # fixed values: first match wins
CONTINENT_ORDER = ("North America", "South America", "Europe", "Africa", "Asia", "Oceania", "Antarctica", "Other")


def continent_case() -> str:
    """The rules as one CASE over columns lat and lon, in Spark's SQL and in others."""
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in CONTINENTS) + " ELSE 'Other' END"


#: (up to km, value): the first row that the diagonal does not exceed. Fixed values.
SAT_SCALES = ((10, 10), (30, 30), (100, 100), (500, 500), (None, 1000))
DIMS = ((10, 600), (50, 500), (200, 300), (None, 200))


def by_size(km: Column, steps) -> Column:
    out = None
    for top, v in steps[:-1]:
        out = F.when(km <= top, v) if out is None else out.when(km <= top, v)
    return out.otherwise(steps[-1][1])


def clamp_scale(width_m: Column, height_m: Column, scale: Column, budget: int = 25_165_824, side: int = 32_768) -> Column:
    """The least whole-metre scale that keeps the image within the pixel budget and the side limit."""
    return F.greatest(scale.cast("double"), F.ceil(F.sqrt(width_m * height_m / budget)).cast("double"), F.ceil(width_m / side).cast("double"), F.ceil(height_m / side).cast("double"))


def mercator_tile(lon: Column, lat: Column, n: Column) -> tuple[Column, Column]:
    """Web-mercator tile indices, truncated toward zero; latitudes are clamped to 85.05."""
    rad = F.radians(F.least(F.greatest(lat, F.lit(-85.05)), F.lit(85.05)))
    y = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2 * n
    return ((lon + 180) / 360 * n).cast("int"), y.cast("int")


def hemisphere(text: Column) -> Column:
    """`N43.6` or `W72.8` as signed degrees; null if it isn't one."""
    h, v = F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 100).try_cast("double")
    return F.when(h.isin("N", "E"), v).when(h.isin("S", "W"), -v)


def cache_key(namespace: Column, box: tuple[Column, Column, Column, Column], params: Column) -> Column:
    n, s, e, w = (F.format_string("%.4f", x) for x in box)
    return F.md5(F.concat(namespace, F.lit(":N"), n, F.lit("_S"), s, F.lit("_E"), e, F.lit("_W"), w, F.lit(":"), params))


def sorted_json(params: Column) -> Column:
    """A JSON object of a map from names to JSON texts, sorted by name, without spaces; of a null or empty map {}."""
    parts = F.transform(F.array_sort(F.map_keys(params)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.element_at(params, k)))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("}"))


def vector_cache_key(box: tuple[Column, Column, Column, Column], tolerance: Column, least_area: Column) -> Column:
    """The key of vector data by box, simplification tolerance and least area (both as text)."""
    n, s, e, w = (F.format_string("%.4f", x) for x in box)
    return F.md5(F.concat(n, F.lit("_"), s, F.lit("_"), e, F.lit("_"), w, F.lit("_t"), tolerance, F.lit("_a"), least_area))


def mercator_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_R, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * MERCATOR_R


def river_depth(base: float, order: Column, exponent: float) -> Column:
    return base * F.pow(order / 9.0, F.lit(exponent))


def river_buffer(pixel: float, order: Column) -> Column:
    return F.greatest(F.lit(0.6 * pixel), 0.6 * pixel * order / 3)


def tile_pixel(lon: Column, lat: Column, n: Column, side: int = 256) -> tuple[Column, Column]:
    """The pixel within its mercator tile (n tiles a side), truncated; latitudes are kept within 85.05 degrees."""
    low = F.radians(F.least(F.greatest(lat, F.lit(-85.05)), F.lit(85.05)))
    x, y = (lon + 180) / 360 * n, (1 - F.ln(F.tan(low) + 1 / F.cos(low)) / F.pi()) / 2 * n
    part = lambda v: F.floor((v - F.floor(v)) * side).cast("int")
    return part(x), part(y)
