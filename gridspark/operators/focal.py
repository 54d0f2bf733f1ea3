"""Neighbourhood operators.

Kernels work on tiles with halos: a cell goes to its tile and to those within the kernel's radius, once, and each tile is worked on as an array in Arrow batches, so one exchange
serves any radius and any chain of steps. Extremes run in two scans a line, whatever the radius. Single passes along one axis can also scatter and aggregate: each cell
is sent to the keys that need it, with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells along a tile's side, at least; four radii where the kernel is wide.
TILE = 256
#: A kernel is wide when a tile has fewer than so many times its length of lines.
WIDE = 4


#: How a grid goes on beyond its borders: numpy's names, and zero.
BORDERS = {"reflect": {"mode": "symmetric"}, "reflect101": {"mode": "reflect"}, "zero": {"mode": "constant", "constant_values": 0.0}}


def tiled(cells: DataFrame, shape: tuple[int, int], r: int, apply, by: tuple[str, ...] = (), border: str = "reflect") -> DataFrame:
    """(by, row, col, value): apply(array) gives the inner part of a tile from the tile and r cells around it, where cells without a value are NaN and
    the grid's borders are reflected (d c b a | a b c d; reflect101 leaves the edge out) or zero. Values that come out as NaN are left out."""
    side = max(TILE, 4 * r)
    own = lambda c, n: F.sequence(F.floor(F.greatest(F.col(c) - r, F.lit(0)) / side).cast("int"), F.floor(F.least(F.col(c) + r, F.lit(n - 1)) / side).cast("int"))
    spread = cells.select(*by, "row", "col", F.col("value").cast("double").alias("value"), F.explode(own("row", shape[0])).alias("__tr"), own("col", shape[1]).alias("__tcs")).withColumn("__tc", F.explode("__tcs")).drop("__tcs")
    keys = [*by, "__tr", "__tc"]
    schema = T.StructType([*(spread.schema[c] for c in by), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def worked(key, table):
        at = [int(k.as_py()) * side for k in key[-2:]]
        end = [min(a + side, n) for a, n in zip(at, shape, strict=True)]
        lo, hi = [max(a - r, 0) for a in at], [min(b + r, n) for b, n in zip(end, shape, strict=True)]
        grid = np.full([b - a for a, b in zip(lo, hi, strict=True)], np.nan)
        grid[table["row"].to_numpy() - lo[0], table["col"].to_numpy() - lo[1]] = table["value"].to_numpy()
        # Reflection may run over a short grid more than once; numpy pads it as often as it takes.
        grid = np.pad(grid, [(r - (a - b), r - (d - c)) for a, b, c, d in zip(at, lo, end, hi, strict=True)], **BORDERS[border])
        out = apply(grid)
        i, j = np.nonzero(~np.isnan(out))
        columns = [*(pa.array([k.as_py()] * len(i), table.schema.field(c).type) for k, c in zip(key, by, strict=False)), pa.array((i + at[0]).astype(np.int32)), pa.array((j + at[1]).astype(np.int32)), pa.array(out[i, j])]
        return pa.Table.from_arrays(columns, names=[f.name for f in schema])

    return spread.groupBy(*keys).applyInArrow(worked, schema)


def along(grid: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One pass of a kernel down the rows of a padded array; a cell near one without a value has none.

    A wide kernel over a complete array is one product with its matrix, in which most entries are weights."""
    n = len(grid) - len(weights) + 1
    if n < WIDE * len(weights) and not np.isnan(grid).any():
        flat = np.zeros(n * (len(grid) + 1))  # each row begins one place further on
        flat.reshape(n, -1)[:, : len(weights)] = weights
        return flat[: n * len(grid)].reshape(n, -1) @ grid
    return sum(w * grid[k : k + n] for k, w in enumerate(weights))


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def fold(i: Column, n: int, border: str) -> Column:
    """An index folded into [0, n): reflect repeats the edge (d c b a | a b c d), reflect101 does not."""
    if border == "reflect":
        k = F.pmod(i, F.lit(2 * n))
        return F.when(k < n, k).otherwise(2 * n - 1 - k)
    k = F.pmod(i, F.lit(max(1, 2 * n - 2)))
    return F.when(k < n, k).otherwise(2 * n - 2 - k)


def pass_along(cells: DataFrame, axis: str, n: int, weights: list[float], border: str = "reflect", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """One pass of a separable kernel: out[i] = sum_k w[k] v[fold(i + k)], as a scatter from each source to the outputs that read it."""
    r = len(weights) // 2
    other = "col" if axis == "row" else "row"
    # Output i reads fold(i + k). The few outputs near a border are found by testing k over the kernel and its reflections.
    taps = F.array(*(F.struct(F.lit(k - r).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)))
    images = [F.col(axis)] + ([-1 - F.col(axis), 2 * n - 1 - F.col(axis)] if border == "reflect" else [-F.col(axis), 2 * n - 2 - F.col(axis)])
    src = cells.select(*by, other, F.col(value).alias("__v"), F.explode(F.array_distinct(F.array(*images))).alias("__at")).where(f"__at >= {-r} and __at < {n + r}")
    out = src.select(*by, other, "__v", "__at", F.explode(taps).alias("t")).select(*by, other, (F.col("__at") - F.col("t.k")).cast("int").alias(axis), (F.col("t.w") * F.col("__v")).alias("__p"))
    return out.where(f"{axis} >= 0 and {axis} < {n}").groupBy(*by, "row", "col").agg(F.sum("__p").alias(value))


def above_smooth(cells: DataFrame, shape: tuple[int, int], sigma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """What a complete grid's values are above its Gaussian smoothing, 0 below, on the tiles that smooth it."""
    w = np.array(gaussian_weights(sigma))
    r = len(w) // 2

    def above(grid: np.ndarray) -> np.ndarray:
        low = along(along(grid, w).T, w).T
        return np.maximum(grid[r : r + low.shape[0], r : r + low.shape[1]] - low, 0.0)

    return tiled(cells, shape, r, above, by)


def smooth(cells: DataFrame, shape: tuple[int, int], sigma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian smoothing of a complete grid, borders reflected; `by` keeps several grids apart. The kernel may be at most as wide as the grid is long."""
    w = np.array(gaussian_weights(sigma))
    return tiled(cells, shape, len(w) // 2, lambda grid: along(along(grid, w).T, w).T, by)


def medians(grid: np.ndarray, size: int) -> np.ndarray:
    """Medians of a padded array's size x size windows, in slices of rows, so that at most some MEDIAN_CELLS values are sorted at once."""
    r, wide = size // 2, grid.shape[1] - size + 1
    step, parts = max(1, MEDIAN_CELLS // (wide * size * size)), []
    for top in range(0, grid.shape[0] - size + 1, step):
        windows = np.lib.stride_tricks.sliding_window_view(grid[top : top + step + size - 1], (size, size))
        flat = np.sort(windows.reshape(*windows.shape[:2], -1), axis=2)  # NaN comes last
        n = (~np.isnan(flat)).sum(2)
        pick = lambda k, flat=flat: np.take_along_axis(flat, np.clip(k, 0, size * size - 1)[..., None], 2)[..., 0]
        out = (pick((n - 1) // 2) + pick(n // 2)) / 2
        parts.append(np.where((n > 0) & ~np.isnan(grid[top + r : top + r + out.shape[0], r : r + out.shape[1]]), out, np.nan))
    return np.concatenate(parts)


MEDIAN_CELLS = 4_000_000


def median(cells: DataFrame, shape: tuple[int, int], size: int) -> DataFrame:
    """Median of the size x size neighbourhood of every cell, borders reflected, cells without a value left out."""
    r = size // 2

    def middle(grid: np.ndarray) -> np.ndarray:
        return medians(grid, size)

    return tiled(cells, shape, r, middle)


def high_pass(cells: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    s = smooth(cells, shape, sigma).withColumnRenamed("value", "__s")
    return cells.join(s, ["row", "col"]).select("row", "col", (F.col("value") - F.col("__s")).alias("value"))


def sharpen(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    h = high_pass(cells, shape, 1.5).withColumnRenamed("value", "__h")
    return cells.join(h, ["row", "col"]).select("row", "col", (F.col("value") + 0.5 * F.col("__h")).alias("value"))


def neighbours(cells: DataFrame, shape: tuple[int, int], offsets: list[tuple], columns: list[str]) -> DataFrame:
    """Each value sent to row + dr, col + dc for every (dr, dc, *columns), within the grid."""
    taps = F.array(*(F.struct(F.lit(o[0]).alias("dr"), F.lit(o[1]).alias("dc"), *(F.lit(x).alias(c) for x, c in zip(o[2:], columns, strict=True))) for o in offsets))
    e = cells.select("row", "col", "value", F.explode(taps).alias("t"))
    e = e.select((F.col("row") + F.col("t.dr")).alias("row"), (F.col("col") + F.col("t.dc")).alias("col"), "value", *(F.col(f"t.{c}").alias(c) for c in columns))
    return e.where(f"row >= 0 and row < {shape[0]} and col >= 0 and col < {shape[1]}")


def square(r: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]


def running(grid: np.ndarray, r: int, least: bool) -> np.ndarray:
    """The least or greatest of 2r + 1 cells down each column of a padded array: runs forward and back within blocks of that length, and one comparison."""
    w = 2 * r + 1
    n = len(grid) - w + 1
    far = np.inf if least else -np.inf
    rows = np.concatenate([grid, np.full((-len(grid) % w, grid.shape[1]), far)]).reshape(-1, w, grid.shape[1])
    f = np.minimum if least else np.maximum
    ahead = f.accumulate(rows, axis=1).reshape(-1, grid.shape[1])
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1, grid.shape[1])
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def square_extreme(grid: np.ndarray, r: int, least: bool) -> np.ndarray:
    return running(running(grid, r, least).T, r, least).T


def _bits(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", F.col("value").cast("int").alias("value"))


def erode(mask: DataFrame, shape: tuple[int, int], r: int) -> DataFrame:
    """Binary erosion of a 0/1 grid by a square of side 2r + 1; what lies outside or is missing counts 0."""
    return _bits(tiled(mask, shape, r, lambda g: square_extreme(np.nan_to_num(g), r, True), border="zero"))


def dilate(mask: DataFrame, shape: tuple[int, int], r: int) -> DataFrame:
    return _bits(tiled(mask, shape, r, lambda g: square_extreme(np.nan_to_num(g), r, False), border="zero"))


def opened(grid: np.ndarray, r: int) -> np.ndarray:
    """Opening of a 0/1 array with 2r cells around it."""
    return square_extreme(square_extreme(np.nan_to_num(grid), r, True), r, False)


def opening(mask: DataFrame, shape: tuple[int, int], r: int) -> DataFrame:
    """Erosion and dilation on the same tiles."""
    return _bits(tiled(mask, shape, 2 * r, lambda g: opened(g, r), border="zero"))


def thin_features(mask: DataFrame, shape: tuple[int, int], width: int) -> DataFrame:
    """Cells of the mask that an opening with a square of side 2 max(1, width // 2) + 1 removes."""
    r = max(1, width // 2)
    inner = lambda g: g[2 * r : g.shape[0] - 2 * r, 2 * r : g.shape[1] - 2 * r]
    return tiled(mask, shape, 2 * r, lambda g: np.where((inner(g) == 1) & (opened(g, r) == 0), 1.0, np.nan), border="zero").select("row", "col")


def near_set(grid: np.ndarray, r: int) -> np.ndarray:
    """Whether a set cell of a padded boolean array lies within distance r of each inner cell: exact distances down the columns by two scans, then for each column offset
    what may be left of r."""
    n = len(grid) - 2 * r
    place = np.arange(len(grid))[:, None]
    far = len(grid) + r + 1
    above = place - np.maximum.accumulate(np.where(grid, place, -far), axis=0)
    below = np.minimum.accumulate(np.where(grid, place, 2 * far)[::-1], axis=0)[::-1] - place
    down = np.minimum(above, below)[r : r + n]
    out = np.zeros((n, grid.shape[1] - 2 * r), bool)
    for dx in range(-r, r + 1):
        out |= down[:, r + dx : r + dx + out.shape[1]] <= math.isqrt(r * r - dx * dx)
    return out


def dilate_disk(mask: DataFrame, shape: tuple[int, int], r: int) -> DataFrame:
    """Keys of the cells within distance r of a set cell."""
    return tiled(mask.where("value = 1"), shape, r, lambda g: np.where(near_set(g == 1, r), 1.0, np.nan), border="zero").select("row", "col")


SOBEL = [(a, b, float(-a * (2 - abs(b))), float(-b * (2 - abs(a)))) for a, b in square(1)]


def sobel(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Gradient magnitude of the inner cells."""
    e = neighbours(cells, shape, SOBEL, ["wy", "wx"]).where(f"row > 0 and row < {shape[0] - 1} and col > 0 and col < {shape[1] - 1}")
    g = e.groupBy("row", "col").agg(F.sum(F.col("wx") * F.col("value")).alias("gx"), F.sum(F.col("wy") * F.col("value")).alias("gy"))
    return g.select("row", "col", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("value"))


def morphological_gradient(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    return neighbours(cells, shape, square(1), []).groupBy("row", "col").agg((F.max("value") - F.min("value")).alias("value"))


def shoreline(cells: DataFrame, shape: tuple[int, int], r: int = 2) -> DataFrame:
    """Keys of cells within distance r of land (value > 0) that are not land; a cell without a value is not land."""

    def ring(g: np.ndarray) -> np.ndarray:
        land = g > 0
        inner = land[r : len(g) - r, r : g.shape[1] - r]
        return np.where(near_set(land, r) & ~inner, 1.0, np.nan)

    return tiled(cells, shape, r, ring, border="zero").select("row", "col")


def carve_shoreline(cells: DataFrame, shape: tuple[int, int], r: int = 2, share: float = 0.01) -> DataFrame:
    """Cells whose shoreline lies lower by a share of the relief, greatest less least value."""
    ptp = cells.agg((F.max("value") - F.min("value")).alias("__ptp"))
    ring = shoreline(cells, shape, r).withColumn("__ring", F.lit(1))
    return cells.join(ring, ["row", "col"], "left").crossJoin(F.broadcast(ptp)).select("row", "col", (F.col("value") - F.coalesce("__ring", F.lit(0)) * F.col("__ptp") * share).alias("value"))
