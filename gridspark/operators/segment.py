"""Segmentation of images and equalisation of relief by global statistics and focal filters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import components, focal, raster, vector, zonal

#: Reference colours, 0 to 1. Fixed values.
COLOURS = ((0.2, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5))


def large_objects(mask: DataFrame, shape: tuple[int, int], least: int, by: str | None = None) -> DataFrame:
    """Cells (by, row, col) of the 4-connected objects of at least `least` cells; `by`, a whole number, keeps several masks apart.

    Masks lie under one another in one grid, with an empty row between them, so that all are labelled together."""
    keep = [by] if by else []
    at = F.col("row").cast("long") + (F.col(by) * (shape[0] + 1) if by else 0)
    r = components.saved(vector.runs(mask.select(at.alias("row"), "col")))  # read four times
    c = components.label(vector.run_links(r, shape[1]))
    r = r.join(c, (F.col("row") * shape[1] + F.col("first")) == F.col("node"))
    big = r.groupBy("root").agg(F.sum("n").alias("__area")).where(F.col("__area") >= least)
    cells = r.join(big, "root", "left_semi").select("row", F.explode(F.sequence("first", "last")).alias("col"))
    if by:
        cells = cells.withColumn(by, F.floor(F.col("row") / (shape[0] + 1)).cast("int")).withColumn("row", F.col("row") % (shape[0] + 1))
    return cells.select(*keep, F.col("row").cast("int").alias("row"), "col")


def colour_segments(pixels: DataFrame, shape: tuple[int, int], sigma: float = 20.0, least: int = 20, cut: float = 0.75) -> DataFrame:
    """(row, col, label): closeness to each reference colour, floored at its mean, high-passed, clipped to three standard
    deviations about the median, stretched and cut; where colours compete the last one wins. pixels: r, g, b in 0..1."""
    refs = F.array(*(F.struct(F.lit(k + 1).alias("k"), *(F.lit(v).alias(f"__{n}") for v, n in zip(c, "rgb", strict=True))) for k, c in enumerate(COLOURS)))
    d = pixels.select("row", "col", "r", "g", "b", F.inline(refs))
    d = d.select("k", "row", "col", (-F.sqrt(sum(F.pow(F.col(n) - F.col(f"__{n}"), F.lit(2)) for n in "rgb"))).alias("value"))
    d = d.join(F.broadcast(d.groupBy("k").agg(F.avg("value").alias("m"))), "k").select("k", "row", "col", F.greatest("value", "m").alias("value"))
    h = components.saved(focal.above_smooth(d, shape, sigma, by=("k",)))
    stats = h.groupBy("k").agg(F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    middle = zonal.percentiles(h, [0.5], by=("k",)).select("k", F.col("p")[0].alias("med"))
    c = h.join(F.broadcast(stats), "k").join(F.broadcast(middle), "k")
    top, bottom = F.col("med") + 3 * F.col("sd"), F.col("med") - 3 * F.col("sd")
    clip = lambda x: F.least(F.greatest(x, bottom), top)
    t = F.try_divide(clip(F.col("value")) - clip(F.col("lo")), F.nullif(clip(F.col("hi")) - clip(F.col("lo")), F.lit(0.0)))
    hits = large_objects(c.where(t > cut).select("k", "row", "col"), shape, least, by="k")
    return hits.groupBy("row", "col").agg(F.max("k").alias("label"))


def bright_lines(pixels: DataFrame, shape: tuple[int, int], sigma: float = 31.0, least: int = 100, size: int = 3) -> DataFrame:
    """Cells of bright lines of an image (r, g, b in 0..1): the bands' norm, clipped to two standard deviations about the median, high-passed, median filtered, above the
    median by one standard deviation, in objects of at least `least` cells.

    The high-pass and the median run on the same tiles: the reflected grid's high-pass is the reflected high-pass."""
    middle = lambda df: df.crossJoin(F.broadcast(zonal.percentiles(df, [0.5]).select(F.col("p")[0].alias("med"))))
    norm = components.saved(pixels.select("row", "col", F.sqrt(sum(F.pow(F.col(c), F.lit(2)) for c in "rgb")).alias("value")))
    s = raster.with_stats(middle(norm), sd=F.stddev_pop("value"))
    c = s.select("row", "col", F.least(F.greatest("value", F.col("med") - 2 * F.col("sd")), F.col("med") + 2 * F.col("sd")).alias("value"))
    w = np.array(focal.gaussian_weights(sigma))
    r = len(w) // 2

    def lines(g: np.ndarray) -> np.ndarray:
        low = focal.along(focal.along(g, w).T, w).T
        return np.maximum(focal.medians(g[r : r + low.shape[0], r : r + low.shape[1]] - low, size), 0.0)

    m = components.saved(focal.tiled(c, shape, r + size // 2, lines))
    t = raster.with_stats(middle(m), sd=F.stddev_pop("value"))
    return large_objects(t.where("value > med + sd"), shape, least)


def equalise(cells: DataFrame, knots: int = 15) -> DataFrame:
    """Positive values mapped to 0..100 by linear interpolation between quantile knots that crowd at the ends (logistic)."""
    xs = [100 * k / (knots - 1) for k in range(knots)]
    ps = [1 / (1 + math.exp(-(x - 50) / 8)) for x in xs]
    q = zonal.percentiles(cells.where("value > 0"), ps).select(F.col("p").alias("q"))
    s = cells.join(F.broadcast(q))
    v, out = F.col("value"), F.lit(xs[-1])
    for k in reversed(range(knots - 1)):
        a, b = F.col("q")[k], F.col("q")[k + 1]
        out = F.when(v < b, xs[k] + F.coalesce(F.try_divide(v - a, F.nullif(b - a, F.lit(0.0))), F.lit(0.0)) * (xs[k + 1] - xs[k])).otherwise(out)
    out = F.when(v <= F.col("q")[0], F.lit(xs[0])).otherwise(out)
    return s.select("row", "col", F.when(v > 0, out).otherwise(v).alias("value"))
