"""Global, zonal and histogram aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators import quadtree


def summary(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    v = F.col("value")
    return cells.groupBy(*(by or [])).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("ptp"), F.count(v).alias("n"))


def histogram(cells: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, n, cdf): equal bins between least and greatest value; empty bins count 0; a constant grid falls into bin 0."""
    s = cells.crossJoin(F.broadcast(cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))))
    width = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width * bins)).cast("int")
    n = s.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("cdf", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # `bins` rows


#: Accuracy of the sketch that brackets a percentile's rank; how far (as a share of the rows) a bracket goes to either side, by the least number of
#: rows for which that covers both the sketch's error and the neighbouring ranks.
ACCURACY, MARGINS = 100_000, ((150_000, 4e-5), (3_200, 1e-3), (110, 3e-2), (0, 1.0))


def percentiles(cells: DataFrame, ps: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: by, n and p, the exact linear percentiles of the values that are not null, in the order of ps.

    A quantile sketch brackets each rank; then only counts below the bracket and the different values inside it are aggregated, so no task
    holds all values, however many are different. Groups are few: their sketches are broadcast.
    """
    v = F.col("value")
    rows = cells.select(*by, "value").where(v.isNotNull())
    ends = [min(1.0, max(0.0, p + d)) for p in ps for _, m in MARGINS for d in (-m, m)]
    end = lambda i, side: F.coalesce(*(F.when(F.col("n") >= least, F.element_at("__q", (i * len(MARGINS) + k) * 2 + side)) for k, (least, _) in enumerate(MARGINS)))
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("value", ends, ACCURACY).alias("__q"))
    brackets = F.array(*(F.struct(F.lit(i).alias("__i"), F.lit(float(p)).alias("__at"), end(i, 1).alias("__a"), end(i, 2).alias("__b")) for i, p in enumerate(ps)))
    sketch = F.broadcast(sketch.select(*by, "n", F.inline(brackets)))
    each = rows.join(sketch, list(by)) if by else rows.crossJoin(sketch)
    one = [*by, "__i", "__at", "n"]
    counted = each.where(v <= F.col("__b")).groupBy(*one, F.when(v >= F.col("__a"), v).alias("__x")).agg(F.count("*").alias("__c"))
    up_to = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy(F.asc_nulls_first("__x")).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("__at") * (F.col("n") - 1)
    holds = lambda r: F.max(F.when((F.col("__to") - F.col("__c") <= r) & (r < F.col("__to")), F.col("__x")))
    picked = counted.withColumn("__to", up_to).groupBy(*one).agg(holds(F.floor(rank)).alias("lo"), holds(F.ceil(rank)).alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (rank - F.floor(rank))
    got = picked.select(*by, "n", F.struct("__i", value.alias("x")).alias("s")).groupBy(*by, "n").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return got.select(*by, "n", F.transform("s", lambda s: s["x"]).alias("p"))  # len(ps) numbers


def percentile_clip(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Clipped to exact linear percentiles."""
    s = cells.crossJoin(F.broadcast(percentiles(cells, [low, high])))
    return s.select("row", "col", F.least(F.greatest("value", F.col("p")[0]), F.col("p")[1]).alias("value"))


def robust_normalise(cells: DataFrame, sample: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values less the sample's median, over its high percentile above it and over its low one (or the median less 1) below."""
    x, (a, b, c) = F.col("value") - F.col("p")[1], (F.col("p")[k] for k in range(3))
    s = cells.crossJoin(F.broadcast(percentiles(sample, [low, 0.5, high])))
    return s.select("row", "col", F.when(x < 0, F.try_divide(x, F.greatest(a, b - 1))).otherwise(F.try_divide(x, c)).alias("value"))


def water_coverage(cover: DataFrame, water: int = 80) -> DataFrame:
    """One row: cells of the water class, all cells, and the percent."""
    w = F.count_if(F.col("class_id") == water)
    return cover.agg(w.alias("water"), F.count("*").alias("total"), F.coalesce(F.try_divide(100 * w, F.count("*")), F.lit(0.0)).alias("percent"))


def class_areas(cells: DataFrame) -> DataFrame:
    """Cells and share by class, with the total from a rollup (class null)."""
    r = cells.rollup("class_id").agg(F.count("*").alias("n"))
    return r.crossJoin(F.broadcast(cells.agg(F.count("*").alias("__t")))).select("class_id", "n", F.try_divide("n", "__t").alias("share"))


#: Cells in a leaf on which they meet regions.
CELLS_A_LEAF = 20_000


def zones(cells: DataFrame, regions: DataFrame, box: tuple, shape: tuple[int, int], most: int = CELLS_A_LEAF) -> DataFrame:
    """Cells with the regions that hold their centre (south and west edges included): cells lie on the leaves of a quadtree of their density, regions meet those leaves."""
    n, s, e, w = box
    lat, lon = n - (F.col("row") + 0.5) * ((n - s) / shape[0]), w + (F.col("col") + 0.5) * ((e - w) / shape[1])
    c = cells.withColumn("__lat", lat).withColumn("__lon", lon)
    tree = quadtree.grow(c, most, "__lon", "__lat")
    j = quadtree.on_leaves(c, tree, "__lon", "__lon", "__lat", "__lat").select(*c.columns, "__leaf").join(quadtree.on_leaves(regions, tree, "west", "east", "south", "north").select(*regions.columns, "__leaf"), "__leaf")
    return j.where((F.col("__lat") >= F.col("south")) & (F.col("__lat") < F.col("north")) & (F.col("__lon") >= F.col("west")) & (F.col("__lon") < F.col("east"))).drop("__leaf", "__lat", "__lon")


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised cross-correlation of two layers over their common cells; 0 where one is constant. Centred sums in one pass after the means."""
    j = a.join(b.select("row", "col", F.col("value").alias("__b")), ["row", "col"])
    s = j.crossJoin(F.broadcast(j.agg(F.avg("value").alias("ma"), F.avg("__b").alias("mb"))))
    x, y = F.col("value") - F.col("ma"), F.col("__b") - F.col("mb")
    return s.agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")).select(F.coalesce(F.try_divide("xy", F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))), F.lit(0.0)).alias("ncc"))
