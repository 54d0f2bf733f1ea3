"""Stored layouts that later reads gain from: reaches along a space-filling curve with an index of their files, and layers bucketed by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import raster, scan
from gridspark.operators.registry import RIVER_REGIONS

#: Rows in a file of the reach store, about.
FILE_ROWS = 1_000_000
#: Files that a read names one by one; a box that meets more reads its partitions.
NAMED_FILES = 10_000
#: Reaches outside all river regions are stored under this code.
ELSEWHERE = "none"


def z_key(x: Column, y: Column, box: tuple = (90.0, -90.0, 180.0, -180.0), bits: int = 16) -> Column:
    """Place on the Z-order curve over a box (north, south, east, west): the bits of column and row, interleaved. Points outside lie on its edge."""
    n, s, e, w = box
    top = (1 << bits) - 1

    def spread(v: Column) -> Column:
        v = F.greatest(F.lit(0), F.least(F.lit(top), v)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(F.floor((x - w) / (e - w) * (top + 1))).bitwiseOR(F.shiftleft(spread(F.floor((n - y) / (n - s) * (top + 1))), 1))


def by_region(reaches: DataFrame) -> DataFrame:
    """Reaches with covering columns, tier and region: a row for each river region whose box a reach meets, or one under ELSEWHERE."""
    t = F.broadcast(reaches.sparkSession.createDataFrame([(c, *map(float, b)) for c, b in RIVER_REGIONS.items()], "region string, __w double, __s double, __e double, __n double"))
    met = (F.col("max_x") >= F.col("__w")) & (F.col("min_x") <= F.col("__e")) & (F.col("max_y") >= F.col("__s")) & (F.col("min_y") <= F.col("__n"))
    return scan.with_cover(reaches).join(t, met, "left").withColumn("region", F.coalesce("region", F.lit(ELSEWHERE))).drop("__w", "__s", "__e", "__n")


def write_reach_store(reaches: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Reaches by region and tier, in files of about file_rows rows that follow the curve of their middle, and an index of the files' extents beside them.

    Rows are dealt by ranges of (region, tier, curve, reach_id), so a region or tier of any size is many tasks; the rows are counted once for the number of files.
    """
    rows = by_region(reaches).withColumn("z", z_key((F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2))
    order = ["region", "tier", "z", "reach_id"]
    parts = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("z").write.mode("errorifexists").partitionBy("region", "tier").parquet(f"{path}/reaches")
    stored = reaches.sparkSession.read.parquet(f"{path}/reaches").select("region", "tier", "min_x", "max_x", "min_y", "max_y", F.col("_metadata.file_path").alias("file"))
    ends = [f(c).alias(c) for f, cs in ((F.min, ("min_x", "min_y")), (F.max, ("max_x", "max_y"))) for c in cs]
    stored.groupBy("region", "tier", "file").agg(*ends, F.count("*").alias("rows")).write.parquet(f"{path}/files")


def read_reach_store(spark: SparkSession, path: str, box: tuple, min_order: int = 1) -> DataFrame:
    """Reaches of a store that overlap a box (north, south, east, west; edges included), of an order and up, each once.

    The box names the regions, the order the tier, and the index the files that are read; inside them the covering columns skip row groups. At most NAMED_FILES file names
    come to the driver.
    """
    n, s, e, w = box
    regions = [c for c, (rw, rs, re, rn) in RIVER_REGIONS.items() if rw <= e and re >= w and rs <= n and rn >= s] + [ELSEWHERE]
    part = F.col("region").isin(*regions)
    if min_order >= 3:
        part &= F.col("tier") == 1
    files = [r["file"] for r in scan.within_box(spark.read.parquet(f"{path}/files").where(part), box).select("file").limit(NAMED_FILES + 1).collect()]
    data = f"{path}/reaches"
    if len(files) > NAMED_FILES:
        rows = spark.read.parquet(data).where(part)
    elif files:
        rows = spark.read.option("basePath", data).parquet(*files)
    else:
        rows = spark.read.parquet(data).where(F.lit(False))
    return scan.within_box(rows, box).where(F.col("ord_stra") >= min_order).dropDuplicates(["reach_id"])


# Layers that share a layout ------------------------------------------------------------------------

KEY = ["row", "col"]


def write_layer(cells: DataFrame, table: str, path: str, buckets: int) -> None:
    """Cells (row, col, value) as a table bucketed and sorted by cell, a file a bucket. Layers with as many buckets join without moving rows."""
    rows = cells.select(*KEY, "value").repartition(buckets, *KEY)
    rows.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)


def merge_stored(spark: SparkSession, base: str, layers: list[tuple[str, str, float]]) -> DataFrame:
    """Stored layers (table, mode, weight) blended in order onto a stored base; missing values count 0. Buckets meet buckets: no row is shuffled, whatever the number of layers."""
    out = spark.table(base).withColumn("value", F.coalesce("value", F.lit(0.0)))
    for table, mode, w in layers:
        if mode not in raster.MODES:
            raise ValueError(f"unknown blend mode {mode}")
        out = out.join(spark.table(table).select(*KEY, F.col("value").alias("__l")).hint("merge"), KEY, "left")
        out = out.select(*KEY, F.when(F.col("__l").isNull(), F.col("value")).otherwise(raster.MODES[mode](F.col("value"), F.col("__l"), w)).alias("value"))
    return out
