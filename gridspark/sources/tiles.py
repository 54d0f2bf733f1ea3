"""A folder of raster tiles as a data source: one partition a tile, extents read from the tiles' names, filters on extents drop tiles before any is opened.

    spark.dataSource.register(TileStore)
    spark.read.format("tile_store").load("/shared/tiles").where("north > 10 and south < 20 and east > 0 and west < 30")

A tile is a Parquet file (`at` place in the tile row by row, `value`) named like t_n90.0_s67.5_w-180.0_e-135.0.parquet. Rows are cells:
tile, north, south, east, west, at, value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

NAME = re.compile(r"_n(?P<north>-?\d+(?:\.\d+)?)_s(?P<south>-?\d+(?:\.\d+)?)_w(?P<west>-?\d+(?:\.\d+)?)_e(?P<east>-?\d+(?:\.\d+)?)")
EXTENT = ("north", "south", "east", "west")
COMPARE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


def extent(name: str) -> dict[str, float]:
    """north, south, east, west of a tile's name; another name is an error."""
    found = NAME.search(name)
    if not found:
        raise ValueError(f"no extent in {name}")
    return {k: float(found[k]) for k in EXTENT}


@dataclass
class Tile(InputPartition):
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1].removesuffix(".parquet")


class TileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of an extent's side with a number; others stay with Spark."""
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in EXTENT and isinstance(f.value, (int, float)):
                self.tests.append((f.attribute[0], COMPARE[type(f)], float(f.value)))
            else:
                yield f

    def partitions(self) -> list[Tile]:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
        return [Tile(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if all(test(extent(f.base_name)[side], value) for side, test, value in self.tests)]

    def read(self, partition: Tile | None):
        if partition is None:  # what Spark passes where no tile is left
            return
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        box = extent(partition.name)
        with fs.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["at", "value"]):
                n = len(batch)
                fixed = [pa.array([partition.name] * n), *(pa.array([box[k]] * n, pa.float64()) for k in EXTENT)]
                yield pa.RecordBatch.from_arrays([*fixed, pc.cast(batch.column("at"), pa.int64()), pc.cast(batch.column("value"), pa.float64())], names=["tile", *EXTENT, "at", "value"])


class TileStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_store"

    def schema(self) -> str:
        return "tile string, north double, south double, east double, west double, at bigint, value double"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """The source, and pushing filters into it, for a session. Without the second the tiles are dropped by Spark after they were read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileStore)


def write_tiles(cells: DataFrame, path: str, side: int, box: tuple, shape: tuple[int, int]) -> None:
    """Cells (row, col, value) as tile files of side x side cells; every task writes the tiles that it holds straight to the shared folder."""
    n, s, e, w = box
    lat, lon = (n - s) / shape[0], (e - w) / shape[1]
    tr, tc = F.floor(F.col("row") / side).cast("int"), F.floor(F.col("col") / side).cast("int")
    at = (F.col("row") % side * side + F.col("col") % side).cast("long")
    rows = cells.select(tr.alias("tr"), tc.alias("tc"), at.alias("at"), F.col("value").cast("double").alias("value"))

    def put(key, table):
        r, c = (int(k.as_py()) for k in key)
        name = f"t_n{n - r * side * lat}_s{n - min((r + 1) * side, shape[0]) * lat}_w{w + c * side * lon}_e{w + min((c + 1) * side, shape[1]) * lon}.parquet"
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        held = table.select(["at", "value"]).sort_by("at")
        with fs.open_output_stream(f"{root}/.{name}.part") as out:
            pq.write_table(held, out)
        fs.move(f"{root}/.{name}.part", f"{root}/{name}")
        return pa.table({"name": [name], "cells": [len(held)]})

    written = rows.groupBy("tr", "tc").applyInArrow(put, "name string, cells bigint")
    written.agg(F.count("*")).first()


def read_section(spark: SparkSession, path: str, side: int, box: tuple, shape: tuple[int, int], rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A complete window (end exclusive) of a stored raster (row, col, value) out of the tiles that meet it: cells that no tile has count 0, negative heights are raised to 0."""
    from gridspark.operators import scan

    n, s, e, w = box
    lat, lon = (n - s) / shape[0], (e - w) / shape[1]
    tiles = spark.read.format("tile_store").load(path)
    near = tiles.where((F.col("south") < n - rows[0] * lat) & (F.col("north") > n - rows[1] * lat) & (F.col("west") < w + cols[1] * lon) & (F.col("east") > w + cols[0] * lon))
    corner = lambda v: F.round(v, 0).cast("int")
    row, col = corner((n - F.col("north")) / lat) + F.floor(F.col("at") / side), corner((F.col("west") - w) / lon) + F.col("at") % side
    have = near.select(row.cast("int").alias("row"), col.cast("int").alias("col"), F.col("value").alias("__v"))
    return scan.grid(spark, rows, cols).join(have, ["row", "col"], "left").select("row", "col", F.greatest(F.coalesce("__v", F.lit(0.0)), F.lit(0.0)).alias("value"))


def create_views(cells: DataFrame, features: DataFrame, segments: DataFrame, regions: DataFrame) -> None:
    """SQL access: the temporary views cells, features, segments and regions of the tables' session."""
    for name, df in (("cells", cells), ("features", features), ("segments", segments), ("regions", regions)):
        df.createOrReplaceTempView(name)
