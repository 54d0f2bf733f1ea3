"""Stored layouts: what a read opens, what a merge moves, and values against plain versions."""

import pytest
from pyspark.sql import functions as F

from gridspark.operators import raster, scan, store
from gridspark.plans import fixtures
from gridspark.sources import tiles

SMALL = (52.0, 47.0, 12.0, 6.0)


@pytest.fixture(scope="module")
def reaches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reaches")) + "/store"
    rivers = fixtures.rivers(spark, "/root/testdata/sf0.01")
    store.write_reach_store(rivers, path, file_rows=100)
    return rivers, path


def plan(df):
    return df._jdf.queryExecution().toString()


def test_z_key_interleaves(spark):
    at = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0), (0.0, 0.0), (-180.0, 0.0)], "x double, y double")
    assert [r[0] for r in at.select(store.z_key(F.col("x"), F.col("y"))).collect()] == [0, 2**32 - 1, 3 << 30, 2 << 30]


def test_a_small_box_opens_few_files(spark, reaches):
    rivers, path = reaches
    df = store.read_reach_store(spark, path, SMALL, 1)
    every = spark.read.parquet(f"{path}/reaches")
    assert len(df.inputFiles()) * 10 < len(every.inputFiles())
    assert "PushedFilters: [IsNotNull(max_x)" in plan(df)
    want = scan.within_box(scan.with_cover(rivers), SMALL)
    assert {r[0] for r in df.select("reach_id").collect()} == {r[0] for r in want.select("reach_id").collect()} != set()


def test_orders_name_the_tier(spark, reaches):
    rivers, path = reaches
    df = store.read_reach_store(spark, path, SMALL, 3)
    assert all("tier=1" in f for f in df.inputFiles())
    want = scan.within_box(scan.with_cover(rivers), SMALL).where("ord_stra >= 3")
    assert df.count() == want.count()


def test_no_file_holds_a_tier(spark, reaches):
    _, path = reaches
    most = spark.read.parquet(f"{path}/files").agg(F.max("rows"), F.count("*")).first()
    assert most[0] <= 250 and most[1] > 100


def test_a_wide_box_reads_partitions_and_finds_the_same(spark, reaches, monkeypatch):
    _, path = reaches
    named = store.read_reach_store(spark, path, SMALL).count()
    monkeypatch.setattr(store, "NAMED_FILES", 0)
    assert store.read_reach_store(spark, path, SMALL).count() == named
    assert store.read_reach_store(spark, path, (-89.9, -90.0, 0.1, 0.0)).count() >= 0


def test_bucketed_layers_merge_without_an_exchange(spark, tmp_path):
    cells = spark.range(2000).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    layers = [cells, cells.where("row % 2 = 0").withColumn("value", F.lit(7.0)), cells.where("col < 9").withColumn("value", F.col("value") - 3)]
    for k, df in enumerate(layers):
        store.write_layer(df, f"layer_test_{k}", f"{tmp_path}/{k}", 4)
    got = store.merge_stored(spark, "layer_test_0", [("layer_test_1", "max", 1.0), ("layer_test_2", "blend", 0.5)])
    assert "Exchange" not in plan(got).split("== Physical Plan ==")[1]
    want = raster.blend(raster.blend(layers[0], layers[1], "max"), layers[2], "blend", 0.5)
    united = raster.merge_layers([(layers[0], "base", 1.0), (layers[1], "max", 1.0), (layers[2], "blend", 0.5)])
    assert plan(united).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) == rows(united)
    with pytest.raises(ValueError):
        raster.merge_layers([(layers[0], "base", 1.0), (layers[1], "odd", 1.0)])
    for k in range(3):
        spark.sql(f"DROP TABLE layer_test_{k}")


@pytest.fixture(scope="module")
def tile_store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles")) + "/t"
    tiles.register(spark)
    cells = spark.range(100 * 60).select((F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), (F.col("id") - 500).cast("double").alias("value")).where("row < 40 or col < 30")
    tiles.write_tiles(cells, path, 10, (90.0, -90.0, 180.0, -180.0), (100, 60))
    return cells, path


def test_filters_drop_tiles_before_they_are_read(spark, tile_store):
    cells, path = tile_store
    every = spark.read.format("tile_store").load(path)
    assert every.rdd.getNumPartitions() == 42
    assert every.count() == cells.count()
    one = every.where("north > 80 and west < -150")
    assert one.rdd.getNumPartitions() == 1
    assert one.count() == 100
    assert every.where("value > 5000 and south >= 72").rdd.getNumPartitions() == 6
    assert every.where("north > 200").count() == 0


def test_section_over_tiles_and_gaps(spark, tile_store):
    cells, path = tile_store
    got = tiles.read_section(spark, path, 10, (90.0, -90.0, 180.0, -180.0), (100, 60), (35, 47), (25, 36))
    have = {(r.row, r.col): max(r.value, 0.0) for r in cells.collect()}
    assert {(r.row, r.col): r.value for r in got.collect()} == {(r, c): have.get((r, c), 0.0) for r in range(35, 47) for c in range(25, 36)}


def test_a_bad_tile_name_is_an_error():
    with pytest.raises(ValueError):
        tiles.extent("tile_1.parquet")
