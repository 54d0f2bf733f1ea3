"""Focal operators at wide radii and registration by pyramid, against plain array versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import components, focal, terrain, vector

SHAPE = (70, 90)


@pytest.fixture(scope="module")
def mask(spark):
    rng = np.random.default_rng(5)
    grid = (rng.random(SHAPE) < 0.97).astype(int)
    grid[30:34, 20:60] = 0
    df = spark.createDataFrame([(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(grid)], "row int, col int, value int")
    return grid, df.persist()


def grid_of(df, shape=SHAPE):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"] if "value" in r.asDict() else 1
    return out


def square(grid, r, f, outside=0):
    padded = np.pad(grid, r, constant_values=outside)
    return f(np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1)), axis=(2, 3))


@pytest.mark.parametrize("r", [1, 4, 30])
def test_morphology_at_any_radius(spark, mask, r, monkeypatch):
    monkeypatch.setattr(focal, "TILE", 32)
    grid, df = mask
    eroded = square(grid, r, np.min)
    assert (grid_of(focal.erode(df, SHAPE, r)) == eroded).all()
    assert (grid_of(focal.dilate(df, SHAPE, r)) == square(grid, r, np.max)).all()
    assert (grid_of(focal.opening(df, SHAPE, r)) == square(eroded, r, np.max)).all()
    thin = grid & ~square(eroded, r, np.max)
    assert ((~np.isnan(grid_of(focal.thin_features(df, SHAPE, 2 * r)))) == (thin == 1)).all()


@pytest.mark.parametrize("r", [1, 2, 7, 30])
def test_disks_at_any_radius(spark, r, monkeypatch):
    monkeypatch.setattr(focal, "TILE", 32)
    rng = np.random.default_rng(r)
    set_ = {(int(a), int(b)) for a, b in zip(rng.integers(0, SHAPE[0], 12), rng.integers(0, SHAPE[1], 12), strict=True)}
    df = spark.createDataFrame([(a, b, 1) for a, b in set_], "row int, col int, value int")
    got = ~np.isnan(grid_of(focal.dilate_disk(df, SHAPE, r)))
    rows, cols = np.indices(SHAPE)
    want = np.any([(rows - a) ** 2 + (cols - b) ** 2 <= r * r for a, b in set_], axis=0)
    assert (got == want).all()
    land = want.astype(float) * 5 - 1
    cells = spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in np.ndenumerate(land)], "row int, col int, value double")
    ring = ~np.isnan(grid_of(focal.shoreline(cells, SHAPE, 2)))
    near = np.zeros(SHAPE, bool)
    for dr, dc in [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]:
        for a, b in zip(*np.nonzero(want), strict=True):
            if 0 <= a + dr < SHAPE[0] and 0 <= b + dc < SHAPE[1]:
                near[a + dr, b + dc] = True
    assert (ring == (near & ~want)).all()
    assert np.allclose(grid_of(focal.carve_shoreline(cells, SHAPE, 2)), land - ring * (land.max() - land.min()) * 0.01)


def test_edge_map_on_small_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    g = rng.random(SHAPE)
    df = spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in np.ndenumerate(g)], "row int, col int, value double")
    whole = grid_of(terrain.edge_map(df, SHAPE))
    monkeypatch.setattr(focal, "TILE", 16)
    assert np.allclose(grid_of(terrain.edge_map(df, SHAPE)), whole)


def test_medians_in_slices(monkeypatch):
    g = np.random.default_rng(1).random((40, 30))
    whole = focal.medians(g, 5)
    monkeypatch.setattr(focal, "MEDIAN_CELLS", 26 * 25)
    assert (focal.medians(g, 5) == whole).all()


def waves(spark, dr, dc, shape=(160, 128)):
    r, c = F.floor(F.col("id") / shape[1]).cast("int"), (F.col("id") % shape[1]).cast("int")
    base = spark.range(shape[0] * shape[1]).select(r.alias("row"), c.alias("col"))
    at = lambda i, j: F.sin(i / 23.0) * 3 + F.cos(i / 7.0 + j / 5.0) * 2 + F.sin(j / 17.0)
    a = base.select("row", "col", at(F.col("row"), F.col("col")).alias("value"))
    return a, base.select("row", "col", at(F.col("row") - dr, F.col("col") - dc).alias("value")), shape


def test_a_far_shift_is_found(spark):
    a, b, shape = waves(spark, 40, -21)
    got = terrain.best_shift(a, b, shape, 48).first()
    assert (got["dr"], got["dc"]) == (40, -21) and got["ncc"] > 0.999


@pytest.mark.parametrize("shift", [(0, 0), (3, -2), (-1, 3)])
def test_near_shifts_equal_the_full_search(spark, shift):
    a, b, shape = waves(spark, *shift, shape=(60, 50))
    full = max(terrain.shift_scores(a, b, focal.square(3)).collect(), key=lambda r: r["ncc"])
    got = terrain.best_shift(a, b, shape, 3).first()
    assert (got["dr"], got["dc"]) == (full["dr"], full["dc"]) == shift


def test_heights_without_a_tag(spark):
    df = spark.createDataFrame([("7.5 m", None), (None, "4"), (None, None), (None, "x"), ("x", None), ("900", None)], "t string, n string")
    assert [r[0] for r in df.select(vector.fill_height(F.col("t"), F.col("n"))).collect()] == [7.5, 16.0, 12.0, 12.0, 12.0, 300.0]
    assert df.select(vector.fill_height(F.col("t"), F.col("n"), "towers")).collect()[2][0] == 20.0


def test_bright_lines_need_a_hundred_cells(spark):
    from gridspark.operators import segment


    px = spark.range(120 * 80).select(F.floor(F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    px = px.select("row", "col", *(F.when(F.abs(F.col("col") - 40) <= 1, 1.0).otherwise(F.when((F.abs(F.col("row") - 10) <= 1) & (F.col("col") < 20), 1.0).otherwise(0.2)).alias(b) for b in "rgb"))
    cells = segment.bright_lines(px, (120, 80))
    assert {r["col"] for r in cells.collect()} <= {38, 39, 40, 41, 42} and cells.count() >= 300




def test_shift_scores_send_a_cell_once(spark, monkeypatch):
    """Scores on tiles with gaps equal plain ones, and what is exchanged doesn't grow with the number of shifts."""
    rng = np.random.default_rng(8)
    grids = [np.where(rng.random(SHAPE) < 0.8, rng.random(SHAPE) + 50, np.nan) for _ in "ab"]
    a, b = (spark.createDataFrame([(int(r), int(c) - 1, float(v)) for (r, c), v in np.ndenumerate(g) if not np.isnan(v)], "row int, col int, value double") for g in grids)
    monkeypatch.setattr(focal, "TILE", 16)
    shifts = [(-3, 0), (0, 0), (5, 2), (20, -33), (500, 0)]
    got = {(r["dr"], r["dc"]): (r["n"], r["ncc"]) for r in terrain.shift_scores(a, b, shifts).collect()}
    assert set(got) == set(shifts[:-1])
    for dr, dc in shifts[:-1]:
        x = np.full(SHAPE, np.nan)
        x[max(dr, 0) : SHAPE[0] + min(dr, 0), max(dc, 0) : SHAPE[1] + min(dc, 0)] = grids[0][max(-dr, 0) : SHAPE[0] + min(-dr, 0), max(-dc, 0) : SHAPE[1] + min(-dc, 0)]
        both = ~np.isnan(x) & ~np.isnan(grids[1])
        assert got[dr, dc][0] == both.sum() and np.isclose(got[dr, dc][1], np.corrcoef(x[both], grids[1][both])[0, 1])
    flat = a.withColumn("value", F.lit(0.1))
    assert {r["ncc"] for r in terrain.shift_scores(flat, b, shifts).collect()} == {0.0}
    monkeypatch.setattr(focal, "TILE", 256)
    sent = []
    shown = components.saved
    monkeypatch.setattr(components, "saved", lambda df: sent.append(df._jdf.queryExecution().optimizedPlan().toString()) or shown(df))
    terrain.shift_scores(a, b, focal.square(10))
    assert len(sent) == 1 and "FlatMapGroupsInArrow" in sent[0] and "inline" not in sent[0] and "Join" not in sent[0]


def test_a_wide_kernel_is_one_product():
    rng = np.random.default_rng(8)
    w = np.array(focal.gaussian_weights(5.0))
    for rows in (len(w), 60, 300):
        g = rng.random((rows, 30))
        n = rows - len(w) + 1
        taps = sum(x * g[k : k + n] for k, x in enumerate(w))
        assert np.allclose(focal.along(g, w), taps, rtol=0, atol=1e-13)
        g[n // 2, 3] = np.nan
        assert (np.isnan(focal.along(g, w)) == np.isnan(sum(x * g[k : k + n] for k, x in enumerate(w)))).all()


def test_values_above_their_smoothing_need_no_join(spark):
    rng = np.random.default_rng(9)
    grid = rng.random(SHAPE)
    df = spark.createDataFrame([(7, int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(grid)], "k int, row int, col int, value double")
    got = focal.above_smooth(df, SHAPE, 6.0, by=("k",))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(grid_of(got), np.maximum(grid - grid_of(focal.smooth(df, SHAPE, 6.0, by=("k",))), 0), rtol=0, atol=1e-12)
