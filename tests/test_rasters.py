"""Rasters tile by tile against array kernels of the whole."""

import math

import numpy as np
import pytest

from quillmap.operators import rasters, terrain


def table(spark, grid):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(grid) if v], "i int, j int, v double")


def grid_of(df, res, column="v"):
    out = np.full((res, res), np.nan)
    for r in df.collect():
        assert math.isnan(out[r["i"], r["j"]])
        out[r["i"], r["j"]] = r[column]
    return out


@pytest.mark.parametrize("res,tile,sigma", [(40, 8, 0.7), (40, 16, 3.0), (37, 10, 1.6), (12, 5, 4.0)])
def test_blur_by_tiles_equals_the_whole(spark, res, tile, sigma):
    grid = np.random.default_rng(1).random((res, res)) * (np.random.default_rng(2).random((res, res)) < 0.2)
    grid[:, -3:] = 0
    got = grid_of(rasters.blurred(table(spark, grid), res, sigma, tile), res)
    n = max(1, int(4 * sigma + 0.5))
    if n <= res:
        assert np.allclose(got, terrain.blur(grid, sigma), atol=1e-12)
    assert not np.isnan(got).any() and abs(got.sum() - grid.sum()) < 1e-9


def test_slide_by_tiles_equals_the_whole(spark):
    grid = np.random.default_rng(3).random((50, 50)) * 40
    grid[20:24, 20:24] += 200
    got = grid_of(rasters.avalanche(table(spark, grid), 50, 3.0, tile=9), 50)
    assert np.allclose(got, terrain.avalanche(grid, 3.0), atol=1e-9)
    assert np.allclose(grid_of(rasters.avalanche(table(spark, grid), 50, 3.0, passes=2, tile=9), 50), terrain.avalanche(grid, 3.0, 2), atol=1e-9)


def test_density_and_heights_equal_array_kernels(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(float(x), float(y)) for x, y in np.concatenate((rng.normal(3000, 800, (500, 2)), rng.uniform(-9000, 9000, (200, 2)), [[9000, 9000], [9001, 0]]))], "x double, y double")
    counts = terrain.histogram(points, 64)
    assert np.array_equal(np.nan_to_num(grid_of(rasters.counted(points, 64), 64)), counts)
    assert np.allclose(grid_of(rasters.density(points, 64, tile=20), 64), terrain.density(counts), atol=1e-12)
    want, books, env = terrain.heightmap(points, 64)
    rows = rasters.heights(points, 64, tile=24).cache()
    for column, plain in (("height", want), ("density", books), ("envelope", env)):
        assert np.allclose(grid_of(rows, 64, column), plain, atol=1e-9)
    assert np.allclose(grid_of(rasters.heights(None, 32, spark=spark, tile=10), 32, "height"), terrain.heightmap(None, 32)[0])


def test_empty_rasters_are_zero(spark):
    none = spark.createDataFrame([], "x double, y double")
    assert np.array_equal(grid_of(rasters.density(none, 12, tile=5), 12), np.zeros((12, 12)))


def test_tiles_know_their_sides(spark):
    none = spark.createDataFrame([], "i int, j int, v double")
    got = grid_of(rasters.tiled(none, 7, 1, lambda g, own: np.full_like(g, sum(k << b for b, k in enumerate(own))), 3), 7)
    side = lambda t: (t // 3 == 0) | (t // 3 == 1) << 1 | (t // 3 == 2) << 1  # noqa: E731 - the halo of the middle tile ends at the rim
    assert all(got[i, j] == side(i) | side(j) << 2 for i in range(7) for j in range(7))
