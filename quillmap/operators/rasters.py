"""Rasters as tables of cells: stencils tile by tile, density, the sand slide and the height field as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import terrain
from .quantiles import quantiles
from .terrain import WORLD, Ground

#: Cells a side of a tile; a task holds one, and the halo around it.
TILE = 256
Kernel = Callable[[np.ndarray, tuple[bool, bool, bool, bool]], np.ndarray]


def counted(points: DataFrame, res: int, world: float = WORLD) -> DataFrame:
    """(i, j, v) of the cells of a raster of res x res that hold points(x, y): how many; i along y, the last edges closed."""
    bin_of = lambda c: F.least(F.floor((F.col(c) + world / 2) / world * res), F.lit(res - 1)).cast("int")
    inside = points.where((F.abs("x") <= world / 2) & (F.abs("y") <= world / 2))
    return inside.groupBy(bin_of("y").alias("i"), bin_of("x").alias("j")).agg(F.count("*").cast("double").alias("v"))


def tiled(raster: DataFrame, res: int, halo: int, kernel: Kernel, tile: int = TILE) -> DataFrame:
    """(i, j, v) of every cell of a raster(i, j, v) of res x res after a kernel that looks at most `halo` cells far; missing cells are 0.

    A cell goes to its tile and to those whose halo it lies in, one shuffle for any
    number of passes. A task puts a tile and its halo together as an array, and the
    kernel gets it with four flags, which of its sides (low i, high i, low j, high j)
    are the raster's own; what it makes of the halo is left out. Tiles without a cell are
    made too.
    """
    count, spark = -(-res // tile), raster.sparkSession
    meets = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + halo) / tile), F.lit(count - 1)).cast("int"))
    cells = raster.withColumn("ti", F.explode(meets("i"))).withColumn("tj", F.explode(meets("j"))).select("ti", "tj", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    none = lambda t: F.lit(None).cast(t)
    every = spark.range(count * count).select(F.floor(F.col("id") / count).cast("int"), (F.col("id") % count).cast("int"), none("int"), none("int"), none("double"))
    rows = cells.union(every).repartition("ti", "tj").sortWithinPartitions("ti", "tj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def close() -> pa.RecordBatch:
            (ti, tj), sides = here, []
            for t in (ti, tj):
                low, high = t * tile, min((t + 1) * tile, res)
                sides.append((max(low - halo, 0), low, high, min(high + halo, res)))
            (a0, a1, a2, a3), (b0, b1, b2, b3) = sides
            grid = np.zeros((a3 - a0, b3 - b0))
            for i, j, v in held:
                grid[i - a0, j - b0] = v
            out = kernel(grid, (a0 == 0, a3 == res, b0 == 0, b3 == res))[a1 - a0 : a2 - a0, b1 - b0 : b2 - b0]
            i, j = np.mgrid[a1:a2, b1:b2]
            return pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(out.ravel())], ["i", "j", "v"])

        for batch in batches:
            ti, tj = batch.column("ti").to_numpy(), batch.column("tj").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(ti) != 0) | (np.diff(tj) != 0)) + 1).tolist(), len(ti)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if (ti[a], tj[a]) != here:
                    if here is not None:
                        yield close()
                    here, held = (int(ti[a]), int(tj[a])), []
                part = batch.slice(a, b - a).drop_null()
                held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "v")))
        if here is not None:
            yield close()

    return rows.mapInArrow(run, "i int, j int, v double")


def blur_kernel(sigma: float) -> tuple[Kernel, int]:
    """A separable Gaussian cut at four sigma, the raster's own sides mirrored, and how far it looks."""
    n = max(1, int(4 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-n, n + 1) / max(sigma, 1e-9)) ** 2)
    weights /= weights.sum()

    def run(grid: np.ndarray, own: tuple[bool, bool, bool, bool]) -> np.ndarray:
        for axis in (0, 1):
            length = grid.shape[axis]
            at = np.arange(-n, length + n)
            turn = at % (2 * length)
            # A side that isn't the raster's own lies in the halo; what is put beyond it does not count.
            padded = np.take(grid, np.where(turn < length, turn, 2 * length - 1 - turn), axis)
            grid = sum(w * np.take(padded, np.arange(k, k + length), axis) for k, w in enumerate(weights))
        return grid

    return run, n


def blurred(raster: DataFrame, res: int, sigma: float, tile: int = TILE) -> DataFrame:
    """(i, j, v): the raster under a Gaussian of `sigma` cells. Where the kernel is wider than the raster, one tile holds all of it."""
    kernel, reach = blur_kernel(sigma)
    return tiled(raster, res, reach, kernel, tile if reach < res else res)


def density(points: DataFrame, res: int, world: float = WORLD, first: float = 220.0, second: float = 400.0, tile: int = TILE) -> DataFrame:
    """(i, j, v): blurred counts over their 98th percentile, which is exact over all cells, clipped to [0, 1], blurred again; all 0 if that percentile is."""
    texel = world / res
    smooth = stored(blurred(counted(points, res, world), res, first / texel, tile), "density")
    top = quantiles(smooth, F.col("v"), {"top": 0.98})
    share = F.when(F.col("top") > 0, F.least(F.greatest(F.col("v") / F.col("top"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    clipped = smooth.join(F.broadcast(top)).select("i", "j", share.alias("v"))  # top: one row
    return blurred(clipped.where("v <> 0"), res, second / texel, tile)


def avalanche(raster: DataFrame, res: int, texel: float, passes: int = 18, degrees: float = 33.0, relax: float = 0.5, tile: int = TILE) -> DataFrame:
    """(i, j, v): slopes over the angle of repose flow to the lower neighbour, along each axis in turn; a cell's height after p passes depends on cells p + 1 away at most."""
    return tiled(raster, res, passes + 1, lambda grid, own: terrain.avalanche(grid, texel, passes, degrees, relax), tile)


def heights(points: DataFrame | None, res: int, world: float = WORLD, ground: Ground = Ground(), spark: SparkSession | None = None, tile: int = TILE) -> DataFrame:
    """(i, j, height, density, envelope) of the world square: hill, settled dunes under the envelope, swell and ripples; no points, no density.

    The pointwise terms come from tasks over ranges of cells, density and slide tile by
    tile, and the three meet by an equi-join on the cell.
    """
    spark = points.sparkSession if points is not None else spark or SparkSession.active()
    rows = stored(terrain.field_rows(spark, res, world, ground=ground), "field")
    dunes = avalanche(rows.select("i", "j", F.col("dunes").alias("v")), res, world / res, tile=tile).withColumnRenamed("v", "settled")
    every = rows.select("i", "j", "r", "rest").join(dunes, ["i", "j"])
    if points is not None:
        every = every.join(density(points, res, world, tile=tile).withColumnRenamed("v", "density"), ["i", "j"])
    else:
        every = every.withColumn("density", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, rest, settled, books = (batch.column(c).to_numpy() for c in ("r", "rest", "settled", "density"))
            env = ground.envelope(r, books)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(rest + env * settled), batch.column("density"), pa.array(env)], ["i", "j", "height", "density", "envelope"])

    return every.select("i", "j", "r", "rest", "settled", "density").mapInArrow(run, "i int, j int, height double, density double, envelope double")
