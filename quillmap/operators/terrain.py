"""Height fields: density in Spark, smoothing and slopes as array kernels of one raster."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORLD = 18_000.0


def histogram(points: DataFrame, res: int, world: float = WORLD) -> np.ndarray:
    """Counts of points(x, y) by cell, the last edges closed; counted in Spark, one number a cell comes back."""
    bin_of = lambda c: F.least(F.floor((F.col(c) + world / 2) / world * res), F.lit(res - 1)).cast("int")
    inside = points.where((F.abs("x") <= world / 2) & (F.abs("y") <= world / 2))
    out = np.zeros((res, res))
    for r in inside.groupBy(bin_of("y").alias("i"), bin_of("x").alias("j")).agg(F.count("*").alias("n")).toLocalIterator():
        out[r["i"], r["j"]] = r["n"]
    return out


def blur(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, edges mirrored, cut at four sigma."""
    n = max(1, int(4 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / max(sigma, 1e-9)) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(grid, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        grid = sum(k * np.take(padded, range(i, i + grid.shape[axis]), axis) for i, k in enumerate(w))
    return grid


def density(counts: np.ndarray, world: float = WORLD, first: float = 220.0, second: float = 400.0) -> np.ndarray:
    """Blurred counts over their 98th percentile, clipped to [0, 1], blurred again; all 0 if that percentile is."""
    texel = world / len(counts)
    d = blur(counts, first / texel)
    top = np.percentile(d, 98)
    return blur(np.clip(d / top, 0, 1), second / texel) if top > 0 else np.zeros_like(d)


def avalanche(grid: np.ndarray, texel: float, passes: int = 18, degrees: float = 33.0, relax: float = 0.5) -> np.ndarray:
    """Slopes over the angle of repose flow to the lower neighbour, along each axis in turn; the sum stays."""
    most = math.tan(math.radians(degrees)) * texel
    grid = grid.copy()
    for _ in range(passes):
        for axis in (0, 1):
            step = np.diff(grid, axis=axis)
            flow = np.sign(step) * np.maximum(np.abs(step) - most, 0) * relax / 2
            lead = [(0, 1) if a == axis else (0, 0) for a in (0, 1)]
            back = [(1, 0) if a == axis else (0, 0) for a in (0, 1)]
            grid += np.pad(flow, lead) - np.pad(flow, back)
    return grid


#: The generator and seed that shuffle the 256 lattice places, and the gradients by the low three bits.
SHUFFLE_SEED, SHUFFLE_TIMES, SHUFFLE_PLUS = 0x9E3779B1, 1664525, 1013904223
GRADIENTS = np.array([(1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1)], float)


def lattice() -> np.ndarray:
    """The shuffled lattice places, twice over."""
    places, state = np.arange(256), SHUFFLE_SEED
    for last in range(255, 0, -1):
        state = (state * SHUFFLE_TIMES + SHUFFLE_PLUS) % (1 << 32)
        pick = state % (last + 1)
        places[[last, pick]] = places[[pick, last]]
    return np.tile(places, 2)


LATTICE = lattice()


def ease(t: np.ndarray) -> np.ndarray:
    t = np.clip(t, 0.0, 1.0)
    return t**3 * (t * (6 * t - 15) + 10)


def gradient_noise(x: np.ndarray, y: np.ndarray, period: int | None = None) -> np.ndarray:
    """Gradient noise in about [-1, 1]; with a period, the same after so many units of x."""
    i, j = np.floor(x), np.floor(y)
    fx, fy = x - i, y - j
    row = j.astype(np.int64) & 255
    out = np.zeros(np.broadcast(x, y).shape)
    for di, wx in ((0, 1 - ease(fx)), (1, ease(fx))):
        column = (np.mod(i + di, period) if period else i + di).astype(np.int64) & 255
        if not period:  # the place after the last column of the table is read from its second copy
            column = (i.astype(np.int64) & 255) + di
        for dj, wy in ((0, 1 - ease(fy)), (1, ease(fy))):
            g = GRADIENTS[LATTICE[LATTICE[column] + row + dj] & 7]
            out = out + wx * wy * (g[..., 0] * (fx - di) + g[..., 1] * (fy - dj))
    return out


def octaves(x: np.ndarray, y: np.ndarray, period: int | None = None, n: int = 3) -> np.ndarray:
    """Noise of doubling frequencies (and periods) and halving heights, over the sum of the heights."""
    parts = [gradient_noise(x * 2**k, y * 2**k, period * 2**k if period else None) / 2**k for k in range(n)]
    return sum(parts) / sum(0.5**k for k in range(n))


@dataclass(frozen=True)
class Ground:
    """The knobs of the height field; the defaults are fixed values, in world units and radians."""

    peak: float = 60.0
    plateau: float = 700.0
    base: float = 5200.0
    crater: float = 18.0
    crater_edge: float = 1400.0
    dunes: float = 70.0
    dune_space: float = 300.0
    dune_aspect: float = 4.5
    twist: float = 0.6
    arms: int = 6
    harmonics: int = 6
    swell: float = 60.0
    swell_arms: int = 3
    swell_full: float = 1400.0
    swell_wobble: float = 0.5
    swell_wobble_scale: float = 2600.0
    swell_fade: tuple[float, float] = (2400.0, 5200.0)
    ripple: float = 0.0
    ripple_scale: float = 110.0
    ripple_fade: tuple[float, float] = (480.0, 660.0)
    centre_calm: float = 1.0
    centre_edge: tuple[float, float] = (220.0, 1400.0)
    book_calm: float = 0.85

    def hill(self, r: np.ndarray) -> np.ndarray:
        """A broad rise with a shallow crater in its middle."""
        return self.peak * (1 - ease((r - self.plateau) / (self.base - self.plateau))) - self.crater * (1 - ease(r / self.crater_edge))

    def wound(self, x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Angles, turned the more the farther out: what lies on a spiral shares one."""
        return np.arctan2(z, x) - self.twist * np.log(np.maximum(r, 1.0) / self.plateau)

    def spiral_dunes(self, x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Ridges along spirals, whose number doubles outward so that their spacing stays.

        A harmonic of k ridges has its home where the circle holds k spacings and fades
        out over one doubling either way; the weights of neighbours add up to one.
        """
        if not self.dunes:
            return np.zeros_like(r)
        depth, turns = np.log(np.maximum(r, 1.0)), self.wound(x, z, r) / (2 * np.pi)
        total, weights = np.zeros_like(r), np.zeros_like(r)
        for k in (self.arms * 2**n for n in range(self.harmonics)):
            away = (depth - np.log(k * self.dune_space / (2 * np.pi))) / np.log(2)
            w = np.where(np.abs(away) < 1, (1 + np.cos(np.pi * away)) / 2, 0.0)
            total += w * (1 - np.abs(octaves(k * turns, k * depth / (2 * np.pi * self.dune_aspect), k))) ** 2
            weights += w
        return self.dunes * np.where(weights > 1e-6, total / np.maximum(weights, 1e-6), total)

    def spiral_swell(self, x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
        """A few broad arms that wind with the dunes, peaks and gaps alike, between the plateau and the outer fade."""
        band = ease((r - self.plateau) / (self.swell_full - self.plateau)) * (1 - ease((r - self.swell_fade[0]) / (self.swell_fade[1] - self.swell_fade[0])))
        phase = self.swell_wobble * gradient_noise(x / self.swell_wobble_scale, z / self.swell_wobble_scale)
        return self.swell * band * np.cos(self.swell_arms * self.wound(x, z, r) + phase)

    def ripples(self, x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
        if not self.ripple:
            return np.zeros_like(r)
        n = (gradient_noise(x / self.ripple_scale, z / self.ripple_scale) + gradient_noise(2 * x / self.ripple_scale, 2 * z / self.ripple_scale) / 2) / 1.5
        return self.ripple * n * (1 - ease((r - self.ripple_fade[0]) / (self.ripple_fade[1] - self.ripple_fade[0])))

    def envelope(self, r: np.ndarray, books: np.ndarray) -> np.ndarray:
        """How high dunes stand, in [0, 1]: the calmer of the centre and of the books' density."""
        centre = self.centre_calm * (1 - ease((r - self.centre_edge[0]) / (self.centre_edge[1] - self.centre_edge[0])))
        return 1 - np.clip(np.maximum(centre, self.book_calm * books), 0, 1)

    def smear(self, x: np.ndarray, z: np.ndarray, scale: float = 760.0) -> np.ndarray:
        """Two octaves of noise by which the bands of eras wander."""
        return gradient_noise(x / scale, z / scale) + gradient_noise(x / (0.4 * scale), z / (0.4 * scale)) / 2


def _axes(k: np.ndarray, res: int, world: float, middle: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """(row, column, x, z, r) of the cells of those numbers; rows go along z, points are the cells' centres."""
    i, j = k // res, k % res
    z, x = ((a + 0.5) / res * world - world / 2 + m for a, m in ((i, middle[1]), (j, middle[0])))
    return i, j, x, z, np.hypot(x, z)


def field_rows(spark: SparkSession, res: int, world: float = WORLD, middle: tuple[float, float] = (0.0, 0.0), ground: Ground = Ground(), parts: int = 8) -> DataFrame:
    """(i, j, r, dunes, rest): what of the height field is pointwise, in any number of tasks; rest is hill, swell and ripples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, x, z, r = _axes(batch.column("id").to_numpy(), res, world, middle)
            rest = ground.hill(r) + ground.spiral_swell(x, z, r) + ground.ripples(x, z, r)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r), pa.array(ground.spiral_dunes(x, z, r)), pa.array(rest)], ["i", "j", "r", "dunes", "rest"])

    return spark.range(0, res * res, numPartitions=parts).mapInArrow(run, "i int, j int, r double, dunes double, rest double")


def _grid(rows: DataFrame, column: str, res: int) -> np.ndarray:
    part = rows.select("i", "j", column).toPandas()
    out = np.empty((res, res))
    out[part.i, part.j] = part[column]
    return out


def heightmap(points: DataFrame | None, res: int, world: float = WORLD, ground: Ground = Ground()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(heights, density, envelope) of the world square: hill, settled dunes under the envelope, swell and ripples.

    The pointwise part runs in tasks; the sand slide passes over one raster of res x res,
    whose size is the caller's, so it runs as an array kernel. No points, no density.
    """
    spark = points.sparkSession if points is not None else SparkSession.active()
    rows = field_rows(spark, res, world, ground=ground)
    books = density(histogram(points, res, world), world) if points is not None else np.zeros((res, res))
    env = ground.envelope(_grid(rows, "r", res), books)
    return _grid(rows, "rest", res) + env * avalanche(_grid(rows, "dunes", res), world / res), books, env


def window(spark: SparkSession, x: float, z: float, size: float, res: int, ground: Ground = Ground()) -> np.ndarray:
    """The field of a small square at full dune height, for a close look."""
    rows = field_rows(spark, res, size, (x, z), ground)
    return _grid(rows, "rest", res) + avalanche(_grid(rows, "dunes", res), size / res)


def normals(grid: np.ndarray, texel: float, reach: int = 1) -> np.ndarray:
    """Unit normals (x, up, z) of the inner cells, from heights `reach` cells to either side."""
    inner, n = slice(reach, -reach), len(grid)
    hx = grid[inner, 2 * reach : n] - grid[inner, : n - 2 * reach]
    hz = grid[2 * reach : n, inner] - grid[: n - 2 * reach, inner]
    out = np.stack([-hx, np.full_like(hx, 2 * reach * texel), -hz], -1)
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


#: The multipliers of the lattice hash.
VERTEX_HASH = (374761393, 668265263, 1274126177)


def lattice_hash(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A hash of two integers in [0, 1), by products of 32 bits."""
    low = np.uint64(0xFFFFFFFF)
    a, b = (np.asarray(v, np.int64).astype(np.uint64) & low for v in (i, j))
    h = (a * np.uint64(VERTEX_HASH[0]) + b * np.uint64(VERTEX_HASH[1])) & low
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(VERTEX_HASH[2])) & low
    return (h ^ (h >> np.uint64(16))) / 2.0**32


def jittered(i: np.ndarray, j: np.ndarray, cell: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """World (x, z) of lattice corners, moved within a disc of `share` of a cell by a fixed hash."""
    away, turn = share * cell * np.sqrt(lattice_hash(i, j)), 2 * np.pi * lattice_hash(np.asarray(i) + 7919, np.asarray(j) + 104729)
    return np.asarray(i) * cell + away * np.cos(turn), np.asarray(j) * cell + away * np.sin(turn)


def grid_mesh(grid: np.ndarray, world: float, stride: int = 1, clip_radius: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a grid; cells whose centre lies outside the disc are left out."""
    rows = np.arange(0, len(grid), stride)
    at = (rows + 0.5) / len(grid) * world - world / 2
    x, z = np.meshgrid(at, at)
    vertices = np.stack([x.ravel(), grid[np.ix_(rows, rows)].ravel(), z.ravel()], 1)
    n = len(rows)
    a = (np.arange(n - 1)[:, None] * n + np.arange(n - 1)).ravel()
    if clip_radius is not None:
        half = stride / 2 / len(grid) * world
        a = a[np.hypot(vertices[a, 0] + half, vertices[a, 2] + half) <= clip_radius]
    return vertices, np.concatenate([np.stack([a, a + n, a + 1], 1), np.stack([a + 1, a + n, a + n + 1], 1)])


def soup(vertices: np.ndarray, faces: np.ndarray) -> np.ndarray:
    return vertices[faces].reshape(-1, 3)
